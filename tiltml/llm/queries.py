"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from tiltml.llm.conversation_repair import op11_conversation_repair
from tiltml.llm.decontaminate import OP2_SQL, op2_decontaminate
from tiltml.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from tiltml.llm.kmeans_tree import op13_nearest
from tiltml.llm.language_id import op1_language_id
from tiltml.llm.passages import op9_passages
from tiltml.llm.piece_sampling import op10_piece_sampling
from tiltml.llm.secrets import op8_secret_scan
from tiltml.llm.simhash_dedup import op4_simhash_dedup
from tiltml.llm.token_counts import op6_token_counts
from tiltml.llm.token_files import op5_token_files
from tiltml.llm.top_k import OP3_SQL, op3_top_k
from tiltml.llm.warc_zip import OP7_SQL, op7_warc_zip

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_top_k": op3_top_k,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_token_files": op5_token_files,
    "op6_token_counts": op6_token_counts,
    "op7_warc_zip": op7_warc_zip,
    "op8_secret_scan": op8_secret_scan,
    "op9_passages": op9_passages,
    "op10_piece_sampling": op10_piece_sampling,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_nearest": op13_nearest,
}

ORACLE = {"op2_decontaminate": OP2_SQL, "op3_top_k": OP3_SQL, "op7_warc_zip": OP7_SQL, "op12_hard_negatives": OP12_SQL}
