"""Training-data pipeline over ``documents``: each stage reads what the one before it wrote.

1. language_id: documents whose language isn't told go (``und``, or a posterior under 0.5).
2. simhash_dedup: of each group of near-duplicates the document with the smallest doc_id stays.
3. decontaminate: documents that hold a benchmark item go.
4. secret_scan: secrets' values are replaced in the text, and n_chars is set anew.
5. piece_sampling: the documents' columns but the text, with sampled SentencePiece ids.

Every stage keeps null and empty texts, extra columns and repeated rows as its operator's docstring
says; an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tiltml.llm.common import load, materialize
from tiltml.llm.decontaminate import decontaminate_stage
from tiltml.llm.language_id import language_stage
from tiltml.llm.piece_sampling import encode_stage
from tiltml.llm.secrets import secret_stage
from tiltml.llm.simhash_dedup import dedup_stage

STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secret_scan", secret_stage),
    ("piece_sampling", encode_stage),
]

# Naive Bayes, Markov models and seeded sampling have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
