"""Token counts by dynamic programming that distinct pre-tokens share along a trie.

A pre-token is a run of non-space characters behind a space mark. Its count is the number of
tokens on its best path: the segmentation into pieces with the highest sum of unigram scores, where
equal sums take fewer tokens. The distinct pre-tokens of a batch are visited in the order of
their trie (sorted, so each shares the longest prefix with the one before), with the forward
scores and counts of the current path on a stack: a prefix that several share is computed once.
The counts at the terminals are kept in a bounded table and added up per document, without a shuffle.

Defined cases: null and empty texts have no tokens. Repeated rows are counted alike; an empty table
gives no rows. Texts are counted whole, and so are pre-tokens of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltml.llm.common import load, pieces
from tiltml.llm.piece_vocab import BYTE_SCORE, SPACE, Vocabulary, vocabulary
from tiltml.llm.token_files import public_tokenizer

KEPT = 300_000


def terminal_counts(words: Iterable[str], vocab: Vocabulary) -> dict[str, int]:
    """Tokens on the best path of each distinct word (with the space mark in front)."""
    table = vocab.pieces
    longest = vocab.longest
    out: dict[str, int] = {}
    path = ""
    scores, counts = [0.0], [0]  # of each prefix of the current path, the trie's root first
    for word in sorted(set(words)):
        text = SPACE + word
        shared = 0
        for a, b in zip(path, text, strict=False):
            if a != b:
                break
            shared += 1
        del scores[shared + 1:], counts[shared + 1:]
        for end in range(shared + 1, len(text) + 1):
            best, tokens = float("-inf"), 0
            for start in range(max(0, end - longest), end):
                piece = table.get(text[start:end])
                if piece is not None:
                    score, n = scores[start] + piece[1], counts[start] + 1
                elif start == end - 1:
                    size = len(text[start].encode())
                    score, n = scores[start] + BYTE_SCORE * size, counts[start] + size
                else:
                    continue
                if score > best or score == best and n < tokens:
                    best, tokens = score, n
            scores.append(best)
            counts.append(tokens)
        out[word] = counts[-1]
        path = text
    return out


def count_tokens(docs: DataFrame, model: Callable[[], str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words (pre-tokens), n_tokens of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        vocab, known = vocabulary(model), {}
        for batch in pieces(batches, "text"):
            words = [t.split() for t in batch.column(1).to_pylist()]
            wanted = set().union(*words)
            new = wanted.difference(known)
            if len(known) + len(new) > KEPT:
                known, new = {}, wanted
            known.update(terminal_counts(new, vocab))
            get = known.__getitem__
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(get, w)) for w in words], pa.int64())],
                ["doc_id", "n_words", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))
