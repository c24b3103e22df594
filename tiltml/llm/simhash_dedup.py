"""SimHash near-duplicate detection by multi-index hashing.

A text's fingerprint has the bits that are set in over half of the XXH64 hashes of its word
shingles. Fingerprints within two bits are linked, and links join documents to components.

The search runs over distinct fingerprints, so copies cost nothing. A fingerprint is cut into
segments; it is entered in the table under itself and under every member of the radius-1 Hamming
ball within each segment, the other segments unchanged. Two words within two bits have a
word between them, one bit or less from either, so they meet under it; words that meet are at
most two bits apart, which the complete distance verifies. All words under one key are
therefore linked to each other, and linking each to the smallest loses no component. A key
holds at most 65 distinct words whatever the data, so there is no hot bucket and no pair
expansion (an index on single segments would list all pairs of a large near-copy group).

Defined cases: a null text and a text without words have fingerprint zero and are linked like
any other; a component's id is its smallest non-null doc_id (null if it has none). Repeated rows
stay in the result. An empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiltml.llm.common import load, materialize, pieces
from tiltml.llm.components import connected_components

SEED = 42
SEGMENTS = ((0, 32), (32, 64))
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int = 3) -> list[int]:
    """XXH64 of every shingle, in order: words are lower-cased in A-Z and told apart by ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip(starts, ends[shingle - 1:], strict=False)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    hashes = shingle_hashes(text, shingle)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        h = np.array(hashes[i:i + _CHUNK], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text, tells rows that repeat an id apart), fp."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches):
        for batch in pieces(batches, "text"):
            fp = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())], ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(words: DataFrame, max_distance: int = 2, segments: Sequence[tuple[int, int]] = SEGMENTS) -> DataFrame:
    """(u, v): each distinct fingerprint of ``words(fp)`` with the smallest one under each common key."""
    if max_distance not in (0, 2):
        raise ValueError("max_distance is 0 or 2")
    flips = [_signed(1 << bit) for low, high in segments for bit in range(low, high)] if max_distance else []
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in flips])
    table = words.select("fp", F.explode(ball).alias("key"))
    met = table.withColumn("least", F.min("fp").over(Window.partitionBy("key")))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("least")))
    return met.where((F.col("fp") != F.col("least")) & (distance <= max_distance)).select(F.col("fp").alias("u"), F.col("least").alias("v"))


def near_duplicates(prints: DataFrame, max_distance: int = 2) -> DataFrame:
    """``prints`` (doc_id, fp, more columns) with component_id. ``prints`` is read twice: materialise it."""
    words = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(words.select("fp"), max_distance))
    labelled = words.join(roots, words["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(labelled.join(ids, "root").select("fp", "component_id"), "fp")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(fingerprints(load(spark, sf_dir, "documents")), "fingerprints")
    out = near_duplicates(prints)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component, the row with the smallest doc_id stays (nulls last; of rows
    that repeat it, the one with the smallest fingerprint and text hash; of equal rows, one)."""
    prints = materialize(fingerprints(docs), "fingerprints")
    found = near_duplicates(prints).withColumn("component", F.coalesce("component_id", "fp"))
    best = found.groupBy("component", F.col("component_id").isNull().alias("nameless")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "fp", "text_hash")).alias("best")).select("best.doc_id", "best.text_hash")
    rows = docs.withColumn("__h", F.xxhash64(F.col("text").cast("string")))
    kept = rows.join(best, rows["doc_id"].eqNullSafe(best["doc_id"]) & (rows["__h"] == best["text_hash"]), "left_semi")
    once = Window.partitionBy("doc_id", "__h").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(*[f"`{c}`" for c in docs.columns])
