"""Benchmark decontamination: item-sized windows by SimHash, multi-index blocks, exact check.

DataFrame functions only. A window of a document is as long as the benchmark item it is compared
with, and both are bags of five-word shingles weighted by how often they occur. A similarity of at
least ``threshold`` (weighted Jaccard: sum of minima over sum of maxima) means that many of the
window's shingles occur in the item, so:

1. a document and an item go on if the document has that many positions with shingles of the item,
   and its windows go on that hold that many (no window over the threshold is lost by this);
2. the windows and the items get SimHash fingerprints, cut into ``max_distance + 1`` blocks; a
   window meets its item in the table of blocks if one block is equal, which all fingerprints
   within ``max_distance`` bits of each other fulfil, and the complete distance is checked;
3. the weighted similarity of the survivors is computed exactly.

Two bags that similar differ in about 10 of 64 bits (standard deviation 3); the distance of 23 leaves
out less than one in 10,000 windows that lie right at the threshold.

Words are runs of letters and digits in lower case. Defined cases: texts without a word are no
window and no item; an item of fewer than five words is one shingle, and is found in documents of as
few words only; a document shorter than the item is one window. Null texts have no words. Rows with
null ids take part. Repeated rows give their pair once. Of a document's windows the most similar,
then the first, is reported. Empty tables give no rows. Texts are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiltml.llm.common import load, materialize

SHINGLE = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column) -> Column:
    """Hashes of the five-word shingles, in order; of fewer words, one of them all; of none, none."""
    n = F.size(words)
    full = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, full).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def with_shingles(rows: DataFrame, out: str) -> DataFrame:
    """``rows`` with the shingles of ``text`` in place of it. The words are bound as a lambda's
    variable: whatever the optimizer moves or repeats, a text is split once, not once a shingle."""
    return rows.withColumn(out, F.get(F.transform(F.array(words_of(F.col("text"))), shingles_of), 0)).drop("text")


def simhash(shingles: Column) -> Column:
    """64-bit fingerprint of a bag: the bits set in over half of it, repeats included."""
    zero = F.array_repeat(F.lit(0), 64)
    bits = F.sequence(F.lit(0), F.lit(63))
    counts = F.aggregate(shingles, zero, lambda acc, x: F.zip_with(acc, bits, lambda a, b: a + F.getbit(x, b).cast("int")))
    return F.aggregate(F.zip_with(counts, bits, lambda c, b: F.when(2 * c > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
                       F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def blocks_of(fp: Column, blocks: int) -> Column:
    """array<struct(block, value)>: the fingerprint cut into blocks of nearly equal width."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = lambda a, b: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(i).alias("block"), part(a, b).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def _need(window: Column, item: Column, threshold: float) -> Column:
    """Common shingles that a similarity of the threshold takes."""
    return F.ceil(F.lit(threshold) * (window + item) / F.lit(1 + threshold) - F.lit(1e-9))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, max_distance: int = 23) -> DataFrame:
    """doc_id, text_hash, item_id, start_word, distance, similarity: the best window of each document and
    item that reach the threshold. text_hash (XXH64 of the text) tells rows apart that repeat an id."""
    items = with_shingles(items.select("item_id", F.xxhash64(F.col("text").cast("string")).alias("item"), "text"), "i")
    items = items.where(F.size("i") > 0).dropDuplicates(["item_id", "item"])
    items = materialize(items.withColumns({"size_i": F.size("i"), "fp_i": simhash(F.col("i"))}), "items")
    # Bags with the same words under several ids are compared once.
    bags = items.dropDuplicates(["item"])
    weights = bags.select("item", "size_i", F.explode("i").alias("h")).groupBy("item", "size_i", "h").agg(F.count("*").alias("weight"))
    texts = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), "text")

    # 1. Documents and items with enough common positions.
    places = with_shingles(texts, "d").select("doc_id", "text_hash", F.size("d").alias("size_d"), F.explode_outer("d").alias("h"))
    common = places.join(weights.select("item", "size_i", "h"), "h").groupBy("doc_id", "text_hash", "size_d", "item", "size_i").agg(F.count("*").alias("n"))
    size_w = F.least("size_d", "size_i")
    near = materialize(common.where(F.col("n") >= _need(size_w, F.col("size_i"), threshold)).select("doc_id", "text_hash", "item", "size_i"), "leaks")

    # Their windows with enough common positions.
    who = near.select("doc_id", "text_hash").distinct()
    found = materialize(with_shingles(_semi(texts, who), "d").dropDuplicates(["doc_id", "text_hash"]), "leak-texts")
    pairs = _same(near, found)
    at = pairs.select("doc_id", "text_hash", "item", "size_i", F.posexplode("d").alias("pos", "h")).join(weights.select("item", "h", "weight"), ["item", "h"])
    runs = at.groupBy("doc_id", "text_hash", "item").agg(F.sort_array(F.collect_list("pos")).alias("p"))  # at most a document's length
    windows = _same(pairs, runs, ["doc_id", "text_hash", "item"])
    n, size_w = F.size("d"), F.least(F.size("d"), F.col("size_i"))
    need = _need(size_w, F.col("size_i"), threshold).cast("int")
    windows = windows.withColumns({"w": size_w, "need": need, "last": n - size_w})

    def starts(i):
        low = F.greatest(F.get("p", i + F.col("need") - 1) - F.col("w") + 1, F.lit(0))
        high = F.least(F.get("p", i), F.col("last"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    windows = windows.where(F.size("p") >= F.col("need"))
    windows = windows.withColumn("start", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("p") - F.col("need")), starts)))))
    windows = windows.select("doc_id", "text_hash", "item", "start", F.slice("d", F.col("start") + 1, F.col("w")).alias("bag"))
    windows = materialize(windows.withColumn("fp", simhash(F.col("bag"))), "leak-windows")

    # 2. Fingerprints that share a block with their item's, and lie within the distance.
    blocks = max_distance + 1
    table = bags.select("item", "fp_i", "size_i", F.explode(blocks_of(F.col("fp_i"), blocks)).alias("b")).select("item", "fp_i", "size_i", "b.*")
    probes = windows.select("doc_id", "text_hash", "item", "start", "fp", F.explode(blocks_of(F.col("fp"), blocks)).alias("b")).select("*", "b.*").drop("b")
    close = probes.join(table, ["item", "block", "value"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_i"))))
    close = close.where(F.col("distance") <= max_distance).groupBy("doc_id", "text_hash", "item", "start").agg(F.first("distance").alias("distance"), F.first("size_i").alias("size_i"))

    # 3. Exact weighted similarity.
    bags_of = _same(close, windows.select("doc_id", "text_hash", "item", "start", "bag"), ["doc_id", "text_hash", "item", "start"])
    counted = bags_of.select("doc_id", "text_hash", "item", "start", "distance", "size_i", F.size("bag").alias("w"), F.explode("bag").alias("h"))
    counted = counted.groupBy("doc_id", "text_hash", "item", "start", "distance", "size_i", "w", "h").agg(F.count("*").alias("c"))
    shared = counted.join(weights.select("item", "h", "weight"), ["item", "h"]).groupBy("doc_id", "text_hash", "item", "start", "distance", "size_i", "w").agg(
        F.sum(F.least("c", "weight")).alias("both"))
    scored = shared.withColumn("similarity", F.col("both") / (F.col("w") + F.col("size_i") - F.col("both"))).where(F.col("similarity") >= threshold)
    best = scored.groupBy("doc_id", "text_hash", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "distance")).alias("b"))
    return best.join(items.select("item_id", "item"), "item").select(
        "doc_id", "text_hash", "item_id", (-F.col("b.before")).cast("int").alias("start_word"), F.col("b.distance").alias("distance"), F.col("b.similarity").alias("similarity"))


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...] | list[str] = ("doc_id", "text_hash")) -> DataFrame:
    """Inner join in which null ids are equal; the keys appear once."""
    named = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(named, on).drop(*[f"__{k}" for k in keys])


def _semi(left: DataFrame, right: DataFrame) -> DataFrame:
    named = right.select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash"))
    return left.join(named, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_hash") == F.col("__text_hash")), "left_semi")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("before"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.before")).alias("start_word"), F.col("b.similarity").alias("similarity"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops the documents in which a benchmark item is found."""
    found = materialize(leaks(docs, load(spark, sf_dir, "benchmark")).select("doc_id", "text_hash").distinct(), "leaking")
    named = found.select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash"))
    hit = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__text_hash"))
    return docs.join(named, hit, "left_anti")


OP2_SQL = r"""
WITH d AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (
  SELECT doc_id, greatest(len(w) - 4, 1) AS nd, pos, CASE WHEN len(w) < 5 THEN '-' ELSE '' END || array_to_string(w[pos + 1:pos + 5], ' ') AS h
  FROM d, unnest(range(greatest(len(w) - 4, 1))) AS u(pos) WHERE len(w) > 0),
s AS (
  SELECT item_id, greatest(len(w) - 4, 1) AS ni, CASE WHEN len(w) < 5 THEN '-' ELSE '' END || array_to_string(w[pos + 1:pos + 5], ' ') AS h
  FROM i, unnest(range(greatest(len(w) - 4, 1))) AS u(pos) WHERE len(w) > 0),
si AS (SELECT item_id, ni, h, count(*) AS weight FROM s GROUP BY ALL),
m AS (SELECT doc_id, item_id, pos, h, nd, ni, weight, least(nd, ni) AS nw FROM ds JOIN si USING (h)),
c AS (SELECT doc_id, item_id FROM m GROUP BY doc_id, item_id, nw, ni HAVING count(*) >= 0.8 * (nw + ni) / 1.8 - 1e-9),
p AS (
  SELECT doc_id, item_id, start, h, any_value(weight) AS weight, count(*) AS n, any_value(nw) AS nw, any_value(ni) AS ni
  FROM m JOIN c USING (doc_id, item_id), unnest(range(greatest(pos - nw + 1, 0), least(pos, nd - nw) + 1)) AS u(start)
  GROUP BY doc_id, item_id, start, h),
b AS (SELECT doc_id, item_id, start, sum(least(n, weight)) AS overlap, any_value(nw) AS nw, any_value(ni) AS ni FROM p GROUP BY doc_id, item_id, start),
r AS (SELECT doc_id, item_id, start, overlap::DOUBLE / (nw + ni - overlap)::DOUBLE AS similarity FROM b)
SELECT doc_id, item_id, arg_max(start, (similarity, -start))::INTEGER AS start_word, max(similarity) AS similarity
FROM r WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
