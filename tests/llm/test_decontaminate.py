import re
from collections import Counter

from tests_llm_helpers import rows_of
from tiltml.llm import decontaminate as D
from tiltml.llm.queries import QUERIES


def shingles(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return [tuple(words[i:i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [("short", *words)] * bool(words)


def brute_force(docs, items, threshold=0.8):
    """Every item-sized window of every document against every item."""
    out = {}
    for item_id, text in set(items):
        item = shingles(text)
        for doc_id, body in set(docs):
            found = shingles(body)
            size = min(len(item), len(found))
            for s in range(len(found) - size + 1) if size else ():
                a, b = Counter(found[s:s + size]), Counter(item)
                similarity = sum((a & b).values()) / sum((a | b).values())
                if similarity >= threshold:
                    best = out.get((doc_id, item_id), (0, 0))
                    out[doc_id, item_id] = max(best, (similarity, -s))
    return {(*k, -s, round(v, 9)) for k, (v, s) in out.items()}


def test_equals_brute_force(spark, tables):
    docs = [r[:2] for r in rows_of(spark, tables) if len(r[1] or "") < 60_000]
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id, r.start_word, round(r.similarity, 9)) for r in QUERIES["op2_decontaminate"](spark, tables).collect()}
    assert got == brute_force(docs, items)
    assert {(14, 1), (14, 2), (15, 1), (17, 1), (23, 5), (24, 5)} <= {x[:2] for x in got} and 16 not in {x[0] for x in got}


def test_no_near_window_is_beyond_the_distance(spark):
    """Bags at the threshold lie far inside the 23 bits that the blocks guarantee."""
    rows = [(i, [i * 1000 + k for k in range(40)], [i * 1000 + k + (100 if k < 4 else 0) for k in range(40)]) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>").selectExpr("i", "transform(a, x -> xxhash64(x)) a", "transform(b, x -> xxhash64(x)) b")
    distance = df.select((D.F.bit_count(D.simhash(D.F.col("a")).bitwiseXOR(D.simhash(D.F.col("b"))))).alias("d"))
    assert max(r.d for r in distance.collect()) <= 23


def test_simhash_and_blocks(spark):
    values = [3, -5, 2**62, -1]
    row = spark.createDataFrame([(values,)], "v array<long>").select(D.simhash(D.F.col("v")).alias("fp")).first()
    want = sum(1 << b for b in range(64) if 2 * sum((v >> b) & 1 for v in values) > len(values))
    assert row.fp & (2**64 - 1) == want
    cut = spark.createDataFrame([(-2,)], "fp long").select(D.blocks_of(D.F.col("fp"), 24).alias("b")).first().b
    edges = [64 * i // 24 for i in range(25)]
    assert sum(x.value << edges[x.block] for x in cut) == (-2) & (2**64 - 1)


def test_native(spark, tables):
    plan = QUERIES["op2_decontaminate"](spark, tables)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark, empty_tables, tables):
    assert QUERIES["op2_decontaminate"](spark, empty_tables).count() == 0
    docs, items = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "benchmark"))
    assert D.leaks(docs, items.limit(0)).count() == 0 and D.leaks(docs.limit(0), items).count() == 0


def test_stage_drops_leaks_only(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = D.decontaminate_stage(spark, docs, tables)
    assert out.columns == docs.columns
    kept = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
    assert kept == sorted(str(r[0]) for r in rows_of(spark, tables) if r[0] not in (14, 15, 17, 23, 24))
