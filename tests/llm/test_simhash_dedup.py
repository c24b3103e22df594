import random
import re

import xxhash

from tests_llm_helpers import rows_of, union_find
from tiltml.llm import simhash_dedup as S
from tiltml.llm.components import connected_components
from tiltml.llm.queries import QUERIES


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def slow_components(rows):
    """doc_id's smallest reachable id over all pairs of fingerprints."""
    prints = {r: slow_fingerprint(r[1]) for r in rows}
    words = sorted(set(prints.values()))
    roots = union_find(words, [(a, b) for a in words for b in words if a < b and (a ^ b).bit_count() <= 2])
    first = {}
    for (doc_id, *_), p in prints.items():
        if doc_id is not None:
            first[roots[p]] = min(doc_id, first.get(roots[p], doc_id))
    return {r: (f"{p:016x}", first.get(roots[p])) for r, p in prints.items()}


def test_equals_brute_force(spark, tables):
    rows = [r[:2] for r in rows_of(spark, tables)]
    want = slow_components(rows)
    got = QUERIES["op4_simhash_dedup"](spark, tables).collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=r[0], fingerprint=want[r][0], component_id=want[r][1])) for r in rows)


def test_links_of_random_words(spark):
    r = random.Random(3)
    words = {r.getrandbits(64) for _ in range(150)}
    for w in list(words):
        for _ in range(4):
            words.add(w ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    words |= {(1 << 64) - 1, 0, 1 << 63}
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    want = union_find(sorted(map(signed, words)), [(signed(a), signed(b)) for a in words for b in words if a < b and (a ^ b).bit_count() <= 2])
    prints = spark.createDataFrame([(i, signed(w)) for i, w in enumerate(sorted(words))], "doc_id long, fp long")
    got = {row.fp: row.component_id for row in S.near_duplicates(prints).collect()}
    groups = {}
    for fp, root in want.items():
        groups.setdefault(root, set()).add(fp)
    assert len(got) == len(words)
    assert {frozenset(g) for g in groups.values()} == {frozenset(fp for fp in got if got[fp] == c) for c in set(got.values())}


def test_large_near_copy_group_makes_few_rows(spark):
    """All words within two bits of one centre: keys are met by at most 65 words."""
    centre = 0x0123456789ABCDEF
    words = [centre] + [centre ^ 1 << b for b in range(63)] + [centre ^ 1 << a ^ 1 << b for a in range(63) for b in range(a)]
    prints = spark.createDataFrame(list(enumerate(words)), "doc_id long, fp long")
    assert S.links(prints.select("fp")).count() < 65 * len(words)
    assert {r.component_id for r in S.near_duplicates(prints).collect()} == {0}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(500)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(path + star + [(7, 7), (2000, 1999)], "u long, v long")).collect()}
    want = {**{i: 0 for i in range(1, 301)}, **{1001 + i: 1000 for i in range(500)}, 2000: 1999}
    assert got == want


def test_components_of_random_links(spark):
    r = random.Random(8)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(300)]
    nodes = {n for l in links for n in l}
    want = {n: root for n, root in union_find(nodes, links).items() if n != root}
    assert {x.node: x.root for x in connected_components(spark.createDataFrame(links, "u long, v long")).collect()} == want


def test_empty_table(spark, empty_tables):
    assert QUERIES["op4_simhash_dedup"](spark, empty_tables).count() == 0


def test_stage_keeps_one_of_each_group(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = S.dedup_stage(spark, docs, tables)
    assert out.columns == docs.columns
    want = slow_components([r[:2] for r in rows_of(spark, tables)])
    components = {c for _, c in want.values()} - {None}
    kept = [tuple(r) for r in out.select("doc_id", "text").collect()]
    assert sorted(want[r][1] for r in kept if want[r][1] is not None) == sorted(components)
    assert all(r[0] == want[r][1] for r in kept if want[r][1] is not None)
