import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from tests_llm_helpers import rows_of
from tiltml.llm import passages as P
from tiltml.llm.queries import QUERIES


def slow_windows(values, width):
    n, out = len(values), set()
    for c in range(n):
        left = c
        while left and values[left - 1] > values[c]:
            left -= 1
        right = c
        while right + 1 < n and values[right + 1] >= values[c]:
            right += 1
        if right - left + 1 >= width:
            out.add((left, c, right))
    return out


@pytest.mark.parametrize("high", [3, 50, 2**60])
def test_compact_windows(high):
    r = np.random.default_rng(high % 1000)
    counts = np.array([0, 1, 5, 6, 7, 40, 0, 300, 6])
    lists = [r.integers(0, high, n).astype(np.uint64) for n in counts]
    got = {tuple(map(int, w)) for w in zip(*P.compact_windows(np.concatenate(lists), counts, 6), strict=True)}
    want = {tuple(start + x for x in w) for start, v in zip(np.cumsum(counts) - counts, lists, strict=True) for w in slow_windows(v.tolist(), 6)}
    assert got == want
    assert len(P.compact_windows(np.arange(100, dtype=np.uint64), np.array([100]), 6)[0]) == 95


def test_sliding_overlap():
    r = np.random.default_rng(4)
    for high in (2, 5, 100):
        x, y = r.integers(0, high, 60), r.integers(0, high, 60)
        want = [sum((Counter(x[i:i + 7].tolist()) & Counter(y[i:i + 7].tolist())).values()) for i in range(54)]
        assert P.sliding_overlap(x, y, 7).tolist() == want


def words(text):
    return (text or "").encode().lower().split()


def repeated_runs(rows):
    """(doc_id, place) of every run of 50 words that another text holds too."""
    runs = defaultdict(set)
    for row in rows:
        w = words(row[1])
        for i in range(len(w) - 49):
            runs[tuple(w[i:i + 50])].add((row, i))
    return {(row[0], i) for v in runs.values() if len({row for row, _ in v}) > 1 for row, i in v}


def covered(got, doc_id, place):
    return any(r.doc_id == doc_id and r.start_word <= place and place + 50 <= r.end_word or
               r.of_doc_id == doc_id and r.of_start_word <= place and place + 50 <= r.of_end_word for r in got)


def test_covers_brute_force(spark, tables):
    rows = [r[:2] for r in rows_of(spark, tables)]
    got = QUERIES["op9_passages"](spark, tables).collect()
    want = repeated_runs(set(rows))
    assert {5, 6, 7, 11, 12, 13} <= {d for d, _ in want} and all(covered(got, *w) for w in want)
    texts = defaultdict(list)
    for doc_id, text in rows:
        texts[doc_id].append(words(text))
    for r in got:  # every row is a near-equal passage of at least 50 words
        assert r.end_word - r.start_word >= 45 and r.similarity >= 0.8
        best = 0
        for a in texts[r.doc_id]:
            for b in texts[r.of_doc_id]:
                x = {tuple(a[i:i + 5]) for i in range(r.start_word, r.end_word - 4)}
                y = {tuple(b[i:i + 5]) for i in range(r.of_start_word, r.of_end_word - 4)}
                best = max(best, len(x & y) / len(x | y))
        assert best >= 0.75  # sets here, bags there
    assert not {r.doc_id for r in got} & {8, 9, 22, 23}


def test_hot_passage_and_near_copies(spark):
    """One passage in many texts, in some with a changed word; unrelated texts with a common phrase."""
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    passage, phrase = [word() for _ in range(120)], [word() for _ in range(12)]
    texts = []
    for i in range(60):
        p = passage.copy()
        if i % 3 == 1:
            p[60] = word()
        texts.append(" ".join([word() for _ in range(30)] + p + [word() for _ in range(30)]))
    texts += [" ".join([word() for _ in range(60)] + phrase + [word() for _ in range(60)]) for _ in range(60)]
    got = P.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id for x in got} | {x.of_doc_id for x in got} == set(range(60))
    assert all(any(x.doc_id == d and x.end_word - x.start_word >= 100 for x in got) for d in range(1, 60))


def test_third_text_in_front(spark):
    """The first member of a group shares half a passage only; the others' common passage is found all the same."""
    r = random.Random(2)
    word = lambda: "".join(r.choices("klmnopqrst", k=6))
    passage = [word() for _ in range(70)]
    texts = [" ".join(passage[20:50] + [word() for _ in range(60)])] + [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)]) for _ in range(3)]
    got = P.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(x.doc_id, x.of_doc_id) for x in got} == {(2, 1), (3, 1)}


@pytest.mark.parametrize("common", [40, 42, 44])
def test_third_text_settles_one_of_two(spark, common):
    """X repeats 50 words of the first text, and Y 50 words of X; Y and the first text share fewer."""
    r = random.Random(common)
    word = lambda: "".join(r.choices("abcdefghijklm", k=7))
    some = lambda n: [word() for _ in range(n)]
    texts = []
    for _ in range(40):
        a, b, c = some(50 - common), some(common), some(50 - common)
        texts += [some(30) + a + b + some(30), some(30) + a + b + c + some(30), some(30) + b + c + some(30)]
    got = P.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for i in range(0, 120, 3):
        assert covered([x for x in got if x.of_doc_id == i], i + 1, 30), i
        assert covered([x for x in got if (x.doc_id, x.of_doc_id) == (i + 2, i + 1)], i + 2, 30), i


@pytest.mark.parametrize("length, changed", [(50, [25]), (50, [23]), (50, [15]), (50, [4]), (60, [30]), (60, [20]), (100, [25, 75]), (150, [24, 74, 124])])
def test_changed_words_are_found_wherever_they_stand(spark, length, changed):
    """Near-equal passages in random text, at the rule's limit: brute force finds all of them, so must the keys."""
    r = random.Random(length * 1000 + changed[0])
    word = lambda: "".join(r.choices("abcdefghijklm", k=7))
    texts = []
    for i in range(25):
        passage = [word() for _ in range(length)]
        near = [word() if j in changed else w for j, w in enumerate(passage)]
        a, b = {tuple(p[j:j + 5]) for j in range(length - 4) for p in (passage,)}, {tuple(near[j:j + 5]) for j in range(length - 4)}
        assert len(a & b) / len(a | b) >= 0.8
        texts += [(2 * i + k, " ".join([word() for _ in range(r.randrange(80))] + p + [word() for _ in range(r.randrange(80))])) for k, p in enumerate((passage, near))]
    got = P.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.of_doc_id) for x in got} == {(2 * i + 1, 2 * i) for i in range(25)}
    for x in got:
        assert x.similarity >= 0.8 and x.end_word - x.start_word >= 45  # only words that both have end a stretch


def test_inserted_words_and_a_passage_over_the_window_bound(spark):
    """One word put into a passage of 60, 90 and 150 words; a passage of 40,000 words, which is more than a window reaches."""
    r = random.Random(31)
    text = lambda n, name: [f"{name}{r.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i, n in enumerate((60, 90, 150)):
        passage = text(n, "p")
        at = n // 2
        rows += [(2 * i, " ".join(text(40, "a") + passage + text(40, "b"))), (2 * i + 1, " ".join(text(30, "c") + passage[:at] + ["added"] + passage[at:] + text(30, "d")))]
    long = text(40_000, "l")
    rows += [(100, " ".join(text(10, "e") + long)), (101, " ".join(long + text(10, "f")))]
    found = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = {x for f in found for x in (f.doc_id, f.of_doc_id)}
    assert ids == {0, 1, 2, 3, 4, 5, 100, 101}
    assert any({f.doc_id, f.of_doc_id} == {100, 101} and f.end_word - f.start_word >= 40_000 for f in found)


def test_steps_leave_no_shuffle_files(spark):
    """What a step has shuffled goes when the step is written, and so do the windows that only the next step reads."""
    r = random.Random(5)
    passage = [f"p{r.randrange(10**9)}" for _ in range(70)]
    texts = [" ".join([f"w{r.randrange(10**9)}" for _ in range(40)] + passage[:70 - i] + [f"w{r.randrange(10**9)}" for _ in range(40)]) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p for d in folders for p in Path(d).rglob("shuffle_*.data")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf = files(), spark.conf.get(name, None)
    found = P.repeated_passages(docs)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(name, None) == conf
    first = sorted(map(tuple, found.collect()))
    assert {(x[0], x[4]) for x in first} == {(i, 0) for i in range(1, 6)}
    assert sorted(map(tuple, found.collect())) == first  # a result can be read again


def test_empty_table(spark, empty_tables):
    assert QUERIES["op9_passages"](spark, empty_tables).count() == 0
