import zlib
from collections import Counter
from math import exp, log

import numpy as np
import regex

from tests_llm_helpers import rows_of
from tiltml.llm import language_id as L
from tiltml.llm.queries import QUERIES


def brute_force(rows):
    """Multinomial naive Bayes over dictionaries, n-gram by n-gram."""
    def grams(text):
        t = f" {text.lower()} "
        for n in L.SIZES:
            for i in range(len(t) - n + 1):
                g = t[i:i + n]
                if "\0" not in g:
                    yield int(L.buckets_of(L.codes_of(g), n, 15)[0])

    letter = regex.compile(r"\p{L}")
    counts, docs = {}, Counter()
    for doc_id, text, lang in rows:
        held = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1
        if not held and lang is not None and text is not None and letter.search(text):
            docs[lang] += 1
            counts.setdefault(lang, Counter()).update(grams(text))
    out = []
    for doc_id, text, _ in rows:
        held = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1
        if text is None or not letter.search(text):
            out.append((doc_id, held, "und", 0.0))
            continue
        own = Counter(grams(text))
        joint = {}
        for lang, c in sorted(counts.items()):
            total = sum(c.values()) + 0.5 * (1 << 15)
            joint[lang] = log(docs[lang] / sum(docs.values())) + sum(n * log((c[g] + 0.5) / total) for g, n in own.items())
        best = max(joint, key=lambda k: (joint[k], [-ord(x) for x in k]))
        out.append((doc_id, held, best, 1 / sum(exp(min(v - joint[best], 0)) for v in joint.values())))
    return out


def test_equals_brute_force(spark, tables):
    rows = [r for r in rows_of(spark, tables) if r[1] is None or len(r[1]) < 60_000]
    got = {(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in QUERIES["op1_language_id"](spark, tables).collect()}
    # The long texts are learned from too, so they are part of the brute-force training.
    want = {(a, b, c, round(d, 6)) for a, b, c, d in brute_force(rows_of(spark, tables))}
    assert got == want and rows


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_language_id"](spark, folder).join(docs, "doc_id").where("held_out")
    right = got.where("lang = lang_pred").count()
    assert right >= 0.97 * got.count()


def test_long_texts_are_cut_without_loss():
    model = L.fit(["a", "b"], np.array([1, 1]), np.random.default_rng(1).integers(0, 50, (2, 1 << 15)), 15, L.SIZES, 0.5)
    text = "".join(chr(97 + i * i % 26) for i in range(5000))
    want = L.log_scores([text], model)
    block, L._BLOCK = L._BLOCK, 700
    try:
        assert np.allclose(L.log_scores([text, "x", text], model)[[0, 2]], want)
    finally:
        L._BLOCK = block


def test_empty_table(spark, empty_tables):
    assert QUERIES["op1_language_id"](spark, empty_tables).count() == 0


def test_too_many_languages(spark):
    rows = spark.createDataFrame([(str(i), "abc") for i in range(5)], "lang string, text string")
    try:
        L.train(rows, max_languages=4)
    except ValueError:
        return
    raise AssertionError("more languages than the bound were accepted")


def test_stage_keeps_clean_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = L.language_stage(spark, docs, tables)
    assert out.columns == docs.columns
    kept = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
    gone = sorted(str(r[0]) for r in rows_of(spark, tables) if r[1] is None or not regex.search(r"\p{L}", r[1]))
    assert sorted(kept + gone) == sorted(str(r[0]) for r in rows_of(spark, tables))
