import regex

import corpus_pipeline
from test_decontaminate import brute_force
from test_secrets import base
from test_simhash_dedup import slow_components
from tests_llm_helpers import rows_of
from tiltml.llm import piece_sampling, secrets
from tiltml.llm.token_files import public_tokenizer

MODEL = public_tokenizer("piece_bpe_32k.model")


def test_equals_brute_force(spark, tables):
    """Stage by stage on plain lists; the sampled ids are decoded."""
    rows = [r[:2] for r in rows_of(spark, tables) if r[1] is not None and regex.search(r"\p{L}", r[1])]
    groups = slow_components(rows)
    kept = {}
    for r in rows:
        c = groups[r][1] if groups[r][1] is not None else groups[r]
        kept[c] = min(kept.get(c, r), r, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    leaking = {x[0] for x in brute_force([r for r in kept.values() if len(r[1]) < 60_000], items)}
    left = [r for r in kept.values() if r[0] not in leaking]
    out = corpus_pipeline.run(spark, tables)
    got = {r.doc_id: r.text for r in piece_sampling.decode(out, MODEL).select("doc_id", "text").collect()}
    assert set(got) == {r[0] for r in left}
    for doc_id, text in left:
        if base(text):
            assert got[doc_id] == secrets.redacted(text, None)
        else:
            assert got[doc_id] == text


def test_columns_and_empty_table(spark, tables, empty_tables):
    docs = spark.read.parquet(f"{empty_tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0 and docs.columns == spark.read.parquet(f"{tables}/documents.parquet").columns
    assert corpus_pipeline.run(spark, empty_tables).count() == 0
