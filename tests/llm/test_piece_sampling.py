import zlib
from collections import Counter
from math import exp

import numpy as np

from tests_llm_helpers import rows_of
from tiltml.llm import piece_sampling as S
from tiltml.llm.piece_vocab import BYTE_SCORE, vocabulary
from tiltml.llm.queries import QUERIES
from tiltml.llm.token_files import public_tokenizer

MODEL = public_tokenizer("piece_bpe_32k.model")
VOCAB = vocabulary(MODEL)


def segmentations(unit, alpha):
    """Every segmentation of a unit with its weight."""
    if not unit:
        return [((), 1.0)]
    out = []
    for n in range(1, len(unit) + 1):
        head = unit[:n]
        piece = VOCAB.pieces.get(("▁" + head[1:]) if head[0] == " " else head) if "▁" not in head and " " not in head[1:] else None
        if piece:
            ids, weight = (piece[0],), exp(alpha * piece[1])
        elif n == 1:
            ids, weight = tuple(VOCAB.byte_tokens(head)), exp(alpha * BYTE_SCORE * len(head.encode()))
        else:
            continue
        out += [(ids + rest, weight * w) for rest, w in segmentations(unit[n:], alpha)]
    return out


def test_samples_follow_the_lattice():
    for unit, alpha in ((" then", 1.0), ("hering", 0.5), ("aña\x07", 1.0)):
        paths = segmentations(unit, alpha)
        total = sum(w for _, w in paths)
        n = 20_000
        seen = Counter(tuple(x.tolist()) for x in S.Sampler(VOCAB, alpha, 3).encode([unit] * n, np.arange(n, dtype=np.uint64)))
        assert set(seen) <= {p for p, _ in paths}
        statistic = sum((seen[p] - n * w / total) ** 2 / (n * w / total) for p, w in paths if n * w / total >= 5)
        freedom = sum(n * w / total >= 5 for _, w in paths)
        assert statistic < freedom + 5 * (2 * freedom) ** 0.5


def plain_segmentations(text, alpha):
    """As ``segmentations``, of a whole text: every space is a mark, wherever it stands."""
    if not text:
        return [((), 1.0)]
    out = []
    for n in range(1, min(len(text), VOCAB.longest) + 1):
        piece = VOCAB.pieces.get(text[:n].replace(" ", "▁"))
        if piece:
            out += [((piece[0], *rest), exp(alpha * piece[1]) * w) for rest, w in plain_segmentations(text[n:], alpha)]
        elif n == 1:
            out += [((*VOCAB.byte_tokens(text[0]), *rest), exp(alpha * BYTE_SCORE * len(text[0].encode())) * w) for rest, w in plain_segmentations(text[1:], alpha)]
    return out


def test_spaces_and_long_runs_are_one_lattice(monkeypatch):
    """Pieces of several marks are drawn, and pieces across the 32nd character, kept or filtered for the batch only."""
    texts = ["    x", "a   \n  b", "a  );\r\n"]
    for text, kept in [(t, k) for t in texts for k in (200, 3)]:
        monkeypatch.setattr(S, "KEPT_UNIT", kept)
        paths = plain_segmentations(text, 0.5)
        total, n = sum(w for _, w in paths), 5_000
        seen = Counter(tuple(x.tolist()) for x in S.Sampler(VOCAB, 0.5, 3).encode([text] * n, np.arange(n, dtype=np.uint64)))
        assert set(seen) <= {p for p, _ in paths}
        assert any("▁▁" in VOCAB.pieces and VOCAB.pieces["▁▁"][0] in p for p in seen)
        statistic = sum((seen[p] - n * w / total) ** 2 / (n * w / total) for p, w in paths if n * w / total >= 5)
        freedom = sum(n * w / total >= 5 for _, w in paths)
        assert statistic < freedom + 5 * (2 * freedom) ** 0.5
        if "\r" in text:
            assert any(VOCAB.pieces[");\r"][0] in p for p in seen)
    word = "there" * 60
    for kept in (200, 1000):
        monkeypatch.setattr(S, "KEPT_UNIT", kept)
        borders, n = Counter(), 400
        for ids in S.Sampler(VOCAB, 1.0, 3).encode([word] * n, np.arange(n, dtype=np.uint64)):
            assert S.decode_ids(ids.tolist(), VOCAB) == word
            borders.update(np.cumsum([len(VOCAB.bytes_of[i]) for i in ids]).tolist())
        for cut in (32, 64, 96, 288):  # in the middle of a word: as often a border as the same place of its neighbours
            assert abs(borders[cut] - borders[cut - 5]) < 6 * (2 * borders[cut - 5] + 1) ** 0.5 and borders[cut] < 0.9 * n


def test_lossless_and_reproducible(spark, tables):
    rows = rows_of(spark, tables)
    got = QUERIES["op10_piece_sampling"](spark, tables).collect()
    assert len(got) == len(rows) and all(r.decoded_equal for r in got)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    again = S.encode(docs.repartition(7), MODEL, columns=["doc_id"], digest=True).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = S.encode(docs, MODEL, seed=8, columns=["doc_id"], digest=True).collect()
    assert sorted(map(str, got)) != sorted(map(str, other))


def test_ids_do_not_depend_on_the_batch(monkeypatch):
    texts = [" then there", "the ring ▁ \n x", "", "ab" * 100, "é日🎉"]
    keys = np.array([5, 9, 2**63, 2**64 - 1, 0], np.uint64)
    whole = S.Sampler(VOCAB, 1.0, 7).encode(texts, keys)
    monkeypatch.setattr(S, "KEPT_NODES", 10)
    small = S.Sampler(VOCAB, 1.0, 7)
    for text, key, ids in zip(texts, keys, whole, strict=True):
        assert small.encode([text], np.array([key], np.uint64))[0].tolist() == ids.tolist()
        assert S.decode_ids(ids.tolist(), VOCAB) == text


def test_columns_of_ids_and_decoding(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = S.encode(docs, MODEL)
    assert "text" not in out.columns and out.columns.count("n_tokens") == 1
    back = S.decode(out, MODEL).select("doc_id", "text").collect()
    assert sorted(str((r.doc_id, r.text)) for r in back) == sorted(str((i, t or "")) for i, t, _ in rows_of(spark, tables))
    digests = {(r.doc_id, r.ids_crc32) for r in QUERIES["op10_piece_sampling"](spark, tables).collect()}
    assert {(r.doc_id, zlib.crc32(np.array(r.token_ids, "<u4").tobytes())) for r in out.collect()} == digests


def test_empty_table(spark, empty_tables):
    assert QUERIES["op10_piece_sampling"](spark, empty_tables).count() == 0
