import io
import zlib

import numpy as np
import pytest

from tests_llm_helpers import rows_of
from tiltml.llm import token_files as K
from tiltml.llm.queries import QUERIES


def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(K.public_tokenizer("word_bpe_49k.json")())


@pytest.mark.parametrize("ids", [[5], [7] * 300, list(range(4096)), [0, 2**32 - 1, 3], [2**31] * 9 + [1], np.random.default_rng(2).zipf(1.3, 4096).clip(0, 2**32 - 1).tolist()])
def test_block_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert K.decode_block(K.encode_block(ids)).tolist() == ids.tolist()


def test_outliers_are_exceptions():
    ids = np.array([3, 5, 2, 4] * 1000 + [2**30] * 3, np.uint32)
    data = K.encode_block(ids)
    assert len(data) < 4003 and K.decode_block(data).tolist() == ids.tolist()


def test_file_round_trip_and_range_reads():
    r = np.random.default_rng(5)
    docs = [r.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 9000, 3, 0, 70_000, 4096)]
    out = io.BytesIO()
    writer = K.TokenFileWriter(out)
    for i, ids in enumerate(docs):
        writer.add(None if i == 3 else i * 10, ids)
    writer.close()
    reader = K.TokenFileReader(out)
    whole = np.concatenate(docs)
    for a, b in ((0, 0), (0, len(whole)), (4095, 4097), (9001, 9004), (80_000, len(whole))):
        assert reader.ids(a, b).tolist() == whole[a:b].tolist()
    read = list(reader.documents(run=100))
    assert [x[0] for x in read] == [0, 10, 20, None, 40, 50, 60]
    assert all(x[2].tolist() == d.tolist() for x, d in zip(read, docs, strict=True))


def test_empty_file():
    out = io.BytesIO()
    K.TokenFileWriter(out).close()
    assert list(K.TokenFileReader(out).documents()) == []


def test_pieces_equal_whole_texts():
    library = tokenizer()
    texts = ["don't STOP-it's  ß Ünḯ \x1cfoo\x85bar <|endoftext|> x<|startoftext|>y 日本 ǅ İstanbul ΑΣ ſ", "", "   ", "a b　c 12ab3 ...,,, _x_ 'tis", "É́ Ａ ﬁ ²³ ªº µm ÿ÷×",
             "word," * 50, "x" * 5000, "Foo foo FOO foo. foo, (foo) foo's foo-bar"]
    small = K.PieceEncoder(K.public_tokenizer("word_bpe_49k.json")(), cache_size=5)
    for text, ids in zip(texts, small.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_equals_the_library(spark, tables):
    library = tokenizer()
    got = [tuple(r) for r in QUERIES["op5_token_files"](spark, tables).collect()]
    rows = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows_of(spark, tables)]
    assert sorted((str(a), n, c) for a, _, n, c in got) == sorted((str(a), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for a, ids in rows)
    # Ascending ids (null first), each start right behind the document before.
    place = 0
    for doc_id, start, n, _ in sorted(got, key=lambda x: x[1]):
        assert start == place
        place += n
    ids = [x[0] for x in sorted(got, key=lambda x: x[1])]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_empty_table(spark, empty_tables):
    assert QUERIES["op5_token_files"](spark, empty_tables).count() == 0
