"""Token-id files: patched frame-of-reference blocks with block and document indexes.

Encoding range-partitions the documents by id, so file after file holds ids in ascending
document order. Each task tokenizes its documents and streams one file:

    magic | blocks | document table | block starts | trailer

A block holds up to ``BLOCK`` ids: its minimum is subtracted, the differences are packed at the
bit width that a percentile of them needs (of ``PERCENTILES``, the one with the smallest block),
and the positions and full differences of wider ones follow in an exception list. The block
starts let a reader fetch any run of ids by a range read.

A task names its file after its own attempt and reports it in a manifest row, which is
materialised once: a file of a lost or repeated attempt is never referenced.

Defined cases: a null text counts as empty; a null id sorts first; rows that repeat an id follow
one another, ordered by a hash of the text. An empty table gives no rows. Texts of any length are
encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiltml.llm.common import filesystem, load, materialize, pieces, shared_path

BLOCK = 4096
PERCENTILES = (90, 95, 99, 100)
MAGIC = b"TILTPFR1"
_HEAD = struct.Struct("<HBHI")  # ids, width, exceptions, minimum
_TRAILER = struct.Struct("<QQQQ8s")  # place of the document table, documents, blocks, ids


# --- blocks ---------------------------------------------------------------------------------

def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, little end first."""
    if width == 0 or not len(values):
        return b""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    if width == 0 or n == 0:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    lengths = np.frexp(rest.astype(np.float64))[1]
    size = lambda w: len(ids) * w / 8 + 6 * int((lengths > w).sum())
    width = min({int(np.percentile(lengths, p, method="higher")) for p in PERCENTILES}, key=lambda w: (size(w), w))
    out = np.flatnonzero(lengths > width)
    return b"".join([_HEAD.pack(len(ids), width, len(out), low), pack_bits(rest, width),
                     out.astype("<u2").tobytes(), rest[out].astype("<u4").tobytes()])


def decode_block(data: bytes) -> np.ndarray:
    n, width, exceptions, low = _HEAD.unpack_from(data)
    at = _HEAD.size + (n * width + 7) // 8
    rest = unpack_bits(data[_HEAD.size:at], n, width).copy()
    where = np.frombuffer(data, "<u2", exceptions, at)
    rest[where] = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
    return rest + np.uint32(low)


# --- files ----------------------------------------------------------------------------------

class TokenFileWriter:
    """Streams ids of documents to an open binary file; holds one block and the indexes."""

    def __init__(self, out):
        self.out, self.place, self.ids = out, len(MAGIC), 0
        self.starts: list[int] = []
        self.counts: list[int] = []
        self.names: list[int | None] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.names.append(doc_id)
        self.counts.append(len(ids))
        self.ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            data = encode_block(ids[i:min(i + BLOCK, end)])
            self.starts.append(self.place)
            self.out.write(data)
            self.place += len(data)
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        table = b"".join([np.array([x is None for x in self.names], np.uint8).tobytes(),
                          np.array([x or 0 for x in self.names], "<i8").tobytes(), np.array(self.counts, "<u8").tobytes()])
        self.out.write(table + np.array(self.starts, "<u8").tobytes())
        self.out.write(_TRAILER.pack(self.place, len(self.names), len(self.starts), self.ids, MAGIC))


class TokenFileReader:
    """Range-reads a seekable binary file written by TokenFileWriter."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        self.end, docs, blocks, self.n_ids, magic = _TRAILER.unpack(self._read(size - _TRAILER.size, _TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        data = self._read(self.end, 17 * docs + 8 * blocks)
        null = np.frombuffer(data, np.uint8, docs)
        names = np.frombuffer(data, "<i8", docs, docs)
        self.names = [None if z else int(x) for z, x in zip(null, names, strict=True)]
        self.counts = np.frombuffer(data, "<u8", docs, 9 * docs).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", blocks, 17 * docs).astype(np.int64)

    def _read(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number ``start`` to ``stop`` of the file, by one range read of the blocks that hold them."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        edges = [*self.starts[first:last + 1].tolist(), int(self.starts[last + 1]) if last + 1 < len(self.starts) else self.end]
        data = self._read(edges[0], edges[-1] - edges[0])
        parts = [decode_block(data[a - edges[0]:b - edges[0]]) for a, b in zip(edges, edges[1:], strict=False)]
        return np.concatenate(parts)[start - first * BLOCK:stop - first * BLOCK]

    def documents(self, run: int = 64 * BLOCK) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, first id's number, ids) of each document; about ``run`` ids are held beside a longer document's."""
        ends = np.cumsum(self.counts)
        base, held = 0, np.empty(0, np.uint32)
        for name, count, end in zip(self.names, self.counts.tolist(), ends.tolist(), strict=True):
            if end > base + len(held):
                base, held = end - count, self.ids(end - count, min(self.n_ids, max(end, end - count + run)))
            yield name, end - count, held[end - count - base:end - base]


# --- encoding -------------------------------------------------------------------------------

# A plain piece between white space is made of Latin-1 letters, then ASCII marks other than an apostrophe:
# the tokenizer cuts it after the letters, whatever stands around it.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class PieceEncoder:
    """Ids of texts under a word-end BPE of the tokenizers library.

    Such a tokenizer drops white space and never joins pieces across it, so a text's ids are the
    ids of its pieces in order. Each batch's different pieces are told apart once; the library encodes those
    that the cache doesn't know, and the texts' ids are gathered from them as arrays. The cache is bounded: two
    generations of half its size, so that pieces in use stay when it is full. Plain words go to the library
    many at a time and are told apart by their word-end tokens; if those don't add up, and for every
    other piece, one by one.
    """

    def __init__(self, path: str, cache_size: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        # plain words, other pieces; the generation before of both
        self.plain: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}
        self.older: tuple[dict, dict] = {}, {}
        self.marks: dict[str, bytes] = {}
        self.cache_size = cache_size

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(words) or stops[-1] != 4 * len(ids):
            return self._library(words)
        data, cuts = ids.tobytes(), [0, *stops.tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, words: list[str], others: list[str], marks: list[str]) -> None:
        for i in range(0, len(words), 1000):
            self.plain.update(zip(words[i:i + 1000], self._words(words[i:i + 1000]), strict=True))
        self.other.update(zip(others, self._library(others), strict=True))
        self.marks.update(zip(marks, self._library(marks), strict=True))

    def _pieces(self, distinct: list[str]) -> list[bytes]:
        if len(self.plain) + len(self.other) > self.cache_size // 2:
            self.older, self.plain, self.other = (self.plain, self.other), {}, {}
        if len(self.marks) > self.cache_size // 10:
            self.marks = {}
        plain, other, marks = self.plain, self.other, self.marks
        cut = [piece.rstrip(_MARKS) for piece in distinct]
        words: dict[str, None] = {}
        others: dict[str, None] = {}
        ends: dict[str, None] = {}
        for piece, word in zip(distinct, cut, strict=True):
            if word not in plain and piece not in other:
                if word in self.older[0]:
                    plain[word] = self.older[0][word]
                elif piece in self.older[1]:
                    other[piece] = self.older[1][piece]
                elif len(piece) < 200 and _PLAIN.fullmatch(word):
                    words[word] = None
                else:
                    others[piece] = None
                    continue
            if len(word) != len(piece) and piece[len(word):] not in marks:
                ends[piece[len(word):]] = None
        self._learn(list(words), list(others), list(ends))
        out = []
        for piece, word in zip(distinct, cut, strict=True):
            ids = plain.get(word)
            out.append(other[piece] if ids is None else ids if len(word) == len(piece) else ids + marks[piece[len(word):]])
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text starts and the end) of an array without nulls."""
        split = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(split.flatten())
        found = self._pieces(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        piece = coded.indices.to_numpy()
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[piece])])
        place = np.repeat((np.cumsum(sizes) - sizes)[piece] - ends[:-1], sizes[piece]) + np.arange(ends[-1])
        starts = split.offsets.to_numpy()
        return pool[place], ends[starts - starts[0]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, starts = self.ids(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process, so that its cache serves all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: Callable[[], str], end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Writes token files below ``folder``; returns the manifest: part, path, n_docs, n_ids, start."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # The hash and the row number split a much repeated id over partitions; both repeat in a rerun.
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").drop("h", "row")

    def write(batches):
        encode = encoder(tokenizer()).ids
        task = TaskContext.get()
        fs, root = filesystem(folder)
        tail = np.array([end_id], "<u4")
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.pfor"
        writer = out = None
        for batch in pieces(batches, "text"):
            if writer is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}")
                writer = TokenFileWriter(out)
            ids, starts = encode(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), starts.tolist(), starts[1:].tolist(), strict=False):
                writer.add(doc_id, np.concatenate([ids[a:b], tail]))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "path": f"{folder}/{name}", "n_docs": len(writer.names), "n_ids": writer.ids}],
                                             schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    manifest = materialize(rows.mapInArrow(write, "part int, path string, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    files = manifest.select("path", "start")

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = filesystem(path)
                with fs.open_input_file(place) as source:
                    rows: list[tuple] = []
                    for doc_id, start, ids in TokenFileReader(_Seekable(source)).documents():
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 10_000:
                            yield _digests(rows)
                            rows = []
                    if rows:
                        yield _digests(rows)

    return files.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


class _Seekable:
    """seek() that returns the place, over a pyarrow file."""

    def __init__(self, source):
        self.source = source
        self.read = source.read

    def seek(self, place: int, whence: int = 0) -> int:
        self.source.seek(place, whence)
        return self.source.tell()


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def public_tokenizer(name: str) -> Callable[[], str]:
    """Place of a public tokenizer's file, looked up where the task runs."""
    def place() -> str:
        import public_tokenizers
        return public_tokenizers.path(name)
    return place


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(load(spark, sf_dir, "documents"), shared_path(spark, "tokens"), public_tokenizer("word_bpe_49k.json"), end_id=2)
    return read_tokens(manifest)
