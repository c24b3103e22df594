"""Sampled SentencePiece encoding by forward filtering and backward sampling, and decoding.

A text is cut into units, only where no piece can stand across the cut: a run of non-space characters of
any length with all the spaces before it, or other white space that no piece joins to it; a run of over ``UNIT`` characters is cut
further between two characters that stand side by side in no piece. So the units' lattices together are the text's
lattice. Each distinct unit's lattice of pieces is filtered once: the
forward weight of a node adds up all segmentations of the prefix, and the edges into the node get
their shares of it as cumulative 24-bit integers. A unit that stays longer than ``KEPT_UNIT`` is filtered for
its batch only and keeps one forward weight a character; its edges are looked up again on the way back. An occurrence is sampled from its end: a
hash of (seed, row key, place of the unit, step) picks an edge into the current node, until the
start is reached. All occurrences of a block of texts take a step together in numpy.

The draws depend on the row key and the text alone, so a rerun, another partitioning or a retried
task gives the same ids. Space is a piece's mark, characters outside the vocabulary become byte
pieces, and a literal mark in a text does too, so decoding gives the text back exactly.

Defined cases: null and empty texts have no ids and decode to the empty text. Rows with the same key
and text get the same ids; a null key is a key of its own. An empty table gives no rows. Texts are
encoded whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltml.llm.common import load, pieces
from tiltml.llm.piece_vocab import BYTE_SCORE, SPACE, Vocabulary, vocabulary
from tiltml.llm.token_files import public_tokenizer

UNIT, KEPT_UNIT = 32, 200
_OUTSIDE = "\uffff"  # a noncharacter: stands for a literal mark, which no piece may match
BITS = 24
# Bounds of a task's memory: nodes of lattices that it keeps, and bytes of text that it samples at a time.
KEPT_NODES, PIECE_BYTES = 2_500_000, 2 << 20


class Cutter:
    """Cuts a text where no piece of the vocabulary can stand across."""

    def __init__(self, vocab: Vocabulary):
        # White space inside of pieces (line feeds behind brackets) goes with the word before it.
        inner = {c for p in vocab.pieces if len(p) > 1 for c in p if c.isspace()}
        self.words = re.compile(rf" *[\S{re.escape(''.join(sorted(inner)))}]+| +|\s")
        self.across = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in vocab.pieces)  # then only pairs tell
        self.pairs = {p[i:i + 2].replace(SPACE, " ") for p in vocab.pieces for i in range(len(p) - 1)}

    def units(self, text: str) -> list[str]:
        out: list[str] = []
        for unit in [text] * bool(text) if self.across else self.words.findall(text):
            if len(unit) <= UNIT:
                out.append(unit)
                continue
            start = 0
            for i in range(1, len(unit)):
                if unit[i - 1:i + 1] not in self.pairs:
                    out.append(unit[start:i])
                    start = i
            out.append(unit[start:])
        return out


class PieceTrie:
    """The vocabulary's trie as sorted arrays, to be walked from many places of a text at once."""

    def __init__(self, vocab: Vocabulary):
        step: dict[tuple[int, int], int] = {}
        piece = [-1]
        for text, (i, _) in vocab.pieces.items():
            node = 0
            for c in map(ord, text):
                child = step.get((node, c))
                if child is None:
                    child = step[node, c] = len(piece)
                    piece.append(-1)
                node = child
            piece[node] = i
        moves = sorted((n << 21 | c, child) for (n, c), child in step.items())
        self.keys, self.children = (np.array(x, np.int64) for x in zip(*moves, strict=True))
        self.piece = np.array(piece, np.int64)

    def matches(self, codes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece id) of every piece in ``codes`` that ends by the ``stops`` of its start."""
        out = []
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        depth = 0
        while len(at):
            key = node << 21 | codes[at + depth]
            move = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[move] == key
            at, node = at[ok], self.children[move[ok]]
            depth += 1
            hit = self.piece[node] >= 0
            out.append((at[hit], at[hit] + depth, self.piece[node[hit]]))
            on = at + depth < stops[at]
            at, node = at[on], node[on]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def lattices(units: Sequence[str], trie: PieceTrie, scores: np.ndarray, byte_score: float) -> tuple[np.ndarray, ...]:
    """(end node, start node, piece id or -1, character's place, cumulative share) of each edge of the units'
    lattices, by end and start. A unit of n characters has n + 1 nodes, numbered on from unit to unit.

    Forward filtering goes over the ends 1, 2, ... of all units together: the weight of a node is
    the sum over its edges of the weight of the edge's start times the piece's probability."""
    lengths = np.array([len(u) for u in units])
    text = "".join(u.replace(SPACE, _OUTSIDE) for u in units)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    first = np.cumsum(lengths) - lengths
    codes[codes == 32] = ord(SPACE)
    stops = np.repeat(first + lengths, lengths)
    node_of = np.arange(len(codes)) + np.repeat(np.arange(len(units)), lengths)  # the node before each character
    start, end, piece = trie.matches(codes, stops)
    single = np.zeros(len(codes), bool)
    single[start[end - start == 1]] = True
    alone = np.flatnonzero(~single)
    sizes = 1 + (codes[alone] > 0x7F) + (codes[alone] > 0x7FF) + (codes[alone] > 0xFFFF)
    weight = np.concatenate((scores[piece], byte_score * sizes))
    start, end, piece = (np.concatenate(x) for x in ((start, alone), (end, alone + 1), (piece, np.full(len(alone), -1))))
    order = np.argsort(end << 6 | 63 - (end - start))  # by end, then by start: no two edges have both
    start, end, piece, weight = start[order], end[order], piece[order], weight[order]
    from_node, to_node = node_of[start], node_of[end - 1] + 1
    ends = end - np.repeat(first, lengths)[end - 1]
    forward = np.zeros(len(codes) + len(units))
    cumulative = np.empty(len(start), np.int64)
    ends = ends.astype(np.uint16)  # a unit has at most KEPT_UNIT characters
    by_end = np.argsort(ends, kind="stable")
    cuts = np.searchsorted(ends[by_end], np.arange(1, int(lengths.max()) + 2))
    for low, high in zip(cuts, cuts[1:], strict=False):
        edges = by_end[low:high]
        nodes = to_node[edges]
        new = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
        n = np.diff(np.append(new, len(edges)))
        score = forward[from_node[edges]] + weight[edges]
        top = np.maximum.reduceat(score, new)
        share = np.exp(score - np.repeat(top, n))
        total = np.add.reduceat(share, new)
        forward[nodes[new]] = top + np.log(total)
        whole = np.floor(share / np.repeat(total, n) * (1 << BITS)).astype(np.int64)
        sums = np.cumsum(whole)
        sums -= np.repeat(sums[new] - whole[new], n)
        sums[new + n - 1] = 1 << BITS
        cumulative[edges] = sums
    return to_node, from_node, piece, start, cumulative


class _Column:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.data, self.n = np.empty(1024, kind), 0

    def extend(self, values: Sequence) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.empty(max(end, 2 * len(self.data)) - len(self.data), self.data.dtype)])
        self.data[self.n:end] = values
        self.n = end

    @property
    def view(self) -> np.ndarray:
        return self.data[:self.n]


class Sampler:
    """Filtered lattices of distinct units, kept up to a bound, and the backward sampler over them."""

    def __init__(self, vocab: Vocabulary, alpha: float, seed: int, trie: PieceTrie | None = None, kept_nodes: int | None = None):
        self.kept_nodes = kept_nodes or KEPT_NODES
        if any(_OUTSIDE in p for p in vocab.pieces):
            raise ValueError("the vocabulary holds a noncharacter")
        self.trie, self.seed, self.vocab, self.alpha = trie or PieceTrie(vocab), np.uint64(seed), vocab, alpha
        self.cutter = Cutter(vocab)
        self.scores, self.byte_score, self.byte_ids = np.zeros(len(vocab.bytes_of)), alpha * BYTE_SCORE, vocab.byte_ids
        for i, score in vocab.pieces.values():
            self.scores[i] = alpha * score
        self._clear()

    def _clear(self) -> None:
        self.first: dict[str, int] = {}  # unit -> its node 0
        self.nodes = 0
        # Of each edge: node << BITS plus the cumulative share; node it comes from; ids in ``flat``.
        self.key, self.back, self.at, self.size = _Column(np.int64), _Column(np.int32), _Column(np.int32), _Column(np.uint8)
        self.flat = _Column(np.int32)
        self.flat.extend(np.arange(len(self.scores)))  # a piece's id stands at its own number
        self.spelled: dict[str, tuple[int, int]] = {}  # place and number of a character's byte pieces in ``flat``

    def _learn(self, units: list[str]) -> None:
        if not units:
            return
        to_node, from_node, piece, place, cumulative = lattices(units, self.trie, self.scores, self.byte_score)
        lengths = np.array([len(u) for u in units])
        self.first.update(zip(units, (self.nodes + np.cumsum(lengths + 1) - lengths - 1).tolist(), strict=True))
        at, size = piece.copy(), np.ones(len(piece), np.int32)
        text = "".join(units)
        for i in np.flatnonzero(piece < 0).tolist():
            char = text[place[i]]
            if char not in self.spelled:
                ids = [self.byte_ids[b] for b in char.encode()]
                self.spelled[char] = (self.flat.n, len(ids))
                self.flat.extend(ids)
            at[i], size[i] = self.spelled[char]
        for column, values in ((self.key, (self.nodes + to_node << BITS) + cumulative), (self.back, self.nodes + from_node), (self.at, at), (self.size, size)):
            column.extend(values)
        self.nodes += int((lengths + 1).sum())

    def encode(self, texts: Sequence[str], keys: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, drawn under its 64-bit key."""
        split = [self.cutter.units(t) for t in texts]
        wanted = set().union(*split)
        long = {u for u in wanted if len(u) > KEPT_UNIT}
        if long:
            return self._encode_long(split, long, keys)
        return self._encode(split, wanted, keys)

    def _encode(self, split: list[list[str]], wanted: set[str], keys: np.ndarray, places: np.ndarray | None = None) -> list[np.ndarray]:
        """``places`` (of each unit in its text) are 0, 1, ... if not given."""
        new = wanted.difference(self.first)
        if self.nodes + sum(map(len, new)) > self.kept_nodes and self.nodes:
            self._clear()
            new = wanted
        self._learn(sorted(new))
        counts = np.array([len(s) for s in split], np.int64)
        flat_units = [u for s in split for u in s]
        base = np.fromiter(map(self.first.__getitem__, flat_units), np.int64, len(flat_units))
        node = base + np.fromiter(map(len, flat_units), np.int64, len(flat_units))
        place = np.arange(len(base)) - np.repeat(np.cumsum(counts) - counts, counts) if places is None else places
        with np.errstate(over="ignore"):
            seeds = _mix(np.repeat(_mix(keys.astype(np.uint64) ^ _mix(self.seed)), counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        key, back = self.key.view, self.back.view
        alive = np.argsort(base)  # equal units look up the same edges: one after the other
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(alive):
            with np.errstate(over="ignore"):
                draw = (_mix(seeds[alive] + np.uint64(len(steps) + 1) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - BITS)).astype(np.int64)
            edge = np.searchsorted(key, (node[alive] << BITS) + draw, side="right")
            steps.append((alive, edge))
            node[alive] = back[edge]
            alive = alive[node[alive] > base[alive]]
        n_edges = np.zeros(len(base), np.int64)
        for who, _ in steps:
            n_edges[who] += 1
        ends = np.cumsum(n_edges)
        edges = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for i, (who, edge) in enumerate(steps):
            edges[ends[who] - 1 - i] = edge
        size, at = self.size.view[edges].astype(np.int64), self.at.view[edges].astype(np.int64)
        after = np.cumsum(size)
        ids = self.flat.view[np.repeat(at - (after - size), size) + np.arange(int(after[-1]) if len(after) else 0)]
        # ids before each edge, edges before each unit, units before each text
        cut = np.concatenate(([0], after))[np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]]
        return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]


    def _encode_long(self, split: list[list[str]], long: set[str], keys: np.ndarray) -> list[np.ndarray]:
        """Ids of texts with long units: the stretches of short units between them as rows of their own."""
        weights = {u: self._forward(u) for u in long}
        rows: list[list[str]] = []
        row_keys, places, parts = [], [], []
        for units, key in zip(split, keys.tolist(), strict=True):
            mine: list[int | tuple[str, int]] = []  # number of a row, or a long unit and its place
            for place, unit in enumerate(units):
                if unit in weights:
                    mine.append((unit, place))
                    continue
                if not mine or isinstance(mine[-1], tuple):
                    mine.append(len(rows))
                    rows.append([])
                    row_keys.append(key)
                rows[-1].append(unit)
                places.append(place)
            parts.append(mine)
        short = self._encode(rows, set().union(*rows), np.array(row_keys, np.uint64), np.array(places, np.int64)) if rows else []
        out = []
        for mine, key in zip(parts, keys.tolist(), strict=True):
            ids = [self._sample(x[0], weights[x[0]], key, x[1]) if isinstance(x, tuple) else short[x] for x in mine]
            out.append(np.concatenate([np.empty(0, np.int32), *ids]))
        return out

    def _edges(self, unit: str, end: int) -> list[tuple[int, int, float]]:
        """(start, piece id or -1, log-weight) of the edges into a node, by start; ``unit`` with marks for spaces."""
        pieces, out = self.vocab.pieces, []
        for start in range(max(0, end - self.vocab.longest), end):
            found = pieces.get(unit[start:end])
            if found:
                out.append((start, found[0], self.alpha * found[1]))
        if not out or out[-1][0] != end - 1:
            char = ord(unit[end - 1])
            out.append((end - 1, -1, self.byte_score * (1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF))))
        return out

    def _forward(self, unit: str) -> np.ndarray:
        """The forward log-weight of each node."""
        text, out = unit.replace(SPACE, _OUTSIDE).replace(" ", SPACE), np.zeros(len(unit) + 1)
        recent = {0: 0.0}
        for end in range(1, len(text) + 1):
            scores = [recent[start] + weight for start, _, weight in self._edges(text, end)]
            top = max(scores)
            recent[end] = out[end] = top + math.log(sum(math.exp(x - top) for x in scores))
            recent.pop(end - self.vocab.longest, None)
        return out

    def _sample(self, unit: str, weights: np.ndarray, key: int, place: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            seed = _mix(_mix(np.uint64(key) ^ _mix(self.seed)) + np.uint64(place) * np.uint64(0x9E3779B97F4A7C15))
            draws = _mix(seed + np.arange(1, len(unit) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - BITS)
        text = unit.replace(SPACE, _OUTSIDE).replace(" ", SPACE)
        end, out = len(text), []
        for draw in draws.tolist():
            edges = self._edges(text, end)
            total = weights[end]
            for start, piece, weight in edges:
                draw -= math.floor(math.exp(weights[start] + weight - total) * (1 << BITS))
                if draw < 0:
                    break
            out.extend([piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(unit[end - 1].encode())])
            end = start
            if not end:
                break
        return np.array(out[::-1], np.int32)


def _mix(x):
    """The finishing step of the splitmix64 generator."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def decode_ids(ids: Iterable[int], vocab: Vocabulary) -> str:
    return b"".join(map(vocab.bytes_of.__getitem__, ids)).decode()


_TRIES: dict[str, PieceTrie] = {}


def sampler(model: Callable[[], str], alpha: float, seed: int, kept_nodes: int) -> Sampler:
    """A sampler for one task: its lattices go with the task, the vocabulary's trie stays with the worker."""
    path = model()
    if path not in _TRIES:
        _TRIES[path] = PieceTrie(vocabulary(model))
    return Sampler(vocabulary(model), alpha, seed, _TRIES[path], kept_nodes)


def encode(docs: DataFrame, model: Callable[[], str], alpha: float = 1.0, seed: int = 7, key: str = "doc_id", text: str = "text",
           columns: Sequence[str] | None = None, digest: bool = False, kept_nodes: int = KEPT_NODES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``columns`` (default: all but the text) with the ids. ``digest`` gives n_tokens, ids_crc32 and
    whether decoding gives the text back (decoded_equal) in place of token_ids. Input columns named
    like an output column are replaced by it."""
    made = ["n_tokens", "ids_crc32", "decoded_equal"] if digest else ["n_tokens", "token_ids"]
    keep = [c for c in (docs.columns if columns is None else columns) if c.lower() not in made and (columns is not None or c != text)]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(F.col(f"`{key}`").cast("string")).alias("__key"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    kinds = {"n_tokens": T.LongType(), "ids_crc32": T.LongType(), "decoded_equal": T.BooleanType(), "token_ids": T.ArrayType(T.IntegerType())}
    schema = T.StructType([*rows.schema.fields[:-2], *[T.StructField(c, kinds[c]) for c in made]])

    def run(batches):
        draw, vocab = sampler(model, alpha, seed, kept_nodes), vocabulary(model)
        for batch in pieces(batches, "__text", piece_bytes):
            n = batch.num_columns - 2
            texts = batch.column(n + 1).to_pylist()
            ids = draw.encode(texts, batch.column(n).to_numpy().astype(np.int64).view(np.uint64))
            out = [pa.array([len(x) for x in ids], pa.int64())]
            if digest:
                out += [pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array([decode_ids(x.tolist(), vocab) == t for x, t in zip(ids, texts, strict=True)])]
            else:
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *out], [*batch.schema.names[:n], *made])

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model: Callable[[], str], ids: str = "token_ids", text: str = "text") -> DataFrame:
    """``rows`` with the ids replaced by their text (null ids: null)."""
    keep = [c for c in rows.columns if c not in (ids, text)]
    source = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").cast("array<int>").alias("__ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(text, T.StringType())])

    def run(batches):
        vocab = vocabulary(model)
        for batch in batches:
            texts = [None if x is None else decode_ids(x, vocab) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], text])

    return source.mapInArrow(run, schema)


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"), columns=["doc_id"], digest=True)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the documents' columns but the text, with the sampled ids. It shares the workers
    with the stages before it, so it holds less at a time than a query of its own (the ids are the same)."""
    return encode(docs, public_tokenizer("piece_bpe_32k.model"), kept_nodes=800_000, piece_bytes=1 << 20)
