"""Secret scans: fixed patterns, and strings that look random under character Markov models.

Two first-order Markov models are trained in Spark from labelled samples: one of random strings
(the values that the fixed patterns find, and strings drawn with a fixed seed), one of ordinary
identifiers (the other long words of the texts). A candidate string becomes a span if the mean
log-likelihood ratio of its transitions reaches a threshold and it touches no pattern's span.

Spans are code points, end exclusive. Defined cases: a null text counts as empty and, where
texts are rewritten, stays null; a sample without any long word leaves the identifier model flat.
Repeated rows are scanned alike. An empty table gives no rows. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltml.llm.common import load, pieces

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 and more; shorter runs would be dropped
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{8,}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
N_CODES = len(ALPHABET) + 1


@dataclass(frozen=True)
class MarkovPair:
    """ratio[a, b]: log P(b after a | random) - log P(b after a | identifier)."""

    ratio: np.ndarray
    min_ratio: float = 0.75

    def score(self, text: str) -> float:
        c = codes_of(text)
        return float(self.ratio[c[:-1], c[1:]].mean()) if len(c) > 1 else 0.0


def codes_of(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


def find_spans(text: str, model: MarkovPair | None) -> list[tuple[int, int, int, int]]:
    """The fixed patterns' spans and the model's, by start, then kind."""
    base = base_spans(text)
    if model is None:
        return base
    more = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        if not any(s < b and a < e for s, _, e, _ in base) and model.score(m[0]) >= model.min_ratio:
            more.append((a, 3, b, a))
    return sorted(base + more)


def joined(spans: Iterable[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def transitions(texts: Iterable[str]) -> np.ndarray:
    counts = np.zeros(N_CODES * N_CODES, np.int64)
    for t in texts:
        c = codes_of(t)
        counts += np.bincount(c[:-1] * N_CODES + c[1:], minlength=N_CODES * N_CODES)
    return counts


def labelled_strings(text: str) -> tuple[list[str], list[str]]:
    """(values of the fixed patterns, long words that touch none of them)."""
    base = base_spans(text)
    words = [m[0] for m in _WORD.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e, _ in base)]
    return [text[v:e] for _, _, e, v in base], words


def drawn_strings(seed: int = 20_24, each: int = 500, length: int = 32) -> list[str]:
    """Random strings over the usual alphabets of keys: the labelled random class has these at least."""
    draw = random.Random(seed)
    return ["".join(draw.choices(a, k=length)) for a in (ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(each)]


def fit(random_counts: np.ndarray, word_counts: np.ndarray, backoff: float = 10.0, min_ratio: float = 0.75) -> MarkovPair:
    """Transition probabilities that back off to how often a character follows at all: after a character that
    ordinary words hardly hold, their model doesn't turn flat."""
    def log_rows(counts):
        c = counts.reshape(N_CODES, N_CODES)
        follows = (c.sum(axis=0) + 0.5) / (c.sum() + 0.5 * N_CODES)
        return np.log((c + backoff * follows) / (c.sum(axis=1, keepdims=True) + backoff))
    return MarkovPair(log_rows(random_counts) - log_rows(word_counts), min_ratio)


def training_texts(docs: DataFrame, text: str, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` distinct texts, however often one is repeated."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text")).where("text is not null").withColumn("h", F.xxhash64("text"))
    n = rows.agg(F.count_distinct("h")).first()[0]
    if n > sample_rows:
        rows = rows.where(F.shiftrightunsigned("h", 1) < (sample_rows << 63) // n)
    return rows.dropDuplicates(["h"]).select("text")


def train(docs: DataFrame, text: str = "text", sample_rows: int = 20_000, min_ratio: float = 0.75) -> MarkovPair:
    """Fits on about ``sample_rows`` distinct texts, chosen by a hash of the text (all, if there are fewer).
    The driver receives one transition matrix for each label."""
    rows = training_texts(docs, text, sample_rows)

    def count(batches):
        counts = np.zeros((2, N_CODES * N_CODES), np.int64)
        for batch in pieces(batches, "text"):
            for t in batch.column(0).to_pylist():
                for label, strings in enumerate(labelled_strings(t)):
                    counts[label] += transitions(strings)
        label, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[label, at])], ["label", "at", "n"])

    got = rows.mapInArrow(count, "label int, at int, n long").groupBy("label", "at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, N_CODES * N_CODES), np.int64)
    counts[got.column("label").to_numpy(), got.column("at").to_numpy()] = got.column("n").to_numpy()
    return fit(counts[0] + transitions(drawn_strings()), counts[1], min_ratio=min_ratio)


def scan(docs: DataFrame, model: MarkovPair | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, counts of the fixed kinds and of the model's, all spans."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches, "text"):
            found = [find_spans(t, shared.value) for t in batch.column(1).to_pylist()]
            counts = [[sum(x[1] == k for x in f) for f in found] for k in range(4)]
            base = [hashlib.sha256(joined(x for x in f if x[1] < 3).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(base), pa.array([joined(f) for f in found]), pa.array(counts[3], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def redacted(text: str, model: MarkovPair | None, mark: str = "[secret]") -> str:
    """The text with the value of each span replaced; values that touch are replaced by one mark."""
    out, done = [], 0
    for start, end in sorted((v, e) for _, _, e, v in find_spans(text, model)):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join(out) + text[done:] if out else text


def redact(docs: DataFrame, model: MarkovPair | None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with secrets' values replaced, and the length column set anew."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = names.index(text_col)

    def run(batches):
        for batch in pieces(batches, text_col):
            texts = [None if t is None else redacted(t, shared.value) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if length_col in names:
        kind = dict(docs.dtypes)[length_col]
        out = out.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return out


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return scan(docs, train(docs))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, secrets' values replaced."""
    return redact(docs, train(docs))
