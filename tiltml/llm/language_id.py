"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per (language, bucket) in a distributed pass over all labelled rows;
only the ``languages x buckets`` count matrix reaches the driver, which turns it into
log-probabilities and broadcasts them. Scoring is a sparse product in numpy: the n-gram
buckets of many texts form one index array, the matrix rows are gathered at those indices
and added up per text.

Defined cases: a null text, an empty text and a text without a letter get ``und`` with score
0; so does every text if nothing was learned. Rows with a null language, and rows without a
letter, are not learned from. Ties go to the smaller language name. Repeated rows count as
often as they occur. NUL characters take part in no n-gram. Input columns named like an output
column are replaced by it. Texts of any length are scored whole, in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltml.llm.common import load, pieces

UNKNOWN = "und"
SIZES = (1, 2, 3)
_LETTER = regex.compile(r"\p{L}")
# Odd multipliers of the n-gram hash, one for each character place.
_PLACES = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], dtype=np.uint32)
_BLOCK = 1 << 20


@dataclass(frozen=True)
class NaiveBayes:
    """languages (sorted), log priors, and log-probabilities of shape (languages, buckets + 1);
    the last bucket stands for "no n-gram" and adds nothing."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    bits: int
    sizes: tuple[int, ...]


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def buckets_of(codes: np.ndarray, n: int, bits: int, limit: int | None = None) -> np.ndarray:
    """Bucket of the n-gram at each start (of the first ``limit`` starts); 2**bits where it holds a NUL."""
    m = len(codes) - n + 1
    if limit is not None:
        m = min(m, limit)
    if m <= 0:
        return np.empty(0, np.int64)
    h = np.full(m, n * 40503, np.uint32)
    void = np.zeros(m, bool)
    for k in range(n):
        c = codes[k:k + m]
        h += c * _PLACES[k]
        void |= c == 0
    h ^= h >> np.uint32(15)
    h *= np.uint32(2654435769)
    out = (h >> np.uint32(32 - bits)).astype(np.int64)
    out[void] = 1 << bits
    return out


def blocks_of(texts: Sequence[str], sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int | None]]:
    """(text numbers, codes, start of each text, limit of starts): lower-cased texts between
    spaces, NUL-separated, joined to blocks of bounded size; a longer text is cut into pieces that
    overlap by the longest n-gram less one, of which only the first ``limit`` starts count."""
    over = max(sizes) - 1
    held: list[str] = []
    numbers: list[int] = []
    total = 0

    def joined():
        lengths = np.array([len(t) + 1 for t in held])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return np.array(numbers), codes_of("\0".join(held) + "\0"), starts, None

    for i, text in enumerate(texts):
        t = f" {text.lower()} "
        if len(t) > _BLOCK:
            for s in range(0, len(t), _BLOCK):
                yield np.array([i]), codes_of(t[s:s + _BLOCK + over]), np.array([0]), _BLOCK
            continue
        if total + len(t) > _BLOCK and held:
            yield joined()
            held, numbers, total = [], [], 0
        held.append(t)
        numbers.append(i)
        total += len(t)
    if held:
        yield joined()


def log_scores(texts: Sequence[str], model: NaiveBayes) -> np.ndarray:
    """Log joint probability of each text (row) with each language (column)."""
    out = np.tile(model.log_prior, (len(texts), 1))
    for numbers, codes, starts, limit in blocks_of(texts, model.sizes):
        for n in model.sizes:
            idx = buckets_of(codes, n, model.bits, limit)
            if not len(idx):
                continue
            # A start past the end belongs to a last text shorter than n: it adds nothing.
            at = np.minimum(starts, len(idx) - 1)
            for k, row in enumerate(model.log_prob):
                sums = np.add.reduceat(row[idx], at)
                sums[starts >= len(idx)] = 0.0
                out[numbers, k] += sums
    return out


def predict_texts(texts: Sequence[str | None], model: NaiveBayes) -> tuple[list[str], list[float]]:
    """Language and posterior probability of each text."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if has_letter(t)]
    if not known or not model.languages:
        return langs, scores
    joint = log_scores([texts[i] for i in known], model)
    best = joint.argmax(axis=1)
    posterior = 1.0 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
    for i, b, p in zip(known, best, posterior, strict=True):
        langs[i], scores[i] = model.languages[b], float(p)
    return langs, scores


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", bits: int = 15,
          sizes: tuple[int, ...] = SIZES, alpha: float = 0.5, max_languages: int = 256) -> NaiveBayes:
    """Fits on every row of ``labelled``. The driver receives at most ``max_languages * 2**bits``
    counts; more languages are an error, since the matrix is broadcast."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where(
        "lang is not null and text is not null")
    names = sorted(r[0] for r in rows.select("lang").distinct().limit(max_languages + 1).collect())
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages knowingly")

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text"):
            groups: dict[str, list[str]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(t):
                    groups.setdefault(name, []).append(t)
            for name, texts in groups.items():
                c = counts.setdefault(name, np.zeros((1 << bits) + 1, np.int64))
                c[-1] += len(texts)
                for _, codes, _, limit in blocks_of(texts, sizes):
                    for n in sizes:
                        idx = buckets_of(codes, n, bits, limit)
                        c[:-1] += np.bincount(idx, minlength=(1 << bits) + 1)[:-1]
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    total = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = total.toArrow()
    place = {name: i for i, name in enumerate(names)}
    matrix = np.zeros((len(names), (1 << bits) + 1), np.int64)
    if got.num_rows:
        at = np.array([place[x] for x in got.column("lang").to_pylist()])
        matrix[at, got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    seen = matrix[:, -1] > 0
    return fit([n for n, s in zip(names, seen, strict=True) if s], matrix[seen, -1], matrix[seen, :-1], bits, sizes, alpha)


def fit(names: list[str], documents: np.ndarray, counts: np.ndarray, bits: int, sizes: tuple[int, ...], alpha: float) -> NaiveBayes:
    """Add-alpha smoothed log-probabilities from document counts and bucket counts by language."""
    smooth = counts + alpha
    log_prob = np.zeros((len(names), (1 << bits) + 1))
    if len(names):
        log_prob[:, :-1] = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return NaiveBayes(names, np.log(documents / max(1, documents.sum())), log_prob, bits, tuple(sizes))


def identify(docs: DataFrame, model: NaiveBayes, text: str = "text", columns: Sequence[str] | None = None,
             lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``columns`` (default: all) of ``docs`` with the predicted language and its posterior. No shuffle."""
    keep = [c for c in (docs.columns if columns is None else columns) if c.lower() not in (lang_out, score_out)]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches, "__text"):
            last = batch.num_columns - 1
            langs, scores = predict_texts(batch.column(last).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names[:last], lang_out, score_out])

    return source.mapInArrow(run, schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that the fixed split gives to training: crc32 of the id as text, mod 3, is not 1."""
    return docs.where(~held_out_column())


def held_out_column():
    """A null id counts as the empty text, so its row is learned from."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3) == 1


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train(learnable(docs))
    return identify(docs.select("doc_id", held_out_column().alias("held_out"), "text"), model, columns=["doc_id", "held_out"])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = 0.5) -> DataFrame:
    """Pipeline stage: keeps the documents whose language is told with a posterior of at least ``min_score``."""
    out = identify(docs, train(learnable(docs)), lang_out="__lang", score_out="__score")
    return out.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= min_score)).select(*[f"`{c}`" for c in docs.columns])
