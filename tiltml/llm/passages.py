"""Repeated passages: compact windows under min-hashes of word shingles.

Under a hash function, all stretches of a text that share their smallest shingle hash, at the same
place, form a compact window: a node of the Cartesian tree over the hashes, given by the smallest
hash's place and how far it stays the smallest to either side. Only windows that hold an intact run
(``intact_run``) are kept, about two for each such length: passages of ``min_words`` words within the
threshold that are aligned word by word have such a run unchanged (25 of 50 words), wherever their changed
words stand. Two texts that share the run hold, under every function, windows with the same hash around it.

1. Each task computes the compact windows of its texts under ``functions`` hash functions, with a
   hash of half an intact run to either side of the centre.
2. Windows are grouped by hash and half: around the centre of a common run at least one half
   lies in it, so its windows meet; texts that have just a short phrase in common don't. Within a
   group every member is compared with the first one only, so a group of any size costs as many
   comparisons as it has members.
3. Collisions of one pair of texts join to one candidate where their intervals overlap, whatever
   functions they come from, and are verified on the shingles of both: the stretches in which every
   run of ``min_words`` has a similarity (Jaccard, weighted) of at least ``threshold``.
4. If a member's centre lies in no verified stretch with the first member, all members of the key, the
   settled ones and the first included, are grouped anew, by every run of ``min_words`` words in their
   window (who shares one repeats it exactly, so again one comparison with the first of a group settles
   it). No exact repetition is given up because a third text came first.
5. Keys with a member whose centre still lies in no verified stretch are settled by near-equal passages:
   their members are compared again, on a passage's length to either side of the centre, with the first
   one of the key, and with the first one of the key and the smallest hash, under ``NEAR_FUNCTIONS``
   other functions, of a run around the centre. Near-equal members mostly share the latter; a third text
   with a shorter phrase mostly doesn't.

Words are runs of non-space characters, A-Z in lower case; places are word numbers, end exclusive.
Defined cases: null texts and texts shorter than ``min_words`` have no passage. A text is compared
with itself too: a passage that it repeats is reported with its own id, but for repetitions with a
period under ``min_words``, which count as one stretch. Rows that repeat an id are
texts of their own, told apart by ``text_hash``; equal rows count once. Rows with null ids take
part. Empty tables give no rows. Texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltml.llm.common import load, materialize, pieces

SHINGLE, MIN_WORDS, FUNCTIONS, THRESHOLD = 5, 50, 2, 0.8
PIECE = 512 << 10  # bytes of text that numpy works on at once; more don't stay in a core's cache
NEAR_FUNCTIONS = 4  # by whose minima open members are grouped anew
# A window in one long: centre << 32 | function << 30 | extent to the left << 15 | to the right.
_FAR = (1 << 15) - 1
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): every word of each text, text after text. All bytes of the texts go through numpy at
    once: a word's hash is the difference of two running sums over its bytes."""
    data = [(t or "").encode().lower() for t in texts]
    raw = np.frombuffer(b"\n" + b"\n".join(data) + b"\n", np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    sums, down = _rolling(raw.astype(np.uint64) + np.uint64(1))
    hashes = _mix((sums[ends] - sums[starts]) * down[starts])
    after = np.cumsum([len(d) + 1 for d in data])  # place of the line end behind each text
    return hashes, np.diff(np.searchsorted(starts, after), prepend=0)


def shingle_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the five-word shingle at each word but the last four of each text, text after text."""
    h, sizes = word_hashes(texts)
    counts = np.maximum(sizes - SHINGLE + 1, 0)
    out = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        out = _mix(out * _MULTIPLY + h[k:k + len(out)])
    return out[_spans(np.cumsum(sizes) - sizes, counts)], counts


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] places, then the next."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def compact_windows(values: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right), ends inclusive, of the compact windows that hold ``width`` values, of lists of
    ``counts`` values that follow one another. Of equal values the leftmost is the smallest.

    A centre is the smallest of some run of ``width``. The smaller value next to either side is a centre too
    if it is a run or more away; so the centres alone give the far extents, and the nearer ones are looked up
    within a run. Extents are found by halving steps over the smallest of blocks.
    """
    n = len(values)
    starts = np.cumsum(counts) - counts
    valid = _spans(starts, np.maximum(counts - width + 1, 0))
    if not len(valid):
        return (np.empty(0, np.int64),) * 3
    # A centre is as small as the smallest of some run, which is the largest of its runs' smallest.
    least = np.zeros(n + width - 1, values.dtype)  # by run, at its first place + width - 1
    least[valid + width - 1] = ~_run_largest(~values, width)[valid]
    centres = np.flatnonzero(_run_largest(least, width)[:n] == values)
    owner = np.repeat(np.arange(len(counts)), counts)[centres]
    first, last = starts[owner], starts[owner] + counts[owner] - 1
    own = values[centres]
    near = (width - 1).bit_length()
    # Far extents: the next smaller centre of the same list. Of equal values the left one is the smaller.
    held = np.bincount(owner, minlength=len(counts))
    far = int(held.max()).bit_length()
    low = (np.cumsum(held) - held)[owner]
    number = np.arange(len(centres))
    after = _reach(own, number, own, low + held[owner] - number - 1, far, 1)
    before = _reach(own, number, own, number - low, far, -1)
    right = np.where(number + after + 1 < low + held[owner], centres[np.minimum(number + after + 1, len(centres) - 1)] - 1, last)
    left = np.where(number - before - 1 >= low, centres[np.maximum(number - before - 1, 0)] + 1, first)
    # Nearer extents: the first smaller value within a run.
    for sign, end in ((1, right), (-1, left)):
        steps = np.minimum(np.abs(end - centres), (1 << near) - 1)
        got = _reach(values, centres, own, steps, near, sign)
        end[:] = np.where(got < steps, centres + sign * got, end)
    wide = right - left + 1 >= width
    return left[wide], centres[wide], right[wide]


def _run_largest(values: np.ndarray, width: int) -> np.ndarray:
    """The largest of each run of ``width`` values, by its first place (of 0 behind the last one): blocks of
    ``width`` hold prefix and suffix maxima."""
    n = len(values)
    grid = np.concatenate((values, np.zeros(-n % width + width, values.dtype))).reshape(-1, width)
    before = np.maximum.accumulate(grid, axis=1).ravel()
    after = np.maximum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(after[:n], before[width - 1:width - 1 + n])


def _reach(values: np.ndarray, at: np.ndarray, own: np.ndarray, most: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """How many values in a row beside each place, ``most`` at most (under 2 ** ``bits``), aren't smaller than
    its own; to the left (``sign`` -1) equal ones are smaller."""
    blocks = [values]  # blocks[k][i]: the smallest of 2 ** k values from i
    for k in range(bits - 1):
        b = blocks[-1]
        blocks.append(np.minimum(b[:-(1 << k)], b[1 << k:]) if len(b) > 1 << k else b[:0])
    got = np.zeros(len(at), np.int64)
    for k in reversed(range(bits)):
        size, b = 1 << k, blocks[k]
        if not len(b):
            continue
        start = at + got + 1 if sign > 0 else at - got - size
        smallest = b[np.clip(start, 0, len(b) - 1)]
        got += size * ((got + size <= most) & ((smallest >= own) if sign > 0 else (smallest > own)))
    return got


def _rolling(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of position-weighted hashes and the weights' inverses."""
    powers = np.cumprod(np.full(len(hashes), _MULTIPLY, np.uint64))
    inverse = np.uint64(pow(int(_MULTIPLY), -1, 1 << 64))
    down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(hashes), inverse, np.uint64))))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers))), down


def _stretch(rolled: tuple[np.ndarray, np.ndarray], start: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hashes of the stretches of ``size`` from each start, wherever they stand."""
    return (rolled[0][start + size] - rolled[0][start]) * rolled[1][start]


def needed(width: int, threshold: float) -> int:
    """How many shingles two runs of ``width`` have in common at least, to reach the threshold."""
    return int(-(-2 * threshold * width // (1 + threshold)))


def intact_run(width: int, threshold: float) -> int:
    """Length of the longest run of shingles that two aligned runs of ``width`` within the threshold surely have
    in common: a change that doesn't touch an end breaks ``SHINGLE - 1`` shingles or more, so few fit in."""
    need = needed(width, threshold)
    return -(-need // (1 + (width - need) // (SHINGLE - 1)))


def window_rows(hashes: np.ndarray, counts: np.ndarray, functions: int, width: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, window, list's number): each compact window once for either side on which half an intact run fits.
    Extents of over ``_FAR`` words are cut: a passage that long holds many more centres."""
    whole = intact_run(width, threshold)
    half = (whole - 1) // 2
    rolled = _rolling(hashes)
    starts = np.cumsum(counts) - counts
    owner_of = np.repeat(np.arange(len(counts)), counts)
    out = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    for f in range(functions):
        left, centre, right = compact_windows(_mix(hashes ^ np.uint64((f + 1) * 0xA0761D6478BD642F % (1 << 64))), counts, whole)
        owner = owner_of[centre]
        window = centre - starts[owner] << 32 | f << 30 | np.minimum(centre - left, _FAR) << 15 | np.minimum(right - centre, _FAR)
        for side, fits, start in ((1, centre + half <= right, centre), (2, centre - half >= left, centre - half)):
            key = _mix(_stretch(rolled, start[fits], half + 1) ^ np.uint64(f * 4 + side))
            # Where a text repeats itself with a period under ``width``, the first centre stands for the chain.
            order = np.lexsort((centre[fits], key))
            key, place, own = key[order], centre[fits][order], owner[fits][order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1]) | (np.diff(place) >= width)
            out.append((key[new], window[fits][order][new], own[new]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def verified(a: np.ndarray, b: np.ndarray, spots: list[tuple[int, int, int, int]], width: int, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start in b, end in b, similarity) of the near-equal stretches of two shingle lists, ends
    exclusive. ``spots``: aligned stretches (start, end, start in b, end in b) in which to look."""
    need = needed(width, threshold)
    out: list[tuple[int, int, int, int, float]] = []
    for start, end, start_b, end_b in sorted(set(spots)):
        shift = start_b - start
        low, high = max(start, -shift), min(end, len(b) - shift)
        if high - low < width:
            continue
        if any(o[0] <= low and high <= o[1] and o[2] - o[0] == shift for o in out):
            continue
        x, y = a[low:high], b[low + shift:high + shift]
        if np.array_equal(x, y):
            out.append((low, high, low + shift, high + shift, 1.0))
            continue
        same = np.concatenate(([0], np.cumsum(x == y)))
        good = (same[width:] - same[:-width]) >= need
        if not good.all():
            hits = np.concatenate(([0], np.cumsum(_among(x, y))))
            unsure = np.flatnonzero(~good & ((hits[width:] - hits[:-width]) >= need))
            # Runs near one another are counted together.
            for part in np.split(unsure, np.flatnonzero(np.diff(unsure) > width) + 1) if len(unsure) else ():
                i, j = int(part[0]), int(part[-1])
                good[i:j + 1] |= sliding_overlap(x[i:j + width], y[i:j + width], width) >= need
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.astype(np.int8), [0]))))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            stop = j - 1 + width
            # Only words that both have end a stretch.
            if x[i] != y[i] or x[stop - 1] != y[stop - 1]:
                inside = np.flatnonzero(_among(x[i:stop], y[i:stop]))
                i, stop = i + int(inside[0]), i + int(inside[-1]) + 1
            score = similarity(x[i:stop], y[i:stop])
            if score < threshold:  # each run reaches it, but not all together: the best run stands
                i = int(i + np.argmax(same[i + width:stop + 1] - same[i:stop + 1 - width])) if stop - i >= width else j - 1
                stop = i + width
                score = similarity(x[i:stop], y[i:stop])
            if score >= threshold:
                out.append((low + i, low + stop, low + i + shift, low + stop + shift, score))
    return out


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y (not empty)."""
    held = np.sort(y)
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


def sliding_overlap(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Size of the common bag of x[i:i + width] and y[i:i + width], for every i, by one step from the last."""
    out, both = [], 0
    # for each value: how often it is in x's run less how often in y's
    ahead: dict[int, int] = {}
    xs, ys = x.tolist(), y.tolist()
    for i, (a, b) in enumerate(zip(xs, ys, strict=True)):
        d = ahead.get(a, 0)
        both += d < 0
        ahead[a] = d + 1
        d = ahead.get(b, 0)
        both += d > 0
        ahead[b] = d - 1
        if i >= width - 1:
            out.append(both)
            a, b = xs[i - width + 1], ys[i - width + 1]
            # x loses a: common if y's run has at least as many
            d = ahead[a]
            both -= d <= 0
            ahead[a] = d - 1
            d = ahead[b]
            both -= d >= 0
            ahead[b] = d + 1
    return np.array(out, np.int64)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    if np.array_equal(x, y):
        return 1.0
    x, y = np.sort(x), np.sort(y)
    # The k-th of equal values of x has a partner if y holds more than k.
    nth = np.arange(len(x)) - np.searchsorted(x, x)
    both = int((nth < np.searchsorted(y, x, side="right") - np.searchsorted(y, x)).sum())
    return both / (len(x) + len(y) - both)


def _member():
    """A window of a text, ordered by id (nulls last), text and place."""
    return F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash", "window").alias("m")


def unpacked(window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function, centre, left, right) of packed windows."""
    centre = window >> 32
    return window >> 30 & 3, centre, centre - (window >> 15 & _FAR), centre + (window & _FAR)


def windows_of(texts: DataFrame, functions: int, width: int, threshold: float) -> DataFrame:
    """key, doc_id, text_hash, window for each compact window side of ``texts`` (doc_id, text_hash, text)."""
    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            with np.errstate(over="ignore"):
                key, window, who = window_rows(*shingle_hashes(batch.column(2).to_pylist()), functions, width, threshold)
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(window, pa.int64())],
                                             ["key", "doc_id", "text_hash", "window"])

    return texts.mapInArrow(run, "key long, doc_id long, text_hash long, window long")


def shingles_table(texts: DataFrame) -> DataFrame:
    """doc_id, text_hash, shingles: the upper halves of the shingle hashes, to verify passages by."""
    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            with np.errstate(over="ignore"):
                hashes, counts = shingle_hashes(batch.column(2).to_pylist())
            short = (hashes >> np.uint64(32)).astype("<u4")
            data = [x.tobytes() for x in np.split(short, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["doc_id", "text_hash", "shingles"])

    return texts.mapInArrow(run, "doc_id long, text_hash long, shingles binary")


def near_keys(hashes: np.ndarray, keys: np.ndarray, centres: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the centre): each centre's key, and its key with the smallest hash, under each of ``NEAR_FUNCTIONS``
    functions, of every run of ``width`` that holds the centre. Near-equal runs mostly have it in common."""
    low, high = np.maximum(centres - width + 1, 0), np.minimum(centres, len(hashes) - width)
    counts = np.maximum(high - low + 1, 0)
    spans, who = _spans(low, counts), np.repeat(np.arange(len(centres)), counts)
    out = [(keys, np.arange(len(keys)))]
    if len(spans):
        new = np.ones(len(spans), bool)
        for g in range(NEAR_FUNCTIONS):
            salt = np.uint64((g + 1) * 0x8EBC6AF09C88C6E3 % (1 << 64))
            smallest = np.lib.stride_tricks.sliding_window_view(_mix(hashes ^ salt), width).min(axis=1)[spans]
            new[1:] = (smallest[1:] != smallest[:-1]) | (who[1:] != who[:-1])
            out.append((_mix(_mix(smallest[new] ^ salt) + keys[who[new]]), who[new]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _with_shingles(held: DataFrame, table: DataFrame) -> DataFrame:
    own = table.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), "shingles")
    return held.join(own, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__t"))).drop("__d", "__t")


def exact_runs(rest: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """key, m: each window of ``rest`` (doc_id, text_hash, window) under the hash of every run of ``width``
    shingles that holds its centre and lies in it, so that the centre has one place in equal runs."""
    # a text's windows are at most as many as its words
    held = rest.groupBy("doc_id", "text_hash").agg(F.collect_set("window").alias("windows"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = np.frombuffer(batch.column(3)[i].as_py(), "<u4").astype(np.uint64)
                windows = batch.column(2)[i].values.to_numpy()
                f, c, left, right = unpacked(windows)
                low, high = np.maximum(left, c - width + 1), np.minimum(c, np.minimum(right, len(hashes) - 1) - width + 1)
                counts = np.maximum(high - low + 1, 0)
                with np.errstate(over="ignore"):
                    key = _mix(_stretch(_rolling(_mix(hashes)), _spans(low, counts), width) ^ np.repeat(f, counts).astype(np.uint64))
                at = pa.array(np.full(len(key), i))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.repeat(windows, counts))],
                                                 ["key", "doc_id", "text_hash", "window"])

    rows = _with_shingles(held, table).mapInArrow(run, "key long, doc_id long, text_hash long, window long")
    return rows.select("key", _member())


def near_runs(rest: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """key, m: each window of ``rest`` (key, doc_id, text_hash, window) under its ``near_keys``."""
    held = rest.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("key", "window")).alias("held")).select(
        "doc_id", "text_hash", F.col("held.key").alias("keys"), F.col("held.window").alias("windows"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = np.frombuffer(batch.column(4)[i].as_py(), "<u4").astype(np.uint64)
                keys, windows = (batch.column(j)[i].values.to_numpy() for j in (2, 3))
                with np.errstate(over="ignore"):
                    key, who = near_keys(hashes, keys.view(np.uint64), windows >> 32, width)
                at = pa.array(np.full(len(key), i))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(windows[who])],
                                                 ["key", "doc_id", "text_hash", "window"])

    rows = _with_shingles(held, table).mapInArrow(run, "key long, doc_id long, text_hash long, window long")
    return rows.select("key", _member())


def uncovered(rest: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``rest`` (key, doc_id, text_hash, window) whose centre lies in no verified stretch, on either side."""
    stretches = found.select("doc_id", "text_hash", "start_word", "end_word").union(found.select("of_doc_id", "of_text_hash", "of_start_word", "of_end_word")).distinct()
    # a text's stretches hold its centres, its windows are at most as many as its words
    by_text = stretches.groupBy(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).agg(F.collect_list("start_word").alias("starts"), F.collect_list("end_word").alias("ends"))
    held = rest.groupBy("doc_id", "text_hash").agg(F.collect_list("key").alias("keys"), F.collect_list("window").alias("windows"))
    both = held.join(by_text, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__t")), "left").select("doc_id", "text_hash", "keys", "windows", "starts", "ends")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, windows = (batch.column(j)[i].values.to_numpy() for j in (2, 3))
                open_ = np.ones(len(windows), bool)
                if batch.column(4)[i].is_valid:
                    starts, ends = (batch.column(j)[i].values.to_numpy() for j in (4, 5))
                    order = np.argsort(starts)
                    reach = np.concatenate(([0], np.maximum.accumulate(ends[order] - SHINGLE + 1)))
                    open_ = reach[np.searchsorted(starts[order], windows >> 32, side="right")] <= windows >> 32
                at = pa.array(np.full(int(open_.sum()), i))
                yield pa.RecordBatch.from_arrays([pa.array(keys[open_]), batch.column(0).take(at), batch.column(1).take(at), pa.array(windows[open_])], ["key", "doc_id", "text_hash", "window"])

    return both.mapInArrow(run, "key long, doc_id long, text_hash long, window long")


_COLUMNS = ["doc_id", "text_hash", "start_word", "end_word", "of_doc_id", "of_text_hash", "of_start_word", "of_end_word", "similarity", "n_functions"]
_CHECKED = ("doc_id long, text_hash long, start_word int, end_word int, of_doc_id long, of_text_hash long, of_start_word int, of_end_word int, "
            "similarity double, n_functions int, open array<struct<key: long, window: long>>")
_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("of_doc_id", pa.int64()),
                    ("of_text_hash", pa.int64()), ("of_start_word", pa.int32()), ("of_end_word", pa.int32()), ("similarity", pa.float64()), ("n_functions", pa.int32()),
                    ("open", pa.list_(pa.struct([("key", pa.int64()), ("window", pa.int64())])))])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, functions: int = FUNCTIONS, threshold: float = THRESHOLD) -> DataFrame:
    """One row a verified stretch: doc_id, text_hash, start_word, end_word, the same of the text that it
    repeats (of_*), similarity, and how many functions' centres it holds."""
    if not 1 <= functions <= 4:
        raise ValueError("1 to 4 functions")
    width = min_words - SHINGLE + 1
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    with _shuffles_freed(docs.sparkSession):
        steps = _steps(texts, functions, width, threshold)
    found = steps[0]
    for step in steps[1:]:
        found = found.unionByName(step)
    return found.where("start_word is not null").select(*_COLUMNS).distinct()


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """While a step is written, only its own shuffle files lie on disk: Spark deletes them when the step ends. Pairs of a task,
    each with few collisions, are gathered by hash."""
    ours = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384"}
    before = {name: spark.conf.get(name, None) for name in ours}
    try:
        for name, value in ours.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _steps(texts: DataFrame, functions: int, width: int, threshold: float) -> list[DataFrame]:
    """Verified stretches and open collisions of the first comparison, of exact repetitions and of near-equal passages. What
    Python makes and two branches read (windows, runs) is written once."""
    windows = materialize(windows_of(texts, functions, width, threshold), "windows")
    # Keys with more than one window; equal rows are one member.
    keys = materialize(windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    pending = materialize(windows.join(keys.hint("shuffle_hash"), "key", "left_semi").select("key", _member()).distinct(), "windows")
    _drop(windows)
    _drop(keys)
    table = materialize(_semi(shingles_table(texts), pending.select("m.doc_id", "m.text_hash").distinct()).dropDuplicates(["doc_id", "text_hash"]), "shingles")
    checked = materialize(_verify(_links(pending), table, width, threshold, repeated=False), "passages")
    rest = checked.where("start_word is null").select("doc_id", "text_hash", F.explode("open").alias("hit")).select("hit.key", "doc_id", "text_hash", "hit.window")
    # All members of a key with an open one: it may repeat a text that the first one settles.
    members = pending.join(rest.select("key").distinct(), "key", "left_semi").select("m.doc_id", "m.text_hash", "m.window")
    runs = materialize(exact_runs(members, table, width), "runs")
    exact = materialize(_verify(_anew(runs), table, width, threshold), "passages")
    _drop(runs)
    found = checked.unionByName(exact).where("start_word is not null")
    # Centres in no exact repetition: their texts are near-equal to another of the key, or to none.
    keys = uncovered(rest, found).select("key").distinct()
    members = pending.join(keys, "key", "left_semi").select("key", "m.doc_id", "m.text_hash", "m.window")
    runs = materialize(near_runs(members, table, width), "runs")
    near = materialize(_verify(_anew(runs), table, width, threshold, width - 1), "passages")
    _drop(runs)
    return [checked, exact, near]


def _drop(table: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing reads it any more."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(folder))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _links(members: DataFrame) -> DataFrame:
    """Every member of a key's group with the group's first one."""
    first = members.groupBy("key").agg(F.min("m").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    return members.join(first.hint("shuffle_hash"), "key").where(F.col("m") != F.col("first")).select(
        "key",
        F.col("m.doc_id").alias("doc_id"), F.col("m.text_hash").alias("text_hash"), F.col("m.window").alias("window"),
        F.col("first.doc_id").alias("of_doc_id"), F.col("first.text_hash").alias("of_text_hash"), F.col("first.window").alias("of_window"))


def _anew(members: DataFrame) -> DataFrame:
    """The links of members that stood under many keys."""
    return _links(members).withColumn("key", F.lit(0).cast("long"))


def _verify(links: DataFrame, table: DataFrame, width: int, threshold: float, reach: int = 0, repeated: bool = True) -> DataFrame:
    """Verified stretches of every pair, and one row with the collisions that lie in none (start_word null). They
    are looked for where both windows lie, and ``reach`` shingles from their centre to either side. A link may come twice if ``repeated``."""
    pair = ["doc_id", "text_hash", "of_doc_id", "of_text_hash"]
    # A pair's collisions are at most as many as its texts have windows. Members that stand under many keys meet the same one often.
    hits = (F.collect_set if repeated else F.collect_list)(F.struct("window", "of_window", "key"))
    pairs = links.groupBy(*pair).agg(hits.alias("h")).select(*pair, F.col("h.window").alias("hits"), F.col("h.of_window").alias("of_hits"), F.col("h.key").alias("keys"))
    own = table.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), F.col("shingles").alias("a"))
    other = table.select(F.col("doc_id").alias("__e"), F.col("text_hash").alias("__u"), F.col("shingles").alias("b"))
    both = pairs.join(own, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__t"))).drop("__d", "__t")
    both = both.join(other, F.col("of_doc_id").eqNullSafe(F.col("__e")) & (F.col("of_text_hash") == F.col("__u"))).select(*pair, "hits", "of_hits", "keys", "a", "b")

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for i in range(batch.num_rows):
                names = {k: batch.column(j)[i].as_py() for j, k in enumerate(pair)}
                hits, of_hits, keys = (batch.column(j)[i].values.to_numpy() for j in (4, 5, 6))
                a, b = (np.frombuffer(batch.column(j)[i].as_py(), "<u4") for j in (7, 8))
                rows += [names | r for r in _checked_pair(a, b, hits, of_hits, keys, width, threshold, reach)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)

    return both.mapInArrow(run, _CHECKED)


def _checked_pair(a: np.ndarray, b: np.ndarray, hits: np.ndarray, of_hits: np.ndarray, keys: np.ndarray, width: int, threshold: float, reach: int) -> list[dict]:
    f, c, left, right = unpacked(hits)
    _, of_c, of_left, of_right = unpacked(of_hits)
    # a near-equal passage that holds the centre may go on behind smaller hashes
    back, ahead = (np.maximum(np.minimum(x, y), reach) for x, y in ((c - left, of_c - of_left), (right - c, of_right - of_c)))
    stretches = verified(a, b, joined_spots(np.maximum(c - back, 0), np.minimum(c + ahead + 1, len(a)), of_c - c), width, threshold)
    out: list[dict] = []
    covered = np.zeros(len(hits), bool)
    for start, end, of_start, of_end, score in stretches:
        inside = (start <= c) & (c < end) & (of_start <= of_c) & (of_c < of_end)
        covered |= inside
        out.append({"start_word": start, "end_word": end + SHINGLE - 1, "of_start_word": of_start, "of_end_word": of_end + SHINGLE - 1, "similarity": score,
                    "n_functions": len(np.unique(f[inside]))})
    return out if covered.all() else [*out, {"open": [{"key": k, "window": w} for k, w in zip(keys[~covered].tolist(), hits[~covered].tolist(), strict=True)]}]


def joined_spots(starts: np.ndarray, ends: np.ndarray, shifts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Interval join of a pair's collisions: on each diagonal, overlapping windows become one stretch, over all functions."""
    out: list[list[int]] = []
    for shift, start, end in sorted(set(zip(shifts.tolist(), starts.tolist(), ends.tolist(), strict=True))):
        if out and out[-1][2] == shift and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, shift])
    return [(start, end, start + shift, end + shift) for start, end, shift in out]


def _semi(left: DataFrame, right: DataFrame) -> DataFrame:
    named = right.select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash"))
    return left.join(named, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_hash") == F.col("__text_hash")), "left_semi")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(load(spark, sf_dir, "documents"))
    return found.drop("text_hash", "of_text_hash")
