"""Repair of conversations by the cheapest edits, found by bidirectional Dijkstra.

Rows of a conversation are put in order, each gets at most one fault (blank, duplicate, truncated),
and the cheapest sequence of edits is searched that makes the roles' initials ``(s?(ua)+)?``. The
lattice has a node for every number of rows consumed and every state of that pattern (nothing yet,
after ``s``, after ``u``, after ``a``). Its edges are the edits: Keep 0, Rerole 2, Delete 3, Insert 2,
and 1 more for a truncated row that stays. A node has at most one edge of each letter, so the
letters in order (the audit) name a path.

A forward heap starts at the first node and a reverse heap at the accepting ones. They go on until the
sum of their smallest keys is over the best meeting, so that every node of every cheapest path is
settled on one side and all crossings of equal cost are known. Nodes that lead to such a crossing are
marked backwards; then the path takes the least letter that stays on a cheapest path, which makes
its audit the least of all concatenated ones. Conversations of more than ``SEGMENT`` rows are searched in
segments: from the last to the first for the costs to go of the four states at each border, then
forward for the audit, so that a search never holds more than a segment's lattice.

Rows of a conversation meet in one task sorted by turn, since its repaired text is one sequence. They
stream through it: a byte a row stays in memory, texts go to a temporary file of the task beyond 16 MB.

Defined cases: a null role or text is one space, a null turn comes before all others and counts for no
gap, a null conv_id is a conversation of its own. Rows of equal turn are ordered by role and text, equal
rows stay side by side. An empty role has no initial: it can be reroled or deleted. Other columns
aren't read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiltml.llm.common import load

# Costs of the edits, and white space as byte values.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = r"\x20\x09-\x0D"

SEGMENT = 50_000
HELD_BYTES = 16 << 20
CACHED = 50_000
INF = 1 << 60

# States of (s?(ua)+)?: nothing yet, after s, after u, after a. NEXT[x][state]: the state after initial x
# (0 s, 1 u, 2 a, 3 any other), -1 if it doesn't fit. MADE[state]: the state after a made user or assistant turn.
NEXT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
MADE = (2, 2, 3, 2)
ACCEPT = ((0, 0), (3, 0))
INITIALS = {"s": 0, "u": 1, "a": 2}
SOUND, GONE, CUT = 0, 4, 8  # added to the initial's number: no fault, blank or duplicate, truncated


# --------------------------------------------------------------------------- rows

def damaged(rows: DataFrame) -> DataFrame:
    """The table with seeded faults: crc32 of ``conv_id:turn`` modulo 20 drops a row (0; it stays as a row of no
    copies), empties its text (1), takes its ends of sentences (2), repeats it (3) or sets its role (4)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    staged = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    k = F.col("kind")
    return staged.select("conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                         F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                         F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, fault of each row, partitioned by conversation and in its order. Texts of blank and
    repeated rows are left out: no repair keeps them. A repeated row's faults are those of its first copy; the others are duplicates."""
    blank = ~F.col("text").rlike(rf"[^{SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    there = F.col("copies") > 0
    earlier = F.row_number().over(Window.partitionBy("conv_id", there, "role", "text").orderBy("turn")) > 1
    fault = F.when(blank, "blank").when(earlier, "duplicate").when(cut, "truncated").otherwise("none")
    out = rows.repartition("conv_id").select("conv_id", "turn", "role", "text", "copies", F.when(there, fault).otherwise("none").alias("fault"))
    out = out.sortWithinPartitions("conv_id", "turn", "role", "text", F.col("fault") == "duplicate")
    return out.withColumn("text", F.when(there & F.col("fault").isin("none", "truncated"), F.col("text")))


# --------------------------------------------------------------------------- search

def _edges(codes: bytes, i: int, s: int, inserts: bool) -> list[tuple[str, int, int, int]]:
    """(letter, rows consumed, state, cost) of the edits at a node, least letter first."""
    out = []
    if i < len(codes):
        c = codes[i]
        stays = c < GONE or c >= CUT
        more = TRUNCATED if c >= CUT else 0
        out.append(("D", i + 1, s, DELETE))
    if inserts or i < len(codes):
        out.append(("I", i, MADE[s], INSERT))
    if i < len(codes) and stays:
        kept = NEXT[c & 3][s]
        if kept >= 0:
            out.append(("K", i + 1, kept, KEEP + more))
        out.append(("R", i + 1, MADE[s], REROLE + more))
    return out


def _edges_back(codes: bytes, i: int, t: int, inserts: bool) -> list[tuple[int, int, int]]:
    """(rows consumed, state, cost) of the nodes with an edit that leads here."""
    made = [s for s in range(4) if MADE[s] == t]
    out = [(i, s, INSERT) for s in made] if inserts or i < len(codes) else []
    if i > 0:
        c = codes[i - 1]
        out.append((i - 1, t, DELETE))
        if c < GONE or c >= CUT:
            more = TRUNCATED if c >= CUT else 0
            out += [(i - 1, s, REROLE + more) for s in made] + [(i - 1, s, KEEP + more) for s in range(4) if NEXT[c & 3][s] == t]
    return out


def cheapest(codes: bytes, state: int, exits: tuple[tuple[int, int], ...], last: bool = True, path: bool = True) -> tuple[int, str, int]:
    """(cost, least audit, state at the end) from ``state`` before the first row to any of ``exits``, pairs of a state after the last
    row and what it costs from there. ``last`` allows inserts after the last row; without ``path`` only the cost is found."""
    m = len(codes)
    size = 4 * (m + 1)
    ahead, back = [INF] * size, [INF] * size
    done_ahead, done_back = bytearray(size), bytearray(size)
    ahead[state] = 0
    heap_ahead, heap_back = [(0, state)], []
    for s, cost in exits:
        back[4 * m + s] = cost
        heapq.heappush(heap_back, (cost, 4 * m + s))
    best = back[state]
    while heap_ahead and heap_back and heap_ahead[0][0] + heap_back[0][0] <= best:
        if heap_ahead[0][0] <= heap_back[0][0]:
            cost, x = heapq.heappop(heap_ahead)
            if done_ahead[x]:
                continue
            done_ahead[x] = 1
            for _, i, s, w in _edges(codes, x >> 2, x & 3, last):
                y = 4 * i + s
                if cost + w < ahead[y]:
                    ahead[y] = cost + w
                    heapq.heappush(heap_ahead, (cost + w, y))
                    best = min(best, cost + w + back[y])
        else:
            cost, x = heapq.heappop(heap_back)
            if done_back[x]:
                continue
            done_back[x] = 1
            for i, s, w in _edges_back(codes, x >> 2, x & 3, last):
                y = 4 * i + s
                if cost + w < back[y]:
                    back[y] = cost + w
                    heapq.heappush(heap_back, (cost + w, y))
                    best = min(best, cost + w + ahead[y])
    if not path or best >= INF:
        return best, "", -1
    end = {4 * m + s: cost for s, cost in exits}
    # crossings of equal cost, and the nodes that lead to one
    marked = bytearray(size)
    todo = []
    for x in range(size):
        if done_ahead[x] and (ahead[x] + end.get(x, INF) == best or any(done_back[4 * i + s] and ahead[x] + w + back[4 * i + s] == best
                                                                        for _, i, s, w in _edges(codes, x >> 2, x & 3, last))):
            marked[x] = 1
            todo.append(x)
    while todo:
        x = todo.pop()
        for i, s, w in _edges_back(codes, x >> 2, x & 3, last):
            y = 4 * i + s
            if done_ahead[y] and not marked[y] and ahead[y] + w == ahead[x]:
                marked[y] = 1
                todo.append(y)
    x, spent, audit = state, 0, []
    while spent + end.get(x, INF) != best:
        for letter, i, s, w in _edges(codes, x >> 2, x & 3, last):
            y = 4 * i + s
            if done_back[y] and spent + w + back[y] == best or marked[y] and ahead[y] == spent + w:
                x, spent = y, spent + w
                audit.append(letter)
                break
    return best, "".join(audit), x & 3


def repair_audit(codes: bytes, segment: int = 0) -> tuple[int, str]:
    """(cost, least audit) of a whole conversation, given a byte a row: the initial's number plus the fault's."""
    segment = segment or SEGMENT
    starts = list(range(0, len(codes), segment)) or [0]
    to_go: list[tuple[tuple[int, int], ...]] = [ACCEPT]
    for at in reversed(starts[1:]):
        part, last = codes[at:at + segment], at == starts[-1]
        to_go.append(tuple((s, cheapest(part, s, to_go[-1], last, path=False)[0]) for s in range(4)))
    state, audits, total = 0, [], None
    for at, exits in zip(starts, reversed(to_go), strict=True):
        cost, audit, state = cheapest(codes[at:at + segment], state, exits, at == starts[-1])
        total = cost if total is None else total
        audits.append(audit)
    return total or 0, "".join(audits)


# --------------------------------------------------------------------------- repair

def _edits(codes: bytes, audit: str) -> Iterator[tuple[str, int, str | None]]:
    """(letter, row consumed or -1, made role or None) of each edit."""
    i, s = 0, 0
    for letter in audit:
        if letter == "D":
            yield letter, i, None
            i += 1
        elif letter == "K":
            yield letter, i, None
            s, i = NEXT[codes[i] & 3][s], i + 1
        else:
            role = "assistant" if s == 2 else "user"
            yield letter, (i if letter == "R" else -1), role
            s, i = MADE[s], i + (letter == "R")


class _Conversation:
    """What a task holds of the conversation that it reads: a byte a row, counts, and the texts (spooled)."""

    def __init__(self, key):
        self.key, self.codes = key, bytearray()
        self.turns = [None, None, 0]  # smallest, largest, distinct
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.before = None
        self.texts = tempfile.SpooledTemporaryFile(max_size=HELD_BYTES)

    def add(self, turn, role, text, fault):
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = initial
        if fault in self.counts:
            self.counts[fault] += 1
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        self.codes.append(INITIALS.get(initial, 3) + (GONE if fault in ("blank", "duplicate") else CUT if fault == "truncated" else SOUND))
        for part in (b"" if turn is None else str(turn).encode(), role.encode(), (text or "").encode()):
            self.texts.write(len(part).to_bytes(8, "little") + part)

    def rows(self, known: dict) -> Iterator[tuple]:
        """(conv_id, place, edit, turn, role, text, counts and cost at place -1): the summary, then every edit in order."""
        codes = bytes(self.codes)
        found = known.get(codes) or repair_audit(codes)
        if len(codes) <= 64 and len(known) < CACHED:
            known[codes] = found
        low, high, distinct = self.turns
        gaps = 0 if low is None else high - low + 1 - distinct
        yield self.key, -1, None, None, None, None, {"gaps": gaps, **self.counts, "cost": found[0]}
        self.texts.seek(0)
        part = lambda: self.texts.read(int.from_bytes(self.texts.read(8), "little")).decode()
        for place, (letter, row, role) in enumerate(_edits(codes, found[1])):
            if row < 0:
                yield self.key, place, letter, None, role, "", None
            else:
                turn, own, text = part(), part(), part()
                yield self.key, place, letter, int(turn) if turn else None, role or own, text, None
        self.texts.close()


FOUND = "struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long>"
FOUND_ARROW = pa.struct([(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])


def repaired(rows: DataFrame) -> DataFrame:
    """The edits of every conversation, in order within a partition: conv_id, place, edit (D, I, K, R), turn, role, text after the edit.
    The row of place -1 comes first and holds ``found``: counts of faults and the cost. Rows without an edit of ``D`` are the
    repaired conversation; deleted rows that were blank or repeated come without text."""
    checked = faults(rows)
    kind = checked.schema["conv_id"].dataType.simpleString()

    def work(batches):
        known: dict = {}
        out: list[tuple] = []
        size, schema = 0, None

        def batch():
            cols = list(zip(*out, strict=True))
            types = [schema, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), FOUND_ARROW]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "place", "edit", "turn", "role", "text", "found"])

        def ended():
            nonlocal size
            for row in now.rows(known):
                out.append(row)
                size += 64 + len(row[5] or "")
                if size > HELD_BYTES:
                    yield batch()
                    out.clear()
                    size = 0

        now = None
        for b in batches:
            schema = b.column(0).type
            for start in range(0, b.num_rows, 1024):
                some = b.slice(start, 1024)
                for key, turn, role, text, copies, fault in zip(*(some.column(j).to_pylist() for j in range(6)), strict=True):
                    if now is None or now.key != key:
                        if now is not None:
                            yield from ended()
                        now = _Conversation(key)
                    for n in range(copies):
                        now.add(turn, role, text if n == 0 else None, fault if n == 0 or fault == "blank" else "duplicate")
        if now is not None:
            yield from ended()
        if out:
            yield batch()

    return checked.mapInArrow(work, f"conv_id {kind}, place long, edit string, turn long, role string, text string, found {FOUND}")


def digests(edits: DataFrame) -> DataFrame:
    """One row a conversation from :func:`repaired`: its counts, the audit, and the SHA-256 of the repaired ``role:text`` lines. Reads
    the rows as they lie: nothing is shuffled, texts go into the hash one by one."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def work(batches):
        key, found, audit, sha, first = None, None, bytearray(), None, True
        out: list[tuple] = []
        row = lambda: (key, *(found[n] for n in names), audit.decode(), sha.hexdigest())
        schema = None
        for b in batches:
            schema = b.column(0).type
            for conv, place, edit, role, text, own in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "place", "edit", "role", "text", "found")), strict=True):
                if place < 0:
                    if found is not None:
                        out.append(row())
                    key, found, audit, sha, first = conv, own, bytearray(), hashlib.sha256(), True
                    continue
                audit += edit.encode()
                if edit != "D":
                    sha.update(b"" if first else b"\n")
                    sha.update(role.encode() + b":" + text.encode())
                    first = False
            yield from made(out, schema)
        if found is not None:
            out.append(row())
        yield from made(out, schema)

    def made(out, schema):
        if out:
            types = [schema, *[pa.int64()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", *names, "audit", "repaired_sha256"])
            out.clear()

    return edits.mapInArrow(work, f"conv_id {kind}, {', '.join(f'{n} long' for n in names)}, audit string, repaired_sha256 string")


def repaired_turns(edits: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, text of the repaired conversations."""
    kept: Column = (F.col("place") >= 0) & (F.col("edit") != "D")
    return edits.where(kept).select("conv_id", "place", "turn", "role", "text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repaired(damaged(load(spark, sf_dir, "conversations"))))
