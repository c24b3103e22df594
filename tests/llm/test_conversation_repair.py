import hashlib
import random
import re
import tempfile
import zlib
from functools import lru_cache

import pytest

from tiltml.llm import conversation_repair as R
from tiltml.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = "\x20\x09-\x0D"


def brute_audit(rows):
    """Least (cost, audit) by trying every edit from the end; rows are (initial, blank or duplicate, truncated)."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, state, room):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        nxt = {x: t for x, t in step[state].items()}
        if room:
            found += [(2 + c, "I" + a) for x, t in nxt.items() if x != "s" for c, a in [best(i, t, room - 1)] if c < 10**6]
        if i < len(rows):
            initial, gone, cut = rows[i]
            found += [(3 + c, "D" + a) for c, a in [best(i + 1, state, 2)]]
            if not gone:
                if initial in nxt:
                    found += [(cut + c, "K" + a) for c, a in [best(i + 1, nxt[initial], 2)]]
                found += [(2 + cut + c, "R" + a) for x, t in nxt.items() if x != "s" for c, a in [best(i + 1, t, 2)]]
        return min(found, default=(10**6, ""))
    return best(0, "", 2)


def brute_force(table):
    rows = {}
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = rows.setdefault(conv, [])
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in rows.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, plain = set(), []
        counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            words = re.sub(f"[{SPACE}]+$", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            plain.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit = brute_audit(tuple(plain))
        lines, i, before = [], 0, None
        for x in audit:
            if x == "K":
                before = own[i][1]
                lines.append(f"{own[i][1]}:{own[i][2]}")
            elif x in "RI":
                before = "assistant" if before is not None and before[0] == "u" else "user"
                lines.append(f"{before}:{own[i][2] if x == 'R' else ''}")
            i += x != "I"
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def awkward():
    r = random.Random(3)
    text = lambda: r.choice(["Yes.", "No", "", " \t", None, "Same.", "Same.", "a.b", "Wait!  \n", "what?", ". . x", "é 🎉."])
    rows = [(c, r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", "tool", None, "", "User"]), text()) for c in range(300) for _ in range(r.randrange(1, 9))]
    rows += [(c, t, ("user", "assistant")[t % 2], f"Turn {t}.") for c in range(400, 450) for t in range(8)]
    rows += [(None, t, "user", "x.") for t in range(4)] + [(500, t // 2, "assistant", "Same.") for t in range(60)] + [(501, None, None, None)]
    rows += [(502, t, r.choice(["user", "assistant", "system"]), f"{t}" + "." * (t % 3)) for t in range(150)] + [(503, 1, "user", "long " * 400_000), (503, 2, "assistant", "word. " * 300_000)]
    return rows + rows[:40]


@pytest.fixture(scope="module")
def folder(spark):
    path = tempfile.mkdtemp(prefix="tiltml-conv-")
    rows = [(*x, 1, "a", -1, "K") for x in awkward()]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int, audit string, place int, edit string").repartition(5).write.parquet(f"{path}/conversations.parquet")
    return path


def got(spark, path):
    return sorted((tuple(r) for r in QUERIES["op11_conversation_repair"](spark, path).select(*NAMES).collect()), key=str)


def test_equals_brute_force_on_awkward_rows(spark, folder):
    table = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(spark, folder) == brute_force(table)


def test_equals_brute_force_on_the_given_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(spark, SF) == brute_force(table)


@pytest.mark.parametrize("segment", [1, 2, 3, 7, 50_000])
def test_search_in_segments_finds_the_least_audit(segment):
    r = random.Random(segment)
    for _ in range(400):
        rows = [("suax"[r.randrange(4)], *r.choice([(False, 0), (False, 0), (True, 0), (False, 1)])) for _ in range(r.randrange(0, 14))]
        codes = bytes("suax".index(x) + (R.GONE if gone else R.CUT if cut else R.SOUND) for x, gone, cut in rows)
        assert R.repair_audit(codes, segment) == brute_audit(tuple(rows))


def test_long_conversation_is_searched_in_segments():
    r = random.Random(1)
    codes = bytes(r.choice([0, 1, 2, 3, 4, 5, 9, 10]) for _ in range(30_000))
    assert R.repair_audit(codes, 4_000) == R.repair_audit(codes, 30_000)


def test_spooled_texts_give_the_same_rows(spark, folder, monkeypatch):
    whole = got(spark, folder)
    monkeypatch.setattr(R, "HELD_BYTES", 50)
    assert got(spark, folder) == whole


def test_repaired_turns_follow_the_pattern(spark, folder):
    edits = R.repaired(R.damaged(spark.read.parquet(f"{folder}/conversations.parquet")))
    turns = {}
    for r in R.repaired_turns(edits).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert all(re.fullmatch("s?(ua)+", "".join(role[0] for role, _ in rows)) for rows in turns.values())


def test_empty_table(spark, folder):
    path = tempfile.mkdtemp(prefix="tiltml-conv-")
    spark.read.parquet(f"{folder}/conversations.parquet").limit(0).write.parquet(f"{path}/conversations.parquet")
    assert got(spark, path) == []
