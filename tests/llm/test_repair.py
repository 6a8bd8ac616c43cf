"""Conversation repair against trying every sequence of edits, and against a plain pass over whole conversations."""

import hashlib
import re
import zlib
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import queries, repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
FINE = re.compile("(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def every_edit(initials, faults):
    """(cost, audit) of the best of all edit sequences, two inserts at a place at most."""
    found = []

    def go(at, out, cost, audit, inserts):
        if not re.fullmatch("s?(ua)*u?|", out):
            return
        if at == len(initials) and FINE.fullmatch(out):
            found.append((cost, audit))
        if inserts < 2:
            for r in "ua":
                go(at, out + r, cost + 5, audit + "I", inserts + 1)
        if at == len(initials):
            return
        go(at + 1, out, cost + 2, audit + "D", 0)
        if faults[at] not in ("blank", "duplicate"):
            late = 5 * (faults[at] == "truncated")
            go(at + 1, out + initials[at], cost + late, audit + "K", 0)
            for r in "ua":
                go(at + 1, out + r, cost + late + 1, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


def test_search_equals_trying_everything():
    rng = np.random.default_rng(11)
    for _ in range(250):
        n = int(rng.integers(0, 6))
        initials = [str(x) for x in rng.choice(["s", "u", "a", "x", ""], n, p=[.15, .4, .35, .05, .05])]
        faults = [str(x) for x in rng.choice(repair.FAULTS, n, p=[.6, .1, .1, .2])]
        got = repair.search(initials, faults, repair.START, repair.ENDS, first=True)
        assert list(got.values()) == [every_edit(initials, faults)], (initials, faults)
        assert repair.search(initials, faults, repair.START, repair.ENDS)[next(iter(got))] == next(iter(got.values()))


def test_heuristic_never_exceeds_the_cost():
    rng = np.random.default_rng(12)
    for _ in range(100):
        n = int(rng.integers(0, 9))
        initials, faults = [str(x) for x in rng.choice(["s", "u", "a"], n)], [str(x) for x in rng.choice(repair.FAULTS, n)]
        for at, low in enumerate(repair.unavoidable(faults)):
            for entry in range(4):
                assert all(cost >= low for cost, _ in repair.search(initials[at:], faults[at:], entry, range(4)).values())


def damage(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if how:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            out += [(c, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def plain(rows):
    """The query's rows, a conversation at a time, by one search over all of it."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], [])
    for r in damage(rows):
        groups[r[0]].append(r)
    out = []
    for c, g in groups.items():
        g.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in g:
            end = text.rstrip(SPACE)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        initials, turns = [r[2][:1] for r in g], [r[1] for r in g if r[1] is not None]
        (cost, audit), = repair.search(initials, faults, repair.START, repair.ENDS, first=True).values()
        lines, at, last = [], 0, ""
        for e in audit:
            if e == "D":
                at += 1
                continue
            role = g[at][2] if e == "K" else "assistant" if last == "u" else "user"
            lines.append(f"{role}:{'' if e == 'I' else g[at][3]}")
            last, at = role[:1] or last, at + (e != "I")
        assert FINE.fullmatch("".join(x[:1] for x in lines if x[0] != ":"))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in repair.FAULTS[1:]),
                    sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)) for r in df.collect())


def odd_rows():
    rng = np.random.default_rng(13)
    said = ["Hello there.", "no end", "", None, " \t\n", "Yes!", "É?\r\n", "x" * 40 + "1", "x" * 40 + "2", "ok.", "long " * 20_000]
    roles = ["user", "assistant", "system", None, "tool", "User"]
    rows = []
    for c in range(120):
        for t in range(int(rng.integers(1, 9))):
            turn = None if rng.random() < .05 else t + 3 * int(rng.random() < .1) - 1
            rows.append((None if c == 7 else c, turn, roles[int(rng.choice(6, p=[.4, .36, .1, .05, .04, .05]))], said[int(rng.integers(0, len(said)))]))
    return rows + rows[:20]


@pytest.mark.parametrize("segment", [512, 3])
def test_query_equals_the_plain_pass(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    for df in (spark.read.parquet(f"{SF}/conversations.parquet"), spark.createDataFrame(odd_rows(), SCHEMA)):
        rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
        df = df.withColumn("part", F.lit("x")).withColumn("audit", F.lit(1))
        assert rows_of(repair.digest(df, repair.repair(repair.damaged(df)))) == plain(rows)


def test_a_hot_conversation_is_cut_and_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 16)
    rng = np.random.default_rng(14)
    rows = [(1, t, str(rng.choice(["user", "assistant"])), str(rng.choice([f"Turn {t}.", f"open {t}", "again."]))) for t in range(3000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, SCHEMA)
    fixed = repair.repair(repair.damaged(df))
    assert rows_of(repair.digest(df, fixed)) == plain(rows)
    turns = fixed.turns().filter("conv_id = 1").orderBy("place").collect()
    assert {r.role for r in turns[0::2]} == {"user"} and {r.role for r in turns[1::2]} == {"assistant"}


def test_sound_conversations_stay(spark):
    df = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (2, 5, "user", "Why?"), (2, 6, "assistant", "So.")], SCHEMA)
    assert {(r.conv_id, r.cost, r.audit) for r in repair.repair(df).report.collect()} == {(1, 0, "KKK"), (2, 0, "KK")}


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.digest(df, repair.repair(df)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert rows_of(repair.digest(df, repair.repair(repair.damaged(df)))) == [repr((gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))]


def test_registered(spark):
    assert queries.QUERIES["op12_conversation_repair"](spark, SF).count() == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
