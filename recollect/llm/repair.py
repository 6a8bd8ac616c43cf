"""Repair of conversation structure by A* on the edit lattice.

A conversation is read row by row. A node of the lattice is (rows read, what the output may go on
with): nothing written yet, after a system turn, after a user turn, after an assistant turn. Edits
lead from node to node:

    K  keep the row                          0
    R  give it the role user or assistant    1
    D  delete it, as blank and duplicate rows must be    2
    I  insert an empty user or assistant turn            5

and a truncated row that is not deleted costs 5 more. The output must be nothing, or turns of user
and assistant by pairs, after a system turn at most. The search takes nodes by (cost + heuristic,
audit), the audit being the edits so far; the heuristic is a suffix sum of what no path can avoid:
2 for each row that must be deleted, and for each truncated row the cheaper of deleting it and
keeping it truncated. It never falls by more than an edit costs, so a node is settled the first
time it is taken, with the least audit among its cheapest.

Rows stand in ranges over (conversation, order), so one conversation of any size is spread. A
range's rows of a conversation, ``SEGMENT`` at most, are a segment: it is searched from every state
that it can be entered in to every state that it can be left in. The best way through the segments
in turn is the best path, since an audit never begins with another one of the same cost and rows.
Only costs and audits of a conversation meet, then its audit goes back to the segments.

Defined cases: null role and text count as one space; a null turn sorts first, equal turns go by
role, then text (by its first characters and a hash), copies stay adjacent; a row with an empty
role that is kept adds no initial; rows with a null conversation form one; equal rows are rows of
their own; an empty table gives an empty result; columns beyond conv_id, turn, role, text play no
part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize

#: Rows in a segment.
SEGMENT = 512
RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may be written in a state, and the state after it.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
#: The first fault of a row.
FAULTS = ("", "blank", "duplicate", "truncated")


def unavoidable(faults: list[str]) -> list[int]:
    """Least cost of the rows from each one on."""
    out = [0]
    for f in reversed(faults):
        out.append(out[-1] + (DELETE if f in ("blank", "duplicate") else min(DELETE, TRUNCATED) if f == "truncated" else 0))
    return out[::-1]


def search(initials: list[str], faults: list[str], entry: int, exits: Iterable[int], first: bool = False) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) from entry, before the rows, to each of exits, behind them; first: to
    the one of them that is best."""
    n, rest, exits = len(initials), unavoidable(faults), set(exits)
    queue, settled, out = [(rest[0], "", 0, entry, 0)], set(), {}
    while queue and len(out) < (1 if first else len(exits)):
        _, audit, at, state, cost = heapq.heappop(queue)
        if (at, state) in settled:
            continue
        settled.add((at, state))
        if at == n and state in exits:
            out[state] = (cost, audit)

        def step(edit, price, to, reads, audit=audit, at=at, cost=cost):
            if (at + reads, to) not in settled:
                heapq.heappush(queue, (cost + price + rest[at + reads], audit + edit, at + reads, to, cost + price))

        for role, to in NEXT[state].items():
            if role in NAMES:
                step("I", INSERT, to, 0)
        if at == n:
            continue
        step("D", DELETE, state, 1)
        if faults[at] in ("blank", "duplicate"):
            continue
        late = TRUNCATED if faults[at] == "truncated" else 0
        if initials[at] == "":
            step("K", late, state, 1)
        elif initials[at] in NEXT[state]:
            step("K", late, NEXT[state][initials[at]], 1)
        for role, to in NEXT[state].items():
            if role in NAMES:
                step("R", RE_ROLE + late, to, 1)
    return out


def applied(roles: list[str], texts: list[str], entry: int, audit: str) -> list[tuple[str, str]]:
    """The rows that an audit makes of a segment's rows."""
    out, state, at = [], entry, 0
    for edit in audit:
        if edit in "IR":
            letter = next(r for r in NEXT[state] if r in NAMES)
            out.append((NAMES[letter], texts[at] if edit == "R" else ""))
            state = NEXT[state][letter]
        elif edit == "K":
            out.append((roles[at], texts[at]))
            state = NEXT[state][roles[at][0]] if roles[at] else state
        at += edit != "I"
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """conversations as the query damages them: conv_id, turn, role, text, by a checksum of `conv_id:turn`."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    return d.filter("how <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def faulty(rows: DataFrame) -> DataFrame:
    """Written rows in ranges of their order: conv_id, turn, role, text, fault (number in FAULTS),
    part (range), row (place in it)."""
    space = F.lit(" \t\n\x0b\x0c\r")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = materialize(rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text")).withColumn("id", F.monotonically_increasing_id()), "turns")
    order = ["turn", "role", F.substr("text", F.lit(1), F.lit(32)).alias("begins"), F.xxhash64("text").alias("h"), "id"]
    # One first row of each role and text: partial minima, then a join on the row's own number.
    firsts = own.groupBy("conv_id", F.xxhash64("role", "text").alias("x"), F.xxhash64("text", "role").alias("y")).agg(F.min(F.struct(*order))["id"].alias("first"))
    end = F.rtrim(F.col("text"), space)
    fault = F.when(end == "", 1).when(F.col("first").isNull(), 2).when(~F.substr(end, F.lit(-1)).isin(".", "!", "?"), 3).otherwise(0)
    marked = materialize(own.join(firsts.select("first"), F.col("id") == F.col("first"), "left").select("conv_id", *order, "text", fault.alias("fault")), "marked")
    by = ["conv_id", "turn", "role", "begins", "h", "id"]
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    out = materialize(marked.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "turn", "role", "text", "fault", F.spark_partition_id().alias("part"), row.alias("row")), "ordered")
    discard(own, marked)
    return out


def segments_of(ordered: DataFrame) -> DataFrame:
    """A row a segment: conv_id, part, row (its first), roles, texts, faults, begins and ends (whether
    it is surely the first, the last of its conversation: cuts are made at multiples of SEGMENT and
    at the borders of ranges only)."""
    sizes = ordered.groupBy("part").agg(F.max("row").alias("most"))
    turn = F.struct("row", "role", "text", "fault")
    s = ordered.groupBy("part", F.floor(F.col("row") / SEGMENT).alias("seg"), "conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).join(sizes, "part")
    first, last = F.col("t")[0]["row"], F.element_at("t", -1)["row"]
    return s.select("conv_id", "part", first.alias("row"), F.col("t.role").alias("roles"), F.col("t.text").alias("texts"), F.col("t.fault").alias("faults"),
                    (first % SEGMENT != 0).alias("begins"), ((last % SEGMENT != SEGMENT - 1) & (last < F.col("most"))).alias("ends"))


WAYS = "ways array<struct<entry:int,leave:int,cost:long,audit:string>>"


def _ways(segments: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each segment costs from each state it can be entered in to each it can be left in."""
    for pdf in segments:
        out = []
        for s in pdf.itertuples():
            faults, initials = [FAULTS[f] for f in s.faults], list(s.initials)
            ways = [(entry, state, cost, audit) for entry in ((START,) if s.begins else range(4))
                    for state, (cost, audit) in search(initials, faults, entry, ENDS if s.ends else range(4), first=s.ends).items()]
            bad = sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))
            out.append((s.conv_id, s.part, s.row, ways, initials[0], initials[-1], *(faults.count(f) for f in FAULTS[1:]), bad))
        yield pd.DataFrame(out, columns=["conv_id", "part", "row", "ways", "begin", "end", "blank", "duplicate", "truncated", "bad"])


def _through(conversations: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best way through each conversation's segments."""
    for pdf in conversations:
        out = []
        for segments in pdf.segments:
            best, trail = {START: (0, "")}, []
            for segment in segments:
                onward, back = {}, {}
                for w in segment["ways"]:
                    if w["entry"] in best:
                        cost, audit = best[w["entry"]]
                        got = (cost + w["cost"], audit + w["audit"])
                        if w["leave"] not in onward or got < onward[w["leave"]]:
                            onward[w["leave"]], back[w["leave"]] = got, w
                best, trail = onward, [*trail, back]
            state = min((s for s in ENDS if s in best), key=best.__getitem__)
            (cost, audit), steps = best[state], []
            for segment, back in zip(reversed(segments), reversed(trail), strict=True):
                steps.append((segment["part"], segment["row"], back[state]["entry"], back[state]["audit"]))
                state = back[state]["entry"]
            seams = sum(a["end"] + b["begin"] not in ("su", "ua", "au") for a, b in pairwise(segments))
            out.append((int(cost), audit, seams, steps[::-1]))
        yield pdf.drop(columns="segments").assign(**{c: [o[k] for o in out] for k, c in enumerate(("cost", "audit", "seams", "steps"))})


def _applied(segments: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in segments:
        turns = [applied(list(s.roles), list(s.texts), s.entry, s.audit) for s in pdf.itertuples()]
        yield pdf[["conv_id", "part", "row"]].assign(turns=turns)


@dataclass
class Repaired:
    """segments: conv_id, part, row (their order in a conversation), turns (array of role and text)
    after repair. report, a row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit."""

    segments: DataFrame
    report: DataFrame

    def turns(self) -> DataFrame:
        """A row a repaired turn: conv_id, place (part, row, number: in the order of the turns), role, text."""
        each = self.segments.select("conv_id", "part", "row", F.posexplode("turns").alias("number", "turn"))
        return each.select("conv_id", F.struct("part", "row", "number").alias("place"), "turn.role", "turn.text")


def repair(rows: DataFrame) -> Repaired:
    """Repairs the conversations of rows (conv_id, turn, role, text)."""
    ordered = faulty(rows)
    packed = materialize(segments_of(ordered), "segments")
    conv = packed.schema["conv_id"].dataType.simpleString()
    seen = packed.select("conv_id", "part", "row", F.transform("roles", lambda r: F.substr(r, F.lit(1), F.lit(1))).alias("initials"), "faults", "begins", "ends")
    ways = seen.mapInPandas(_ways, f"conv_id {conv}, part int, row long, {WAYS}, begin string, end string, blank long, duplicate long, truncated long, bad long")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "bad")]
    met = ways.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "row", "ways", "begin", "end"))).alias("segments"), *sums)
    step = "steps array<struct<part:int,row:long,entry:int,audit:string>>"
    best = materialize(met.mapInPandas(_through, f"conv_id {conv}, blank long, duplicate long, truncated long, bad long, cost long, audit string, seams long, {step}"), "audits")
    turns = ordered.groupBy("conv_id").agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.count_distinct("turn").alias("n")).withColumnRenamed("conv_id", "c")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("n"), F.lit(0)).cast("long")
    report = best.join(turns, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("bad") + F.col("seams")).alias("illegal"), "cost", "audit")
    chosen = best.select(F.explode("steps").alias("s")).select(F.col("s.part").alias("p"), F.col("s.row").alias("r"), "s.entry", "s.audit")
    both = packed.join(chosen, (F.col("part") == F.col("p")) & (F.col("row") == F.col("r"))).select("conv_id", "part", "row", "roles", "texts", "entry", "audit")
    return Repaired(both.mapInPandas(_applied, f"conv_id {conv}, part int, row long, turns array<struct<role:string,text:string>>"), report)


def digest(rows: DataFrame, repaired: Repaired) -> DataFrame:
    """The columns of the query: every conversation of rows, with zeros where nothing of it was repaired."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    texts = repaired.segments.select("conv_id", "part", "row", lines.alias("lines")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "row", "lines"))).alias("s"))
    texts = texts.select(F.col("conv_id").alias("b"), F.array_join(F.flatten("s.lines"), "\n").alias("all"))
    every = rows.select(F.col("conv_id").alias("a")).distinct()
    both = every.join(repaired.report, F.col("a").eqNullSafe(F.col("conv_id")), "left").join(texts, F.col("a").eqNullSafe(F.col("b")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(F.col("a").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("all", F.lit("")).cast("binary"), 256).alias("repaired_sha256"))
