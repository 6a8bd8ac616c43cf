"""Ordered folds over keys of any size, by maps that can be composed.

What a row does to a state is a map. Clamped lines x -> least(high, greatest(low, a x + b)), a >= 0,
and tables of states are closed under composition, so the rows of a key are cut into segments, each
segment's maps are composed on their own, and only one composed map a segment meets the others of
its key. That gives the state before each segment, and with it the state after each row.

Sums, counts since a reset, decays, averages with momentum, budgets within bounds and products are
clamped lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators.store import set_checkpoints

#: Rows of a segment at most.
SIZE = 65_536
INF = float("inf")


@dataclass
class Line:
    """x -> least(high, greatest(low, a x + b)); a must not be negative. start: the state before all rows."""

    a: Column | float
    b: Column | float
    low: Column | float = -INF
    high: Column | float = INF
    start: float = 0.0

    def column(self) -> Column:
        return F.struct(*[(c if isinstance(c, Column) else F.lit(float(c))).cast("double").alias(n) for n, c in (("a", self.a), ("b", self.b), ("low", self.low), ("high", self.high))])


def segments(df: DataFrame, by: str, order: list[str], size: int | None = None) -> DataFrame:
    """df's rows by segments of a key, in order: by, part, seg (their order), rows (array of struct).

    Keys of up to ``size`` rows are a segment each. If there is a larger one, rows stand in ranges
    over (by, order) and segments are at most ``size`` rows of a range. Nulls of by are a key.
    """
    size = size or SIZE
    whole = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = F.transform(F.sort_array(F.collect_list(whole)), lambda x: x["row"]).alias("rows")
    most = df.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    if most <= size:
        return df.groupBy(by).agg(rows).select(by, F.lit(0).alias("part"), F.lit(0).cast("long").alias("seg"), "rows")
    set_checkpoints(df.sparkSession)
    kept = df.withColumn("__id", F.monotonically_increasing_id()).checkpoint()  # ranges are taken from a sample
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = kept.repartitionByRange(by, *order, "__id").sortWithinPartitions(by, *order, "__id").select("*", F.spark_partition_id().alias("part"), F.floor(place / size).alias("seg"), place.alias("__place")).checkpoint()
    inner = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return ranged.groupBy(by, "part", "seg").agg(F.transform(F.sort_array(F.collect_list(F.struct("__place", inner))), lambda x: x["row"]).alias("rows"))


def _then(f: Column, g: Column) -> Column:
    """The line that does f and then g."""
    into = lambda v: F.least(g["high"], F.greatest(g["low"], F.when(g["a"] == 0, F.lit(0.0)).otherwise(g["a"] * v) + g["b"]))
    return F.struct((f["a"] * g["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), into(f["low"]).alias("low"), into(f["high"]).alias("high"))


def _same() -> Column:
    return F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(-INF).alias("low"), F.lit(INF).alias("high"))


def _at(line: Column, x: Column | float) -> Column:
    return F.least(line["high"], F.greatest(line["low"], line["a"] * x + line["b"]))


def _composed(s: DataFrame, by: str, lines: dict[str, Line], last: list[str]) -> DataFrame:
    """One row a segment: by, part, seg, n, the composed lines, the columns ``last`` of its last row."""
    total = [F.aggregate(F.col(f"rows.__{n}"), _same(), _then).alias(n) for n in lines]
    return s.select(by, "part", "seg", F.size("rows").alias("n"), *total, *[F.element_at("rows", -1)[c].alias(c) for c in last])


def fold(df: DataFrame, by: str, order: list[str], lines: dict[str, Line], last: tuple[str, ...] = (), size: int | None = None) -> DataFrame:
    """The state of each key after all its rows: by, n (rows), each line's state, the columns
    ``last`` of the last row."""
    d = df.select(*dict.fromkeys([by, *order, *last]), *[x.column().alias(f"__{n}") for n, x in lines.items()])
    parts = _composed(segments(d, by, order, size), by, lines, list(last))
    g = parts.groupBy(by).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("part", "seg", *lines, *last))).alias("s"))
    final = [_at(F.aggregate(F.col(f"s.{n}"), _same(), _then), x.start).alias(n) for n, x in lines.items()]
    return g.select(by, "n", *final, *[F.element_at("s", -1)[c].alias(c) for c in last])


def scan(df: DataFrame, by: str, order: list[str], lines: dict[str, Line], size: int | None = None) -> DataFrame:
    """df with each line's state after each row, and before it (name_before)."""
    set_checkpoints(df.sparkSession)
    d = df.select("*", *[x.column().alias(f"__{n}") for n, x in lines.items()])
    s = segments(d, by, order, size).checkpoint()
    parts = _composed(s, by, lines, [])
    g = parts.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("part", "seg", *lines))).alias("s"))
    kind, names, first = g.schema[by].dataType.simpleString(), list(lines), [x.start for x in lines.values()]

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The states that each segment of a key begins with."""
        for pdf in batches:
            out = []
            for key, segs in zip(pdf[by], pdf.s, strict=True):
                x = list(first)
                for seg in segs:
                    out.append((key, seg["part"], seg["seg"], *x))
                    x = [min(m["high"], max(m["low"], m["a"] * v + m["b"])) for v, m in zip(x, (seg[n] for n in names), strict=True)]
            yield pd.DataFrame(out, columns=["__k", "__p", "__q", *[f"{n}_start" for n in names]])

    begun = g.mapInPandas(starts, f"__k {kind}, __p int, __q long, " + ", ".join(f"{n}_start double" for n in lines))
    both = s.join(begun, F.col(by).eqNullSafe(F.col("__k")) & (F.col("part") == F.col("__p")) & (F.col("seg") == F.col("__q")))
    states = "array<struct<" + ",".join(f"{n}:double,{n}_before:double" for n in lines) + ">>"

    @F.pandas_udf(states)
    def walked(maps: pd.Series, *begin: pd.Series) -> pd.Series:
        out = []
        for rows, *x in zip(maps, *begin, strict=True):
            got = []
            for row in rows:
                new = [min(m["high"], max(m["low"], m["a"] * v + m["b"])) for v, m in zip(x, (row[f"__{n}"] for n in names), strict=True)]
                got.append({k: v for n, a, b in zip(names, new, x, strict=True) for k, v in ((n, a), (f"{n}_before", b))})
                x = new
            out.append(got)
        return pd.Series(out)

    only = F.transform("rows", lambda r: F.struct(*[r[f"__{n}"].alias(f"__{n}") for n in lines]))
    each = both.select("rows", walked(only, *[F.col(f"{n}_start") for n in lines]).alias("states")).select(F.explode(F.arrays_zip("rows", "states")).alias("x"))
    return each.select(*[F.col(f"x.rows.`{c}`") for c in df.columns], *[F.col(f"x.states.{c}") for n in lines for c in (n, f"{n}_before")])


def fold_states(df: DataFrame, by: str, order: list[str], moves: Column, states: list[str], size: int | None = None) -> DataFrame:
    """The state of each key after all its rows: by, n, state. moves: a row's array of the state
    that follows each of ``states``; the first one is where keys begin."""
    d = df.select(*dict.fromkeys([by, *order]), moves.alias("__moves"))
    stay = F.array(*map(F.lit, states))
    place = lambda table, at: F.element_at(table, F.array_position(stay, at).cast("int"))
    then = lambda f, g: F.transform(f, lambda at: place(g, at))
    s = segments(d, by, order, size)
    parts = s.select(by, "part", "seg", F.size("rows").alias("n"), F.aggregate(F.transform("rows", lambda r: r["__moves"]), stay, then).alias("moves"))
    g = parts.groupBy(by).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("part", "seg", "moves"))).alias("s"))
    return g.select(by, "n", F.aggregate(F.transform("s", lambda x: x["moves"]), stay, then)[0].alias("state"))
