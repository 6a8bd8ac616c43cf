"""Order within keys of any size and spread, against plain lists."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import ordered, records, sequences


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(18)
    rows = [("hot" if i % 3 else f"k{i % 4}", int(rng.integers(0, 50)), i, int(rng.integers(0, 9))) for i in range(500)]
    return rows + [("hot", 10_000_000, 500, 1), (None, 1, 501, 2), (None, 0, 502, 3)]  # one row far from all others


@pytest.mark.parametrize("size", [None, 16])
def test_places_neighbours_and_sums(spark, rows, size):
    df = spark.createDataFrame(rows, "k string, t int, id long, v int")
    by, want = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by[r[0]].append(r)
    for g in by.values():
        for n, r in enumerate(g):
            want[r[2]] = (n + 1, len(g), g[n - 1][2] if n else None, g[n + 1][2] if n + 1 < len(g) else None, sum(x[3] for x in g[:n + 1]), n + 1)
    d = ordered.placed(df, "k", ["t", "id"], total="all", size=size)
    d = ordered.beside(d, "k", ["t", "id"], {"before": "id"}, size=size)
    d = ordered.beside(d, "k", ["t", "id"], {"behind": "id"}, after=True, size=size)
    d = ordered.running(d, "k", ["t", "id"], F.col("v"), "sum", "count", size=size)
    assert {r.id: (r.place, r["all"], r.before, r.behind, r["sum"], r["count"]) for r in d.collect()} == want
    if size:
        b, many = ordered.bucketed(df, "k", ["t", "id"], size)
        assert many and b.groupBy("__k", "__b").count().agg(F.max("count")).first()[0] <= size


@pytest.mark.parametrize("parts,size,within", [(1, 4096, None), (4, 7, 11), (200, 5, 50)])
def test_runs_cross_blocks_and_partitions(spark, rows, monkeypatch, parts, size, within):
    if within:
        monkeypatch.setattr(ordered, "SIZE", within)
    df = spark.createDataFrame(rows, "k string, t int, id long, v int").repartition(parts)
    v = [r[0] for r in sorted(rows, key=lambda r: r[2])]
    want = Counter(tuple(v[i:i + n]) for n in range(2, 6) for i in range(len(v) - n + 1))
    got = Counter({tuple(r.run): r.n for r in ordered.runs(df, "k", ["id"], 5, size=size).groupBy("run").agg(F.count("*").alias("n")).collect()})
    assert got == want


@pytest.fixture(scope="module")
def zeros(spark):
    return spark.createDataFrame([(i, "d", float(i), i, v) for i, v in enumerate([5.0, 0.0, 0.0, 5.0, 5.0])], "id long, domain string, stored_at double, store_seq long, value double")


def test_moves_from_a_value_of_zero(zeros):
    got = {r.id: r.change for r in sequences.market_moves(zeros).collect()}
    assert got[1] == -100 and math.isnan(got[2]) and got[3] == math.inf and set(got) == {1, 2, 3}


def test_signals_from_a_value_of_zero(zeros):
    assert {r.id: r.signal for r in records.trading_signals(zeros).collect()} == {1: "revert_up", 2: "revert_down", 3: "revert_down"}
