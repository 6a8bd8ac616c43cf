"""Bounded paths over relations against a plain walk."""

from collections import defaultdict

import numpy as np
import pytest

from recollect.operators import multihop as m

SCHEMA = "source string, target string, type string, strength double"


def plain(rows, seed, hops, keep, least=0.0):
    edges = defaultdict(dict)
    for a, b, t, s in rows:
        s = 0.5 if s is None else s
        if a != b:
            for x, y in ((a, b), (b, a)):
                edges[x][y] = max(edges[x].get(y, (-1.0, "")), (s, t))
    front, best, found = [([seed], [], 1.0)], {seed: 1.0}, []
    for step in range(1, hops + 1):
        new = [(p + [b], ts + [t], s * w) for p, ts, s in front for b, (w, t) in edges[p[-1]].items() if b not in p and s * w >= least]
        found += [(*x, step) for x in new]
        by = defaultdict(list)
        for x in new:
            if round(x[2], 12) > round(best.get(x[0][-1], 0.0), 12):
                by[x[0][-1]].append(x)
        front = [x for xs in by.values() for x in sorted(xs, key=lambda x: (-round(x[2], 12), x[0]))[:keep]]
        for p, _, s in new:
            best[p[-1]] = max(best.get(p[-1], 0.0), s)
    kept, seen = set(), defaultdict(int)
    for p, _ts, s, _h in sorted(found, key=lambda x: (x[3], -round(x[2], 12), x[0])):
        seen[p[-1]] += 1
        if seen[p[-1]] <= keep:
            kept.add(tuple(p))
    return {(tuple(p), tuple(ts), round(s, 9), h, tuple(p) in kept) for p, ts, s, h in found}


@pytest.mark.parametrize("keep,hops,least", [(5, 3, 0.0), (1, 4, 0.1), (2, 3, 0.0)])
def test_paths_equal_the_plain_walk(spark, keep, hops, least):
    rng = np.random.default_rng(8)
    rows = [(f"n{rng.integers(0, 14)}", f"n{rng.integers(0, 14)}", "t" + str(rng.integers(0, 3)), None if rng.random() < .1 else float(rng.integers(1, 11)) / 10) for _ in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    seeds = spark.createDataFrame([("n0",), ("n3",), ("n3",), ("nowhere",)], "node string")
    got = defaultdict(set)
    for r in m.paths_from(df, seeds, hops, least, keep).collect():
        assert r.node == r.path[-1] and r.seed == r.path[0]
        got[r.seed].add((tuple(r.path), tuple(r.types), round(r.strength, 9), r.hops, r.kept))
    assert got == {s: p for s in ("n0", "n3") if (p := plain(rows, s, hops, keep, least))}


def test_work_does_not_explode(spark):
    # a ladder of complete layers: all simple paths are 6 ** hops, the front stays at keep a node
    rows = [(f"l{i}_{a}", f"l{i + 1}_{b}", "t", 0.9) for i in range(5) for a in range(6) for b in range(6)]
    got = m.paths_from(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("l0_0",)], "node string"), 5)
    assert got.filter("hops = 5").count() <= 5 * 6 * 12


def test_reach_bridges_and_connections(spark):
    rows = [("a", "b", "x", 0.9), ("b", "c", "y", 0.9), ("a", "c", "z", 0.5), ("c", "d", "x", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    p = m.paths_from(df, spark.createDataFrame([("a",)], "node string"))
    got = {r.node: r for r in m.reachable(p).collect()}
    assert (got["c"].path, got["c"].types, got["c"].hops, got["c"].n_paths) == ("a > b > c", "x > y", 1, 2) and abs(got["d"].strength - 0.81) < 1e-9
    assert {r.node for r in m.bridging(p).collect()} == {"b", "c"}
    assert m.connection(df, "A", "D").first().path == "a > b > c > d" and m.connection(df, "a", "zz").collect() == []


def test_nothing(spark):
    assert m.paths_from(spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a",)], "node string")).collect() == []
