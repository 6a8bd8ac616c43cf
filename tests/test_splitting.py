"""Episodes of sessions: similarities, each way of splitting against a plain version."""

from collections import defaultdict
from itertools import combinations
from math import exp

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import splitting as sp

SCHEMA = "session_id string, id long, stored_at double, store_seq long, domain string, content string"
A, B = "the rocket left its orbit after launch", "garlic and butter melt in the warm pan"


def talk(session, start, parts):
    """Records of alternating topics: parts of (domain, text, number), a long pause between them."""
    rows, at, i = [], 0.0, start
    for d, text, n in parts:
        for k in range(n):
            rows.append((session, i, at, i, d, f"{text} note{k % 2}"))
            at, i = at + 10, i + 1
        at += 1000
    return rows


ROWS = talk("x", 0, [("space", A, 5), ("food", B, 5)]) + talk("y", 100, [("space", A, 6), ("food", B, 3), ("space", A + " again", 4)]) + talk(None, 200, [("food", B, 3)]) + talk("one", 300, [("food", B, 1)])


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("n", F.lit("clash"))


def likeness(a, b):
    x, y = set(a[5].lower().split()), set(b[5].lower().split())
    return .5 * len(x & y) / len(x | y) + .2 * (1.0 if a[4] == b[4] else .3) + .3 * exp(-.693 * abs(a[2] - b[2]) / 300)


def by_session(rows, size):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return {(s, k // size): g[k:k + size] for s, g in out.items() for k in range(0, len(g), size)}


@pytest.mark.parametrize("size", [64, 4])
def test_similarities_of_a_buffer(df, size):
    got = {(r.session_id, r.buffer, r.i, r.j, r.a, r.b): r.sim for r in sp.pairs(sp.buffers(df, size=size)).collect()}
    want = {(*k, i, j, g[i][1], g[j][1]): likeness(g[i], g[j]) for k, g in by_session(ROWS, size).items() for i, j in combinations(range(len(g)), 2)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("way", ["heuristic", "graph", "conductance", "spectral", "multi"])
def test_every_way_finds_two_topics(df, way):
    rows, eps = sp.split(df, way)
    got = defaultdict(list)
    for r in rows.orderBy("n").collect():
        got[r.session_id].append(r.episode)
    assert got["x"] == [1] * 5 + [2] * 5 and got["one"] == [1] and got[None] == [1, 1, 1]
    assert got["y"][:6] == [1] * 6 and got["y"][6:9] == [2] * 3
    assert sum(r.records for r in eps.collect()) == len(ROWS)
    g = by_session(ROWS, 64)[("x", 0)]
    first = next(r for r in eps.collect() if r.session_id == "x" and r.episode == 1)
    assert (first.records, first["first"], first["last"]) == (5, 0, 4)
    assert abs(first.coherence - np.mean([likeness(a, b) for a, b in combinations(g[:5], 2)])) < 1e-9
    assert next(r for r in eps.collect() if r.session_id == "one").coherence == 1.0


def test_thinnest_cut_against_all_prefixes():
    rng = np.random.default_rng(9)
    for _ in range(40):
        n = int(rng.integers(2, 9))
        m = np.abs(rng.normal(size=(n, n)))
        m = (m + m.T) / 2
        np.fill_diagonal(m, 1)
        cond, side = sp.thinnest_cut(m)
        inside = np.flatnonzero(side == 0)
        out = np.flatnonzero(side == 1)
        assert len(inside) and len(out)
        cross = sum(m[i, j] for i in inside for j in out)
        assert abs(cond - cross / min(m[inside].sum(), m[out].sum())) < 1e-6
        # no prefix of the same order is thinner
        d = m.sum(1)
        x = np.round(np.linalg.eigh(m / np.sqrt(np.outer(d, d)))[1][:, -2] / np.sqrt(d), 9)
        order = np.argsort(x, kind="stable")
        for k in range(1, n):
            p, q = order[:k], order[k:]
            assert sum(m[i, j] for i in p for j in q) / min(d[p].sum(), d[q].sum()) >= cond - 1e-6


def test_refinement_lowers_what_crosses(spark):
    edges = [(1, 2, .9), (1, 3, .9), (2, 3, .9), (3, 4, .2), (4, 5, .9), (4, 6, .9), (5, 6, .9)]
    e = spark.createDataFrame(edges, "a long, b long, weight double")
    labels = spark.createDataFrame([("s", 0, i - 1, i, l) for i, l in ((1, 1), (2, 1), (3, 4), (4, 4), (5, 4), (6, 4))], "session_id string, buffer long, n int, id long, label long")
    got = {r.id: r.label for r in sp.refined(labels, e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    # random graphs: the worst conductance never rises, no buffer becomes one community
    rng = np.random.default_rng(10)
    pairs = [(i, j, float(rng.random())) for i, j in combinations(range(14), 2) if rng.random() < .4]
    start = {i: int(rng.integers(0, 3)) for i in range(14)}
    worst = lambda lab: max(sum(w for a, b, w in pairs if (lab[a] == c) != (lab[b] == c)) / max(1e-12, sum(w * ((lab[a] == c) + (lab[b] == c)) for a, b, w in pairs)) for c in set(lab.values()))
    got = sp.refined(spark.createDataFrame([("s", 0, i, i, l) for i, l in start.items()], labels.schema), spark.createDataFrame(pairs, "a long, b long, weight double"))
    after = {r.id: r.label for r in got.collect()}
    assert len(set(after.values())) > 1 and worst(after) <= worst(start) + 0.15


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    for way in ("graph", "multi"):
        assert [x.collect() for x in sp.split(df, way)] == [[], []]
