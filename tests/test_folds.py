"""Folds by composed maps against plain loops, with keys that are cut into many segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import advisors, folds, lifecycle, sequences
from recollect.operators.folds import Line


@pytest.fixture(params=[None, 7])
def size(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(folds, "SIZE", request.param)
    return request.param


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    return [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 5}", int(rng.integers(0, 60)), i, float(rng.normal())) for i in range(700)]


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_scan_equals_a_loop(spark, rows, size):
    df = spark.createDataFrame(rows, "k string, t int, id long, x double")
    lines = {"kept": Line(0.5, F.col("x"), -0.7, 0.9, 0.1), "reset": Line(F.when(F.col("x") > 1, 0.0).otherwise(1.0), F.when(F.col("x") > 1, 0.0).otherwise(1.0)), "least": Line(1.0, 0.0, -folds.INF, F.col("x"), 5.0)}
    want = {}
    for own in by_key(rows).values():
        a, n, low = 0.1, 0.0, 5.0
        for _, _, i, x in own:
            before = (a, n, low)
            a, n, low = min(0.9, max(-0.7, 0.5 * a + x)), 0.0 if x > 1 else n + 1, min(low, x)
            want[i] = (a, n, low, *before)
    got = {r.id: (r.kept, r.reset, r["least"], r.kept_before, r.reset_before, r.least_before) for r in folds.scan(df, "k", ["t", "id"], lines).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-9) for i in want)
    final = {r.k: (r.n, r.kept, r.reset, r["least"], r.id) for r in folds.fold(df, "k", ["t", "id"], lines, ("id",)).collect()}
    for k, own in by_key(rows).items():
        assert np.allclose(final[k], (len(own), *want[own[-1][2]][:3], own[-1][2]), atol=1e-9)


def test_no_task_gathers_a_key(spark, rows, monkeypatch):
    monkeypatch.setattr(folds, "SIZE", 10)
    df = spark.createDataFrame(rows, "k string, t int, id long, x double")
    s = folds.segments(df, "k", ["t", "id"])
    assert s.agg(F.max(F.size("rows"))).first()[0] <= 10 and s.agg(F.sum(F.size("rows"))).first()[0] == len(rows)
    flat = s.orderBy("part", "seg").select("k", F.explode("rows").alias("r")).collect()
    for k, own in by_key(rows).items():
        assert [x.r["id"] for x in flat if x.k == k] == [r[2] for r in own]


def test_states_equal_a_loop(spark, size):
    rng = np.random.default_rng(5)
    acts = ["activate", "complete", "fail", "abandon", "note", None]
    rows = [(int(rng.integers(0, 40)) % 9, i, acts[int(rng.choice(6, p=[.1, .02, .02, .02, .8, .04]))]) for i in range(600)]
    allowed = {("pending", "activate"): "active", ("pending", "abandon"): "abandoned", ("active", "complete"): "completed", ("active", "fail"): "failed", ("active", "abandon"): "abandoned"}
    want = {}
    for g, _, a in rows:
        s, n = want.get(g, ("pending", 0))
        want[g] = (allowed.get((s, a), s), n + 1)
    got = advisors.goal_transitions(spark.createDataFrame(rows, "goal_id long, at long, action string"))
    assert {r.goal_id: (r.status, r.events) for r in got.collect()} == want


def test_cards_equal_a_loop(spark, size):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 6)), float(i), int(rng.choice([0, 2, 3, 4, 5, 9], p=[.05, .1, .2, .3, .3, .05]))) for i in range(400)]
    want = {}
    for c, at, q in rows:
        n, reps, ef, days, lapses, _ = want.get(c, (0, 0, 2.5, 0.0, 0, 0.0))
        q = min(q, 5)
        days = (1.0 if reps == 0 else 6.0 if reps == 1 else days * ef) if q >= 3 else 1.0
        want[c] = (n + 1, reps + 1 if q >= 3 else 0, max(1.3, ef + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)), days, lapses + (q < 3), at)
    got = {r.memory_id: (r.reviews, r.reps, r.ease, r.interval_days, r.lapses, r.next_review - r.interval_days * 86400) for r in lifecycle.sm2(spark.createDataFrame(rows, "memory_id long, reviewed_at double, quality int")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[c], want[c], rtol=1e-9, atol=1e-4) for c in want)


def test_affect_and_budget_of_a_long_session(spark, size):
    rng = np.random.default_rng(7)
    rows = [(1, i, float(i), i, float(rng.uniform(-1, 1)), float(rng.uniform(0, 1)), float(rng.uniform(0, .5))) for i in range(150)] + [(2, 1000, 0.0, 1000, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "session_id long, id long, stored_at double, store_seq long, valence double, strain double, drift double")
    v, a, b = 0.0, 0.3, 1.0
    history = {}
    for _, i, _, _, x, s, d in rows[:150]:
        v, a = max(-1, min(1, .85 * v + .15 * x)), max(0, min(1, .9 * max(a, min(1, 1.5 * abs(x))) + .03))
        b = max(0, min(1, b - .3 * s - .2 * d + .05))
        history[i] = (v, a, b)
    got = {r.id: (r.valence, r.arousal) for r in sequences.affect_history(df).filter("session_id = 1").collect()}
    assert all(np.allclose(got[i], history[i][:2]) for i in history)
    traits = {r.session_id: r for r in sequences.affect_traits(df).collect()}
    assert np.allclose((traits[1].valence, traits[1].arousal, traits[1].depth), (v, a, 1 - a)) and traits[2].label == "excited" and traits[1].label == ("anxious" if v < 0 else "excited")
    budget = {r.id: (r.budget, r.delta) for r in advisors.budget_history(df).collect()}
    assert all(np.isclose(budget[i][0], history[i][2]) for i in history) and np.isclose(sum(budget[i][1] for i in history), b - 1)
    assert np.isclose({r.session_id: r.budget for r in advisors.coherence_budget(df).collect()}[1], b)


def test_nothing(spark):
    df = spark.createDataFrame([], "k string, t int, id long, x double")
    assert folds.scan(df, "k", ["t"], {"y": Line(1.0, F.col("x"))}).collect() == [] and folds.fold(df, "k", ["t"], {"y": Line(1.0, F.col("x"))}).collect() == []
