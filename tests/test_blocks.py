"""Similar sets by blocks against all pairs."""

import functools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.operators import blocks, cells, condense, knowledge, pairs, records
from recollect.operators.store import cut


def texts() -> dict:
    rnd = random.Random(5)
    base = [[f"word{min(int(rnd.expovariate(0.03)), 400)}" for _ in range(rnd.choice((1, 3, 20, 60)))] for _ in range(60)]
    out = {}
    for i in range(240):
        w = list(base[i % 60])
        for _ in range(rnd.choice((0, 0, 1, 4, 10))):
            w[rnd.randrange(len(w))] = f"word{rnd.randrange(400)}"
        out[i] = " ".join(w)
    return out | {900: None, 901: "", 902: out[3].upper(), 903: out[3]}


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame([(i, i % 3, t) for i, t in texts().items()], "id long, part int, content string").repartition(3)


@pytest.mark.parametrize("least", [0.1, 0.35, 0.5, 0.85])
@pytest.mark.parametrize("by", [[], ["part"]])
def test_pairs_equal_all_pairs_and_nothing_is_shuffled(store, monkeypatch, least, by):
    monkeypatch.setattr(blocks, "SETS", 16)
    monkeypatch.setattr(blocks, "HITS", 50)
    sets = {i: set((t or "").lower().split()) for i, t in texts().items()}
    want = {(i, j): len(s & sets[j]) / len(s | sets[j]) for i, s in sets.items() for j in sets if i < j and s & sets[j] and (not by or i % 3 == j % 3)}
    want = {k: v for k, v in want.items() if v >= least}
    got = pairs.jaccard_join(store, tx.words(F.col("content")), least, by)
    assert "Exchange" not in got._jdf.queryExecution().toString()
    rows = got.collect()
    assert {(r.a, r.b): r.sim for r in rows} == want and len(rows) == len(want) > 100
    if least != 0.5:
        return
    label = pairs.components(pairs.similar_links(store, tx.words(F.col("content")), least, by), store).collect()
    whole = pairs.components(got, store).collect()
    assert sorted(label) == sorted(whole)


def test_contents_equal_all_pairs_by_blocks(store, monkeypatch):
    monkeypatch.setattr(blocks, "SETS", 16)
    t = {i: (x or "").lower() for i, x in texts().items()}
    w, g = {i: set(x.split()) for i, x in t.items()}, {i: {x[k:k + 3] for k in range(len(x) - 2)} for i, x in t.items()}
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    want = {(i, j): round(0.6 * jac(w[i], w[j]) + 0.4 * jac(g[i], g[j]), 9) for i in t for j in t if i < j and w[i] & w[j]}
    want = {k: v for k, v in want.items() if v >= 0.7}
    assert {(r.a, r.b): round(r.sim, 9) for r in condense.similar_contents(store, 0.7).collect()} == want and len(want) > 100


def test_sentences_travel_without_their_text(spark):
    long = "one two three. " * 400
    df = spark.createDataFrame([(1, long), (2, "only one sentence")], "id long, content string")
    wide = df.select("id", F.size(condense.sentences(F.col("content"))).alias("k")).collect()
    assert {r.id: r.k for r in wide} == {1: 400, 2: 1}
    assert "CASE WHEN" in condense.summaries(df)._jdf.queryExecution().analyzed().toString().split("AS whole")[0].rsplit("Project", 1)[1]
    assert {r.id: r.summary for r in condense.summaries(df).collect()}[2] == "only one sentence"


def test_groups_come_as_forests(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SETS", 32)
    words = {i: {f"k{i // 100}", *(f"w{i}x{k}" for k in range(4))} for i in range(200)}
    df = spark.createDataFrame([(i, " ".join(sorted(w))) for i, w in words.items()], "id long, content string").repartition(2)
    for least, n in ((0.1, 2), (0.9, 200)):  # hundred records alike are 4950 pairs
        links = pairs.similar_links(df, tx.words(F.col("content")), least)
        assert links.count() <= 400
        assert pairs.components(links, df).select("component").distinct().count() == n


@pytest.mark.parametrize("name", ["contradictions", "contradiction_strain", "auto_supersede"])
def test_pairs_are_summed_where_they_arise(spark, monkeypatch, name):
    """No pair is written: what is kept of pairs is what the operator gives."""
    seen = []
    monkeypatch.setattr(blocks, "cut", lambda df: seen.append((df.columns, n := cut(df))) or n)
    rows = [(i, "a" if i % 2 else "b", f"same words here often word{i % 3}", [-0.5, 0.5, 0.1][i % 3] if i else None) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, domain string, content string, valence double").repartition(2)
    keys = tx.keywords(F.col("content"))
    by = [] if name == "contradictions" else ["domain"]
    gap = {"contradictions": 0.5, "contradiction_strain": 0.4}.get(name)
    want = [(r.a, r.b, r.sim) for r in pairs.jaccard_join(df, keys, {"contradictions": 0.35, "contradiction_strain": 0.2}.get(name, 0.3), by).collect()]
    v = {r[0]: r[3] for r in rows}
    apart = {(a, b): abs(v[a] - v[b]) for a, b, _ in want if a}
    seen.clear()
    if name == "auto_supersede":
        first = {}
        for a, b, s in sorted(want):
            if 1 - s > 0.05:
                first.setdefault(a, b)
        assert {tuple(r) for r in records.auto_supersede(df).collect()} == set(first.items()) and first
    elif name == "contradictions":
        best = sorted(((-round(s * apart[a, b], 9), a, b) for a, b, s in want if a and apart[a, b] >= gap))[:10]
        assert [(-round(r.score, 9), r.a, r.b) for r in pairs.contradictions(df, keys).collect()] == best
    else:
        some = [s * apart[a, b] / 2 for a, b, s in want if a and apart[a, b] >= gap]
        r = pairs.contradiction_strain(df, keys).first()
        assert r.pairs == len(some) > 1000 and abs(r.strain - (1 - math.exp(-5 * sum(some) / 90))) < 1e-9
    assert max(t.count() for c, t in seen[1:]) <= 90


def test_summaries_are_made_where_texts_lie(spark):
    df = spark.createDataFrame([(1, "One two. Three four five! Six?", "d", 0.5), (2, None, "d", 0.5), (3, " one ", "d", 0.5)], "id long, content string, domain string, importance double")
    for made in (condense.summaries(df), condense.compress(df)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.summary for r in condense.summaries(df).collect()} == {1: "One two. Three four five! Six?", 2: None, 3: "one"}


def test_associations_shuffle_no_pair(spark, monkeypatch):
    monkeypatch.setattr(cells, "row_blocks", functools.partial(cells.row_blocks, block=16))
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None]), i * 100.0, rnd.uniform(-1, 1) if i % 9 else None, [rnd.gauss(0, 1) for _ in range(4)] if i % 3 else None) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, domain string, stored_at double, valence double, embedding array<double>").repartition(3)
    want = {}
    for i, d, t, v, e in rows:
        for j, f, u, w, g in rows[i + 1:]:
            cos = sum(a * b for a, b in zip(e, g)) / math.sqrt(sum(a * a for a in e) * sum(b * b for b in g)) if e and g else -1
            near = [max(0.0, 1 - (u - t) / 300), max(0.0, 1 - abs(v - w) / 0.3) if v is not None and w is not None else 0.0, 0.6 if d and d == f else 0.0]
            if cos >= 0.5 or max(near) > 0:
                want[i, j] = ("semantic", round(cos, 9)) if cos >= 0.5 else (["temporal", "affective", "domain"][near.index(max(near))], round(max(near), 9))
    got = knowledge.associations(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashAggregate" not in plan
    rows = got.collect()
    assert {(r.a, r.b): (r.type, round(r.weight, 9)) for r in rows} == want and len(rows) == len(want) > 500


@pytest.mark.parametrize("by", [None, "part"])
def test_vectors_meet_where_they_lie(spark, by):
    rnd = random.Random(4)
    rows = [(i, i % 3, [rnd.gauss(0, 1) for _ in range(5)] if i % 10 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, part int, embedding array<double>").repartition(3)
    unit = {i: [x / math.sqrt(sum(y * y for y in e)) for x in e] for i, _, e in rows if e}
    want = {(i, j): round(sum(x * y for x, y in zip(unit[i], unit[j])), 9) for i in unit for j in unit if i < j and (by is None or i % 3 == j % 3)}
    want = {k: w for k, w in want.items() if w >= 0.6}
    got = cells.cosine_pairs(df, 0.6, by, block=16)
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b): round(r.weight, 9) for r in got.collect()} == want and len(want) > 500


def test_no_text_is_shuffled_for_values(spark):
    from recollect.schema import documents_as_memories

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if labels were large
    try:
        sets = blocks.token_sets(documents_as_memories(spark, "/root/testdata/sf0.001"), tx.keywords(F.col("content")), ["domain"], value=F.col("valence"))
        plan = sets._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = next(i for i, x in enumerate(plan) if "FileScan" in x and "text#" in x)
    dealt = max(i for i, x in enumerate(plan[:scan]) if "Exchange" in x)
    assert any("array_distinct" in x for x in plan[dealt:scan])


def test_blocks_of_different_keys_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SETS", 32)
    rows = [(i % 4, 2, i, np.array([i % 4, i + 10]), None, 0.0) for i in range(400)]
    made = [(k, b["low"], b["high"], b["first"], b["last"]) for k, b in enumerate(blocks.packed(rows, np.arange(blocks.COUNTERS)))]
    assert len(made) == 16 and all(b[3] == b[4] for b in made)
    x, y = blocks.both_sides(spark.createDataFrame(made, "no long, low int, high int, first long, last long"), [])
    assert x.crossJoin(y).filter(blocks.once() & blocks.fitting(0.3)).count() == 4 * 10


@pytest.mark.parametrize("near", [True, False])
def test_best_pairs_end_at_the_similarity_that_can_still_win(spark, monkeypatch, near):
    levels = []
    meet = blocks.block_pairs
    monkeypatch.setattr(blocks, "block_pairs", lambda b, least, *a, **k: levels.append(least) or meet(b, least, *a, **k))
    rows = [(i, " ".join(f"word{i // 2}x{k}" for k in range(8)) + (" more" if i % 2 and not near else "") + f" only{i} lone{i}" * (not near), 0.5 if i % 2 else -0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, content string, valence double").repartition(2)
    keys = tx.keywords(F.col("content"))
    want = [(r.a, r.b) for r in pairs.jaccard_join(df, keys, 0.35).collect() if abs(rows[r.a][2] - rows[r.b][2]) >= 0.5]
    assert len(want) == 20
    got = pairs.contradictions(df, keys).collect()
    assert [(r.a, r.b) for r in got] == sorted(want)[:10]
    assert levels[1:] == ([0.9] if near else [0.9, 0.7, 0.5])
