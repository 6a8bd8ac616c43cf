"""Clusters against numpy on the same matrix, the elbow, labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import clustering as cl

TOPICS = {"space": "orbit rocket launch satellite planet comet", "food": "bread butter cheese garlic onion pepper", "music": "violin rhythm chorus melody guitar drummer"}


@pytest.fixture(scope="module")
def df(spark):
    rng, rows = np.random.default_rng(1), []
    for i in range(90):
        d = list(TOPICS)[i % 3]
        rows.append((i, d, " ".join(rng.choice(TOPICS[d].split(), 7)) + f" The common note{i % 2}."))
    return spark.createDataFrame([*rows, (90, "food", ""), (91, None, None), (92, "food", "a of the")], "id long, domain string, content string")


@pytest.fixture(scope="module")
def rows(df):
    return cl.tfidf(df, 512).checkpoint()


def matrix(rows):
    got = {r.id: r for r in rows.collect()}
    return cl.dense([got[i] for i in sorted(got)], 512)


def test_rows_are_units_of_tf_and_idf(df, rows):
    x = matrix(rows)
    assert np.allclose(np.linalg.norm(x[:90], axis=1), 1) and not x[90:].any()
    words = {r.id: r.t for r in df.select("id", cl.terms(F.col("content")).alias("t")).collect()}
    n, count = len(words), {}
    for t in words.values():
        for w in set(t):
            count[w] = count.get(w, 0) + 1
    at = {r.w: r.h for r in rows.sparkSession.createDataFrame([(w,) for w in count], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(512)).alias("h")).collect()}
    for i in (0, 17, 88):
        want = np.zeros(512)
        for w in words[i]:
            want[at[w]] += (np.log((n + 1) / (count[w] + 1)) + 1) / len(words[i])
        assert np.allclose(x[i], want / np.linalg.norm(want))


def plain_lloyd(x, centres, most=20, tol=1e-4):
    for _ in range(most):
        near = (x @ centres.T).argmax(1)
        new = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-300)
        still = np.linalg.norm(new - centres) < tol
        centres = new
        if still:
            break
    near = (x @ centres.T).argmax(1)
    return near, ((x - centres[near]) ** 2).sum()


def test_all_numbers_of_clusters_at_once_equal_numpy(rows):
    x, ks = matrix(rows), [2, 3, 4, 5]
    start = cl.seeds(rows, ks, 512)
    assert [len(s) for s in start] == ks
    fit = cl.lloyd(rows, ks, start)
    for k, c, cost, s in zip(ks, fit.centroids, fit.costs, start, strict=True):
        near, want = plain_lloyd(x, s)
        got = {r.id: r.cluster for r in cl.assign(rows, c).collect()}
        assert [got[i] for i in range(93)] == near.tolist() and np.isclose(cost, want), k
    assert ks[fit.chosen] == 3 and fit.costs[0] > fit.costs[1]


def test_chosen_clusters_are_the_topics(df):
    got = cl.clusters(df, features=512).collect()
    assert {r.k for r in got} == {3} and len(got) == 93
    of = {r.id: (r.cluster, r.label) for r in got}
    for i in range(90):
        assert of[i] == of[i % 3] and of[i][1].startswith(f"[{list(TOPICS)[i % 3]}] ")
        assert set(of[i][1].split("] ")[1].split(", ")) <= set(TOPICS[list(TOPICS)[i % 3]].split()) | {"common", "note"}
    assert len({of[i][0] for i in range(3)}) == 3


def test_elbow():
    assert cl.elbow([10.0, 4.0, 3.5, 3.2]) == 1 and cl.elbow([1.0]) == 0 and cl.elbow([9.0, 8.0, 3.0, 2.9, 2.8]) == 2


def test_by_embedding_and_odd_inputs(spark):
    rows = [(i, "d", "", [1.0, 0.01 * i, 0.0] if i % 2 else [0.0, 0.01 * i, 1.0]) for i in range(20)] + [(20, "d", "", [0.0, 0.0, 0.0]), (21, "d", "", None)]
    df = spark.createDataFrame(rows, "id long, domain string, content string, embedding array<double>")
    got = {r.id: r.cluster for r in cl.clusters(df, 2, by_embedding=True).collect()}
    assert len(got) == 21 and len({got[i] for i in range(1, 20, 2)}) == 1 and got[0] != got[1]
    assert cl.clusters(df.limit(0)).collect() == []
    assert {(r.cluster, r.k) for r in cl.clusters(df.withColumn("content", F.lit(""))).collect()} == {(0, 1)}
    assert len(cl.clusters(df.limit(1).withColumn("content", F.lit("lonely words")), 5).collect()) == 1
