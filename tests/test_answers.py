"""Small questions to profiles and graphs."""

from collections import deque

import numpy as np

from recollect.operators import answers as a


def test_causal_path_equals_breadth_first_search(spark):
    rng = np.random.default_rng(19)
    rows = sorted({(f"n{rng.integers(0, 25)}", "causes", f"n{rng.integers(0, 25)}") for _ in range(45)})
    edges = spark.createDataFrame([(*r, 0.1 * (1 + i % 7)) for i, r in enumerate(rows)], "source string, relation string, target string, strength double")
    to = {}
    for s, _, t in rows:
        to.setdefault(s, set()).add(t)
    for goal in ("n1", "n7", "n13", "n24"):
        paths, queue = {"n0": ["n0"]}, deque(["n0"])
        while queue:
            x = queue.popleft()
            for y in sorted(to.get(x, ())):
                if y not in paths:
                    paths[y] = [*paths[x], y]
                    queue.append(y)
        got = a.causal_path(edges, "n0", goal).collect()
        assert [len(r.nodes.split(" > ")) for r in got] == ([len(paths[goal])] if goal in paths else [])
    assert [(r.nodes, r.strength) for r in a.causal_path(edges, "n0", "n0").collect()] == [("n0", 1.0)]
    two = spark.createDataFrame([("a", "causes", "b", .2), ("a", "prevents", "b", .6), ("b", "causes", "c", .4)], edges.schema)
    assert [tuple(r) for r in a.causal_path(two, "a", "c").collect()] == [("a > b > c", "prevents > causes", 0.5)]


def test_five_rules(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = a.goals(f([("d", .1, 6), ("e", .1, 5), ("f", .4, 9)], "domain string, level double, beliefs int"), f([("d", .5), ("e", .3)], "domain string, brier double"), f([("ctx", -.5, .6), ("y", -.5, .5)], "context string, valence double, strength double"),
                  f([("d", 1000), ("e", 100)], "domain string, n int"), f([("g", None, None, 0.0), ("h", "d", "done", 0.0), ("i", "d", "active", 8 * 86400.0)], "goal string, domain string, status string, created_at double"), as_of=10 * 86400.0)
    assert {(r.source, r.domain, r.about, round(r.priority, 6)) for r in got.collect()} == {("curiosity", "d", "d", .54), ("calibration", "d", "d", .25), ("affect", "reflection", "ctx", .2), ("maintenance", "d", "d", .3), ("obligation", "general", "g", .5)}


def test_norms_by_words(spark):
    norms = spark.createDataFrame([("d", "should", "test", "prescriptive", .5), ("d", "never", "skip", "prohibitive", .9)], "domain string, keyword string, subject string, polarity string, confidence double")
    assert [r.subject for r in a.relevant_norms(norms, "One should test this.").collect()] == ["test"] and a.relevant_norms(norms, "of the").collect() == []
