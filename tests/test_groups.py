"""Groups around seeds against the plain greedy."""

from collections import Counter

import numpy as np

from recollect.operators import groups as g


def plain(rows, seeds, support, most):
    out = {}
    for d in {r[1] for r in rows}:
        own = {}
        for i, dom, tok in rows:
            if dom == d:
                own.setdefault(i, set()).add(tok)
        freq = Counter(t for ts in own.values() for t in ts)
        order = sorted((t for t in freq if freq[t] >= support), key=lambda t: (-freq[t], t))[:seeds]
        n = 0
        for r, tok in enumerate(order):
            if n == most:
                break
            group = [i for i, ts in own.items() if tok in ts and (d, i) not in out]
            if len(group) >= support:
                n += 1
                out |= {(d, i): (tok, r) for i in group}
    return out


def test_all_at_once_equals_one_after_another(spark):
    rng = np.random.default_rng(15)
    every, want, case = [], {}, 0
    for case in range(120):
        support, most, d = 2, 12, f"case{case}"
        rows = [(case * 1000 + i, d, f"w{t}") for i in range(int(rng.integers(1, 25))) for t in set(rng.zipf(1.4, int(rng.integers(0, 9))) % int(rng.integers(3, 40)))]
        every += rows
        want |= plain(rows, 30, support, most)
    df = spark.createDataFrame(every, "id long, domain string, tok string")
    got = {(r.domain, r.id): (r.seed, r["rank"]) for r in g.seed_groups(df).collect()}
    assert got == want
    got = {(r.domain, r.id): (r.seed, r["rank"]) for r in g.seed_groups(df, 6, 3, 2).collect()}
    assert got == {k: v for c in range(120) for k, v in plain([r for r in every if r[1] == f"case{c}"], 6, 3, 2).items()}


def test_schemas_and_lessons(spark):
    rows = [(1, "d", "index rebuild failed again", .9, .9), (2, "d", "index rebuild succeeded", .9, -.9), (3, "d", "garden walk", .9, .0), (4, "d", "garden party", .9, .05), (5, None, "lone words here", .9, 0.0), (6, "d", "index low", .1, 0.0)]
    df = spark.createDataFrame(rows, "id long, domain string, content string, importance double, valence double")
    got = {(r.domain, r.seed): (r.members, round(r.confidence, 3), r.keywords) for r in g.schemas(df).collect()}
    assert got == {("d", "index"): (3, .6, "index, rebuild"), ("d", "garden"): (2, .4, "garden")}
    kinds = {r.seed: r.kind for r in g.lessons(df).collect()}
    assert kinds == {"index": "contrast", "garden": "gap"}
    assert {r.question for r in g.open_questions(g.lessons(df)).collect()} == {"Why do records on index, rebuild disagree?", "What is missing on garden?"}
    assert g.schemas(df.limit(0)).collect() == []
