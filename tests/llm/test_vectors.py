import numpy as np
import pytest

from recollect.llm import ann, embdedup
from recollect.llm.vectors import forest, unit

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(n=300, dim=16, seed=0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dim))
    x[50:120] = x[:70] + rnd.normal(size=(70, dim)) * 0.12
    x[120:150] = x[3]
    x[150:160] = x[4] * 2
    return [(int(i), [float(v) for v in r], 0) for i, r in enumerate(x.astype(np.float32))]


ODD = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [float("inf")] + [1.0] * 15, 1), (1004, [None] + [1.0] * 15, 1), (1005, [1.0, 0.0], 1), (1006, [2.0, 0.0], 1), (1007, [], 1)]


def brute(data, threshold=0.9):
    ok = {i: np.array(v, float) for i, v, _ in data if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    link = {i: set() for i, _, _ in data}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                link[a].add(b)
    comp = {}
    for i in sorted(link):
        todo, seen = [i], {i}
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        comp[i] = min(seen)
    return {i: (len(link[i]), comp[i], comp[i] == i) for i in link}


@pytest.mark.parametrize("group", [8192, 40])
def test_near_duplicates_equal_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(embdedup, "LEAF", 16 if group == 40 else 1024)
    data = rows() + ODD
    got = embdedup.near_duplicates(spark.createDataFrame(data, SCHEMA), group=group).collect()
    assert len(got) == len(data)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(data)


def test_near_duplicates_of_nothing(spark):
    assert embdedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    one = embdedup.near_duplicates(spark.createDataFrame(ODD[:2] + [(None, [1.0], 0)], SCHEMA)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in one} == {(1000, 0, 1000, True), (1001, 0, 1001, True)}


def test_distant_intervals_are_skipped(spark):
    rnd = np.random.default_rng(6)
    for low in (np.array([[0.0], [1.0], [5.0]]), np.array([[3.0]]), np.cumsum(rnd.random((11, 2)), 0)):
        boxes = spark.createDataFrame([(i, x.tolist(), (x + 0.5).tolist()) for i, x in enumerate(low)], "run long, lo array<double>, hi array<double>")
        got = {(r.a, r.b) for r in embdedup.joined_intervals(boxes, low.shape[1], 0.6).collect()}
        assert got == {(i, j) for i in range(len(low)) for j in range(i, len(low)) if not embdedup.apart(low[i], low[i] + 0.5, low[j], low[j] + 0.5, 0.6)}


def test_extra_columns_play_no_part(spark):
    data = rows(200, seed=9)
    df = spark.createDataFrame([(*r, 5, "x") for r in data], SCHEMA + ", n_links int, rep string")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(df).collect()} == brute(data)
    df = df.withColumnRenamed("n_links", "score").withColumnRenamed("rep", "rank")
    assert {(r.query_id, r.vec_id) for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), factor=1.0).collect()} == exact(data)
    assert forest(5, np.array([1, 3]), np.array([2, 1])).tolist() == [0, 1, 1, 1, 4]


def exact(data, k=5):
    ok = [(i, np.array(v, float)) for i, v, _ in data if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, x in ok:
        if q % 50 == 0:
            s = sorted((-(x @ y) / np.linalg.norm(x) / np.linalg.norm(y), i) for i, y in ok if i != q and len(y) == len(x))
            out |= {(q, i) for _, i in s[:k]}
    return out


def test_factor_one_is_exact_and_recall_is_high(spark):
    data = rows(600, seed=4) + ODD
    df = spark.createDataFrame(data, SCHEMA)
    want = exact(data)
    for factor, least in ((1.0, 1.0), (ann.FACTOR, 0.9)):
        got = ann.nearest(df, df.filter("vec_id % 50 = 0"), factor=factor, shard=150, block=4).collect()
        hit = {(r.query_id, r.vec_id) for r in got} & want
        assert len(hit) >= least * len(want) and len(got) == len(want)
    for q in {r.query_id for r in got}:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(mine, mine[1:], strict=False))


def test_search_of_little(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0)], SCHEMA)
    assert [(r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []


def test_unit_of_extremes():
    assert np.allclose(unit(np.array([[1e300, 1e300], [1e-300, 0.0]])), [[0.5 ** 0.5, 0.5 ** 0.5], [1.0, 0.0]])


@pytest.mark.parametrize("noise", [1e-5, 1e-6, 1e-7])
def test_near_ties_go_by_their_real_scores(noise):
    rng = np.random.default_rng(21)
    for _ in range(10):
        q = rng.normal(size=64)
        v = np.vstack([q + noise * rng.normal(size=(60, 64)), rng.normal(size=(300, 64))])
        v = np.vstack([v, 3 * v[:5], v[:3]])  # one direction at another length, and copies
        ids = rng.permutation(len(v)) + 1000
        a, b = v.astype(np.longdouble), q.astype(np.longdouble)
        score = ((a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum())).astype(np.float64)
        want = ids[np.lexsort((ids, -score))][:5].tolist()
        for factor in (0.5, 1.0):
            assert ann.search_shard(ids, v, np.array([7]), q[None], 5, factor).vec_id.tolist() == want


def test_equal_rows_count_once(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, df.filter("vec_id = 1")).orderBy("rank").collect()] == [(1, 1, 2), (1, 2, 3)]
    assert {(r.vec_id, r.n_links, r.component_id) for r in embdedup.near_duplicates(df).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 3)}
