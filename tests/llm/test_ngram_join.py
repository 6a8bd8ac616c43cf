import random
from pathlib import Path

import numpy as np

from recollect.llm import ngram_join as nj
from recollect.llm._common import connected_components


def brute(rows, words, need, out_of):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
        sets.setdefault(i, []).append(s)
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and out_of * len(x & y) >= need * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {i: (max(len(s) for s in sets[i]), find(i)) for i in sets}


def run(spark, rows, words, need, out_of):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nj.similar_groups(df, words, (need, out_of)).collect()}


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of", "é"]
    rows = []
    for i in range(n):
        if i > 10 and rnd.random() < 0.6:
            w = rnd.choice(rows)[1].split()
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        else:
            w = rnd.choices(vocab, k=rnd.randint(1, 60))
        rows.append((i, " ".join(w)))
    return rows


def test_equals_brute_force(spark):
    for seed, words, need, out_of in ((1, 3, 90, 100), (2, 5, 4, 5), (3, 1, 1, 2)):
        rows = corpus(seed)
        assert run(spark, rows, words, need, out_of) == brute(rows, words, need, out_of)


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 4)
    monkeypatch.setattr(nj, "PAIRS", 3)
    rows = corpus(5, 80)
    assert run(spark, rows, 3, 4, 5) == brute(rows, 3, 4, 5)


def test_bound_of_cells_is_never_above_the_difference():
    rnd = np.random.default_rng(2)
    for size, shared in ((3, 0), (40, 30), (300, 280), (20_000, 19_000)):
        t = np.unique(rnd.integers(0, 1 << 63, 2 * size - shared, dtype=np.int64).astype(np.uint64))
        x, y = t[:size], t[size - shared:]
        low = nj.least_difference(*(np.frombuffer(nj.cell_counts(np.sort(s)), np.uint8) for s in (x, y)))
        assert low <= len(np.setxor1d(x, y)) and nj.least_difference(*[np.frombuffer(nj.cell_counts(x), np.uint8)] * 2) == 0
        assert size > 300 or low > 0.8 * len(np.setxor1d(x, y))


def test_components_of_a_long_path(spark):
    rnd = random.Random(4)
    ids = list(range(300))
    rnd.shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (900, 900), (901, 902)], "a long, b long")
    got = {r.id: r.component_id for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in ids} | {900: 900, 901: 901, 902: 901}


def test_large_classes_of_copies(spark):
    rows = [(i, "one and the same text " * 9) for i in range(60)] + [(100 + i, f"other text number {i} " * 5) for i in range(30)]
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_intermediate_tables_are_deleted(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    run(spark, corpus(7, 60), 3, 90, 100)
    left = {p.name.split("-")[0] for p in set(shared.iterdir()) - before}
    assert not left & {"signatures", "nodes", "near", "buckets", "candidates", "filtered", "pairs"}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "ONE two"), (6, "one two three four"), (7, "x" * 50_000), (8, "x" * 50_000), (9, "a b c d"), (9, "one two three four"), (9, "a b c d"), (10, "a\0 b c d"), (11, "a\x01 b c d"), (12, "A\0 b c d")]
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)
    assert run(spark, [], 3, 90, 100) == {}


def test_stage_keeps_one_of_each_group_and_rows_without_id(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(3, t, 1), (2, t + " end", 2), (5, "other words here", 3), (None, t, 4), (6, None, 5)], "doc_id long, text string, a long")
    out = nj.drop_similar(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id or -1), r.a) for r in out.collect()) == [(-1, 4), (2, 2), (5, 3), (6, 5)]
