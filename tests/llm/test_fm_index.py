"""The FM-index and the search for benchmark windows against plain versions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import fm_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(texts, items, window):
    """(words, hit words, item ids) of each text by looking at every run of words."""
    seen = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            seen.setdefault(tuple(w[k:k + window]), set()).add("" if i is None else str(i))
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in seen}:
            for k in range(len(w) - n + 1):
                if (run := tuple(w[k:k + n])) in seen:
                    ids |= seen[run]
                    hit.update(range(k, k + n))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_suffixes_ranks_and_places():
    rng = np.random.default_rng(3)
    for _ in range(150):
        sigma = int(rng.integers(2, 7))
        sym = np.append(rng.integers(0, sigma, int(rng.integers(0, 70))), 0)
        order = sorted(range(len(sym)), key=lambda i: [(s > 0, s if s else j) for j, s in enumerate(sym[i:].tolist(), i)])
        assert fm_index.suffix_order(sym).tolist() == order
        tree = fm_index.WaveletTree(sym, sigma)
        at = np.arange(len(sym) + 1)
        for c in range(sigma):
            assert tree.rank(np.full(len(at), c), at).tolist() == np.concatenate(([0], np.cumsum(sym == c))).tolist()
        index = fm_index.FMIndex(sym, sigma, sample=int(rng.integers(1, 9)))
        real = np.arange(int((sym == 0).sum()), len(sym))
        assert index.locate(real).tolist() == order[len(sym) - len(real):]


def made(rng, n):
    alphabet = ["a", "B", "é9", "7", "b"][:int(rng.integers(1, 6))]
    return " ".join(rng.choice(alphabet, n)) if n else [None, "", " .,\n"][int(rng.integers(3))]


def test_search_equals_looking_at_every_run():
    rng = np.random.default_rng(5)
    for _ in range(150):
        texts = [made(rng, int(rng.integers(0, 40))) for _ in range(int(rng.integers(0, 12)))]
        items = [(int(rng.integers(0, 4)), made(rng, int(rng.integers(0, 9)))) for _ in range(int(rng.integers(0, 6)))]
        window = int(rng.integers(1, 5))
        phrases = fm_index.Phrases([str(i) for i, _ in items], [t for _, t in items], window)
        got = sorted(fm_index.search_texts(texts, phrases, int(rng.integers(5, 50))))
        assert [(n, sum(b - a + 1 for a, b, _, _ in s), ids) for _, n, s, ids in got] == plain(texts, items, window)


@pytest.mark.parametrize("block", [1 << 20, 25])
def test_leaks_of_odd_rows(spark, block):
    rng = np.random.default_rng(7)
    texts = [made(rng, int(rng.integers(0, 60))) for _ in range(120)] + [None, None, "", "b " * 30_000, "a B a B a B a B", "a B a B a B a B"]
    rows = [(None if i % 50 == 3 else i // 2, t) for i, t in enumerate(texts)]
    rows += rows[-3:]
    items = [(1, "a b a b a"), (1, "a b a b a"), (2, None), (3, " "), (None, "b b b b b b b"), (10, "7"), (4, "B a B a é9 7 7 a"), (5, "zz top")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = fm_index.leaks(docs, spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(0)), 4, shard=64, block=block).collect()
    want = [(r[0], *p) for r, p in zip(rows, plain([t for _, t in rows], items, 4), strict=True)]
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in got) == sorted(map(repr, want))
    for r in got:
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r.spans, r.spans[1:]))


def test_removal_takes_the_spans_only(spark):
    docs = spark.createDataFrame([(1, "Keep é this: one TWO three four! and é that.", "s"), (2, "nothing here", "s"), (3, None, "s"), (1, "one two three four", None)], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, "One two, three four")], ITEMS)
    got = {(r.doc_id, r.text, r.source) for r in fm_index.remove_leaks(docs, items).collect()}
    assert got == {(1, "Keep é this: ! and é that.", "s"), (2, "nothing here", "s"), (3, None, "s"), (1, "", None)}


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], DOCS), spark.createDataFrame([], ITEMS)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in fm_index.leaks(docs, items).collect()) == [(1, 2, 0, []), (2, 0, 0, [])]
    assert fm_index.leaks(docs.limit(0), spark.createDataFrame([(1, "a b")], ITEMS)).collect() == []
