"""Approximate nearest neighbours: vantage-point trees per shard, relaxed pruning.

All vectors are dealt to shards by hash, every vector is indexed. A shard's tree splits its
distinct vectors at the median distance to a vantage point. A branch is skipped for a query when
the triangle inequality puts it farther than ``factor`` times the query's present k-th best
distance; factor 1 restores exact search, smaller ones search less. Queries travel in blocks
through a tree together, branches nearer to a block's queries first, and their best of all
shards are merged.

The tree gives all candidates whose cosine lies within the error of a double precision product of
the last one wanted. Their scores are computed in extended precision and rounded to double once, so
vectors of one direction tie exactly, whatever their lengths, and others are told apart however
near they are.

Defined cases: null, empty and zero vectors and those with null or non-finite components take no
part, as query or candidate; vectors of different length are no candidates of each other; ties
go by vec_id; rows without vec_id are left out, rows equal in vec_id and vector count once; with
fewer than k candidates all are returned; an empty table gives an empty result; extra columns
play no part.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vectors import unit, usable

K, FACTOR = 5, 0.5
#: Vectors in a shard, queries in a block, vectors in a leaf.
SHARD, BLOCK, LEAF = 16_384, 16_384, 256


class VPTree:
    """A vantage-point tree over unit vectors, by chord length."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.x, self.ids, self.leaf = x, ids, leaf
        self.nodes: list[tuple] = []
        self._build(np.arange(len(x)))

    def _build(self, idx: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(idx) <= self.leaf:
            self.nodes[at] = ("leaf", idx)
            return at
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.x[idx] @ self.x[idx[0]])))
        order = np.argsort(d, kind="stable")
        half = len(idx) // 2
        sides = []
        for part in (order[:half], order[half:]):
            near, far = float(d[part].min()), float(d[part].max())
            sides.append((near, far, self._build(idx[part])))
        self.nodes[at] = ("node", idx[0], sides)
        return at

    def _walk(self, q: np.ndarray, factor: float, reach, leaf) -> None:
        """Visits the leaves whose bound is within factor * reach() of each query, nearer sides first:
        leaf(live queries, rows)."""
        n = len(q)
        todo = [(0, np.zeros(n))]
        while todo:
            at, bound = todo.pop()
            live = np.flatnonzero(bound <= factor * reach() + 1e-12)
            if not len(live):
                continue
            node = self.nodes[at]
            if node[0] == "leaf":
                leaf(live, node[1])
                continue
            d = np.full(n, np.inf)
            d[live] = np.sqrt(np.maximum(0, 2 - 2 * (q[live] @ self.x[node[1]])))
            ways = []
            for near, far, child in node[2]:
                low = np.full(n, np.inf)
                low[live] = np.maximum(bound[live], np.maximum(near - d[live], d[live] - far))
                ways.append((float(np.maximum(low[live], 0).mean()), child, np.maximum(low, 0)))
            # The stack is taken from its end: the nearer side goes last.
            todo += [(child, low) for _, child, low in sorted(ways, key=lambda w: -w[0])]

    def search(self, q: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
        """Per query: the rows whose cosine may be among the k best found, all of them that lie
        within the error of a product of the k-th.

        A first walk finds the k-th cosine; a second one, which needs no more leaves, gathers the rows.
        """
        best = np.full((len(q), k), -np.inf)

        def reach():
            kth = best[:, -1]
            return np.where(np.isinf(kth), np.inf, np.sqrt(np.maximum(0, 2 - 2 * np.maximum(kth, -1.0))))

        def improve(live, rows):
            s = q[live] @ self.x[rows].T
            better = np.flatnonzero(s.max(1) > best[live, -1])
            both = np.concatenate((best[live[better]], s[better]), 1)
            best[live[better]] = -np.partition(-both, k - 1, axis=1)[:, :k] if k < both.shape[1] else both
            best[live[better]] = -np.sort(-best[live[better]], axis=1)

        self._walk(q, factor, reach, improve)
        least = best[:, -1] - 4 * (q.shape[1] + 4) * np.finfo(np.float64).eps
        found: list[list[np.ndarray]] = [[] for _ in q]

        def gather(live, rows):
            i, j = np.nonzero(q[live] @ self.x[rows].T >= least[live][:, None])
            cut = np.searchsorted(i, np.arange(len(live) + 1))
            for at in np.flatnonzero(np.diff(cut)):
                found[live[at]].append(rows[j[cut[at]:cut[at + 1]]])

        self._walk(q, factor, reach, gather)
        return [np.concatenate(f) if f else np.empty(0, np.int64) for f in found]


def search_shard(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, qv: np.ndarray, k: int, factor: float) -> pd.DataFrame:
    """The k nearest in a shard for each query, its own row left out, ties to smaller ids."""
    distinct, inverse = np.unique(v, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    order = np.lexsort((ids, inverse))
    first = np.searchsorted(inverse[order], np.arange(len(distinct)))
    ends = np.append(first[1:], len(order))
    tree = VPTree(unit(distinct), ids[order[first]])
    candidates = tree.search(unit(qv), min(k + 1, len(distinct)), factor)
    rows = []
    wide = distinct.astype(np.longdouble)
    wide /= np.abs(wide).max(1, keepdims=True)
    norm = np.sqrt((wide * wide).sum(1))
    asked = qv.astype(np.longdouble)
    asked /= np.abs(asked).max(1, keepdims=True)
    for qid, q, found in zip(qids, asked, candidates, strict=True):
        score = ((wide[found] * q).sum(1) / (norm[found] * np.sqrt((q * q).sum()))).astype(np.float64)
        # No more than k + 1 ids of equal vectors can be wanted; nor vectors below the k + 1 best.
        turn = np.lexsort((ids[order[first[found]]], -score))
        got: list[tuple[float, int]] = []
        for f, s in zip(found[turn].tolist(), score[turn].tolist(), strict=True):
            if len(got) > k and -s > got[k][0]:
                break
            got = sorted(got + [(-s, i) for i in ids[order[first[f]:min(ends[f], first[f] + k + 1)]].tolist() if i != qid])[:k + 1]
        rows += [(qid, i, -s) for s, i in got[:k]]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score; both inputs have vec_id and embedding."""
    def clean(df):
        df = df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.size("embedding").alias("dim")).dropDuplicates(["vec_id", "v"])

    shards, blocks = max(1, ceil(vectors.count() / shard)), max(1, ceil(queries.count() / block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = clean(vectors).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    asked = clean(queries).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return search_shard(left.vec_id.to_numpy(), np.stack(left.v.to_numpy()), right.vec_id.to_numpy(), np.stack(right.v.to_numpy()), k, factor)

    asked = asked.toDF(*asked.columns)  # fresh columns for the cogroup
    by = ["shard", "block", "dim"]
    found = base.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
