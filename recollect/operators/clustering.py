"""Clusters of records whose number the data choose.

One matrix of TF-IDF rows (or of embeddings), unit rows, serves all numbers k of a range at once.
Seeds come from k-means||: a few passes draw rows in proportion to their distance from those drawn
so far; the drawn rows, weighted by how many rows are nearest to them, are few and are cut to k
seeds on the driver. Lloyd's passes then move the centroids of every k together: tasks send sums per
centroid, never rows. The k is where the curve of costs bends most; a cluster is named after its most
common domain and words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import lexicons as lex
from recollect.operators.store import set_checkpoints

#: Features that words are hashed to, passes of seeding, rows drawn in each a wanted cluster, rows compared at once.
FEATURES, PASSES, DRAWN, ROWS = 4_096, 4, 2, 1_000


def terms(c: Column) -> Column:
    """Words of three letters and more, lower-cased, without stop words."""
    stop = F.array(*map(F.lit, lex.words(lex.CLUSTER_STOP)))
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z][a-z]+"), 0), F.lower), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def tfidf(df: DataFrame, features: int = FEATURES) -> DataFrame:
    """id, at (features, ascending), w (unit weights) of records (id, content): share of a record's
    words times log((n + 1) / (d + 1)) + 1, of features of two records at least (one, if there are
    fewer than four). A record without such a feature has none. Nothing is shuffled but counts."""
    t = df.select("id", F.transform(terms(F.col("content")), lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int")).alias("f"))
    counts = t.select(F.explode(F.array_distinct("f")).alias("at")).groupBy("at").agg(F.count("*").alias("d")).collect()  # `features` rows at most
    n = df.count()
    idf = np.zeros(features)
    for r in counts:
        if r["d"] >= (2 if n >= 4 else 1):
            idf[r["at"]] = np.log((n + 1) / (r["d"] + 1)) + 1

    @F.pandas_udf("at array<int>, w array<double>")
    def weights(f: pd.Series) -> pd.DataFrame:
        at, w = [], []
        for x in f:
            own, c = np.unique(np.asarray(x, np.int32), return_counts=True)
            v = c / max(1, len(x)) * idf[own]
            keep = v > 0
            at.append(own[keep])
            w.append(v[keep] / np.sqrt((v * v).sum()) if keep.any() else v[keep])
        return pd.DataFrame({"at": at, "w": w})

    return t.select("id", weights("f").alias("r")).select("id", "r.at", "r.w")


def embedded(df: DataFrame) -> DataFrame:
    """id, at, w of records with an embedding (all of one length)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return df.filter("embedding IS NOT NULL").select("id", F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i).alias("at"), F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(0.0)).alias("w"))


def _blocks(pdf: pd.DataFrame, features: int) -> Iterator[tuple[slice, np.ndarray]]:
    for a in range(0, len(pdf), ROWS):
        part = pdf.iloc[a:a + ROWS]
        x = np.zeros((len(part), features))
        n = part["at"].map(len).to_numpy()
        if n.sum():
            x[np.repeat(np.arange(len(part)), n), np.concatenate(part["at"].tolist())] = np.concatenate(part.w.tolist())
        yield slice(a, a + len(part)), x


def _sample(rows: DataFrame, centres: np.ndarray, wanted: int, total: float, seed: int) -> list:
    """Rows drawn with a chance of wanted * cost / total each, by a hash of id and seed."""
    features = centres.shape[1]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, x in _blocks(pdf, features):
                cost = np.maximum(0, (x * x).sum(1) + 1 - 2 * (x @ centres.T).max(1))
                some = pdf.iloc[part]
                yield some[some.u.to_numpy() < wanted * cost / total][["at", "w"]]

    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return rows.withColumn("u", u).mapInPandas(draw, "at array<int>, w array<double>").collect()  # about `wanted` rows


def dense(rows: list, features: int) -> np.ndarray:
    out = np.zeros((len(rows), features))
    for i, r in enumerate(rows):
        out[i, r["at"]] = r["w"]
    return out


def _pass(rows: DataFrame, sets: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each set of centroids: sums and numbers of the rows nearest to each, and the cost."""
    features = sets[0].shape[1]
    every, bounds = np.vstack(sets), np.cumsum([0, *map(len, sets)])

    def part_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n, cost = np.zeros_like(every), np.zeros(len(every)), np.zeros(len(sets))
        for pdf in batches:
            for _, x in _blocks(pdf, features):
                dot, own = x @ every.T, (x * x).sum(1)
                for s, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    near = dot[:, a:b].argmax(1)
                    cost[s] += np.maximum(0, own + 1 - 2 * dot[np.arange(len(x)), a + near]).sum()
                    n[a:b] += np.bincount(near, minlength=b - a)
                    hot = np.zeros((b - a, len(x)))
                    hot[near, np.arange(len(x))] = 1
                    sums[a:b] += hot @ x
        yield pd.DataFrame({"c": np.arange(len(every)), "n": n, "sum": list(sums), "cost": np.concatenate([np.r_[cost[s], np.zeros(b - a - 1)] for s, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))])})

    got = rows.mapInPandas(part_sums, "c int, n double, sum array<double>, cost double")
    added = got.groupBy("c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.col("sum")[i]) for i in range(features)]).alias("sum")) if features <= 64 else _added(got)
    r = {x["c"]: x for x in added.collect()}  # a row a centroid
    sums = [np.array([r[c]["sum"] for c in range(a, b)]) for a, b in zip(bounds, bounds[1:], strict=False)]
    return sums, [np.array([r[c]["n"] for c in range(a, b)]) for a, b in zip(bounds, bounds[1:], strict=False)], np.array([sum(r[c]["cost"] for c in range(a, b)) for a, b in zip(bounds, bounds[1:], strict=False)])


def _added(got: DataFrame) -> DataFrame:
    """Sums of a centroid's arrays of all tasks, 64 parts first and then these."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": pdf.c.iloc[:1], "n": [pdf.n.sum()], "cost": [pdf.cost.sum()], "sum": [np.sum(pdf["sum"].tolist(), axis=0)]})

    shape = "c int, n double, cost double, sum array<double>"
    return got.groupBy("c", F.spark_partition_id() % 64).applyInPandas(add, shape).groupBy("c").applyInPandas(add, shape)


def seeds(rows: DataFrame, ks: list[int], features: int, seed: int = 42) -> list[np.ndarray]:
    """Starting centroids for each k, from one k-means|| of the largest."""
    first = rows.filter("size(at) > 0").orderBy(F.xxhash64("id", F.lit(seed))).limit(1).collect()
    if not first:
        return [np.zeros((0, features)) for _ in ks]
    drawn = dense(first, features)
    for p in range(PASSES):
        total = float(_pass(rows, [drawn])[2][0])
        if total < 1e-9:
            break
        got = _sample(rows, drawn, DRAWN * max(ks), total, seed + p + 1)
        drawn = np.unique(np.vstack([drawn, dense([g for g in got if len(g["at"])], features)]), axis=0)
    weight = _pass(rows, [drawn])[1][0]
    rng, out = np.random.default_rng(seed), []
    for k in ks:
        centres = drawn[[int(np.argmax(weight))]]
        while len(centres) < min(k, len(drawn)):
            d = weight * np.maximum(0, 2 - 2 * (drawn @ centres.T).max(1))
            if d.sum() < 1e-12:
                break
            # of a few draws the one that lowers the cost most
            tries = rng.choice(len(drawn), 8, p=d / d.sum())
            left = [float((weight * np.maximum(0, 2 - 2 * np.maximum((drawn @ centres.T).max(1), drawn @ drawn[t]))).sum()) for t in tries]
            centres = np.vstack([centres, drawn[tries[int(np.argmin(left))]]])
        out.append(centres)
    return out


@dataclass
class Fit:
    ks: list[int]
    centroids: list[np.ndarray]
    costs: list[float]
    passes: int

    @property
    def chosen(self) -> int:
        return elbow(self.costs)


def lloyd(rows: DataFrame, ks: list[int], start: list[np.ndarray], most: int = 20, tol: float = 1e-4) -> Fit:
    """Centroids of every k from their seeds, until none moves by tol or after ``most`` passes."""
    now = start
    for done in range(1, most + 1):
        sums, n, costs = _pass(rows, now)
        mean = [np.where(c[:, None] > 0, s / np.maximum(c, 1)[:, None], old) for s, c, old in zip(sums, n, now, strict=True)]
        new = [m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in mean]
        still = all(np.linalg.norm(a - b) < tol for a, b in zip(new, now, strict=True))
        now = new
        if still:
            break
    return Fit(ks, now, [float(c) for c in _pass(rows, now)[2]], done)


def elbow(costs: list[float]) -> int:
    """Index of the k where the curve of costs bends most; the first of fewer than three."""
    if len(costs) < 3:
        return 0
    return int(np.argmax(np.diff(costs, 2))) + 1


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster (the nearest centroid, the first of equals)."""
    kind = rows.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, x in _blocks(pdf, centroids.shape[1]):
                yield pd.DataFrame({"id": pdf.id.iloc[part], "cluster": (x @ centroids.T).argmax(1)})

    return rows.mapInPandas(place, f"id {kind}, cluster int")


def labels(df: DataFrame, assigned: DataFrame, words: int = 3) -> DataFrame:
    """cluster, size, label: its most common domain and words, the first in order of equals."""
    j = df.select("id", "domain", "content").join(assigned, "id")
    top = lambda d, c, k: d.groupBy("cluster", c).agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), c))).filter(F.col("r") <= k)
    said = top(j.select("cluster", F.explode(terms(F.col("content"))).alias("w")), "w", words).groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]), ", ").alias("said"))
    domain = top(j, "domain", 1).select("cluster", F.coalesce("domain", F.lit("general")).alias("d"))
    out = j.groupBy("cluster").agg(F.count("*").alias("size")).join(domain, "cluster").join(said, "cluster", "left")
    return out.select("cluster", "size", F.concat(F.lit("["), "d", F.lit("]"), F.coalesce(F.concat(F.lit(" "), "said"), F.lit(""))).alias("label"))


def clusters(df: DataFrame, k: int | None = None, k_min: int = 2, k_max: int = 10, features: int = FEATURES, seed: int = 42, by_embedding: bool = False) -> DataFrame:
    """id, cluster, k, label of records (id, domain, content; by_embedding: embedding too). Without k
    the elbow of k_min to k_max chooses. Fewer records than clusters make fewer clusters."""
    set_checkpoints(df.sparkSession)
    rows = (embedded(df) if by_embedding else tfidf(df, features)).checkpoint()
    if by_embedding:
        features = rows.agg(F.max(F.size("at"))).first()[0] or 1
    n = rows.count()
    ks = [k] if k else list(range(max(2, k_min), max(2, min(k_max, n - 1)) + 1))
    kind = rows.schema["id"].dataType.simpleString()
    start = seeds(rows, ks, features, seed)
    if not len(start[0]):
        one = rows.select("id", F.lit(0).alias("cluster"))
        return one.join(labels(df, one), "cluster").select("id", "cluster", F.lit(1).alias("k"), "label") if n else df.sparkSession.createDataFrame([], f"id {kind}, cluster int, k int, label string")
    fit = lloyd(rows, ks, start)
    best = fit.chosen
    own = assign(rows, fit.centroids[best]).checkpoint()
    return own.join(labels(df, own), "cluster").select("id", "cluster", F.lit(ks[best]).alias("k"), "label")
