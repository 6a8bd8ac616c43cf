"""Vectors in cells around centroids: who is near whom without meeting everybody.

A vector belongs to the centroid of the largest cosine. Angles obey the triangle inequality, so two
vectors are at least as far apart as their centroids less both their angles to them; cells (and
blocks of cells) that are farther apart than asked never meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.store import cut, set_checkpoints

#: Vectors that centroids are fitted on at most, centroids at most, vectors of a block.
SAMPLE, MOST_CELLS, BLOCK = 50_000, 1_024, 4_096
#: The cell of vectors without a direction: null, zero or with components that are no numbers.
NOWHERE = -1


def units(vectors: list | pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to length 1 in double precision, and which of them have a direction; all must
    be of one length."""
    dim = next((len(v) for v in vectors if v is not None and len(v)), 1)
    m = np.array([v if v is not None and len(v) == dim else np.full(dim, np.nan) for v in vectors], dtype=np.float64).reshape(len(vectors), dim)
    most = np.abs(m).max(1, initial=0.0)
    good = np.isfinite(most) & (most > 0)
    m = np.where(good[:, None], m / np.where(good, most, 1)[:, None], 0.0)
    return m / np.sqrt(np.maximum((m * m).sum(1, keepdims=True), 1e-300)), good


def fit_centroids(df: DataFrame, column: str, cells: int, sample: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """Unit centroids by k-means|| on cosine, of a sample of about ``sample`` vectors at most."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = F.col(column).cast("array<double>")
    good = df.filter(F.col(column).isNotNull()).filter(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)).select(v.alias("v"))
    n = good.count()
    if n == 0 or cells <= 1:
        first = good.first()
        return units([first["v"]])[0] if first else np.zeros((0, 1))
    few = good if n <= sample else good.sample(False, sample / n, seed)
    model = KMeans(k=min(cells, n), seed=seed, initMode="k-means||", distanceMeasure="cosine", maxIter=8, featuresCol="f").fit(few.select(array_to_vector("v").alias("f")))
    c, good = units(list(model.clusterCenters()))
    return c[good]


def nearest(m: np.ndarray, centroids: np.ndarray, k: int = 1) -> np.ndarray:
    """Numbers of the k nearest centroids of each row, nearest first, the lower number of equals."""
    return np.argsort(-(m @ centroids.T), axis=1, kind="stable")[:, :k]


def in_cells(df: DataFrame, column: str, centroids: np.ndarray) -> DataFrame:
    """df with cell and angle (to its centroid, rounded up)."""
    @F.pandas_udf("cell int, angle double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        m, good = units(vectors)
        if not len(centroids) or m.shape[1] != centroids.shape[1]:
            return pd.DataFrame({"cell": np.full(len(m), NOWHERE, np.int32), "angle": np.zeros(len(m))})
        cell = nearest(m, centroids)[:, 0]
        angle = np.arccos(np.clip((m * centroids[cell]).sum(1), -1, 1)) + 1e-7
        return pd.DataFrame({"cell": np.where(good, cell, NOWHERE).astype(np.int32), "angle": np.where(good, angle, 0.0)})

    return df.withColumn("__at", place(F.col(column))).select(*df.columns, F.col("__at.cell").alias("cell"), F.col("__at.angle").alias("angle"))


def row_blocks(df: DataFrame, block: int = 2_048) -> DataFrame:
    """Rows (id, d, has, t, v, embedding) in blocks with a number each, columns as bytes, written."""
    kinds = {"id": np.int64, "d": np.int64, "has": bool, "t": np.float64, "v": np.float64}

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        unit, good = units(rows.embedding)
        return pd.DataFrame([{c: rows[c].to_numpy(kind).tobytes() for c, kind in kinds.items()} | {"good": good.tobytes(), "unit": unit.tobytes()}])

    def run(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= block:
                yield packed(held[:block])
                held = held[block:].reset_index(drop=True)
        if held is not None and len(held):
            yield packed(held)

    made = df.mapInPandas(run, ", ".join(f"{c} binary" for c in [*kinds, "good", "unit"]))
    return cut(made.withColumn("no", F.monotonically_increasing_id()))


def cosine_pairs(df: DataFrame, least: float, by: str | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs a < b of records (id, embedding) of cosine >= least: a, b, weight; by: of equal values
    of that column only. Vectors without a direction have no partner.

    Cells are cut into blocks, written once; blocks that can hold a pair meet in a task that reads them
    where they lie and are compared by one matrix product; the others never do.
    """
    set_checkpoints(df.sparkSession)
    key = F.lit(0) if by is None else F.xxhash64(by)
    v = df if by is None else df.filter(F.col(by).isNotNull())
    v = v.filter("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding"), key.alias("key"))
    n = v.count()
    centroids = fit_centroids(v, "embedding", min(MOST_CELLS, n // (2 * block)))
    placed = in_cells(v, "embedding", centroids).filter(F.col("cell") != NOWHERE)
    sizes = placed.groupBy("key", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = placed.join(sizes, ["key", "cell"]).withColumn("box", F.struct("key", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))).select("id", "embedding", "angle", "box").checkpoint()

    boxes = placed.groupBy("box").agg(F.max("angle").alias("angle"))
    apart = np.arccos(np.clip(centroids @ centroids.T, -1, 1)) - 1e-7
    reach = float(np.arccos(np.clip(least, -1, 1)))
    far = df.sparkSession.createDataFrame([(i, j, float(apart[i, j]) - reach) for i in range(len(centroids)) for j in range(i, len(centroids))], "i int, j int, apart double") if len(centroids) else None
    if far is None:
        return df.sparkSession.createDataFrame([], f"a {v.schema['id'].dataType.simpleString()}, b {v.schema['id'].dataType.simpleString()}, weight double")
    x, y = boxes.select(F.col("box").alias("x"), F.col("angle").alias("ax")), boxes.select(F.col("box").alias("y"), F.col("angle").alias("ay"))
    meet = x.join(far, F.col("x.cell") == F.col("i")).join(y, (F.col("y.cell") == F.col("j")) & (F.col("x.key") == F.col("y.key")))
    meet = meet.filter((F.col("apart") <= F.col("ax") + F.col("ay")) & ((F.col("i") < F.col("j")) | (F.col("x.block") <= F.col("y.block")))).select("x", "y")
    kind = v.schema["id"].dataType.simpleString()

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"box": dict(rows.box.iloc[0]), "ids": rows.id.tolist(), "unit": units(rows.embedding)[0].tobytes()}])

    blocks = cut(placed.groupBy("box").applyInPandas(packed, f"box struct<key: {'int' if by is None else 'long'}, cell: int, block: int>, ids array<{kind}>, unit binary"))
    n = blocks.count()
    # Whom a block meets: a few numbers, sent to every task.
    others = meet.groupBy("x").agg(F.collect_list("y").alias("others"))
    left = blocks.toDF("x", "x_ids", "x_unit").repartition(max(1, n)).join(F.broadcast(cut(others)), "x")
    right = blocks.toDF("y", "y_ids", "y_unit").repartition(max(1, -(-n // 8)))

    def compare(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ia, ib = np.asarray(r.x_ids), np.asarray(r.y_ids)
                w = np.frombuffer(r.x_unit).reshape(len(ia), -1) @ np.frombuffer(r.y_unit).reshape(len(ib), -1).T
                i, j = np.nonzero(w >= least)
                keep = ia[i] < ib[j] if r.same else ia[i] != ib[j]
                i, j = i[keep], j[keep]
                yield pd.DataFrame({"a": np.minimum(ia[i], ib[j]), "b": np.maximum(ia[i], ib[j]), "weight": w[i, j]})

    pairs = left.hint("shuffle_replicate_nl").join(right, F.array_contains("others", F.col("y")))
    return pairs.select("x_ids", "x_unit", "y_ids", "y_unit", (F.col("x") == F.col("y")).alias("same")).mapInPandas(compare, f"a {kind}, b {kind}, weight double")


def best_of(ids: np.ndarray, queries: np.ndarray, rows: pd.DataFrame, k: int, probes: np.ndarray | None = None) -> pd.DataFrame:
    """The k best rows (id, embedding, with probes cell) for each query: query_id, id, score, ties
    by id. probes: the cells that are searched for each query."""
    m, good = units(rows.embedding)
    if not len(queries) or not good.any() or m.shape[1] != queries.shape[1]:
        return pd.DataFrame({"query_id": ids[:0], "id": rows.id[:0].to_numpy(), "score": np.empty(0)})
    rid, score = rows.id.to_numpy(), np.where(good, queries @ m.T, -np.inf)
    if probes is not None:
        cell = rows.cell.to_numpy()
        for c in np.unique(cell):
            score[np.ix_(~(probes == c).any(1), cell == c)] = -np.inf
    order = np.lexsort((np.broadcast_to(rid, score.shape), -score), axis=1)[:, :k]
    at, best = np.repeat(np.arange(len(queries)), order.shape[1]), order.ravel()
    some = np.isfinite(score[at, best])
    return pd.DataFrame({"query_id": ids[at[some]], "id": rid[best[some]], "score": score[at, best][some]})
