"""Embedding near-duplicates by an epsilon grid order join.

Equal vectors are one class first. The unit vectors of the classes are projected on their
leading principal directions (found on a bounded sample), with the length of what these leave
out as one more coordinate, and sorted by grid cells of side epsilon, the chord of the wanted
cosine; runs of about ``GROUP`` vectors in that order are sequence intervals. Intervals are
joined recursively by their boxes, in the cluster: pairs of runs of intervals are halved level
by level, and those provably farther apart than epsilon end there. A task takes one pair of
intervals, goes on halving both the same way down to ``LEAF`` vectors and compares what is left
in double precision. A task returns sums of links and a spanning forest, never pairs.

Boxes can only tell intervals apart as far as the data spread over the leading directions; for
vectors without any such structure all pairs of intervals are compared.

Defined cases: null, empty and zero vectors and those with null or non-finite components link
with nothing; vectors of different length don't link; rows without vec_id are left out; rows
equal in vec_id and vector count once; equal vectors are links of each other; an empty table
gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import connected_components, materialize
from .vectors import forest, unit, usable

THRESHOLD = 0.9
#: Vectors in an interval and in a leaf, leading directions, vectors the directions are found on.
GROUP, LEAF, LEADING, SAMPLE = 8_192, 1_024, 8, 4_096


def directions(sample: np.ndarray, leading: int) -> np.ndarray:
    """Leading principal directions, as columns."""
    x = unit(sample)
    _, vectors = np.linalg.eigh(np.cov(x, rowvar=False).reshape(x.shape[1], x.shape[1]))
    return vectors[:, ::-1][:, :leading]


def apart(low_a, high_a, low_b, high_b, eps: float) -> bool:
    """Whether two boxes are provably farther apart than eps."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float((gap * gap).sum()) > eps * eps


def box_gap(width: int) -> Column:
    """Squared distance of the boxes (lo_a, hi_a) and (lo_b, hi_b)."""
    gap = lambda i: F.greatest(F.lit(0.0), F.col("lo_a")[i] - F.col("hi_b")[i], F.col("lo_b")[i] - F.col("hi_a")[i])
    return sum((gap(i) * gap(i) for i in range(width)), F.lit(0.0))


def joined_intervals(boxes: DataFrame, width: int, eps: float) -> DataFrame:
    """Pairs a <= b of intervals (run, lo, hi) that may hold neighbours, from pairs of long runs of
    intervals down to single ones."""
    last = boxes.agg(F.max("run")).first()[0]
    ends = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(width)]).alias(c)
    pairs = None
    for level in range(int(last).bit_length(), -1, -1):
        tree = boxes.groupBy(F.shiftright("run", level).alias("k")).agg(ends(F.min, "lo"), ends(F.max, "hi"))
        side = lambda s, tree=tree: tree.select(F.col("k").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))
        if pairs is None:
            pairs = tree.select(F.col("k").alias("a"), F.col("k").alias("b"))
            continue
        child = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c)
        pairs = pairs.select(child("a"), "b").select("a", child("b")).filter("a <= b").join(side("a"), "a").join(side("b"), "b").filter(box_gap(width) <= eps * eps).select("a", "b")
    return pairs


def join_interval(x: np.ndarray, y: np.ndarray | None, px: np.ndarray, py: np.ndarray | None, wx: np.ndarray, wy: np.ndarray | None, threshold: float):
    """Links inside x (y None) or between x and y: weighted counts and the forest over x then y."""
    eps = sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7
    same = y is None
    if same:
        y, py, wy = x, px, wx
    nx, ny = len(x), 0 if same else len(y)
    counts = np.zeros(nx + ny, np.int64)
    ea, eb = [], []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if apart(px[a:b].min(0), px[a:b].max(0), py[c:d].min(0), py[c:d].max(0), eps):
            continue
        if b - a > LEAF or d - c > LEAF:
            m, k = (a + b) // 2, (c + d) // 2
            if same and (a, b) == (c, d):
                todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
            elif b - a >= d - c:
                todo += [(a, m, c, d), (m, b, c, d)]
            else:
                todo += [(a, b, c, k), (a, b, k, d)]
            continue
        hit = x[a:b] @ y[c:d].T >= threshold
        own = same and (a, b) == (c, d)
        if own:
            np.fill_diagonal(hit, False)
        i, j = np.nonzero(hit)
        if not len(i):
            continue
        counts[a:b] += np.bincount(i, wy[c:d][j], b - a).astype(np.int64)
        if not own:
            counts[(0 if same else nx) + c:(0 if same else nx) + d] += np.bincount(j, wx[a:b][i], d - c).astype(np.int64)
        # The leaf's forest keeps the edges few.
        label = forest((b - a) + (d - c), i, (0 if own else b - a) + j)
        place = np.concatenate((np.arange(a, b), (0 if same else nx) + np.arange(c, d)))
        k = np.flatnonzero(label != np.arange(len(label)))
        ea.append(place[k])
        eb.append(place[label[k]])
    label = forest(nx + ny, np.concatenate(ea), np.concatenate(eb)) if ea else np.arange(nx + ny)
    return counts, label


def in_grid_order(pdf: pd.DataFrame, eps: float) -> pd.DataFrame:
    """Rows by grid cell, dimension after dimension, then by place on the first one."""
    if len(pdf) < 2:
        return pdf
    p = np.stack(pdf.p.to_numpy())
    cell = np.floor(p / max(eps, 1e-3))
    return pdf.iloc[np.lexsort((p[:, 0], *cell.T[::-1]))]


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    every = rows.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    every = every.select("vec_id", F.when(usable(F.col("v")), F.xxhash64("v")).alias("k1"), F.when(usable(F.col("v")), F.xxhash64(F.lit(1), "v")).alias("k2"), "v")
    # Equal vectors: one class, summed before the shuffle.
    once = every.groupBy("vec_id", "k1", "k2").agg(F.first("v").alias("v"))
    classes = materialize(once.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
                          .withColumn("dim", F.size("v")), "classes")
    eps = sqrt(max(0.0, 2 - 2 * threshold))
    lefts, rights = [], []
    for dim in [r["dim"] for r in classes.select("dim").distinct().collect()]:
        mine = classes.filter(F.col("dim") == dim)
        n = mine.count()
        sample = mine.orderBy("k1", "k2").limit(SAMPLE).select("v").collect()
        way = directions(np.array([r["v"] for r in sample]), LEADING) if len(sample) > 1 else np.eye(dim)[:, :LEADING]

        def place(batches, way=way):
            for pdf in batches:
                u = unit(np.stack(pdf.v.to_numpy()))
                p = u @ way
                left_out = np.sqrt(((u - p @ way.T) ** 2).sum(1))
                p = np.column_stack((p, left_out))
                yield pdf.assign(p=list(p), cell=list(np.floor(p / max(eps, 1e-3)).astype(np.int32)))

        kind = classes.schema["v"].dataType.simpleString()
        placed = mine.select("rep", "copies", "v").mapInPandas(place, f"rep long, copies long, v {kind}, p array<double>, cell array<int>")
        groups, width = ceil(n / group), way.shape[1] + 1

        def number(batches, group=group):
            from pyspark import TaskContext

            at, part = 0, TaskContext.get().partitionId()
            for pdf in batches:
                yield pdf.assign(g=(part << 32) + (at + np.arange(len(pdf))) // group)[["rep", "copies", "v", "p", "g"]]
                at += len(pdf)

        ordered = placed.repartitionByRange(max(1, groups), "cell", "p").sortWithinPartitions("cell", "p")
        ordered = materialize(ordered.mapInPandas(number, f"rep long, copies long, v {kind}, p array<double>, g long"), "grid")
        ends = lambda f, name, width=width: F.array(*[f(F.col("p")[i]) for i in range(width)]).alias(name)
        # Short runs (range partitions end anywhere) are joined to intervals of group to 2 * group
        # vectors: one row for each of them.
        boxes = ordered.groupBy("g").agg(F.count("*").alias("n"), ends(F.min, "lo"), ends(F.max, "hi"))
        boxes = materialize(boxes.withColumn("run", F.floor((F.sum("n").over(Window.orderBy("g")) - F.col("n")) / group).cast("long")), "boxes", small=True)
        runs = boxes.groupBy("run").agg(*[F.array(*[f(F.col(c)[i]) for i in range(width)]).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))])
        # Runs are numbered without gaps, as halving takes them.
        order = runs.select("run", (F.row_number().over(Window.orderBy("run")) - 1).cast("long").alias("k"))
        runs = materialize(runs.join(order, "run").select(F.col("k").alias("run"), "lo", "hi"), "runs", small=True)
        pairs = materialize(joined_intervals(runs, width, eps + 1e-7), "cells", small=True)
        own = ordered.join(boxes.select("g", "run").join(order, "run").select("g", "k"), "g").withColumn("dim", F.lit(dim)).select("dim", "k", "rep", "copies", "v", "p")
        lefts.append(own.join(pairs.withColumn("k", F.col("a")), "k").drop("k"))
        rights.append(own.join(pairs.filter("a <> b").withColumn("k", F.col("b")), "k").drop("k"))
    if not lefts:
        return once.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = in_grid_order(left, eps), in_grid_order(right, eps)
        x, px, wx = unit(np.stack(left.v.to_numpy())), np.stack(left.p.to_numpy()), left.copies.to_numpy()
        if len(right):
            y, py, wy = unit(np.stack(right.v.to_numpy())), np.stack(right.p.to_numpy()), right.copies.to_numpy()
        else:
            y = py = wy = None
        counts, label = join_interval(x, y, px, py, wx, wy, threshold)
        reps = np.concatenate((left.rep.to_numpy(), right.rep.to_numpy())).astype(np.int64)
        k = np.flatnonzero(counts)
        return pd.DataFrame({"rep": reps[k], "links": counts[k], "to": reps[label[k]]})

    left, right = reduce(DataFrame.unionByName, lefts), reduce(DataFrame.unionByName, rights)
    right = right.toDF(*right.columns)  # fresh columns for the cogroup
    by = ["dim", "a", "b"]
    found = materialize(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, "rep long, links long, to long"), "links")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found, "rep", "to").withColumnRenamed("id", "rep")
    known = classes.select("k1", "k2", "rep", "copies").join(totals, "rep", "left").join(comps, "rep", "left")
    out = once.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left")
    comp = F.coalesce("component_id", "rep", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"))
