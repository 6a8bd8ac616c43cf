"""Sessions split into episodes by the similarities of all records of a buffer.

A session's records, in order, fill buffers of ``BUFFER``; a long session has many. Within a buffer
every two records have a similarity (.5 words in common + .2 domain + .3 closeness in time), and an
edge where it reaches a threshold. Ways to split:

    heuristic    before a record that is unlike the one before it
    graph        communities of the edges (label propagation)
    conductance  these, refined: a record moves to a neighbouring community where less of the
                 weight of both crosses their borders
    spectral     again and again in two, by the order of the second eigenvector of the normalised
                 similarities, where the least weight crosses; until no part has a thin border
    multi        for each buffer the way of the greatest mean coherence, less .01 for each episode
                 more or fewer than a fifth of its records

All buffers are split at once. Work grows with the rows times BUFFER.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import text as tx
from recollect.operators.graphs import communities
from recollect.operators.ordered import placed
from recollect.operators.store import cut, set_checkpoints

BUFFER = 64
WAYS = ("heuristic", "graph", "conductance", "spectral")


def buffers(df: DataFrame, by: str = "session_id", size: int = BUFFER) -> DataFrame:
    """Records (id, stored_at, store_seq, domain, content) with buffer and n (their place in it)."""
    p = placed(df.select(by, "id", "stored_at", "store_seq", "domain", "content"), by, ["stored_at", "store_seq"])
    at = F.col("place") - 1
    return p.withColumn("buffer", F.floor(at / size)).withColumn("n", (at % size).cast("int")).drop("place")


def pairs(filled: DataFrame, by: str = "session_id", half_life: float = 300.0) -> DataFrame:
    """The similarity of every two records of a buffer: by, buffer, i < j (places), a, b (ids), sim."""
    own = F.struct("n", "id", "stored_at", "domain", F.array_distinct(tx.words(F.col("content"))).alias("w"))
    g = filled.groupBy(by, "buffer").agg(F.sort_array(F.collect_list(own)).alias("r"))
    each = g.select(by, "buffer", "r", F.posexplode("r").alias("i", "x")).select(by, "buffer", "i", "x", F.explode(F.slice("r", F.col("i") + 2, F.size("r"))).alias("y"))
    near = F.exp(-0.693 * F.abs(F.col("y.stored_at") - F.col("x.stored_at")) / half_life)
    sim = 0.5 * tx.jaccard(F.col("x.w"), F.col("y.w")) + 0.2 * F.when(F.col("x.domain").eqNullSafe(F.col("y.domain")), 1.0).otherwise(0.3) + 0.3 * near
    return each.select(by, "buffer", "i", F.col("y.n").alias("j"), F.col("x.id").alias("a"), F.col("y.id").alias("b"), sim.alias("sim"))


def by_likeness(filled: DataFrame, sims: DataFrame, by: str, least: float) -> DataFrame:
    """by, buffer, n, id, label: a new one where a record is unlike the one before it."""
    unlike = sims.filter("j = i + 1").select(F.col(by).alias("k"), F.col("buffer").alias("q"), F.col("j"), (F.col("sim") < least).cast("int").alias("new"))
    j = filled.join(unlike, F.col(by).eqNullSafe(F.col("k")) & (F.col("buffer") == F.col("q")) & (F.col("n") == F.col("j")), "left")
    w = Window.partitionBy(by, "buffer").orderBy("n")
    return j.select(by, "buffer", "n", "id", F.sum(F.coalesce("new", F.lit(0))).over(w).alias("label"))


def edges_of(sims: DataFrame, least: float) -> DataFrame:
    return sims.filter(F.col("sim") >= least).select("a", "b", F.col("sim").alias("weight"))


def by_communities(filled: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """by, buffer, n, id, label: communities; a record without an edge is one of its own."""
    own = communities(edges).select(F.col("id").alias("x"), F.col("label").alias("l"))
    return filled.join(own, F.col("id") == F.col("x"), "left").select(by, "buffer", "n", "id", F.coalesce("l", "id").alias("label"))


def refined(labels: DataFrame, edges: DataFrame, by: str = "session_id", rounds: int = 10) -> DataFrame:
    """labels after moves that lower conductance (weight across the border / weight of its records'
    edges; 1 for a whole buffer), at most ``rounds``. A record moves to the neighbouring community
    where the worse of the two, its own without it and that one with it, becomes best and better
    than the worse one was. In a round one half of the records, drawn by a hash, may move."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).transform(cut)
    degree = both.groupBy("a").agg(F.sum("weight").alias("deg"))
    size = labels.groupBy(by, "buffer").agg(F.count("*").alias("all"))
    at = labels.select(F.col(by).alias("k"), F.col("buffer").alias("q"), "id")
    whole = at.join(size, F.col("k").eqNullSafe(F.col(by)) & (F.col("q") == size["buffer"])).select("id", "all").transform(cut)
    now = labels.select("id", "label").transform(cut)
    for r in range(rounds):
        la, lb = now.select(F.col("id").alias("a"), F.col("label").alias("la")), now.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        share = both.join(la, "a").join(lb, "b").groupBy("a", "la", "lb").agg(F.sum("weight").alias("w"))
        members = now.join(whole, "id").groupBy("label").agg(F.count("*").alias("size"), F.max("all").alias("all"))
        cond = share.groupBy(F.col("la").alias("label")).agg(F.sum(F.when(F.col("la") != F.col("lb"), F.col("w")).otherwise(0.0)).alias("cut"), F.sum("w").alias("vol")).join(members, "label")
        of = lambda s, c=cond: c.select(*[F.col(x).alias(f"{x}_{s}") for x in c.columns])
        home = share.filter("la = lb").select(F.col("a").alias("h"), F.col("w").alias("inner"))
        m = share.filter("la <> lb").join(degree, "a").join(home, F.col("a") == F.col("h"), "left").join(of("o"), F.col("la") == F.col("label_o")).join(of("t"), F.col("lb") == F.col("label_t"))
        ratio = lambda cut, vol, all_: F.when(all_, 1.0).when(vol < 1e-12, 0.0).otherwise(cut / vol)
        before = F.greatest(ratio(F.col("cut_o"), F.col("vol_o"), F.col("size_o") == F.col("all_o")), ratio(F.col("cut_t"), F.col("vol_t"), F.lit(False)))
        left = ratio(F.col("cut_o") - F.col("deg") + 2 * F.coalesce("inner", F.lit(0.0)), F.col("vol_o") - F.col("deg"), F.lit(False))
        joined = ratio(F.col("cut_t") + F.col("deg") - 2 * F.col("w"), F.col("vol_t") + F.col("deg"), F.col("size_t") + 1 == F.col("all_t"))
        better = m.select("a", "lb", F.round(before, 9).alias("before"), F.round(F.greatest(left, joined), 9).alias("then")).filter("then < before")
        mine = better.groupBy("a").agg(F.min(F.struct("then", "lb"))["lb"].alias("next"))
        turn = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0
        moved = now.join(mine, F.col("id") == F.col("a"), "left").withColumn("wants", F.col("next").isNotNull()).select("id", F.when(F.col("wants") & turn, F.col("next")).otherwise(F.col("label")).alias("label"), "wants").transform(cut)
        now = moved.select("id", "label")
        if moved.filter("wants").isEmpty():
            break
    return labels.drop("label").join(now, "id")


def thinnest_cut(sim: np.ndarray) -> tuple[float, np.ndarray]:
    """(conductance, side) of the best cut along the second eigenvector of the normalised similarities."""
    d = sim.sum(1)
    root = np.sqrt(d)
    _, vectors = np.linalg.eigh(sim / np.outer(root, root))
    x = np.round(vectors[:, -2] / root, 9)
    order = np.lexsort((np.arange(len(x)), x))
    inner = sim[np.ix_(order, order)]
    vol = np.cumsum(d[order])[:-1]
    within = np.array([inner[:k, :k].sum() for k in range(1, len(x))])
    cond = np.round((vol - within) / np.minimum(vol, d.sum() - vol), 9)
    at = int(np.argmin(cond)) + 1
    side = np.zeros(len(x), int)
    side[order[at:]] = 1
    return float(cond[at - 1]), side


def by_spectrum(filled: DataFrame, sims: DataFrame, by: str, thin: float = 0.4, smallest: int = 4) -> DataFrame:
    """by, buffer, n, id, label: parts cut in two again and again, while there is a cut of conductance
    below ``thin`` and a part of ``smallest`` records at least. A task sees one part, of a buffer at most."""
    @F.pandas_udf("array<int>")
    def parted(nodes: pd.Series, a: pd.Series, b: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for n, i, j, s in zip(nodes, a, b, w, strict=True):
            m = np.eye(len(n))
            at = {x: k for k, x in enumerate(n.tolist())}
            rows, cols = [at[x] for x in i.tolist()], [at[x] for x in j.tolist()]
            m[rows, cols] = m[cols, rows] = s
            cond, side = thinnest_cut(m)
            out.append(side.tolist() if cond < thin else None)
        return pd.Series(out)

    part = filled.select(F.col(by).alias("k"), F.col("buffer").alias("q"), "n", F.lit("").alias("part")).transform(cut)
    done = []
    while True:
        x, y = part.select("k", "q", F.col("n").alias("i"), F.col("part").alias("pi")), part.select(F.col("k").alias("k2"), F.col("q").alias("q2"), F.col("n").alias("j2"), F.col("part").alias("pj"))
        same = sims.join(x, F.col(by).eqNullSafe(F.col("k")) & (F.col("buffer") == F.col("q")) & (sims["i"] == x["i"])).join(y, F.col(by).eqNullSafe(F.col("k2")) & (F.col("buffer") == F.col("q2")) & (F.col("j") == F.col("j2")) & (F.col("pi") == F.col("pj")))
        w = same.groupBy(F.col("k").alias("k1"), F.col("q").alias("q1"), F.col("pi").alias("p1")).agg(F.collect_list(F.struct(x["i"].alias("a"), F.col("j").alias("b"), "sim")).alias("e"))
        g = part.groupBy("k", "q", "part").agg(F.sort_array(F.collect_list("n")).alias("nodes")).filter(F.size("nodes") >= max(2, smallest))
        j = g.join(w, F.col("k").eqNullSafe(F.col("k1")) & (F.col("q") == F.col("q1")) & (F.col("part") == F.col("p1")))
        sides = j.select("k", "q", "part", "nodes", parted("nodes", "e.a", "e.b", "e.sim").alias("side")).filter("side IS NOT NULL").select(F.col("k").alias("sk"), F.col("q").alias("sq"), F.explode(F.arrays_zip("nodes", "side")).alias("z")).select("sk", "sq", F.col("z.nodes").alias("sn"), F.col("z.side").alias("side"))
        both = part.join(sides, F.col("k").eqNullSafe(F.col("sk")) & (F.col("q") == F.col("sq")) & (F.col("n") == F.col("sn")), "left").transform(cut)
        done.append(both.filter("side IS NULL").select("k", "q", "n", "part"))
        part = both.filter("side IS NOT NULL").select("k", "q", "n", F.concat("part", F.col("side").cast("string")).alias("part"))
        if part.isEmpty():
            break
    found = reduce(DataFrame.unionByName, done)
    return filled.join(found.withColumnRenamed("n", "m"), F.col(by).eqNullSafe(F.col("k")) & (F.col("buffer") == F.col("q")) & (F.col("n") == F.col("m"))).select(by, "buffer", "n", "id", F.col("part").alias("label"))


def episodes(labels: DataFrame, sims: DataFrame, by: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """(records: by, buffer, n, id, episode (from 1, by their first record); episodes: by, buffer,
    episode, records, first, last (places), coherence: mean similarity of its records, 1 for one)."""
    first = Window.partitionBy(by, "buffer", "label")
    r = labels.withColumn("first", F.min("n").over(first)).withColumn("episode", F.dense_rank().over(Window.partitionBy(by, "buffer").orderBy("first"))).select(by, "buffer", "n", "id", "episode")
    side = lambda s: r.select(F.col("id").alias(s), F.col("episode").alias(f"e{s}"))
    inner = sims.join(side("a"), "a").join(side("b"), "b").filter("ea = eb").groupBy(F.col(by).alias("k"), F.col("buffer").alias("q"), F.col("ea").alias("e")).agg(F.avg("sim").alias("c"))
    g = r.groupBy(by, "buffer", "episode").agg(F.count("*").alias("records"), F.min("n").alias("first"), F.max("n").alias("last"))
    g = g.join(inner, F.col(by).eqNullSafe(F.col("k")) & (F.col("buffer") == F.col("q")) & (F.col("episode") == F.col("e")), "left")
    return r, g.select(by, "buffer", "episode", "records", "first", "last", F.coalesce("c", F.lit(1.0)).alias("coherence"))


def labelled(df: DataFrame, ways: tuple[str, ...], by: str = "session_id", least: float = 0.3, size: int = BUFFER) -> tuple[dict[str, DataFrame], DataFrame]:
    """Labels by each way, and the similarities."""
    set_checkpoints(df.sparkSession)
    filled = buffers(df, by, size).transform(cut)
    sims = pairs(filled, by).transform(cut)
    filled, out = filled.select(by, "buffer", "n", "id"), {}
    if "heuristic" in ways:
        out["heuristic"] = by_likeness(filled, sims, by, least)
    if "graph" in ways or "conductance" in ways:
        edges = edges_of(sims, least)
        graph = by_communities(filled, edges, by)
        if "graph" in ways:
            out["graph"] = graph
        if "conductance" in ways:
            out["conductance"] = refined(graph, edges, by)
    if "spectral" in ways:
        out["spectral"] = by_spectrum(filled, sims, by)
    return {w: out[w] for w in ways}, sims


def split(df: DataFrame, way: str = "multi", by: str = "session_id", least: float = 0.3, size: int = BUFFER) -> tuple[DataFrame, DataFrame]:
    """episodes() by one way; by ``multi`` with the column way: each buffer's best, the first of WAYS of equals."""
    if way != "multi":
        labels, sims = labelled(df, (way,), by, least, size)
        return episodes(labels[way], sims, by)
    labels, sims = labelled(df, WAYS, by, least, size)
    each = {w: episodes(x, sims, by) for w, x in labels.items()}
    rows = reduce(DataFrame.unionByName, [e[0].withColumn("way", F.lit(w)) for w, e in each.items()])
    eps = reduce(DataFrame.unionByName, [e[1].withColumns({"way": F.lit(w), "rank": F.lit(k)}) for k, (w, e) in enumerate(each.items())]).checkpoint()
    n = F.sum("records")
    score = eps.groupBy(by, "buffer", "way", "rank").agg(F.round(F.avg("coherence") - 0.01 * F.abs(F.count("*") - n / 5), 9).alias("score"))
    best = score.groupBy(F.col(by).alias("k"), F.col("buffer").alias("q")).agg(F.min(F.struct((-F.col("score")).alias("s"), "rank", "way"))["way"].alias("best"))
    of = lambda d: d.join(best, F.col(by).eqNullSafe(F.col("k")) & (F.col("buffer") == F.col("q")) & (F.col("way") == F.col("best"))).drop("k", "q", "best", "rank")
    return of(rows), of(eps)
