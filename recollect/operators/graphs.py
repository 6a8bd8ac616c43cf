"""Graph algorithms on weighted edges (a, b, weight) and clustering of texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import text as tx
from recollect.operators.knowledge import ancestors
from recollect.operators.ordered import beside
from recollect.operators.pairs import association_activation, association_edges, both_ways, spreading_activation
from recollect.operators.retrieval import lexical, top
from recollect.operators.store import cut, set_checkpoints


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("a").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength")).withColumnRenamed("a", "id")


def _propagate(label: DataFrame, best_of: Callable[[DataFrame], DataFrame], rounds: int, at_once: bool) -> DataFrame:
    """The rounds of communities: best_of gives each node's (id) best label."""
    for i in range(rounds):
        turn = F.lit(True) if at_once else F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2)) == 0
        new = label.join(best_of(label), "id").select("id", F.when(turn, F.col("best")).otherwise(F.col("label")).alias("label"), (F.col("label") != F.col("best")).alias("moves")).transform(cut)
        label = new.select("id", "label")
        if new.filter("moves").isEmpty():
            return label
    if not at_once:
        raise RuntimeError(f"labels have not settled after {rounds} rounds")
    return label


def communities(edges: DataFrame, rounds: int = 100, at_once: bool = False) -> DataFrame:
    """Label propagation: the label of most weight around, ties to the lowest; the own one weighs .001.

    Ends when no node would change its label. In a round one half of the nodes, drawn by a hash, may
    change; labels that have not settled after ``rounds`` are an error. at_once: all nodes change in
    each of ``rounds``, where neighbours can swap labels for ever, and what is there then is returned.
    """
    set_checkpoints(edges.sparkSession)
    e = both_ways(edges).transform(cut)
    label = e.select("a").distinct().select(F.col("a").alias("id"), F.col("a").alias("label")).transform(cut)

    def best_of(label: DataFrame) -> DataFrame:
        votes = e.join(label, e.b == label.id).select(F.col("a").alias("id"), "label", "weight").unionByName(label.withColumn("weight", F.lit(0.001)))
        s = votes.groupBy("id", "label").agg(F.round(F.sum("weight"), 6).alias("w"))
        return s.groupBy("id").agg(F.max(F.struct("w", (-F.col("label")).alias("neg")))["neg"].alias("neg")).select("id", (-F.col("neg")).alias("best"))

    return _propagate(label, best_of, rounds, at_once)


def association_communities(df: DataFrame, rounds: int = 100, at_once: bool = False, window: float = 300.0, most: int = 1 << 22) -> DataFrame:
    """communities of pairs.association_edges(df), whose edges are never stored: labels go to blocks of
    time, where each node has all its neighbours and votes, ``most`` weights at a time."""
    set_checkpoints(df.sparkSession)
    t = df.select("id", "domain", "stored_at")
    for after in (False, True):
        t = beside(t, "domain", ["stored_at", "id"], {"next" if after else "last": "stored_at"}, after=after)
    near = lambda gap: 1 - gap / window > 0
    met = F.coalesce(near(F.col("stored_at") - F.col("last")), F.lit(False)) | F.coalesce(near(F.col("next") - F.col("stored_at")), F.lit(False))
    nodes = t.filter(met & F.col("domain").isNotNull()).select("id", "domain", "stored_at").transform(cut)
    # Blocks of 32 windows, each with the records up to a window (and a second) off its ends.
    long, k = 32 * window, F.floor(F.col("stored_at") / (32 * window))
    blocks = F.array(k, F.floor((F.col("stored_at") - window - 1) / long), F.floor((F.col("stored_at") + window + 1) / long))

    def vote(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("stored_at", kind="stable")
        ids, at, label, own = g.id.to_numpy(), g.stored_at.to_numpy(), g.label.to_numpy(), np.flatnonzero(g.own.to_numpy())
        best, step = np.empty(len(own), np.int64), max(1, min(64, most // len(g)))
        for i in range(0, len(own), step):
            rows = own[i:i + step]
            y = np.arange(np.searchsorted(at, at[rows[0]] - window), np.searchsorted(at, at[rows[-1]] + window, "right"))
            y = y[np.argsort(label[y], kind="stable")]
            labels, starts = np.unique(label[y], return_index=True)
            w = np.maximum(1 - np.abs(at[rows][:, None] - at[y]) / window, 0)
            w[ids[rows][:, None] == ids[y]] = 0.001
            best[i:i + step] = labels[np.argmax(np.round(np.add.reduceat(w, starts, axis=1), 6), axis=1)]
        return pd.DataFrame({"id": ids[own], "best": best})

    def best_of(label: DataFrame) -> DataFrame:
        rows = nodes.join(label, "id").select("id", "domain", "stored_at", "label", F.explode(F.array_distinct(blocks)).alias("k"), k.alias("home"))
        return rows.select("id", "domain", "stored_at", "label", "k", (F.col("k") == F.col("home")).alias("own")).groupBy("domain", "k").applyInPandas(vote, "id long, best long")

    return _propagate(nodes.select("id", F.col("id").alias("label")), best_of, rounds, at_once)


def association_bridges(df: DataFrame, label: DataFrame) -> DataFrame:
    """bridges of pairs.association_edges(df), labels put to records before edges arise."""
    e = association_edges(df.join(label, "id"), keep=["label"]).filter("a_label <> b_label")
    return e.select("a", "b", "weight", F.col("a_label").alias("community_a"), F.col("b_label").alias("community_b"))


def association_modularity(df: DataFrame, label: DataFrame) -> DataFrame:
    """modularity of pairs.association_edges(df), labels put to records before edges arise."""
    end = lambda c: F.struct(F.col(f"{c}_label").alias("label"), F.col("weight").alias("d"), F.when(F.col("a_label") == F.col("b_label"), F.col("weight") / 2).otherwise(0.0).alias("w"))
    g = association_edges(df.join(label, "id"), keep=["label"]).select(F.inline(F.array(end("a"), end("b")))).groupBy("label").agg(F.sum("d").alias("d"), F.sum("w").alias("w")).transform(cut)
    m = F.broadcast(g.agg((F.sum("d") / 2).alias("m")))
    return g.crossJoin(m).agg(F.sum(F.col("w") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"), F.count("*").alias("communities"))


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Q = sum over communities of inner / m - (degree / 2m) squared."""
    side = lambda c: label.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    e = edges.join(side("a"), "a").join(side("b"), "b")
    inner = e.groupBy(F.col("la").alias("label")).agg(F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0)).alias("w"))
    deg = degrees(edges).join(label, "id").groupBy("label").agg(F.sum("strength").alias("d"))
    m = F.broadcast(edges.agg(F.sum("weight").alias("m")))
    j = deg.join(inner, "label", "left").crossJoin(m)
    return j.agg(F.sum(F.coalesce("w", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"), F.count("*").alias("communities"))


def bridges(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Edges between communities."""
    side = lambda c: label.select(F.col("id").alias(c), F.col("label").alias(f"community_{c}"))
    return edges.join(side("a"), "a").join(side("b"), "b").filter("community_a <> community_b").select("a", "b", "weight", "community_a", "community_b")


def strongest_paths(edges: DataFrame, source: int, steps: int) -> DataFrame:
    """Strength (product of weights) of the best path of at most ``steps`` edges from source;
    ``knowledge.strongest_paths`` has no such bound and gives the paths."""
    e = both_ways(edges)
    best = e.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(1.0).alias("strength"))
    for _ in range(steps):
        step = best.join(e, best.id == e.a).select(F.col("b").alias("id"), (F.col("strength") * F.col("weight")).alias("strength"))
        best = best.unionByName(step).groupBy("id").agg(F.max("strength").alias("strength"))
    return best.filter(F.col("id") != source)


def association_strongest_paths(df: DataFrame, source: int, steps: int) -> DataFrame:
    """strongest_paths over pairs.association_edges(df), whose edges are never shuffled."""
    start = df.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"))
    return association_activation(df, start, 1.0, 0.0, steps).withColumnRenamed("activation", "strength")


def simple_paths(edges: DataFrame, source: int, hops: int = 3) -> DataFrame:
    """Simple paths from source with their strength (multi-hop reasoning)."""
    e = both_ways(edges)
    front = e.sparkSession.range(1).select(F.array(F.lit(source).cast("long")).alias("path"), F.lit(1.0).alias("strength"))
    out = None
    for _ in range(hops):
        front = front.join(e, F.element_at("path", -1) == e.a).filter(~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"), (F.col("strength") * F.col("weight")).alias("strength"))
        out = front if out is None else out.unionByName(front)
    return out


def bridging_scores(paths: DataFrame, k: int = 10) -> DataFrame:
    """Nodes inside paths by the strength that runs through them."""
    inner = paths.filter("size(path) > 2").select(F.explode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("id"), "strength")
    return inner.groupBy("id").agg(F.sum("strength").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def associative_retrieve(df: DataFrame, edges: DataFrame, query: str, seeds: int = 3, k: int = 10) -> DataFrame:
    """Records that the query's best matches activate."""
    s = top(df.withColumn("score", lexical(query)), seeds).select("id")
    return spreading_activation(edges, s).orderBy(F.desc("activation"), "id").limit(k)


def insight_bridges(df: DataFrame, edges: DataFrame, least: float = 0.45, k: int = 8) -> DataFrame:
    """Strongest edges between records of different sessions."""
    side = lambda c: df.select(F.col("id").alias(c), F.col("session_id").alias(f"s{c}"))
    e = edges.filter(F.col("weight") >= least).join(side("a"), "a").join(side("b"), "b").filter("sa <> sb")
    return e.orderBy(F.desc("weight"), "a", "b").limit(k).select("a", "b", F.concat(F.lit("Session "), "sa", F.lit(" meets "), "sb").alias("insight"), "weight")


def tfidf_clusters(df: DataFrame, k: int = 8, features: int = 1 << 12, seed: int = 42) -> DataFrame:
    """Spherical k-means on TF-IDF of keywords: id, cluster (MLlib)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    t = df.select("id", tx.keywords(F.col("content"), 3).alias("words")).filter("size(words) > 0")
    steps = [HashingTF(inputCol="words", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="idf", minDocFreq=2), Normalizer(inputCol="idf", outputCol="features"), KMeans(k=k, seed=seed, distanceMeasure="cosine", predictionCol="cluster", maxIter=10)]
    return Pipeline(stages=steps).fit(t).transform(t).select("id", "cluster")


def tree_depths(tree: DataFrame) -> DataFrame:
    """Depth of each node (node, parent) and its root; null root for a root itself."""
    up = ancestors(tree)
    top = up.groupBy("node").agg(F.max(F.struct("steps", "ancestor")).alias("m"))
    return tree.select("node").join(top, "node", "left").select("node", F.col("m.ancestor").alias("root"), F.coalesce("m.steps", F.lit(0)).alias("depth"))


def blend(df: DataFrame, per_domain: int = 8, least: float = 0.0, k: int = 6) -> DataFrame:
    """Conceptual blends of records of two domains: shared / union * min(1, 4 sa sb) + .005 min(unique, 3)."""
    few = df.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy("store_seq"))).filter(F.col("r") <= per_domain)
    t = few.select("id", "domain", "strength", F.array_distinct(tx.keywords(F.col("content"))).alias("t"))
    tok = t.select("id", "domain", F.explode("t").alias("tok"))
    pair = tok.select(F.col("id").alias("a"), F.col("domain").alias("da"), "tok").join(tok.select(F.col("id").alias("b"), F.col("domain").alias("db"), "tok"), "tok").filter("da < db").groupBy("a", "b").agg(F.count("*").alias("shared"))
    side = lambda c: t.select(F.col("id").alias(c), F.col("strength").alias(f"s{c}"), F.size("t").alias(f"n{c}"))
    j = pair.join(side("a"), "a").join(side("b"), "b")
    s = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")) * F.least(F.lit(1.0), 4 * F.col("sa") * F.col("sb")) + 0.005 * F.least(F.col("na") - F.col("shared"), F.lit(3))
    return j.withColumn("score", s).filter(F.col("score") >= least).orderBy(F.desc("score"), "a", "b").limit(k).select("a", "b", "score")


def vector_dedup_rate(vectors: DataFrame, dims: int = 16) -> DataFrame:
    """By label: vectors and distinct sign patterns of the leading components (a cheap sketch)."""
    sign = F.concat_ws("", F.transform(F.slice("embedding", 1, dims), lambda x: F.when(x >= 0, "1").otherwise("0")))
    return vectors.select("label", sign.alias("s")).groupBy("label", "s").agg(F.count("*").alias("c")).groupBy("label").agg(F.sum("c").alias("n"), F.count("*").alias("patterns"))


def crossmodal_scores(df: DataFrame) -> DataFrame:
    """Mean of three modality similarities to the mean record: emotional, temporal, importance."""
    m = F.broadcast(df.agg(F.avg("valence").alias("mv"), F.avg("intensity").alias("mi"), F.avg("importance").alias("mp")))

    def near(c: str, mean: str, span: float) -> Column:
        return F.greatest(F.lit(0.0), 1 - F.abs(F.col(c) - F.col(mean)) / span)

    return df.crossJoin(m).select("id", ((near("valence", "mv", 2.0) + near("intensity", "mi", 1.0) + near("importance", "mp", 1.0)) / 3).alias("binding"))


def core_retrieve_vectors(vectors: DataFrame, query: list[float], k: int = 10, threshold: float = 0.1) -> DataFrame:
    """Vector path of the core retrieval: min(1, cosine + tier and access boosts) over a threshold.

    vectors has id, store_seq, embedding, tier, access_count.
    """
    from recollect.operators.retrieval import cosine

    boost = F.when(F.col("tier") == "semantic", 0.08).when(F.col("tier") == "long_term", 0.04).when(F.col("tier") == "short_term", 0.02).otherwise(0.0)
    s = F.least(F.lit(1.0), cosine(F.col("embedding").cast("array<double>"), F.array(*map(F.lit, query))) + boost + F.least(F.lit(0.05), 0.01 * F.col("access_count")))
    return top(vectors.withColumn("score", s).filter(F.col("score") > threshold), k).select("id", "tier", "score")


def wisdom(df: DataFrame, query: str, k: int = 8) -> DataFrame:
    """What the k most relevant records say: value words, moral weight, shared principles, and how
    many of these dimensions they touch (confidence = share of dimensions)."""
    from recollect.operators.profiles import map_values, moral_scores

    best = top(df.withColumn("score", lexical(query)), k).drop("score")
    v = map_values(best).agg(F.count("*").alias("values_found"))
    m = moral_scores(best).agg(F.sum("moral_weight").alias("moral_weight"), F.sum((F.col("dominant") != "none").cast("long")).alias("moral_records"))
    t = best.select("id", F.explode(F.array_distinct(tx.keywords(F.col("content")))).alias("tok")).groupBy("tok").agg(F.count("*").alias("c")).filter("c >= 3").agg(F.count("*").alias("principles"))
    j = v.crossJoin(m).crossJoin(t)
    dims = (F.col("values_found") > 0).cast("int") + (F.col("moral_records") > 0).cast("int") + (F.col("principles") > 0).cast("int") + (F.col("moral_weight") > 0).cast("int")
    return j.select("values_found", "moral_records", "principles", F.coalesce("moral_weight", F.lit(0.0)).alias("moral_weight"), (dims / 4).alias("confidence"))
