"""Reasoning over several hops: the best paths from seeds to what they reach, in bounded work.

Rounds of label correcting. The front holds paths; a round lengthens each by every edge that leads
to a node not on it. All of these are paths found. A node's path stays in the front only if it is
stronger than every one that reached the node in an earlier round, and of a round's only the
``keep`` strongest do: so a round makes at most keep * edges paths a seed, whatever the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.operators.store import cut, set_checkpoints


def two_way(relations: DataFrame, default: float = 0.5) -> DataFrame:
    """a, b, type, strength of relations (source, target, type, strength) in both directions, the
    strongest of a pair; a strength not known is ``default``."""
    known = relations.select("source", "target", "type", F.coalesce("strength", F.lit(default)).alias("strength")).filter("source <> target")
    both = known.select(F.col("source").alias("a"), F.col("target").alias("b"), "type", "strength").unionByName(known.select(F.col("target").alias("a"), F.col("source").alias("b"), "type", "strength"))
    return both.groupBy("a", "b").agg(F.max(F.struct("strength", "type")).alias("m")).select("a", "b", "m.type", "m.strength")


def paths_from(relations: DataFrame, seeds: DataFrame, hops: int = 3, least: float = 0.0, keep: int = 5) -> DataFrame:
    """The paths found from seeds (node): seed, node (the end), path (nodes), types, strength
    (product), hops, kept (among the first ``keep`` of its end: fewer hops first, then strength)."""
    set_checkpoints(relations.sparkSession)
    e = two_way(relations).transform(cut)
    front = seeds.select(F.col("node").alias("seed")).distinct().select("seed", F.array("seed").alias("path"), F.array().cast("array<string>").alias("types"), F.lit(1.0).alias("strength"))
    best = front.select("seed", F.col("seed").alias("node"), "strength")
    found = None
    for step in range(1, hops + 1):
        long = front.join(e.withColumnRenamed("strength", "s"), F.element_at("path", -1) == F.col("a")).filter(~F.array_contains("path", F.col("b")))
        new = long.select("seed", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"), F.concat("types", F.array("type")).alias("types"), (F.col("strength") * F.col("s")).alias("strength"))
        new = new.filter(F.col("strength") >= least).withColumn("hops", F.lit(step)).transform(cut)
        found = new if found is None else found.unionByName(new)
        if step == hops or new.isEmpty():
            break
        known = best.select("seed", "node", F.col("strength").alias("was"))
        order = Window.partitionBy("seed", "node").orderBy(F.desc(F.round("strength", 12)), "path")
        front = new.join(known, ["seed", "node"], "left").filter("was IS NULL OR round(strength, 12) > round(was, 12)").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep).select("seed", "path", "types", "strength")
        best = best.unionByName(new.select("seed", "node", "strength")).groupBy("seed", "node").agg(F.max("strength").alias("strength"))
    first = Window.partitionBy("seed", "node").orderBy("hops", F.desc(F.round("strength", 12)), "path")
    return found.withColumn("kept", F.row_number().over(first) <= keep)


def reachable(paths: DataFrame, most: int = 20) -> DataFrame:
    """What each seed reaches, by its strongest kept path: seed, node, strength, hops (the fewest),
    n_paths (kept ones), path, types; the ``most`` strongest of a seed."""
    k = paths.filter("kept")
    strongest = F.max(F.struct(F.round("strength", 12).alias("s"), (-F.col("hops")).alias("h"), "path", "types", "strength"))
    g = k.groupBy("seed", "node").agg(strongest.alias("m"), F.min("hops").alias("hops"), F.count("*").alias("n_paths"))
    r = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("m.s"), "node"))
    return g.withColumn("r", r).filter(F.col("r") <= most).select("seed", "node", F.col("m.strength").alias("strength"), "hops", "n_paths", F.array_join("m.path", " > ").alias("path"), F.array_join("m.types", " > ").alias("types"))


def bridging(paths: DataFrame, most: int = 10) -> DataFrame:
    """The nodes inside a seed's paths, by the strength that runs through them: seed, node, score, paths."""
    inner = paths.filter("hops > 1").select("seed", F.explode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("node"), "strength")
    g = inner.groupBy("seed", "node").agg(F.sum("strength").alias("score"), F.count("*").alias("paths"))
    r = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc(F.round("score", 9)), "node"))
    return g.withColumn("r", r).filter(F.col("r") <= most).drop("r")


def connection(relations: DataFrame, source: str, target: str, hops: int = 5) -> DataFrame:
    """The strongest kept path between two entities: path, types, strength; no row if there is none."""
    seed = relations.sparkSession.createDataFrame([(source.lower(),)], "node string")
    p = paths_from(relations, seed, hops).filter(F.col("kept") & (F.col("node") == target.lower()))
    return p.orderBy(F.desc(F.round("strength", 12)), "hops", "path").limit(1).select(F.array_join("path", " > ").alias("path"), F.array_join("types", " > ").alias("types"), "strength")
