"""Shared plumbing of the training-data operators: tables, shared storage, components.

Everything that has to outlive an executor is written below the shared folder that the
session names in ``spark.checkpoint.dir``; a folder of our own is used only where that
setting is empty (single-machine tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``)."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='recollect-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write df below the shared folder and read it back: cuts lineage, survives lost executors.

    small: far fewer rows than the input (edges, links); goes to an eighth as many files.
    """
    spark = df.sparkSession
    if small:
        df = df.coalesce(max(4, parallelism(spark) // 8))
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(*written: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows, as texts are long; Python workers stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > 1000:
        spark.conf.set(key, "1000")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph given as edges of long ids.

    Returns (id, component_id), component_id being the smallest id reached, for every id on an
    edge. Large-star and small-star rounds until nothing changes: each is two hash aggregations
    with partial sums and a join, so a vertex of very high degree is never gathered in one task.
    Self-loops are fine.
    """
    def stats(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum("v").alias("v")).first()
        return r["n"], r["h"], r["v"]

    first = cur = materialize(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .filter("u IS NOT NULL AND v IS NOT NULL").distinct(), "cc", small=True)
    loops = first.filter("u = v").select(F.col("u").alias("id"))
    seen = stats(cur.filter("u <> v"))
    while seen[0]:
        real = cur.filter("u <> v")
        both = real.unionAll(real.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low.select("u", F.col("m").alias("v"))).distinct()
        done, cur = cur, materialize(nxt, "cc", small=True)
        if done is not first:
            discard(done)
        now = stats(cur)
        if now == seen:
            break
        seen = now
    cur = cur.filter("u <> v")
    done = cur.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    roots = cur.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    lone = loops.join(done.select("id"), "id", "left_anti").withColumn("component_id", F.col("id"))
    return done.unionAll(roots).unionAll(lone).groupBy("id").agg(F.min("component_id").alias("component_id"))
