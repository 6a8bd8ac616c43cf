"""Sources and sinks: snapshots, JSON lines, Markdown and graph text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_snapshot(df: DataFrame, path: str, version: int) -> str:
    """A new directory for each version; what is being read is never overwritten."""
    out = f"{path}/v{version:06d}"
    df.write.mode("errorifexists").partitionBy("namespace").parquet(out)
    return out


def load_snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v{version:06d}")


def _paths(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were saved whole: those with a manifest."""
    p, fs = _paths(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/manifest")))


def save_tables(tables: dict[str, DataFrame], path: str) -> int:
    """All tables as one new version; the manifest is written last, so half a version is none."""
    spark = next(iter(tables.values())).sparkSession
    p, fs = _paths(spark, path)
    taken = [int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName()[1:].isdigit()] if fs.exists(p) else []
    version = max(taken, default=0) + 1
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/v{version:06d}/{name}")
    spark.createDataFrame([(name,) for name in tables], "name string").coalesce(1).write.json(f"{path}/v{version:06d}/manifest")
    return version


def load_tables(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the newest whole one by default."""
    version = max(versions(spark, path)) if version is None else version
    names = [r["name"] for r in spark.read.schema("name string").json(f"{path}/v{version:06d}/manifest").collect()]
    return {n: spark.read.parquet(f"{path}/v{version:06d}/{n}") for n in names}


class KeyValues:
    """A small store of JSON values: appended rows, the last one of a key holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        schema = "key string, at timestamp, value string"
        p, fs = _paths(self.spark, self.path)
        return self.spark.read.schema(schema).json(self.path) if fs.exists(p) else self.spark.createDataFrame([], schema)

    def save(self, key: str, value) -> None:
        import json

        row = self.spark.createDataFrame([(key, json.dumps(value))], "key string, value string")
        row.select("key", F.current_timestamp().alias("at"), "value").write.mode("append").json(self.path)

    def load(self, key: str):
        import json

        got = self._rows().filter(F.col("key") == key).agg(F.max_by("value", "at")).first()[0]
        return None if got is None else json.loads(got)

    def keys(self) -> list[str]:
        return sorted(r["key"] for r in self._rows().select("key").distinct().collect())


def export_jsonl(df: DataFrame, path: str) -> None:
    df.filter("NOT private").write.mode("overwrite").json(path)


def import_jsonl(spark: SparkSession, path: str, schema, known: DataFrame) -> DataFrame:
    """Records of a JSON lines folder whose id is not known yet; tier and strength start anew."""
    new = spark.read.schema(schema).json(path).join(known.select("id"), "id", "left_anti")
    return new.withColumn("tier", F.lit("working")).withColumn("strength", F.lit(1.0))


def append_sessions(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def markdown(df: DataFrame) -> DataFrame:
    """One row a line, in order: domain, line_no, line; contents cut at 500 characters."""
    head = df.select("domain").distinct().select("domain", F.lit(-1.0).alias("at"), F.lit(-1).cast("long").alias("store_seq"), F.concat(F.lit("## "), F.col("domain")).alias("line"))
    body = df.filter("NOT private").select("domain", F.col("stored_at").alias("at"), "store_seq", F.concat(F.lit("- "), F.regexp_replace(F.substring("content", 1, 500), "\\n", " ")).alias("line"))
    return head.unionByName(body).orderBy("domain", "at", "store_seq").select("domain", "line")


def dot(edges: DataFrame, k: int) -> DataFrame:
    """Lines of a DOT graph of the k strongest edges."""
    return edges.orderBy(F.desc("weight"), "a", "b").limit(k).select(F.format_string('  "%d" -> "%d" [weight=%.3f];', "a", "b", "weight").alias("line"))
