"""Streaming ingest: quality filter, dedup with a watermark, novelty, snapshots by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.operators.rules import fingerprint


def read_feed(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def clean(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Good records (content, ts), first of each fingerprint within the watermark.

    State is bounded by time, not by count.
    """
    w = tx.words(F.col("content"))
    good = stream.filter((F.length("content") >= 20) & (F.size(w) >= 5) & (F.size(F.array_distinct(w)) >= 0.3 * F.size(w)))
    return good.withColumn("fp", fingerprint(F.col("content"))).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["fp"]).drop("fp")


def rates(stream: DataFrame, lateness: str = "1 hour", size: str = "10 minutes") -> DataFrame:
    """Records and mean importance by event-time window and domain."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", size).alias("w"), "domain").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "domain", "n")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into Parquet, exactly once, and stop."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def fold_affect(keep: float = 0.85):
    """State function for applyInPandasWithState: the running affect of a session (v, a)."""
    def step(key, batches, state):
        import pandas as pd

        v, a = state.get if state.exists else (0.0, 0.3)
        for pdf in batches:
            for x in pdf.sort_values(["stored_at", "store_seq"]).valence:
                v, a = keep * v + (1 - keep) * x, 0.9 * max(a, min(1.0, abs(x) * 1.5)) + 0.03
        state.update((v, a))
        yield pd.DataFrame({"session_id": [key[0]], "valence": [v], "arousal": [a]})

    return step


def affect_stream(stream: DataFrame) -> DataFrame:
    """Affect of each session as events come in; the batch fold is sequences.ema_affect."""
    return stream.groupBy("session_id").applyInPandasWithState(fold_affect(), "session_id long, valence double, arousal double", "v double, a double", "update", "NoTimeout")
