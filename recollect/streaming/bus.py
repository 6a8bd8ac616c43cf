"""Events on their way: listeners as filters, delivery exactly once, routes from events to tasks.

A micro-batch goes to every listener's folder under its own number, in place of what an earlier try
of the same number left there, so a batch that is played again changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Topic -> (task, measure that must exceed the bound, bound, importance of the task; None: the event's).
ROUTES = {
    "memory.stored": ("self_model_update", "importance", 0.7, None),
    "memory.patterns_detected": ("reflection", None, 0.0, 0.6),
    "prediction.resolved": ("belief_revision", "surprise", 0.3, 0.8),
    "surprise.threshold_exceeded": ("belief_revision", None, 0.0, 0.9),
    "goal.pushed": ("goal_check", None, 0.0, 0.6),
    "emotion.state_changed": ("emotion_regulation", None, 0.0, 0.5),
    "identity.updated": ("self_model_update", None, 0.0, 0.6),
}


@dataclass
class Listener:
    """What a listener hears: the events of its topics (all, if there are none) that ``where`` holds for."""

    name: str
    topics: tuple[str, ...] = ()
    where: str | None = None

    def hears(self) -> Column:
        c = F.col("topic").isin(*self.topics) if self.topics else F.lit(True)
        return F.coalesce(c & F.expr(self.where) if self.where else c, F.lit(False))


def tasks(events: DataFrame) -> DataFrame:
    """Tasks that events (id, topic, domain, importance, surprise) ask for: id, task, topic, domain,
    importance, surprise; topics without a route ask for none."""
    row = F.lit(None)
    for topic, (task, measure, bound, weight) in ROUTES.items():
        asked = F.col("topic") == topic
        if measure:
            asked = asked & (F.coalesce(measure, F.lit(0.5 if measure == "importance" else 0.0)) > bound)
        surprise = F.lit(1.0) if topic == "surprise.threshold_exceeded" else F.coalesce("surprise", F.lit(0.0))
        made = F.struct(F.lit(task).alias("task"), (F.col("importance") if weight is None else F.lit(weight)).cast("double").alias("importance"), surprise.cast("double").alias("surprise"))
        row = F.when(asked, made).otherwise(row)
    t = events.select("id", "topic", F.coalesce("domain", F.lit("general")).alias("domain"), row.alias("t")).filter("t IS NOT NULL")
    return t.select("id", "t.task", "topic", "domain", "t.importance", "t.surprise")


def heard(events: DataFrame, listeners: list[Listener]) -> DataFrame:
    """How many events each listener hears: listener, topic, n."""
    names = F.array_compact(F.array(*[F.when(x.hears(), F.lit(x.name)) for x in listeners]))
    return events.select("topic", F.explode(names).alias("listener")).groupBy("listener", "topic").agg(F.count("*").alias("n"))


def deliver(batch: DataFrame, number: int, path: str, listeners: list[Listener]) -> None:
    """Writes the events of one micro-batch to its listeners, and the tasks they ask for."""
    kept = batch.persist()
    try:
        for x in listeners:
            kept.filter(x.hears()).write.mode("overwrite").parquet(f"{path}/{x.name}/batch={number}")
        tasks(kept).write.mode("overwrite").parquet(f"{path}/tasks/batch={number}")
    finally:
        kept.unpersist()


def subscribe(stream: DataFrame, path: str, checkpoint: str, listeners: list[Listener]) -> None:
    """Delivers what is there and stops; a later call goes on from there."""
    (stream.writeStream.foreachBatch(lambda batch, number: deliver(batch, number, path, listeners)).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def received(spark: SparkSession, path: str, name: str) -> DataFrame:
    """What a listener, or ``tasks``, has received so far."""
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").drop("batch")


def history(events: DataFrame, last: int = 100) -> DataFrame:
    """The newest events, newest first."""
    return events.orderBy(F.desc("id")).limit(last)
