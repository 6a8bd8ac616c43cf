"""Streams that remember: words and fingerprints met, the last turns, what befell a source.

State lives in the session's RocksDB state store, which must be set
(``spark.sql.streaming.stateStore.providerClass``). Vocabularies and fingerprints are spread over
``SHARDS`` keys a namespace, so no key holds all of them; an age (TTL) bounds them by time, not by
count. Rows of a key within a micro-batch are taken in their order; across micro-batches they must
come in order, as everywhere in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from recollect.functions import text as tx
from recollect.operators.rules import fingerprint

SHARDS = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Errors in a row after which a source is off.
OFF_AFTER = 5


def _one(name: str, kind) -> StructType:
    return StructType([StructField(name, kind)])


def _rows(batches: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(list(order), kind="stable")


def stateful(stream: DataFrame, by: list[str], processor: StatefulProcessor, shape: str, ttl: bool = False) -> DataFrame:
    if "RocksDB" not in stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    return stream.groupBy(*by).transformWithStateInPandas(processor, shape, "append", "ProcessingTime" if ttl else "None")


class FirstMet(StatefulProcessor):
    """For each row (item, seq, id) whether its item is met for the first time; a map of items, with an age."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.met = handle.getMapState("met", _one("item", StringType()), _one("seq", LongType()), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, first = _rows(rows, "seq", "id"), []
        known: dict[str, int | None] = {}
        for item, seq in zip(pdf["item"], pdf.seq, strict=True):
            if item not in known:
                known[item] = self.met.getValue((item,))[0] if self.met.containsKey((item,)) else None
            if known[item] is None:
                known[item] = int(seq)
                self.met.updateValue((item,), (int(seq),))
            first.append(known[item] == int(seq))
        yield pd.DataFrame({"id": pdf.id, "first": first})

    def close(self) -> None:
        pass


def first_words(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Per record (id, namespace, store_seq, content) and distinct word: id, first (no earlier record of
    the namespace has it). ``novelty`` of a micro-batch's rows is the mean of first by id."""
    t = stream.select("id", F.col("store_seq").alias("seq"), F.coalesce("namespace", F.lit("")).alias("namespace"), F.explode(F.array_distinct(tx.words(F.col("content")))).alias("item"))
    t = t.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(SHARDS)).cast("int"))
    return stateful(t, ["namespace", "shard"], FirstMet(ttl_ms), "id long, first boolean", ttl_ms is not None)


def novelty(first: DataFrame) -> DataFrame:
    """id, novelty of rows of first_words (of one micro-batch, or as written)."""
    return first.groupBy("id").agg(F.avg(F.col("first").cast("double")).alias("novelty"))


def first_contents(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """id of each record (id, store_seq, content) that is the first of its fingerprint."""
    t = stream.select("id", F.col("store_seq").alias("seq"), fingerprint(F.col("content")).alias("item"))
    t = t.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(SHARDS)).cast("int"))
    return stateful(t, ["shard"], FirstMet(ttl_ms), "id long, first boolean", ttl_ms is not None).filter("first").select("id")


class LastTurns(StatefulProcessor):
    """The number of distinct words of a conversation's last turns, at each turn; a list of their words."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle) -> None:
        self.last = handle.getListState("last", _one("words", ArrayType(StringType())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, "turn", "role", "text")
        last = [list(w[0]) for w in self.last.get()] if self.last.exists() else []
        out = []
        for turn, role, words in zip(pdf.turn, pdf.role, pdf.words, strict=True):
            last = [*last, list(words)][-self.size:]
            out.append((key[0], turn, role, len({w for ws in last for w in ws})))
        self.last.put([(w,) for w in last])
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "words"])

    def close(self) -> None:
        pass


def rolling_context(stream: DataFrame, size: int = 6) -> DataFrame:
    """condense.rolling_context of turns (conv_id, turn, role, text) as they come in."""
    t = stream.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.array_distinct(tx.words(F.col("text"))).alias("words"))
    return stateful(t, ["conv_id"], LastTurns(size), "conv_id long, turn long, role string, words int")


class SourceHealth(StatefulProcessor):
    """What becomes of each fetch of a source; the time of the last one that was made, errors in a row, on or off."""

    def __init__(self, off_after: int):
        self.off_after = off_after

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("last", DoubleType()), StructField("errors", LongType()), StructField("on", BooleanType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, out = _rows(rows, "at", "ok"), []
        last, errors, on = self.state.get() if self.state.exists() else (float("-inf"), 0, True)
        for at, ok, every in zip(pdf["at"], pdf.ok, pdf.every, strict=True):
            if not on:
                what = "off"
            elif at - last < every:
                what = "too early"
            elif ok:
                what, last, errors = "fetched", float(at), 0
            else:
                what, errors = "failed", errors + 1
                on = errors < self.off_after
            out.append((key[0], float(at), what, errors, on))
        self.state.update((last, errors, on))
        yield pd.DataFrame(out, columns=["source", "at", "outcome", "errors", "enabled"])

    def close(self) -> None:
        pass


def source_health(stream: DataFrame, off_after: int = OFF_AFTER) -> DataFrame:
    """Fetches (source, at, ok, every: least seconds between two) with their outcome: fetched, failed,
    too early, or off once a source has failed ``off_after`` times in a row."""
    return stateful(stream.select("source", "at", "ok", "every"), ["source"], SourceHealth(off_after), "source string, at double, outcome string, errors long, enabled boolean")
