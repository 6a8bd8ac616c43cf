"""Stateful streams over three micro-batches, each a run of its own, against their batch forms."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.operators import condense, rules, sequences
from recollect.streaming import state
from recollect.streaming.ingest import run_available

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, state.ROCKSDB)
    yield
    spark.conf.set(PROVIDER, was)


def streamed(spark, tmp_path, parts, make):
    """What make(stream) writes when each of parts arrives and the query starts anew."""
    src, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(src)
        run_available(make(spark.readStream.schema(parts[0].schema).parquet(src)), out, check)
    return spark.read.parquet(out)


@pytest.fixture(scope="module")
def records(spark):
    rng = np.random.default_rng(16)
    rows = [(i, i, f"n{i % 2}", " ".join(f"w{int(t)}" for t in rng.zipf(1.5, 12) % 60)) for i in range(90)] + [(90, 90, "n0", None), (91, 91, None, "w1 w1 alone"), (92, 92, "n0", "w1 w2, w3! w4 w5"), (93, 93, "n0", "W5 w4 w3 w2 w1")]
    return spark.createDataFrame(rows, "id long, store_seq long, namespace string, content string")


def thirds(df, by="id"):
    return [df.filter(F.col(by) < 31), df.filter((F.col(by) >= 31) & (F.col(by) < 62)), df.filter(F.col(by) >= 62)]


def test_novelty(spark, tmp_path, records):
    got = state.novelty(streamed(spark, tmp_path, thirds(records), state.first_words))
    want = sequences.streaming_novelty(records.na.fill({"namespace": ""}), tx.words(F.col("content")))
    assert {(r.id, round(r.novelty, 9)) for r in got.collect()} == {(r.id, round(r.novelty, 9)) for r in want.collect()}


def test_dedup(spark, tmp_path, records):
    parts = thirds(records) + [records.filter("id < 5").withColumn("store_seq", F.col("store_seq") + 1000).withColumn("id", F.col("id") + 1000)]
    got = {r.id for r in streamed(spark, tmp_path, parts, state.first_contents).collect()}
    fp = records.select("id", rules.fingerprint(F.col("content")).alias("fp"))
    assert got == {r.id for r in fp.groupBy("fp").agg(F.min("id").alias("id")).collect()} and 93 not in got


def test_dedup_with_an_age(spark, tmp_path, records):
    """A query with an age runs until it is stopped."""
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    records.coalesce(1).write.parquet(src)
    q = state.first_contents(spark.readStream.schema(records.schema).parquet(src), 3_600_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check").start()
    try:
        for _ in range(240):
            if any(p["numInputRows"] for p in q.recentProgress):
                break
            time.sleep(0.25)
    finally:
        q.stop()
    fp = records.select("id", rules.fingerprint(F.col("content")).alias("fp"))
    assert {r.id for r in spark.read.parquet(out).collect()} == {r.id for r in fp.groupBy("fp").agg(F.min("id").alias("id")).collect()}


def test_rolling_context(spark, tmp_path):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-1, i, "user", f"w{i} same") for i in range(20)], turns.schema))
    parts = [turns.filter("turn < 2"), turns.filter("turn >= 2 AND turn < 5"), turns.filter("turn >= 5")]
    got = streamed(spark, tmp_path, parts, state.rolling_context)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, condense.rolling_context(turns).select("conv_id", "turn", "role", "words").collect()))


def test_sources_go_off_after_errors_in_a_row(spark, tmp_path):
    rng = np.random.default_rng(17)
    rows = [(s, float(t), bool(rng.random() > bad), 2.5) for s, bad in (("good", .1), ("bad", .8), ("flaky", .55)) for t in range(60)]
    df = spark.createDataFrame(rows, "source string, at double, ok boolean, every double")
    got = streamed(spark, tmp_path, [df.filter("at < 20"), df.filter("at >= 20 AND at < 40"), df.filter("at >= 40")], state.source_health)
    want = []
    for s in ("good", "bad", "flaky"):
        last, errors, on = float("-inf"), 0, True
        for _, at, ok, every in [r for r in rows if r[0] == s]:
            if not on:
                what = "off"
            elif at - last < every:
                what = "too early"
            elif ok:
                what, last, errors = "fetched", at, 0
            else:
                what, errors = "failed", errors + 1
                on = errors < 5
            want.append((s, at, what, errors, on))
    assert sorted(map(tuple, got.collect())) == sorted(want) and {r.source for r in got.filter("NOT enabled").collect()} >= {"bad"}


def test_needs_rocksdb(spark, records):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError, match="RocksDB"):
        state.first_words(records)
