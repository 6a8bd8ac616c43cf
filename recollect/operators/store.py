"""Where operators cut lineage."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def set_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder that the session names; a folder of our own serves
    single-machine sessions only."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            folder = f"file://{tempfile.mkdtemp(prefix='recollect-')}"
        spark.sparkContext.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, for what an operator keeps on disk."""
    import uuid

    set_checkpoints(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: for loops, as a checkpoint keeps the estimates of the plan it
    came from, and those of joins multiply from round to round."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """The files of a cut table go, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def for_now(df: DataFrame):
    """df as a table that goes at the end of the block."""
    out = cut(df)
    try:
        yield out
    finally:
        drop(out)
