"""Order within a key whatever the key's size: places, neighbours and running sums.

If every key has ``SIZE`` rows at most, a window a key does. Else rows stand in ranges over (key,
order), from a sample, and are cut into buckets of ``SIZE``; a window never holds more than a bucket,
however the order's values are spread, and what goes over from one bucket of a key to the next
(counts, sums, the row at its edge) is one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.operators.store import set_checkpoints

SIZE = 65_536


def bucketed(df: DataFrame, by: str, order: list[str], size: int | None = None) -> tuple[DataFrame, bool]:
    """df with __k (hash of the key, nulls too) and __b (bucket, ascending in the order), and whether
    a key has more than one."""
    size, d = size or SIZE, df.withColumn("__k", F.xxhash64(F.col(by)))
    if (d.groupBy("__k").count().agg(F.max("count")).first()[0] or 0) <= size:
        return d.withColumn("__b", F.lit(0).cast("long")), False
    set_checkpoints(df.sparkSession)
    by_place = ["__k", *order, "__id"]
    kept = d.withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    b = F.spark_partition_id().cast("long") * (1 << 33) + F.floor(row / size)
    return kept.repartitionByRange(*by_place).sortWithinPartitions(*by_place).select(*[F.col(f"`{c}`") for c in d.columns], b.alias("__b")).checkpoint(), True


def _bare(df: DataFrame) -> DataFrame:
    return df.drop("__k", "__b")


def placed(df: DataFrame, by: str, order: list[str], name: str = "place", total: str | None = None, size: int | None = None) -> DataFrame:
    """df with the 1-based place of each row in its key; total: also the key's rows."""
    d, many = bucketed(df, by, order, size)
    own = F.row_number().over(Window.partitionBy("__k", "__b").orderBy(*order)).cast("long")
    if not many:
        out = d.withColumn(name, own)
        return _bare(out.withColumn(total, F.count("*").over(Window.partitionBy("__k", "__b"))) if total else out)
    c = d.groupBy("__k", "__b").agg(F.count("*").alias("__c"))
    w = Window.partitionBy("__k")
    base = c.select("__k", "__b", (F.sum("__c").over(w.orderBy("__b")) - F.col("__c")).alias("__base"), F.sum("__c").over(w).alias("__all"))
    out = d.join(base, ["__k", "__b"]).withColumn(name, F.col("__base") + own)
    if total:
        out = out.withColumn(total, F.col("__all"))
    return _bare(out).drop("__base", "__all")


def beside(df: DataFrame, by: str, order: list[str], cols: dict[str, str], after: bool = False, size: int | None = None) -> DataFrame:
    """df with columns (name -> column) of the row before in its key; after: of the one behind."""
    d, many = bucketed(df, by, order, size)
    row = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    step = F.lead if after else F.lag
    out = d.withColumn("__near", step(row).over(Window.partitionBy("__k", "__b").orderBy(*order)))
    if many:
        edge = (F.min if after else F.max)(F.struct(*order, row.alias("row")))["row"]
        edges = d.groupBy("__k", "__b").agg(edge.alias("__edge"))
        edges = edges.withColumn("__edge", step("__edge").over(Window.partitionBy("__k").orderBy("__b")))
        out = out.join(edges, ["__k", "__b"]).withColumn("__near", F.coalesce("__near", "__edge")).drop("__edge")
    return _bare(out.select("*", *[F.col(f"__near.{n}").alias(n) for n in cols])).drop("__near")


def running(df: DataFrame, by: str, order: list[str], value: Column, total: str, count: str, size: int | None = None) -> DataFrame:
    """df with the sum of value and the rows up to each row of its key."""
    d, many = bucketed(df.withColumn("__v", value), by, order, size)
    upto = Window.partitionBy("__k", "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not many:
        return _bare(d.withColumn(total, F.sum("__v").over(upto)).withColumn(count, F.count("*").over(upto))).drop("__v")
    c = d.groupBy("__k", "__b").agg(F.count("*").alias("__c"), F.sum("__v").alias("__s"))
    w = Window.partitionBy("__k").orderBy("__b")
    base = c.select("__k", "__b", (F.sum("__c").over(w) - F.col("__c")).alias("__bc"), (F.sum("__s").over(w) - F.col("__s")).alias("__bs"))
    out = d.join(base, ["__k", "__b"]).withColumn(total, F.col("__bs") + F.sum("__v").over(upto)).withColumn(count, F.col("__bc") + F.count("*").over(upto))
    return _bare(out).drop("__v", "__bc", "__bs")


def runs(df: DataFrame, column: str, order: list[str], longest: int, shortest: int = 2, size: int = 4_096) -> DataFrame:
    """Every run of ``shortest`` to ``longest`` neighbouring values of column in one order over the whole
    table: run (array). Rows go in blocks of ``size``, each with the last rows of the block before, so
    runs cross blocks and no window holds the table."""
    p = placed(df.select(F.lit(0).alias("__one"), *dict.fromkeys([column, *order])), "__one", order)
    at = F.col("place") - 1
    block, inside = F.floor(at / size), at % size
    lent = F.when(inside >= size - (longest - 1), F.array(block, block + 1)).otherwise(F.array(block))
    rows = p.select(F.explode(lent).alias("block"), "place", F.col(column).alias("v"))
    g = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("s"))
    # A run belongs to the block of its last row; lent rows end none.
    v, lent = F.col("s.v"), F.size(F.filter("s", lambda x: F.floor((x["place"] - 1) / size) < F.col("block")))

    def ending(i: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(shortest), F.lit(longest)), lambda k: k <= i + 1), lambda k: F.slice(v, i + 2 - k, k))

    own = g.filter(lent < F.size("s")).select(F.flatten(F.transform(F.sequence(lent, F.size("s") - 1), ending)).alias("r"))
    return own.select(F.explode("r").alias("run"))
