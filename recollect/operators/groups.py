"""Disjoint groups of records around shared keywords: schemas and lessons.

In each domain the most common keywords are seeds, in order. A seed takes all records that have it
and belong to no earlier group, if they are enough; else it takes none. A record's seeds are the bits
of a number, and a record is taken exactly if it has an accepted seed, so a seed's decision needs only
how many records there are of each number.

All domains and all seeds are decided together, in rounds: a seed is accepted once there are enough
records without any earlier seed that is accepted or open, and refused once there are too few without
an accepted one. The first open seed of a domain is always decided, mostly all of them are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import text as tx
from recollect.operators.store import cut, set_checkpoints


def keyword_rows(df: DataFrame) -> DataFrame:
    """id, domain, tok: each record's distinct keywords."""
    return df.select("id", F.coalesce("domain", F.lit("general")).alias("domain"), F.explode(F.array_distinct(tx.keywords(F.col("content")))).alias("tok"))


def seed_groups(rows: DataFrame, seeds: int = 30, support: int = 2, most: int = 12) -> DataFrame:
    """Of keyword_rows: id, domain, seed, rank (of the seed in its domain): the group of each record
    that is in one. At most 62 seeds a domain, ``most`` groups."""
    if not 0 < seeds <= 62:
        raise ValueError("1 to 62 seeds")
    set_checkpoints(rows.sparkSession)
    rows = rows.transform(cut)
    freq = rows.groupBy("domain", "tok").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    best = freq.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "tok")) - 1).filter(F.col("r") < seeds).transform(cut)
    bit = F.expr("shiftleft(1L, r)")
    masks = rows.join(best, ["domain", "tok"]).groupBy("domain", "id").agg(F.bit_or(bit).alias("mask")).transform(cut)
    counted = masks.groupBy("domain", "mask").agg(F.count("*").alias("c")).transform(cut)
    state = best.groupBy("domain").agg(F.bit_or(bit).alias("open")).withColumn("taken", F.lit(0).cast("long")).transform(cut)
    one = lambda r: F.lit(1 << r).cast("long")
    while not state.filter("open <> 0").isEmpty():
        j = counted.join(state.filter("open <> 0"), "domain")
        sums = []
        for r in range(seeds):
            has, mask = F.col("mask").bitwiseAND(one(r)) != 0, F.col("mask")
            free = has & (mask.bitwiseAND(F.col("taken")).bitwiseAND(one(r) - 1) == 0)  # later seeds take nothing from it
            alone = free & (mask.bitwiseAND(F.col("open")).bitwiseAND(one(r) - 1) == 0)
            sums += [F.sum(F.when(free, F.col("c")).otherwise(0)).alias(f"up{r}"), F.sum(F.when(alone, F.col("c")).otherwise(0)).alias(f"low{r}")]
        found = j.groupBy("domain", "open", "taken").agg(*sums)
        yes = no = F.lit(0).cast("long")
        for r in range(seeds):
            is_open = F.col("open").bitwiseAND(one(r)) != 0
            yes = yes.bitwiseOR(F.when(is_open & (F.col(f"low{r}") >= support), one(r)).otherwise(0))
            no = no.bitwiseOR(F.when(is_open & (F.col(f"up{r}") < support), one(r)).otherwise(0))
        decided = found.select("domain", F.col("open").bitwiseAND(F.bitwise_not(yes.bitwiseOR(no))).alias("open"), F.col("taken").bitwiseOR(yes).alias("taken"))
        state = state.filter("open = 0").select("domain", "open", "taken").unionByName(decided).transform(cut)
    accepted = best.join(state, "domain").filter(F.col("taken").bitwiseAND(bit) != 0)
    accepted = accepted.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy("r"))).filter(F.col("k") <= most)
    own = rows.join(accepted.select("domain", "tok", "r"), ["domain", "tok"])
    return own.groupBy("id", "domain").agg(F.min(F.struct("r", "tok")).alias("m")).select("id", "domain", F.col("m.tok").alias("seed"), F.col("m.r").alias("rank"))


def described(df: DataFrame, rows: DataFrame, groups: DataFrame, shown: int) -> DataFrame:
    """A row a group: domain, seed, rank, members, confidence (share of the domain's records), keywords
    (those of two members at least, the most common first), valence, spread (of valence)."""
    said = rows.select("id", "tok").join(groups, "id").groupBy("domain", "rank", "tok").agg(F.count("*").alias("n")).filter("n >= 2")
    few = said.withColumn("r", F.row_number().over(Window.partitionBy("domain", "rank").orderBy(F.desc("n"), "tok"))).filter(F.col("r") <= shown)
    words = few.groupBy("domain", "rank").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "tok"))), lambda x: x["tok"]), ", ").alias("keywords"))
    size = df.groupBy(F.coalesce("domain", F.lit("general")).alias("domain")).agg(F.count("*").alias("all"))
    g = groups.join(df.select("id", "valence"), "id").groupBy("domain", "seed", "rank").agg(F.count("*").alias("members"), F.avg("valence").alias("valence"), (F.max("valence") - F.min("valence")).alias("spread"))
    return g.join(size, "domain").join(words, ["domain", "rank"], "left").select("domain", "seed", "rank", "members", (F.col("members") / F.col("all")).alias("confidence"), F.coalesce("keywords", "seed").alias("keywords"), "valence", "spread")


def schemas(df: DataFrame, support: int = 2, most: int = 12) -> DataFrame:
    """Schemas of every domain: domain, seed, rank, members, confidence, keywords (six)."""
    rows = keyword_rows(df)
    return described(df, rows, seed_groups(rows, 30, support, most), 6).drop("valence", "spread")


def lesson_kind(members: Column, valence: Column, spread: Column) -> Column:
    return F.when(spread > 0.6, "contrast").when((F.abs(valence) < 0.1) & (members >= 3), "principle").when(members <= 2, "gap").otherwise("pattern")


def lessons(df: DataFrame, least: float = 0.5, most: int = 8) -> DataFrame:
    """Lessons of the important records of every domain: domain, seed, rank, members, confidence,
    keywords (four), kind."""
    few = df.filter(F.col("importance") >= least)
    rows = keyword_rows(few)
    d = described(few, rows, seed_groups(rows, 20, 2, most), 4)
    return d.select("domain", "seed", "rank", "members", "confidence", "keywords", lesson_kind(F.col("members"), F.col("valence"), F.col("spread")).alias("kind"))


def open_questions(found: DataFrame, per_domain: int = 3) -> DataFrame:
    """What the largest lessons leave open: domain, kind, keywords, question."""
    r = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("members"), "rank"))
    ask = F.when(F.col("kind") == "contrast", F.lit("Why do records on ")).when(F.col("kind") == "gap", F.lit("What is missing on ")).otherwise(F.lit("What follows from "))
    end = F.when(F.col("kind") == "contrast", F.lit(" disagree?")).otherwise(F.lit("?"))
    return found.withColumn("r", r).filter(F.col("r") <= per_domain).select("domain", "kind", "keywords", F.concat(ask, "keywords", end).alias("question"))
