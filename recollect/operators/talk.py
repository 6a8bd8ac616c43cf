"""Conversation memory: what a buffer let go, in a few sentences; strategies that change by their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import lexicons as lex
from recollect.operators.condense import buffer_chunks, sentences

CHUNK = ["conv_id", "chunk"]


def latin(c: str, least: int) -> Column:
    """The words of a text that are ``least`` letters from a to z and nothing else."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: w.rlike(f"^[a-z]{{{least},}}$"))


def chunk_keywords(gone: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent words (four letters at least) of each chunk, the first said of equals: conv_id, chunk, keys."""
    said = gone.select(*CHUNK, "i", F.posexplode(latin("text", 4)).alias("p", "w")).filter(~F.col("w").isin(lex.words(lex.TALK_STOP)))
    counts = said.groupBy(*CHUNK, "w").agg(F.count("*").alias("n"), F.min(F.struct("i", "p")).alias("at"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy(*CHUNK).orderBy(F.desc("n"), "at"))).filter(F.col("r") <= k)
    return best.groupBy(*CHUNK).agg(F.collect_list("w").alias("keys"))


def _apart(kept: Column, own: Column, most: float) -> Column:
    """Whether own is no near repeat of any of the kept ones (sets of words)."""
    return F.forall(kept, lambda k: F.size(F.array_intersect(k["w"], own)) <= most * F.size(F.array_union(k["w"], own)))


def chunk_summaries(turns: DataFrame, window: int = 20, evict: int = 5, most: int = 4, alike: float = 0.7) -> DataFrame:
    """A summary of each chunk of turns (conv_id, turn, role, text) that left the buffer: conv_id,
    chunk, first_turn, last_turn, summary.

    A sentence of over ten letters scores by its keywords and its length, without stop words; the
    best go in, up to ``most``, unless over ``alike`` of the words are those of one that is in. They
    stand in the order they were said. A chunk without such a sentence is the beginnings of its
    turns. A task holds the sentences of one chunk, ``evict`` turns.
    """
    gone = buffer_chunks(turns, window, evict).filter("chunk IS NOT NULL").select(*CHUNK, F.col("i").cast("int").alias("i"), F.coalesce("text", F.lit("")).alias("text"))
    gone = gone.repartition(*CHUNK)  # texts travel once, all that follows is grouped by chunk
    span = gone.groupBy(*CHUNK).agg(F.min("i").alias("first_turn"), F.max("i").alias("last_turn"), F.sort_array(F.collect_list(F.struct("i", F.substring("text", 1, 80).alias("t")))).alias("starts"))
    each = gone.select(*CHUNK, "i", F.posexplode(sentences(F.col("text"))).alias("j", "s")).filter(F.length("s") > 10)
    each = each.withColumn("w", F.array_distinct(latin("s", 3))).join(chunk_keywords(gone), CHUNK, "left")
    own = F.array_except("w", F.array(*map(F.lit, lex.words(lex.TALK_STOP))))
    n = F.size(own)
    score = F.when(n == 0, 0.0).otherwise((F.coalesce(F.size(F.array_intersect(own, F.coalesce("keys", F.array().cast("array<string>")))), F.lit(0)) + F.least(F.lit(1.0), n / 15)) / (1 + n / 30))
    ranked = each.select(*CHUNK, F.struct((-F.round(score, 9)).alias("least"), "i", "j", "s", "w").alias("x")).groupBy(*CHUNK).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    start = F.slice("xs", 1, 0)
    kept = F.aggregate("xs", start, lambda out, x: F.when((F.size(out) < most) & _apart(out, x["w"], alike), F.concat(out, F.array(x))).otherwise(out))
    said = F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"), x["s"].alias("s"))))
    picked = ranked.select(*CHUNK, F.array_join(F.transform(said, lambda x: x["s"]), " ").alias("best"))
    return span.join(picked, CHUNK, "left").select(*CHUNK, "first_turn", "last_turn", F.coalesce("best", F.array_join(F.transform("starts", lambda x: x["t"]), " ")).alias("summary"))


def by_outcome(strategies: DataFrame, outcomes: DataFrame) -> DataFrame:
    """strategies (domain, name, prefix, template, alpha, beta, pulls) after outcomes (domain, name,
    reward from 0 to 1): successes and failures add up, so their order plays no part."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "reward"))
    got = outcomes.groupBy("domain", "name").agg(F.sum(r).alias("won"), F.sum(1 - r).alias("lost"), F.count("*").alias("n"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return strategies.join(got, ["domain", "name"], "left").select("domain", "name", "prefix", "template", (F.col("alpha") + z("won")).alias("alpha"), (F.col("beta") + z("lost")).alias("beta"), (F.col("pulls") + z("n")).alias("pulls"))


def next_generation(strategies: DataFrame, most: int = 10) -> DataFrame:
    """One round of evolution of every domain's strategies, all domains at once.

    Ranked by expected success alpha / (alpha + beta), then name: where there is room, the two best
    have a child with the prefix of the first and the template of the second; of three and more the
    one in the middle, once pulled three times, has a variant with the best one's template; then,
    beyond ``most``, those of five pulls and more go, the least first. New ones begin at 1, 1, 0.
    """
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    w = Window.partitionBy("domain")
    s = strategies.select("domain", "name", "prefix", "template", "alpha", "beta", F.col("pulls").cast("long").alias("pulls"))
    s = s.withColumn("rank", F.row_number().over(w.orderBy(F.desc(mean), "name"))).withColumn("n", F.count("*").over(w))
    middle = F.floor(F.col("n") / 2) + 1
    pick = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    g = s.groupBy("domain", "n").agg(*[pick(r, c).alias(f"{c}{r}") for r in (1, 2) for c in ("name", "prefix", "template")], *[pick(middle, c).alias(f"mid_{c}") for c in ("name", "prefix", "pulls")])
    fresh = [F.lit(1.0).alias("alpha"), F.lit(1.0).alias("beta"), F.lit(0).cast("long").alias("pulls")]
    child = g.filter((F.col("n") >= 2) & (F.col("n") < most)).select("domain", F.concat_ws("+", "name1", "name2").alias("name"), F.col("prefix1").alias("prefix"), F.col("template2").alias("template"), *fresh)
    variant = g.filter("n >= 3 AND mid_pulls >= 3").select("domain", F.concat("mid_name", F.lit("*")).alias("name"), F.col("mid_prefix").alias("prefix"), F.col("template1").alias("template"), *fresh)
    every = s.select("domain", "name", "prefix", "template", "alpha", "beta", "pulls").unionByName(child).unionByName(variant)
    able = F.col("pulls") >= 5
    every = every.withColumn("over", F.count("*").over(w) - most).withColumn("r", F.row_number().over(Window.partitionBy("domain", able).orderBy(mean, F.desc("name"))))
    return every.filter(~(able & (F.col("r") <= F.col("over")))).drop("over", "r")
