"""Answers to questions about what profiles found: causal paths, norms that bear on a deed, how efficacy changes, what to aim at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import lexicons as lex
from recollect.functions import text as tx
from recollect.operators.ordered import placed
from recollect.operators.store import cut, set_checkpoints
from recollect.schema import AS_OF, DAY


def causal_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """The shortest way from source to target along causal edges (source, relation, target, strength),
    the first in order of equally short ones: nodes, relations, strength (mean); no row if there is none.

    Rounds of a search by breadth: a node is reached once, by its first path, so a round makes at most
    as many rows as there are edges.
    """
    set_checkpoints(edges.sparkSession)
    best = edges.groupBy(F.col("source").alias("a"), F.col("target").alias("b")).agg(F.max(F.struct("strength", "relation")).alias("m")).select("a", "b", "m.strength", "m.relation").transform(cut)
    none = F.array().cast("array<string>")
    front = edges.sparkSession.range(1).select(F.lit(source).alias("node"), F.array(F.lit(source)).alias("path"), none.alias("relations"), F.lit(0.0).alias("sum"))
    seen = front.select("node")
    while True:
        hit = front.filter(F.col("node") == target).select(F.array_join("path", " > ").alias("nodes"), F.array_join("relations", " > ").alias("relations"), F.when(F.size("path") == 1, 1.0).otherwise(F.round(F.col("sum") / (F.size("path") - 1), 4)).alias("strength"))
        if not hit.isEmpty() or front.isEmpty():
            return hit
        step = front.join(best, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"), F.concat("relations", F.array("relation")).alias("relations"), (F.col("sum") + F.col("strength")).alias("sum"))
        new = step.join(seen, "node", "left_anti").groupBy("node").agg(F.min(F.struct("path", "relations", "sum")).alias("m"))
        front = new.select("node", "m.path", "m.relations", "m.sum").transform(cut)
        seen = seen.unionByName(front.select("node"))


def relevant_norms(norms: DataFrame, deed: str, k: int = 5) -> DataFrame:
    """The norms (domain, keyword, subject, polarity, confidence) that bear on a deed, by words in common."""
    strip = dict.fromkeys(w.strip(tx.PUNCT).lower() for w in deed.split())
    asked = F.array(*[F.lit(w) for w in strip if len(w) >= 3 and w not in tx.STOP]).cast("array<string>")
    own = F.array_distinct(F.filter(F.array("keyword", "subject", "domain"), lambda w: F.length(w) >= 3))
    s = norms.withColumn("relevance", tx.jaccard(own, asked)).filter("relevance > 0")
    return s.orderBy(F.desc("relevance"), F.desc("confidence"), "domain", "keyword", "subject").limit(k)


def efficacy_trend(df: DataFrame) -> DataFrame:
    """By domain: efficacy of the earlier and the later half of its records, and what it does:
    improving or declining where they differ by over .1."""
    t = placed(df.select("domain", "stored_at", "store_seq", "importance", tx.stripped(F.col("content")).alias("t")), "domain", ["stored_at", "store_seq"], total="n")
    has = lambda ws: F.arrays_overlap("t", F.array(*map(F.lit, lex.words(ws))))
    late = F.col("place") > F.floor(F.col("n") / 2)
    mean = lambda part, ws: F.coalesce(F.avg(F.when(part & has(ws), F.col("importance"))), F.lit(0.0))
    g = t.groupBy("domain").agg(F.count("*").alias("n"), *[((mean(p, lex.SUCCESS) - mean(p, lex.FAILURE) + 1) / 2).alias(name) for p, name in ((~late, "early"), (late, "recent"))])
    gap = F.round(F.col("recent") - F.col("early"), 9)
    return g.filter("n >= 2").select("domain", "early", "recent", F.when(gap > 0.1, "improving").when(gap < -0.1, "declining").otherwise("stable").alias("trend"))


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges (a, b, weight) between nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", "weight")


def goals(capability: DataFrame, calibration: DataFrame, markers: DataFrame, sizes: DataFrame, promised: DataFrame, as_of: float = AS_OF) -> DataFrame:
    """What five rules ask for: source, domain, about, priority.

    curiosity    domains of little capability (domain, level) for all their beliefs (beliefs)
    calibration  domains of poor predictions (domain, brier)
    affect       contexts marked as bad (context, valence, strength)
    maintenance  large domains (domain, n)
    obligation   goals of others that stall (goal, domain, status, created_at)
    """
    made = lambda df, source, domain, about, priority: df.select(F.lit(source).alias("source"), domain.alias("domain"), about.cast("string").alias("about"), priority.alias("priority"))
    c = F.col
    days = (F.lit(as_of) - c("created_at")) / DAY
    return reduce(DataFrame.unionByName, [
        made(capability.filter("level < 0.4 AND beliefs > 5"), "curiosity", c("domain"), c("domain"), 0.6 * (1 - c("level"))),
        made(calibration.filter("brier > 0.3"), "calibration", c("domain"), c("domain"), 0.5 * F.least(c("brier"), F.lit(1.0))),
        made(markers.filter("valence < -0.3 AND strength > 0.5"), "affect", F.lit("reflection"), c("context"), 0.4 * F.abs("valence")),
        made(sizes.filter("n > 100"), "maintenance", c("domain"), c("domain"), 0.3 * F.least(c("n") / 500, F.lit(1.0))),
        made(promised.filter((days > 3) & ~F.coalesce("status", F.lit("active")).isin("completed", "done")), "obligation", F.coalesce("domain", F.lit("general")), c("goal"), 0.7 * F.least(days / 14, F.lit(1.0)))])
