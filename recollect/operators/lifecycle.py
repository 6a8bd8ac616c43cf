"""Lifecycle transforms: a table of memories in, the changed table (or the changes) out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import text as tx
from recollect.operators.folds import Line, fold, scan
from recollect.operators.ordered import beside, placed
from recollect.operators.profiles import clamp
from recollect.operators.retrieval import replay_priority
from recollect.schema import AS_OF, DAY


def retention(as_of: float = AS_OF, base: float = 7.0, boost: float = 2.0) -> Column:
    """exp(-days / ((base + boost * access) * (1 + 3 * importance)))."""
    days = F.greatest(F.lit(0.0), (F.lit(as_of) - F.col("last_accessed")) / DAY)
    return F.exp(-days / F.greatest((base + boost * F.col("access_count")) * (1 + 3 * F.col("importance")), F.lit(0.1)))


def decay_report(df: DataFrame, as_of: float = AS_OF) -> DataFrame:
    r = df.withColumn("r", retention(as_of))
    return r.groupBy("domain").agg(F.count("*").alias("n"), F.avg("r").alias("mean_retention"), F.sum((F.col("strength") * F.col("r") < 0.05).cast("long")).alias("prunable"))


def apply_decay(df: DataFrame, as_of: float = AS_OF, prune: float = 0.05) -> DataFrame:
    return df.withColumn("strength", F.col("strength") * retention(as_of)).filter(F.col("strength") >= prune).select("id", "strength")


def item_decay(df: DataFrame, half_life: float = DAY, as_of: float = AS_OF) -> DataFrame:
    return df.select("id", (F.col("strength") * F.exp(-0.693 * (F.lit(as_of) - F.col("last_accessed")) / half_life)).alias("strength"))


def anneal(df: DataFrame, gap_days: float = 1.0) -> DataFrame:
    """One annealing step at temperature 1 / (1 + gap / 3 days)."""
    t = 1 / (1 + gap_days / 3)
    cut = 0.03 * t * (1 - F.col("importance"))
    weaker = F.when(cut > 0.001, F.greatest(F.lit(0.01), F.col("strength") - cut)).otherwise(F.col("strength"))
    s = df.select("id", "importance", weaker.alias("s"), (F.col("valence") - 0.08 * t * F.col("valence")).alias("valence"))
    return s.select("id", F.when(F.col("importance") >= 0.7, F.least(F.lit(2.0), F.col("s") + 0.05 * (1 - t))).otherwise(F.col("s")).alias("strength"), "valence")


def reconsolidate(df: DataFrame, context_valence: float, delta: float = 0.08, drift: float = 0.06) -> DataFrame:
    """Recall strengthens, less so the more often it happened; valence drifts to the context's."""
    k = 1 / F.log(1 + 1.5 * F.greatest(F.lit(1), F.col("access_count")) + 0.0)
    k = F.least(F.lit(1.0), k)
    return df.select("id", F.least(F.lit(2.0), F.col("strength") + delta * k).alias("strength"), clamp(F.col("valence") + drift * k * F.signum(F.lit(context_valence) - F.col("valence")), -1.0, 1.0).alias("valence"), (F.col("access_count") + 1).alias("access_count"))


def dream(df: DataFrame, up: int = 20, down: int = 10, gain: float = 0.05, loss: float = 0.05, prune: float = 0.05) -> DataFrame:
    """The records most worth replaying get stronger, the least worth weaker; faint ones go."""
    s = df.withColumn("p", replay_priority())
    best = s.orderBy(F.desc("p"), "store_seq").limit(up).select("id", F.lit(gain).alias("gain"))
    worst = s.orderBy("p", F.desc("store_seq")).limit(down).select("id", F.lit(loss).alias("loss"))
    out = df.join(F.broadcast(best), "id", "left").join(F.broadcast(worst), "id", "left")
    out = out.withColumn("strength", F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("strength") + F.coalesce("gain", F.lit(0.0))) - F.coalesce("loss", F.lit(0.0))))
    return out.select("id", "strength", F.col("gain").isNotNull().alias("reinforced"), F.col("loss").isNotNull().alias("weakened"), (F.col("strength") < prune).alias("pruned"))


def suppress(df: DataFrame, rate: float = 0.4, prune: float = 0.05) -> DataFrame:
    """Motivated forgetting of what df holds: strength * (1 - rate)."""
    s = F.col("strength") * (1 - rate)
    return df.select("id", s.alias("strength"), (s < prune).alias("pruned"))


def promote(df: DataFrame, threshold: float = 0.55) -> DataFrame:
    """New tier of each record after one consolidation pass; null tier: forgotten."""
    score = 0.35 * F.col("importance") + 0.25 * F.col("novelty") + 0.25 * F.col("strength") + 0.15 * F.least(F.lit(1.0), F.col("access_count") / 5)
    to = (F.when((F.col("tier") == "working") & F.col("pinned"), "long_term").when((F.col("tier") == "working") & (score >= threshold), "short_term")
          .when((F.col("tier") == "short_term") & (((score >= threshold) & (F.col("access_count") >= 2)) | (F.col("importance") >= 0.8) | F.col("pinned")), "long_term")
          .when((F.col("tier") == "short_term") & (F.col("strength") <= 0.1), F.lit(None))
          .when((F.col("tier") == "long_term") & (F.col("access_count") >= 5) & (F.col("strength") > 0.5), "semantic").otherwise(F.col("tier")))
    return df.select("id", "tier", to.alias("new_tier"))


def evict_overflow(df: DataFrame, capacity: dict[str, int]) -> DataFrame:
    """Oldest records beyond the capacity of a namespace's tier."""
    cap = F.create_map(*[F.lit(x) for kv in capacity.items() for x in kv])
    few = df.filter(F.col("tier").isin(list(capacity))).select("namespace", "tier", "id", "store_seq", F.struct("namespace", "tier").alias("key"))
    p = placed(few, "key", ["store_seq"], total="n")
    return p.filter(F.col("n") - F.col("place") >= cap[F.col("tier")]).select("namespace", "tier", "id")


def purge_expired(df: DataFrame, as_of: float = AS_OF) -> DataFrame:
    return df.filter((F.col("expires_at") < as_of) & F.col("superseded_by").isNull()).select("id", F.lit("__expired__").alias("superseded_by"))


def vote(df: DataFrame, feedback: DataFrame) -> DataFrame:
    """Strength after votes (id, up, down): +.1 an up, -.2 a down, clamped to [0, 1]."""
    f = feedback.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return df.join(f, "id").select("id", clamp(F.col("strength") + 0.1 * F.col("up") - 0.2 * F.col("down")).alias("strength"), (F.col("access_count") + F.col("up")).alias("access_count"))


def supersede_by_key(df: DataFrame, key: str) -> DataFrame:
    """Patch mode: each record of a key is superseded by the next one stored."""
    return beside(df.select(key, "id", "store_seq"), key, ["store_seq"], {"by": "id"}, after=True).filter("by IS NOT NULL").select("id", F.col("by").alias("superseded_by"))


def content_hash() -> Column:
    return F.sha2(F.substring(F.lower(F.trim("content")), 1, 200), 256)


def duplicate_contents(df: DataFrame) -> DataFrame:
    """Contents stored more than once (by the hash of their first 200 characters)."""
    return df.groupBy(content_hash().alias("content_hash")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def compress_episodes(df: DataFrame, size: int = 3) -> DataFrame:
    """Unpinned short-term records of a namespace merged by threes in order of storing."""
    c = placed(df.filter("tier = 'short_term' AND NOT pinned").drop("content"), "namespace", ["store_seq"]).withColumn("chunk", F.floor((F.col("place") - 1) / size))
    return c.groupBy("namespace", "chunk").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("importance").alias("importance"), F.max("novelty").alias("novelty"), F.avg("valence").alias("valence"),
                                               F.when(F.min("domain") == F.max("domain"), F.min("domain")).otherwise("multi").alias("domain"))


def snapshot_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """How records differ between two snapshots: added, removed, strengthened, weakened (by .05), superseded."""
    cols = lambda df, s: df.select("id", F.col("strength").alias(f"s{s}"), F.col("superseded_by").alias(f"p{s}"), F.lit(True).alias(f"in{s}"))
    j = cols(a, 1).join(cols(b, 2), "id", "full_outer")
    kind = (F.when(F.col("in1").isNull(), "added").when(F.col("in2").isNull(), "removed").when(F.col("p1").isNull() & F.col("p2").isNotNull(), "superseded")
            .when(F.col("s2") - F.col("s1") > 0.05, "strengthened").when(F.col("s2") - F.col("s1") < -0.05, "weakened"))
    return j.withColumn("change", kind).filter("change IS NOT NULL").select("id", "change", (F.col("s2") - F.col("s1")).alias("delta"))


def federate(target: DataFrame, source: DataFrame, policy: str = "newest_wins") -> DataFrame:
    """source merged into target: contents that target has are dropped; equal ids by policy."""
    have = target.select(content_hash().alias("h")).distinct()
    new = source.withColumn("h", content_hash()).join(have, "h", "left_anti")
    new = new.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("store_seq"))).filter("r = 1")
    l = target.select("id", F.col("stored_at").alias("t1"), F.col("importance").alias("i1"), F.lit(True).alias("here"))  # noqa: E741
    r = new.select("id", F.col("stored_at").alias("t2"), F.col("importance").alias("i2"), F.lit(True).alias("there"))
    wins = {"local_wins": F.lit(False), "newest_wins": F.col("t2") > F.col("t1"), "importance_wins": F.col("i2") > F.col("i1")}[policy]
    origin = F.when(F.col("there").isNull(), "local").when(F.col("here").isNull(), "merged").when(wins, "replaced").otherwise("local")
    return l.join(r, "id", "full_outer").select("id", origin.alias("origin"))


def sm2(reviews: DataFrame) -> DataFrame:
    """Spaced repetition: the review log (memory_id, reviewed_at, quality 0-5) folded per card.

    Intervals are 1, 6, then the last one times the ease factor before its update; ease >= 1.3. Ease
    and repetitions are scanned first; the interval is a product since the last lapse. Any length
    of a card's log is fine.
    """
    q = F.greatest(F.lit(0), F.least(F.lit(5), "quality"))
    log = reviews.select("memory_id", "reviewed_at", q.alias("quality"))
    ok = F.col("quality") >= 3
    ease = Line(1.0, 0.1 - (5 - F.col("quality")) * (0.08 + (5 - F.col("quality")) * 0.02), 1.3, start=2.5)
    reps = Line(F.when(ok, 1.0).otherwise(0.0), F.when(ok, 1.0).otherwise(0.0))
    order = ["reviewed_at", "quality"]
    log = scan(log, "memory_id", order, {"ease": ease, "reps": reps})
    grows = ok & (F.col("reps_before") >= 2)
    days = Line(F.when(grows, F.col("ease_before")).otherwise(0.0), F.when(grows, 0.0).when(ok & (F.col("reps_before") == 1), 6.0).otherwise(1.0))
    lapses = Line(1.0, F.when(ok, 0.0).otherwise(1.0))
    c = fold(log, "memory_id", order, {"interval_days": days, "lapses": lapses}, ("reviewed_at", "ease", "reps"))
    return c.select("memory_id", F.col("n").cast("int").alias("reviews"), F.col("reps").cast("int").alias("reps"), "ease", "interval_days", F.col("lapses").cast("int").alias("lapses"), (F.col("reviewed_at") + F.col("interval_days") * DAY).alias("next_review"))


def check_intentions(intentions: DataFrame, context: str, least: float = 0.15) -> DataFrame:
    """Intentions (id, trigger_context, priority) whose trigger overlaps the context."""
    ctx = F.array_distinct(F.array(*[F.lit(w) for w in context.lower().split()]))
    o = tx.jaccard(F.array_distinct(tx.words(F.col("trigger_context"))), ctx)
    return intentions.withColumn("overlap", o).filter(F.col("overlap") >= least).select("id", (F.col("overlap") * (0.5 + 0.5 * F.col("priority"))).alias("score"))


def citations_found(df: DataFrame, cites: DataFrame) -> DataFrame:
    """Per citation (id, cited): whether it exists; the cited record's new strength."""
    known = df.select(F.col("id").alias("cited"), "strength")
    return cites.join(known, "cited", "left").select("id", "cited", F.col("strength").isNotNull().alias("found"), F.least(F.lit(1.0), F.col("strength") + 0.1).alias("strength"))


def fold_access(df: DataFrame, log: DataFrame) -> DataFrame:
    """Access counts and times after an access log (id, at): reads stay pure, maintenance folds."""
    g = log.groupBy("id").agg(F.count("*").cast("int").alias("c"), F.max("at").alias("at"))
    return df.join(g, "id").select("id", (F.col("access_count") + F.col("c")).alias("access_count"), F.greatest("last_accessed", "at").alias("last_accessed"))


def source_monitor(df: DataFrame) -> DataFrame:
    """Origin of each record by a rule cascade, counted: hints in the first 200 characters, importance."""
    head = F.lower(F.substring("content", 1, 200))
    kind = F.when(head.contains("licens"), "documentation").when(head.contains("copyright"), "documentation").when(F.col("importance") >= 0.8, "observation").when(F.col("importance") < 0.3, "inference").otherwise("experience")
    return df.select(kind.alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def token_importance(df: DataFrame, as_of: float = AS_OF) -> DataFrame:
    """.4 recency (one day half-life) + .4 importance + .2 frequency, per record."""
    return df.select("id", (0.4 * F.exp(-0.693 * (F.lit(as_of) - F.col("last_accessed")) / DAY) + 0.4 * F.col("importance") + 0.2 * F.least(F.lit(1.0), F.col("access_count") / 10)).alias("keep"))
