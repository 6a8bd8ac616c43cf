"""Timelines, sessions and runs: window operators over time-ordered memories.

Windows are partitioned by a key (domain or session). Where the semantics need one order over
the whole table, per-key or per-bucket sums come first and only those are ordered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import text as tx
from recollect.operators.folds import Line, fold, scan
from recollect.operators.ordered import beside, placed


def timeline_gaps(df: DataFrame, by: str = "domain", least: float = 300.0) -> DataFrame:
    """Gaps of at least ``least`` seconds between neighbours of one key."""
    g = beside(df.select(by, "id", "stored_at", "store_seq"), by, ["stored_at", "store_seq"], {"next_at": "stored_at", "next_id": "id"}, after=True)
    return g.withColumn("gap", F.col("next_at") - F.col("stored_at")).filter(F.col("gap") >= least).select(by, "id", "next_id", "gap")


def timeline_density(df: DataFrame, size: float = 3600.0) -> DataFrame:
    """Records in each bucket of ``size`` seconds from the first record, empty buckets included."""
    ends = df.agg(F.min("stored_at").alias("t0"), F.max("stored_at").alias("t1"))
    ends = ends.withColumn("n", F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) / size)).cast("long"))
    at = df.crossJoin(F.broadcast(ends)).select(F.least(F.floor((F.col("stored_at") - F.col("t0")) / size), F.col("n") - 1).cast("long").alias("bucket"))
    found = at.groupBy("bucket").agg(F.count("*").alias("c"))
    every = ends.select("t0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bucket"))
    return every.join(found, "bucket", "left").select("bucket", (F.col("t0") + F.col("bucket") * size).alias("start"), F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def timeline_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("domain").agg(F.count("*").alias("n"), F.min("stored_at").alias("first_at"), F.max("stored_at").alias("last_at"), F.avg("importance").alias("mean_importance"))


def mood_trajectory(df: DataFrame, by: str = "session_id", parts: int = 5) -> DataFrame:
    """Each key's records in ``parts`` near-equal runs: mean and spread of valence, label."""
    s = df.withColumn("segment", F.ntile(parts).over(Window.partitionBy(by).orderBy("stored_at", "store_seq")))
    g = s.groupBy(by, "segment").agg(F.avg("valence").alias("mean_valence"), F.stddev_pop("valence").alias("spread"))
    return g.withColumn("label", F.when(F.col("spread") > 0.4, "volatile").when(F.col("mean_valence") > 0.2, "positive").when(F.col("mean_valence") < -0.2, "negative").otherwise("neutral"))


def mood_trend(df: DataFrame, by: str = "session_id", parts: int = 5) -> DataFrame:
    """Rising, falling or stable by the slope of the segments' means (least squares, +-.05)."""
    g = mood_trajectory(df, by, parts).groupBy(by).agg(F.regr_slope("mean_valence", "segment").alias("slope"))
    return g.withColumn("trend", F.when(F.col("slope") > 0.05, "rising").when(F.col("slope") < -0.05, "falling").otherwise("stable"))


def resilience_arcs(df: DataFrame, by: str = "session_id", low: float = -0.2, least: int = 2, after: int = 5) -> DataFrame:
    """Runs of valence below ``low``: length, mean, mean of the next records, recovery."""
    w = Window.partitionBy(by).orderBy("stored_at", "store_seq")
    s = df.select(by, "store_seq", "stored_at", "valence", F.row_number().over(w).alias("r"), F.avg("valence").over(w.rowsBetween(1, after)).alias("next_mean")).withColumn("bad", F.col("valence") < low)
    s = s.withColumn("run", F.col("r") - F.row_number().over(Window.partitionBy(by, "bad").orderBy("stored_at", "store_seq"))).filter("bad")
    g = s.groupBy(by, "run").agg(F.count("*").alias("length"), F.min("r").alias("start"), F.avg("valence").alias("depth"), F.max_by("next_mean", "r").alias("next_mean")).filter(F.col("length") >= least)
    return g.select(by, "start", "length", "depth", (F.col("next_mean") - F.col("depth")).alias("slope"), F.coalesce(F.col("next_mean") - F.col("depth") > 0.2, F.lit(False)).alias("recovered"))


def narrative_threads(df: DataFrame, by: str = "domain", size: int = 5) -> DataFrame:
    """Chapters of ``size`` records of a key in time order: span, mood, most important record."""
    s = placed(df.select(by, "id", "stored_at", "store_seq", "valence", "importance"), by, ["stored_at", "store_seq"]).withColumn("chapter", F.floor((F.col("place") - 1) / size))
    return s.groupBy(by, "chapter").agg(F.count("*").alias("n"), F.min("stored_at").alias("from_at"), F.max("stored_at").alias("to_at"), F.avg("valence").alias("mood"),
                                        F.max(F.struct("importance", (-F.col("store_seq")).alias("s"), "id"))["id"].alias("theme_id"))


def presence(df: DataFrame, by: str = "session_id", half: float = 20.0, budget: float = 50.0) -> DataFrame:
    """Per turn: attention 1 / (1 + (turn / 20) ^ 1.5), budget left, rolling mood of five turns."""
    w = Window.partitionBy(by).orderBy("stored_at", "store_seq")
    t = F.row_number().over(w)
    return df.select(by, "id", (1 / (1 + F.pow(t / half, F.lit(1.5)))).alias("presence"), F.greatest(F.lit(0.0), 1 - t / budget).alias("budget"), F.avg("valence").over(w.rowsBetween(-4, 0)).alias("mood"))


def episodes(df: DataFrame, by: str = "session_id", threshold: float = 0.5, decay: float = 3600.0) -> DataFrame:
    """Episodes of a session: a new one where domain and closeness in time fall below a threshold."""
    w = Window.partitionBy(by).orderBy("stored_at", "store_seq")
    sim = 0.4 * F.when(F.col("domain") == F.lag("domain").over(w), 1.0).otherwise(0.3) + 0.6 * F.exp(-0.693 * (F.col("stored_at") - F.lag("stored_at").over(w)) / decay)
    s = df.select(by, "id", "store_seq", "stored_at", "valence", F.coalesce((sim < threshold).cast("int"), F.lit(1)).alias("new"))
    s = s.withColumn("episode", F.sum("new").over(w))
    return s.groupBy(by, "episode").agg(F.count("*").alias("turns"), F.min("stored_at").alias("opened_at"), F.max("stored_at").alias("closed_at"), F.avg("valence").alias("mean_valence"),
                                        F.max(F.struct(F.abs("valence").alias("a"), (-F.col("store_seq")).alias("s"), F.col("valence").alias("v")))["v"].alias("peak_valence"))


def session_summary(df: DataFrame) -> DataFrame:
    g = df.groupBy("session_id", "domain").agg(F.count("*").alias("c"), F.sum("valence").alias("v"), F.min("stored_at").alias("a"), F.max("stored_at").alias("b"))
    return g.groupBy("session_id").agg(F.sum("c").alias("n"), F.min("a").alias("started_at"), F.max("b").alias("ended_at"), (F.sum("v") / F.sum("c")).alias("mean_valence"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", "c")))).alias("types"))


def open_threads(df: DataFrame, top: int = 5) -> DataFrame:
    """Important but unconsolidated records of each namespace to carry into the next session."""
    s = 0.35 * F.col("importance") + 0.25 * F.col("novelty") + 0.25 * F.col("strength") + 0.15 * F.least(F.lit(1.0), F.col("access_count") / 5)
    t = df.filter(F.col("importance") >= 0.5).withColumn("score", s).filter("score < 0.5")
    r = F.row_number().over(Window.partitionBy("namespace").orderBy(F.desc("importance"), "store_seq"))
    return t.withColumn("r", r).filter(F.col("r") <= top).select("namespace", "id", "importance", "score")


def rolling_coherence(df: DataFrame, seconds: int = 3600) -> DataFrame:
    """Share of a session's records in the last hour that have the record's domain."""
    hour = Window.partitionBy("session_id").orderBy(F.col("stored_at").cast("long")).rangeBetween(-seconds, 0)
    same = Window.partitionBy("session_id", "domain").orderBy(F.col("stored_at").cast("long")).rangeBetween(-seconds, 0)
    return df.select("id", (F.count("*").over(same) / F.count("*").over(hour)).alias("coherence"))


def streaming_novelty(df: DataFrame, tokens) -> DataFrame:
    """Share of a record's distinct words that no earlier record of its namespace has."""
    t = df.select("id", "namespace", "store_seq", F.explode(F.array_distinct(tokens)).alias("tok"))
    first = t.groupBy("namespace", "tok").agg(F.min("store_seq").alias("first"))
    return t.join(first, ["namespace", "tok"]).groupBy("id").agg(F.avg((F.col("store_seq") == F.col("first")).cast("double")).alias("novelty"))


def affect_lines(keep: float = 0.85) -> dict[str, Line]:
    """What an event's valence x does to a mood: v = .85 v + .15 x within [-1, 1]; a = .9 max(a, min(1, 1.5 |x|)) + .03."""
    x = F.col("valence")
    spike = F.least(F.lit(1.0), F.abs(x) * 1.5)
    return {"mood": Line(keep, x * (1 - keep), -1.0, 1.0, 0.0), "arousal": Line(0.9, 0.1 * 0.3, 0.9 * spike + 0.1 * 0.3, 1.0, 0.3)}


def ema_affect(df: DataFrame, by: str = "session_id", keep: float = 0.85) -> DataFrame:
    """Affect after each session's events, whatever their number: valence, arousal."""
    return fold(df.select(by, "stored_at", "store_seq", "valence"), by, ["stored_at", "store_seq"], affect_lines(keep)).select(by, F.col("mood").alias("valence"), "arousal")


def affect_traits(df: DataFrame, by: str = "session_id") -> DataFrame:
    """ema_affect with what it means: breadth of attention, depth of processing, tolerance of risk,
    search for the new, label by quadrant."""
    v, a = F.col("valence"), F.col("arousal")
    within = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    high, good = a >= 0.5, v >= 0
    label = F.when(good & high, "excited").when(good, "calm").when(high, "anxious").otherwise("sad")
    return ema_affect(df, by).select(by, "valence", "arousal", within((1 - a) * 0.5 + (v + 1) / 4).alias("breadth"), within(1 - a).alias("depth"), within((v + 1) / 2 + 0.1 * (0.5 - F.abs(a - 0.5))).alias("risk"),
                                     within(0.3 * (v + 1) + 0.4 * F.greatest(F.lit(0.0), 1 - 2 * F.abs(a - 0.5))).alias("novelty_seeking"), label.alias("label"))


def affect_history(df: DataFrame, by: str = "session_id") -> DataFrame:
    """Valence and arousal after each event: by, id, valence, arousal."""
    return scan(df.select(by, "id", "stored_at", "store_seq", "valence"), by, ["stored_at", "store_seq"], affect_lines()).select(by, "id", F.col("mood").alias("valence"), "arousal")


def conversation_chunks(turns: DataFrame, size: int = 5) -> DataFrame:
    """Turns of a conversation in chunks of ``size``: speakers, characters, first words."""
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    c = turns.withColumn("chunk", F.floor((r - 1) / size))
    return c.groupBy("conv_id", "chunk").agg(F.count("*").alias("turns"), F.countDistinct("role").alias("speakers"), F.sum(F.length("text")).alias("chars"), F.substring(F.min(F.struct("turn", "role", "text"))["text"], 1, 40).alias("opening"))


def market_moves(df: DataFrame) -> DataFrame:
    """Per domain and record: change against the one before, kept above 1.5 %, with valence."""
    d = beside(df.select("id", "domain", "stored_at", "store_seq", "value"), "domain", ["stored_at", "store_seq"], {"before": "value"})
    s = d.select("id", "domain", ((tx.quotient(F.col("value"), F.col("before")) - 1) * 100).alias("change")).filter(F.abs("change") > 1.5)
    return s.select("id", "domain", "change", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("change") / 5)).alias("valence"), F.least(F.lit(1.0), F.abs("change") / 10 + 0.3).alias("importance"))
