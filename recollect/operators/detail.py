"""Smaller operators that complete a family: filters of stores, counts, weights, reasons, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import text as tx
from recollect.operators import retrieval as r
from recollect.operators.ordered import beside, running
from recollect.operators.pairs import causal_edges, jaccard_join
from recollect.operators.profiles import moral_scores
from recollect.operators.recall import boosts, lexical_relevance
from recollect.schema import AS_OF, DAY, TIERS, live


def vector_query(vectors: DataFrame, query: list[float], where: str | None = None, k: int = 10) -> DataFrame:
    """The nearest vectors among those that the condition holds for."""
    return r.vector_topk(vectors if where is None else vectors.filter(where), query, k)


def vector_upsert(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """The store after adding vectors; a known vec_id takes the new vector."""
    return vectors.join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new)


def concept_coverage(df: DataFrame) -> DataFrame:
    """Records by concept tag."""
    return df.select(F.explode("concept_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def framework_counts(df: DataFrame) -> DataFrame:
    """Records of moral weight by the framework that rules them."""
    return moral_scores(df).filter("dominant <> 'none'").groupBy("dominant").agg(F.count("*").alias("n"), F.avg("moral_weight").alias("mean_weight"))


def bigram_patterns(df: DataFrame, least: int = 3, top: int = 10) -> DataFrame:
    """Most frequent pairs of neighbouring keywords."""
    t = df.select(tx.keywords(F.col("content"), 3).alias("t")).filter("size(t) > 1")
    pairs = F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: F.concat_ws(" ", a, b))
    return t.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "pair").limit(top)


def effects_of(df: DataFrame, word: str) -> DataFrame:
    """What a word leads to, by strength."""
    return causal_edges(df).filter(F.col("source") == word).select(F.col("target").alias("effect"), "relation", "strength")


def causes_of(df: DataFrame, word: str) -> DataFrame:
    """What leads to a word, by strength."""
    return causal_edges(df).filter(F.col("target") == word).select(F.col("source").alias("cause"), "relation", "strength")


def causal_degrees(df: DataFrame, k: int = 5) -> DataFrame:
    """The words with most causal ties."""
    return causal_edges(df).select(F.explode(F.array("source", "target")).alias("word")).groupBy("word").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "word").limit(k)


def session_threads(df: DataFrame, k: int = 5) -> DataFrame:
    """Open threads of each session: importance .5 at least, consolidation under .3, and why."""
    score = 0.35 * F.col("importance") + 0.25 * F.col("novelty") + 0.25 * F.col("strength") + 0.15 * F.least(F.lit(1.0), F.col("access_count") / 5)
    why = F.concat_ws("; ", F.when(F.col("importance") >= 0.8, "important"), F.when(F.col("access_count") == 0, "never recalled"), F.when(F.col("strength") < 0.3, "fading"), F.when(F.abs("valence") > 0.5, "charged"))
    t = df.filter("importance >= 0.5").select("session_id", "id", "store_seq", "importance", score.alias("score"), why.alias("reasons")).filter("score < 0.3")
    row = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("importance"), "store_seq"))
    return t.withColumn("r", row).filter(F.col("r") <= k).select("session_id", "id", "importance", "score", "reasons")


def presence_trend(df: DataFrame, by: str = "session_id", last: int = 5) -> DataFrame:
    """Whether the valence of a session's last records rises: later half against earlier half, +-.05."""
    t = df.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("stored_at"), F.desc("store_seq")))).filter(F.col("r") <= last)
    g = t.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.when(F.col("r") <= last // 2, F.col("valence"))).alias("late"), F.avg(F.when(F.col("r") > last // 2, F.col("valence"))).alias("early"))
    gap = F.coalesce(F.col("late") - F.col("early"), F.lit(0.0))
    return g.select(by, "n", gap.alias("change"), F.when(gap > 0.05, "rising").when(gap < -0.05, "falling").otherwise("stable").alias("trend"))


def patch_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """The rule log (id, domain, text, importance, version, removed) after changes of the same columns
    but the version: each makes the next version of its rule; a new id starts at 1."""
    last = rules.groupBy("id").agg(F.max("version").alias("v"))
    n = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    new = changes.withColumn("n", n).join(last, "id", "left").withColumn("version", (F.coalesce("v", F.lit(0)) + F.col("n")).cast("int"))
    return rules.unionByName(new.select(*rules.columns))


def rules_prompt(rules: DataFrame, domain: str, k: int = 10) -> DataFrame:
    """One line for each rule in force, of a domain or general, the weightiest first."""
    row = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("version")))
    now = rules.withColumn("r", row).filter("r = 1 AND NOT removed").filter(F.col("domain").isin(domain, "general"))
    return now.orderBy(F.desc("importance"), "id").limit(k).select("id", F.concat(F.lit("- ["), "domain", F.lit("] "), "text").alias("line"))


def merged_episodes(df: DataFrame, size: int = 3) -> DataFrame:
    """Unpinned short-term records of a namespace merged by threes: text, greatest marks, mean valence."""
    from recollect.operators.ordered import placed

    c = placed(df.filter("tier = 'short_term' AND NOT pinned"), "namespace", ["store_seq"]).withColumn("chunk", F.floor((F.col("place") - 1) / size))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.substring("content", 1, 80).alias("c")))), lambda x: x["c"]), " | ")
    return c.groupBy("namespace", "chunk").agg(F.concat(F.lit("[Compressed episode #"), F.first("chunk") + 1, F.lit("] "), parts).alias("content"), F.max("importance").alias("importance"), F.max("intensity").alias("intensity"), F.max("novelty").alias("novelty"), F.avg("valence").alias("valence"))


def stream_by_query(df: DataFrame, query: str, k: int = 20, threshold: float = 0.3, as_of: float = AS_OF) -> DataFrame:
    """Records over the threshold, tier by tier in scan order, the best of each first."""
    s = lexical_relevance(live(df, as_of).filter("NOT private"), query, as_of).filter("found")
    s = s.withColumn("score", F.least(F.lit(1.0), F.col("relevance") + boosts(query, as_of))).filter(F.col("score") > threshold)
    return s.withColumn("rank", F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))).orderBy("rank", F.desc("score"), "store_seq").limit(k).select("id", "tier", "score")


def replay_weights(df: DataFrame, alpha: float = 0.6, beta: float = 0.4, as_of: float = AS_OF) -> DataFrame:
    """Importance-sampling weight of each record: (1 / (n P)) ^ beta over the greatest one."""
    s = df.select("id", F.pow(r.replay_priority(as_of), alpha).alias("p"))
    t = F.broadcast(s.agg(F.sum("p").alias("sum"), F.count("*").alias("n"), F.min("p").alias("low")))
    w = lambda p: F.pow(1 / (F.col("n") * p / F.col("sum")), beta)
    return s.crossJoin(t).select("id", (F.col("p") / F.col("sum")).alias("chance"), (w(F.col("p")) / w(F.col("low"))).alias("weight"))


def overlap_seeds(df: DataFrame, query: str, k: int = 3) -> DataFrame:
    """Seeds of associative recall: shared words over the record's words and one."""
    asked = F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())])
    t = F.array_distinct(tx.words(F.col("content")))
    return r.top(df.withColumn("score", F.size(F.array_intersect(t, asked)) / (F.size(t) + 1)).filter("score > 0"), k).select("id", "score")


def resolve_outcomes(predictions: DataFrame) -> DataFrame:
    """Predictions (id, confidence, confirmed): surprise 1 - confidence if confirmed, else confidence."""
    return predictions.select("id", F.when(F.col("confirmed"), "confirmed").otherwise("violated").alias("status"), F.when(F.col("confirmed"), 1 - F.col("confidence")).otherwise(F.col("confidence")).alias("surprise"))


def domain_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Domains that only one of two snapshots has, with half their share of importance as drift."""
    mass = lambda df, s: df.groupBy("domain").agg(F.sum("importance").alias(s))
    j = mass(a, "x").join(mass(b, "y"), "domain", "full_outer")
    total = F.broadcast(j.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy")))
    return j.filter("x IS NULL OR y IS NULL").crossJoin(total).select("domain", F.when(F.col("x").isNull(), "new").otherwise("lost").alias("change"), (0.5 * F.coalesce(F.col("x") / F.col("sx"), F.col("y") / F.col("sy"))).alias("drift"))


def distinct_goals(goals: DataFrame, least: float = 0.6, k: int = 10) -> DataFrame:
    """Goals (id, content, priority) without those much like one of higher priority, the best k."""
    near = jaccard_join(goals, tx.words(F.col("content")), least).filter(F.col("sim") > least)
    side = lambda s: goals.select(F.col("id").alias(s), F.struct((-F.col("priority")).alias("p"), F.col("id").alias("i")).alias(f"o{s}"))
    worse = near.join(side("a"), "a").join(side("b"), "b").select(F.when(F.col("oa") < F.col("ob"), F.col("b")).otherwise(F.col("a")).alias("id"))
    return goals.join(worse, "id", "left_anti").orderBy(F.desc("priority"), "id").limit(k).select("id", "priority")


def d3(edges: DataFrame, top: int = 20) -> DataFrame:
    """Lines of JSON for a force graph: the strongest edges and their nodes."""
    few = edges.orderBy(F.desc("weight"), "a", "b").limit(top)
    nodes = few.select(F.explode(F.array("a", "b")).alias("id")).distinct().select(F.to_json(F.struct(F.col("id").cast("string").alias("id"))).alias("line"))
    return nodes.unionByName(few.select(F.to_json(F.struct(F.col("a").cast("string").alias("source"), F.col("b").cast("string").alias("target"))).alias("line")))


def kept_intentions(intentions: DataFrame, cap: int = 50) -> DataFrame:
    """Intentions (id, priority) of highest priority, as many as may be pending."""
    return intentions.orderBy(F.desc("priority"), "id").limit(cap).select("id", "priority")


def modal_bands(df: DataFrame) -> DataFrame:
    """The most frequent volatility band of each domain's values."""
    v = F.abs(F.col("value") - 50)
    band = F.when(v < 10, "calm").when(v < 30, "mild").when(v < 60, "active").when(v < 120, "high").otherwise("extreme")
    g = df.groupBy("domain", band.alias("band")).agg(F.count("*").alias("n"))
    return g.groupBy("domain").agg(F.min(F.struct((-F.col("n")).alias("m"), "band")).alias("b")).select("domain", "b.band", (-F.col("b.m")).alias("n"))


def portfolio(df: DataFrame, start: float = 1000.0) -> DataFrame:
    """Value of each domain's portfolio after each trade, and the share of trades won so far."""
    order = ["stored_at", "store_seq"]
    pnl = df.select("domain", "id", *order, (F.col("value") - 50).alias("pnl"))
    p = running(pnl, "domain", order, F.col("pnl"), "gain", "n")
    w = running(p.withColumn("won", (F.col("pnl") > 0).cast("long")), "domain", order, F.col("won"), "wins", "m")
    return w.select("id", "domain", (start + F.col("gain")).alias("worth"), (F.col("wins") / F.col("n")).alias("win_rate"))


def trend_changes(df: DataFrame) -> DataFrame:
    """Records where the trend of a domain's values turns."""
    trend = F.when(F.col("value") > 55, "up").when(F.col("value") < 45, "down").otherwise("flat")
    b = beside(df.select("domain", "id", "stored_at", "store_seq", trend.alias("trend")), "domain", ["stored_at", "store_seq"], {"before": "trend"})
    return b.filter("before <> trend").select("id", "domain", F.col("before").alias("from"), F.col("trend").alias("to"))


def domain_density(df: DataFrame) -> DataFrame:
    """Records a day of each domain, scaled to [0, 1] over the domains; under three records a gap."""
    g = df.groupBy("domain").agg(F.count("*").alias("n"), ((F.max("stored_at") - F.min("stored_at")) / DAY).alias("days")).withColumn("rate", F.col("n") / F.greatest("days", F.lit(1.0)))
    s = F.broadcast(g.agg(F.min("rate").alias("lo"), F.max("rate").alias("hi")))
    return g.crossJoin(s).select("domain", "n", F.when(F.col("hi") > F.col("lo"), (F.col("rate") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("density"), (F.col("n") < 3).alias("gap"))
