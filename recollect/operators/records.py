"""Further record operators: supersession, annotations, rules, summaries, signals, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import text as tx
from recollect.operators.blocks import similar_pairs, token_sets
from recollect.operators.ordered import beside
from recollect.operators.pairs import jaccard_across, jaccard_join
from recollect.operators.profiles import doc_tokens
from recollect.schema import AS_OF, DAY


def auto_supersede(df: DataFrame, near: float = 0.3, apart: float = 0.05) -> DataFrame:
    """Older records of a domain that a later one restates in other words: similar keywords, but
    less than all alike. The first such later record supersedes."""
    first = lambda p: p.filter(1 - F.col("sim") > apart).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("superseded_by"))
    return similar_pairs(token_sets(df, tx.keywords(F.col("content")), ["domain"]), near, then=first)


def latest_annotations(notes: DataFrame) -> DataFrame:
    """Newest annotation (id, record, at, supersedes) of each record that no other one supersedes."""
    gone = notes.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("id")).distinct()
    return notes.join(gone, "id", "left_anti").groupBy("record").agg(F.max_by("id", F.struct("at", "id")).alias("id"), F.max("at").alias("noted_at"))


def growth_report(notes: DataFrame) -> DataFrame:
    """Valence drift of each record: last revised valence less the first original one."""
    return notes.groupBy("record").agg(F.count("*").alias("notes"), (F.max_by("revised", F.struct("at", "id")) - F.min_by("original", F.struct("at", "id"))).alias("drift"))


def active_rules(rules: DataFrame, domain: str, k: int = 10) -> DataFrame:
    """Rules (id, domain, importance, version, removed) of a domain or general ones, newest version, best first."""
    w = Window.partitionBy("id").orderBy(F.desc("version"))
    live = rules.withColumn("r", F.row_number().over(w)).filter("r = 1 AND NOT removed").filter(F.col("domain").isin(domain, "general"))
    return live.orderBy(F.desc("importance"), "id").limit(k).select("id", "domain", "version", "importance")


def arm_scores(df: DataFrame, as_of: float = AS_OF) -> DataFrame:
    """Best arm of the adaptive retriever for each record: temporal, importance or strength."""
    arms = {"temporal": F.exp(-(F.lit(as_of) - F.col("stored_at")) / (30 * DAY)) * F.col("strength"), "importance": F.col("importance"), "access": F.least(F.lit(1.0), F.col("access_count") / 6)}
    s = df.select("id", *[c.alias(n) for n, c in arms.items()])
    best = F.greatest(*arms)
    pick = None
    for n in arms:
        pick = F.when(F.col(n) == best, n) if pick is None else pick.when(F.col(n) == best, n)
    return s.select("id", pick.alias("arm"), best.alias("score"))


def sentence_scores(df: DataFrame, k: int = 2) -> DataFrame:
    """Extractive summary: the k best sentences of each record, in source order.

    Score = .4 coverage of the record's distinct words + .3 position + .3 length (20 words best).
    """
    s = df.select("id", F.greatest(F.size(F.array_distinct(tx.words(F.col("content")))), F.lit(1)).alias("distinct"), F.posexplode(F.filter(F.split("content", "[.!?\\n]+"), lambda x: F.trim(x) != "")).alias("p", "s"))
    w = tx.words(F.col("s"))
    cover = F.size(F.array_distinct(w)) / F.col("distinct")
    score = 0.4 * cover + 0.3 / (1 + F.col("p")) + 0.3 * F.least(F.lit(1.0), F.size(w) / 20)
    r = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "p"))
    return s.select("id", "p", F.trim("s").alias("sentence"), F.round(score, 9).alias("score")).withColumn("r", r).filter(F.col("r") <= k).select("id", F.col("p").alias("pos"), "sentence", "score")


def compression_ratio(df: DataFrame, k: int = 2) -> DataFrame:
    """Characters of the summary over those of the record."""
    s = sentence_scores(df, k).groupBy("id").agg(F.sum(F.length("sentence")).alias("kept"))
    return df.join(s, "id").select("id", (F.col("kept") / F.length("content")).alias("ratio"))


def schema_seeds(df: DataFrame, least: int = 2, k: int = 30) -> DataFrame:
    """Shared keywords of each domain that schemas grow from, the most common first."""
    g = doc_tokens(df).groupBy("domain", "tok").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least)
    return g.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("docs"), "tok"))).filter(F.col("r") <= k).select("domain", "tok", "docs", F.col("r").cast("int").alias("rank"))


def reflection_lessons(df: DataFrame, least: float = 0.5, contrast: float = 0.6) -> DataFrame:
    """Lessons of a domain's important records: one keyword each, by the spread of valence a
    contrast, else a principle, a gap (few records) or a pattern."""
    t = doc_tokens(df.filter(F.col("importance") >= least)).join(df.select("id", "valence"), "id")
    g = t.groupBy("domain", "tok").agg(F.count("*").alias("n"), (F.max("valence") - F.min("valence")).alias("spread"), F.avg("importance").alias("i")).filter("n >= 2")
    best = g.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "tok"))).filter("r <= 3")
    kind = F.when(F.col("spread") > contrast, "contrast").when(F.col("i") >= 0.8, "principle").when(F.col("n") < 3, "gap").otherwise("pattern")
    return best.select("domain", "tok", "n", kind.alias("kind"))


def projections(df: DataFrame, domains: int = 4) -> DataFrame:
    """Likely theme of the first domains: share of the top keyword * .6 + strength * .4."""
    first = df.groupBy("domain").agg(F.min("store_seq").alias("s"), F.count("*").alias("n"), F.avg("strength").alias("m")).orderBy("s").limit(domains)
    g = doc_tokens(df).join(F.broadcast(first), "domain").groupBy("domain", "n", "m", "tok").agg(F.count("*").alias("c"))
    best = g.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("c"), "tok"))).filter("r = 1")
    return best.select("domain", F.col("tok").alias("theme"), (0.6 * F.col("c") / F.col("n") + 0.4 * F.col("m")).alias("plausibility"))


def belief_revisions(df: DataFrame, near: float = 0.3, apart: float = 0.4, window: int = 60) -> DataFrame:
    """Of the first records of a domain, similar pairs of opposite valence: supersede, merge or flag."""
    w = Window.partitionBy("domain").orderBy("store_seq")
    few = df.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= window)
    side = lambda s: few.select(F.col("id").alias(s), F.col("valence").alias(f"v{s}"), F.col("strength").alias(f"s{s}"))
    p = jaccard_join(few, tx.keywords(F.col("content")), near, ["domain"]).join(side("a"), "a").join(side("b"), "b")
    p = p.withColumn("gap", F.abs(F.col("va") - F.col("vb"))).filter(F.col("gap") >= apart).withColumn("score", F.col("sim") * F.col("gap"))
    ratio = F.abs(F.col("sa") - F.col("sb")) / F.greatest("sa", "sb")
    act = F.when((F.col("score") >= 0.5) & (ratio >= 0.3), "supersede").when(F.col("score") >= 0.3, "merge").otherwise("flag")
    return p.select("a", "b", "score", act.alias("action"))


def parse_bot_log(lines: DataFrame) -> DataFrame:
    """Log lines (id, line) of a trading bot: kind, symbol, amount."""
    line = F.upper("line")
    kind = F.when(line.contains("ERROR"), "error").when(line.rlike("\\bBUY\\b"), "buy").when(line.rlike("\\bSELL\\b"), "sell").when(line.contains("TREND"), "trend").otherwise("note")
    return lines.select("id", kind.alias("kind"), F.nullif(F.regexp_extract(line, "\\b([A-Z]{2,5})/USD", 1), F.lit("")).alias("symbol"), F.expr("try_cast(regexp_extract(line, '([0-9]+[.][0-9]+)', 1) AS DOUBLE)").alias("amount"))


def trading_signals(df: DataFrame) -> DataFrame:
    """Momentum beyond +-1.5 % and mean reversion below -2.5 or above +3.5 %, per domain."""
    d = beside(df.select("id", "domain", "stored_at", "store_seq", "value"), "domain", ["stored_at", "store_seq"], {"before": "value"})
    s = d.select("id", "domain", ((tx.quotient(F.col("value"), F.col("before")) - 1) * 100).alias("change"))
    sig = F.when(F.col("change") < -2.5, "revert_up").when(F.col("change") > 3.5, "revert_down").when(F.col("change") > 1.5, "long").when(F.col("change") < -1.5, "short")
    return s.select("id", sig.alias("signal")).filter("signal IS NOT NULL")


def rank_weighted_valence(df: DataFrame, k: int = 10) -> DataFrame:
    """By domain: mean valence of the newest k records with weights 1 / rank."""
    r = df.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("stored_at"), F.desc("store_seq")))).filter(F.col("r") <= k)
    return r.groupBy("domain").agg((F.sum(F.col("valence") / F.col("r")) / F.sum(1 / F.col("r"))).alias("outlook"))


def market_wisdom(df: DataFrame) -> DataFrame:
    """By domain of P&L values: win rate, profit factor, trend of the last five against the mean."""
    p = df.select("domain", "stored_at", "store_seq", (F.col("value") - 50).alias("pnl"))
    last = p.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("stored_at"), F.desc("store_seq")))).filter("r <= 5").groupBy("domain").agg(F.avg("pnl").alias("last"))
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))
    g = p.groupBy("domain").agg(F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), (gain / loss).alias("profit_factor"), F.avg("pnl").alias("mean")).join(last, "domain")
    return g.select("domain", "win_rate", "profit_factor", F.when(F.col("last") > F.col("mean") + 0.05, "up").when(F.col("last") < F.col("mean") - 0.05, "down").otherwise("flat").alias("trend"))


def milestones(df: DataFrame, marks: tuple[int, ...] = (1, 10, 50, 100)) -> DataFrame:
    """Records with which a session reaches a round number of events."""
    r = F.row_number().over(Window.partitionBy("session_id").orderBy("stored_at", "store_seq"))
    return df.withColumn("count", r).filter(F.col("count").isin(list(marks))).select("session_id", "id", "count")


def theme_continuity(df: DataFrame) -> DataFrame:
    """Mean share of keywords that a record keeps of the one before in its namespace."""
    t = df.select("namespace", "store_seq", F.array_distinct(tx.keywords(F.col("content"))).alias("t"))
    s = beside(t, "namespace", ["store_seq"], {"p": "t"}).filter("p IS NOT NULL")
    return s.groupBy("namespace").agg(F.avg(tx.jaccard(F.col("t"), F.col("p"))).alias("continuity"))


def persistent_identity(df: DataFrame, last: int = 100) -> DataFrame:
    """Records, domains and the narrative of the newest three by namespace."""
    r = F.row_number().over(Window.partitionBy("namespace").orderBy(F.desc("store_seq")))
    new = df.select("namespace", "content", "store_seq").withColumn("r", r).filter("r <= 3").groupBy("namespace").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("content", 1, 20).alias("c")))), lambda x: x["c"]), " | ").alias("narrative"))
    s = df.groupBy("namespace").agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains")).withColumn("recent", F.least(F.col("n"), F.lit(last)).cast("long"))
    return s.join(new, s.namespace.eqNullSafe(new.namespace)).select(s.namespace, "n", "domains", "recent", "narrative")


def resolution_rate(found: DataFrame, resolved: DataFrame) -> DataFrame:
    """Contradictions (a, b) found and resolved: counts and rate."""
    j = found.select("a", "b", F.lit(1).alias("f")).join(resolved.select("a", "b", F.lit(1).alias("r")).distinct(), ["a", "b"], "left")
    return j.agg(F.count("*").alias("found"), F.count("r").alias("resolved"), F.coalesce(F.count("r") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("rate"))


def generate_goals(df: DataFrame, k: int = 10) -> DataFrame:
    """Goals by rule: strengthen weak important records, revisit negative ones, explore rare domains."""
    weak = df.filter("importance >= 0.8 AND strength < 0.3").select(F.lit("strengthen").alias("rule"), F.col("id").cast("string").alias("subject"), F.col("importance").alias("priority"))
    sad = df.filter("valence <= -0.7").select(F.lit("revisit"), F.col("id").cast("string"), (0.5 + F.abs("valence") / 2 - 0.1))
    rare = df.groupBy("domain").agg(F.count("*").alias("n")).crossJoin(F.broadcast(df.agg(F.count("*").alias("t")))).filter("n * 25 < t").select(F.lit("explore"), "domain", (1 - F.col("n") / F.col("t")))
    return weak.union(sad).union(rare).orderBy(F.desc("priority"), "rule", "subject").limit(k)


def reality_check(claims: DataFrame, facts: DataFrame, least: float = 0.1) -> DataFrame:
    """Claims (id, content) against facts: supported by a similar record, or unverified."""
    hit = jaccard_across(facts, claims, tx.keywords(F.col("content")), least).select(F.col("b").alias("id")).distinct()
    return claims.select("id").join(hit.withColumn("s", F.lit("supported")), "id", "left").select("id", F.coalesce("s", F.lit("unverified")).alias("status"))


def observe_prompts(turns: DataFrame) -> DataFrame:
    """User turns as decision records of importance .6."""
    return turns.filter("role = 'user'").select("conv_id", "turn", F.lit("decision").alias("obs_type"), F.lit(0.6).alias("importance"), F.substring("text", 1, 60).alias("title"))


def merge_graphs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entity tables (entity, mentions, strength) of two stores: mentions add, strength averages +.05."""
    l, r = a.toDF("entity", "m1", "s1"), b.toDF("entity", "m2", "s2")  # noqa: E741
    j = l.join(r, "entity", "full_outer")
    s = F.when(F.col("s1").isNull(), F.col("s2")).when(F.col("s2").isNull(), F.col("s1")).otherwise(F.least(F.lit(1.0), (F.col("s1") + F.col("s2")) / 2 + 0.05))
    return j.select("entity", (F.coalesce("m1", F.lit(0)) + F.coalesce("m2", F.lit(0))).alias("mentions"), s.alias("strength"))


def due_cards(cards: DataFrame, now: float, k: int = 20) -> DataFrame:
    """Cards (memory_id, next_review, ease) due by now, longest overdue first."""
    return cards.filter(F.col("next_review") <= now).orderBy("next_review", "memory_id").limit(k).select("memory_id", ((F.lit(now) - F.col("next_review")) / DAY).alias("overdue_days"))


def stale_warning(age_days: Column) -> Column:
    return F.when(age_days > 30, "stale").when(age_days > 7, "ageing").otherwise("fresh")
