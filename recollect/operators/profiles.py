"""Profiles: group-by operators over memories. All take a DataFrame and return one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import lexicons as lex
from recollect.functions import text as tx
from recollect.operators.ordered import placed, runs
from recollect.schema import AS_OF, DAY


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def consolidation_score(df: DataFrame) -> DataFrame:
    """id, score = .35 importance + .25 novelty + .25 strength + .15 min(1, access / 5)."""
    return df.select("id", (0.35 * F.col("importance") + 0.25 * F.col("novelty") + 0.25 * F.col("strength") + 0.15 * F.least(F.lit(1.0), F.col("access_count") / 5)).alias("score"))


def counts(df: DataFrame, by: str, missing: str | None = None) -> DataFrame:
    """Rows by value; with ``missing`` nulls get that name."""
    c = F.col(by) if missing is None else F.coalesce(by, F.lit(missing))
    return df.groupBy(c.alias(by)).agg(F.count("*").alias("n"))


def strength_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("tier").agg(F.min("strength").alias("min_strength"), F.avg("strength").alias("mean_strength"), F.max("strength").alias("max_strength"))


def privacy_audit(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.sum(F.col("private").cast("int")).cast("long").alias("private"), F.avg(F.col("private").cast("double")).alias("share"))


def health_score(df: DataFrame) -> DataFrame:
    """Mean of four ratios: live, classified, strong (>= .5) and accessed records."""
    ratio = lambda c: F.avg(c.cast("double"))
    r = df.agg(ratio(F.col("superseded_by").isNull()).alias("live_ratio"), ratio(F.col("obs_type").isNotNull()).alias("typed_ratio"), ratio(F.col("strength") >= 0.5).alias("strong_ratio"), ratio(F.col("access_count") > 0).alias("accessed_ratio"))
    return r.withColumn("health", (F.col("live_ratio") + F.col("typed_ratio") + F.col("strong_ratio") + F.col("accessed_ratio")) / 4)


def token_footprint(df: DataFrame) -> DataFrame:
    """Estimated tokens by tier and in all (tier 'all')."""
    t = df.select("tier", tx.token_estimate(F.col("content")).alias("tokens"))
    return t.rollup("tier").agg(F.sum("tokens").alias("tokens")).withColumn("tier", F.coalesce("tier", F.lit("all")))


def enforce_budget(df: DataFrame, budget: int, policy: str = "composite") -> DataFrame:
    """Records to evict, weakest first, until the tokens fit: semantic and important ones (.8) stay.

    The composite score is .4 importance + .4 strength + .2 min(1, access / 10); other policies go
    by last access (lru), accesses (lfu), importance or strength. Running sums are taken within
    ranges of the score first, so that no task sorts the whole table.
    """
    scores = {"composite": F.round(0.4 * F.col("importance") + 0.4 * F.col("strength") + 0.2 * F.least(F.lit(1.0), F.col("access_count") / 10), 9), "lru": F.col("last_accessed"),
              "lfu": F.col("access_count").cast("double"), "importance": F.col("importance"), "strength": F.col("strength")}
    t = df.select("id", "store_seq", "tier", "importance", tx.token_estimate(F.col("content")).alias("tokens"),
                  scores[policy].alias("score"))
    need = t.agg((F.sum("tokens") - budget).alias("need"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    share = (F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))
    free = t.filter("tier <> 'semantic' AND importance < 0.8").crossJoin(F.broadcast(need)).withColumn("bucket", F.floor(share * 1000))
    before = free.groupBy("bucket").agg(F.sum("tokens").alias("s"))
    # At most 1,001 buckets.
    before = before.select("bucket", (F.sum("s").over(Window.orderBy("bucket")) - F.col("s")).alias("before"))
    run = free.join(F.broadcast(before), "bucket").withColumn("freed_before", F.col("before") + F.sum("tokens").over(Window.partitionBy("bucket").orderBy("score", "store_seq")) - F.col("tokens"))
    return run.filter(F.col("freed_before") < F.col("need")).select("id", "tokens", "score")


def trust_ledger(df: DataFrame) -> DataFrame:
    g = df.groupBy("domain").agg(F.count("*").alias("n"), F.avg("importance").alias("mean_importance"), F.stddev_pop("valence").alias("spread"))
    return g.select("domain", "n", (0.4 * F.col("mean_importance") + 0.4 * (1 - F.col("spread")) + 0.2 * F.least(F.lit(1.0), F.col("n") / 10)).alias("trust"))


def confidence(as_of: float = AS_OF, recency_decay: float = 0.05, saturation: float = 10.0) -> Column:
    """Weighted geometric mean of strength, recency, access and consolidation."""
    score = 0.35 * F.col("importance") + 0.25 * F.col("novelty") + 0.25 * F.col("strength") + 0.15 * F.least(F.lit(1.0), F.col("access_count") / 5)
    days = F.greatest(F.lit(0.0), (F.lit(as_of) - F.col("last_accessed")) / DAY)
    parts = ((0.35, F.least(F.lit(1.0), F.col("strength") / 2)), (0.25, F.exp(-recency_decay * days)), (0.20, F.least(F.lit(1.0), F.col("access_count") / saturation)), (0.20, score))
    total = sum((F.log(f + 1e-9) * w for w, f in parts), F.lit(0.0))
    return clamp(F.exp(total))


def knowledge_map(df: DataFrame) -> DataFrame:
    """By domain: records, mean confidence, importance and strength, share of all records."""
    g = df.withColumn("c", confidence()).groupBy("domain").agg(F.count("*").alias("n"), F.avg("c").alias("mean_confidence"), F.avg("importance").alias("mean_importance"), F.avg("strength").alias("mean_strength"))
    return g.crossJoin(F.broadcast(df.agg(F.count("*").alias("total")))).select("domain", "n", "mean_confidence", "mean_importance", "mean_strength", (F.col("n") / F.col("total")).alias("coverage"))


def find_gaps(df: DataFrame) -> DataFrame:
    return knowledge_map(df).filter("mean_confidence < 0.3 OR coverage < 0.05").select("domain", "mean_confidence", "coverage")


def capability_profile(df: DataFrame) -> DataFrame:
    g = df.groupBy("domain").agg(F.count("*").alias("n"), F.avg("strength").alias("s"))
    return g.select("domain", F.least(F.lit(1.0), F.col("s") * F.log1p("n") / F.log1p(F.lit(5.0))).alias("capability"))


def doc_tokens(df: DataFrame, least: int = 4) -> DataFrame:
    """Distinct keywords of each record: id, domain, importance, strength, tok."""
    return df.select("id", "domain", "importance", "strength", F.explode(F.array_distinct(tx.keywords(F.col("content"), least))).alias("tok"))


def self_beliefs(df: DataFrame) -> DataFrame:
    """The keyword in most records of each domain: confidence .6 share + .4 mean strength."""
    size = df.groupBy("domain").agg(F.count("*").alias("n"))
    g = doc_tokens(df).groupBy("domain", "tok").agg(F.count("*").alias("df"), F.avg("strength").alias("s"))
    best = g.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("df"), "tok"))).filter("r = 1")
    return best.join(size, "domain").select("domain", F.col("tok").alias("belief"), "df", (0.6 * F.col("df") / F.col("n") + 0.4 * F.col("s")).alias("confidence"))


def emotional_coherence(df: DataFrame) -> DataFrame:
    return df.agg(clamp(1 - F.stddev_pop("valence")).alias("coherence"))


def emotional_state(df: DataFrame, window: int = 20) -> DataFrame:
    """Mean and spread of the newest records and their commonest domain."""
    newest = df.orderBy(F.desc("stored_at"), F.desc("store_seq")).limit(window)
    modal = newest.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(1).select(F.col("domain").alias("dominant_domain"))
    return newest.agg(F.avg("valence").alias("valence"), F.avg("intensity").alias("arousal"), F.stddev_pop("valence").alias("volatility")).crossJoin(modal)


def reappraise(df: DataFrame) -> DataFrame:
    """Records of valence below -.3, moved up by .3."""
    return df.filter("valence < -0.3").select("id", "valence", F.least(F.lit(1.0), F.col("valence") + 0.3).alias("reappraised"), F.concat(F.lit("Reappraisal: "), F.substring("content", 1, 60)).alias("note"))


def _lexicon_rows(df: DataFrame, groups: dict[str, str]) -> DataFrame:
    """One row for each (record, group, word): a literal map joined, never a Python UDF."""
    pairs = F.array(*[F.struct(F.lit(w).alias("tok"), F.lit(g).alias("grp")) for g, ws in groups.items() for w in lex.words(ws)])
    words = df.sparkSession.range(1).select(F.explode(pairs).alias("p")).select("p.tok", "p.grp")
    toks = df.select("id", "domain", "importance", F.explode(tx.stripped(F.col("content"))).alias("tok"))
    return toks.join(F.broadcast(words), "tok")


def detect_biases(df: DataFrame, least: float = 0.05) -> DataFrame:
    g = _lexicon_rows(df, lex.BIAS).groupBy("grp", "id").agg(F.first("importance").alias("importance")).groupBy("grp").agg(F.count("*").alias("n_affected"), F.avg("importance").alias("mean_importance"))
    total = F.broadcast(df.agg(F.count("*").alias("total")))
    return g.crossJoin(total).select(F.col("grp").alias("bias"), "n_affected", F.least(F.lit(1.0), F.col("n_affected") / F.col("total") * F.col("mean_importance")).alias("strength")).filter(F.col("strength") >= least)


def map_values(df: DataFrame, least: float = 0.0) -> DataFrame:
    g = _lexicon_rows(df, lex.VALUES).groupBy("grp", "tok", "id").agg(F.count("*").alias("c"), F.sum("importance").alias("s")).groupBy("grp", "tok").agg(F.count("*").alias("n_docs"), (F.sum("s") / F.sum("c")).alias("mean_importance"))
    total = F.broadcast(df.agg(F.count("*").alias("total")))
    return g.crossJoin(total).select(F.col("grp").alias("category"), F.col("tok").alias("value"), "n_docs", F.least(F.lit(1.0), F.col("mean_importance") * F.col("n_docs") / F.col("total") * 5).alias("strength")).filter(F.col("strength") >= least)


def moral_scores(df: DataFrame) -> DataFrame:
    """Per record: share of words of each framework, the dominant one, the moral weight."""
    t = df.withColumn("t", F.transform(tx.words(F.col("content")), lambda w: F.trim(w, F.lit(tx.PUNCT))))
    n = F.greatest(F.size("t"), F.lit(1))
    t = t.select("id", "domain", "importance", "valence", *[tx.rounded(tx.hits(F.col("t"), lex.words(ws)) / n, 4).alias(g) for g, ws in lex.MORAL.items()])
    top = F.greatest(*lex.MORAL)
    dominant = F.when(top < 0.01, F.lit("none"))
    for g in lex.MORAL:
        dominant = dominant.when(F.col(g) == top, F.lit(g))
    return t.select("id", "domain", "valence", *lex.MORAL, dominant.alias("dominant"), tx.rounded(F.least(F.lit(1.0), F.col("importance") * F.abs("valence") * (top + 0.1)), 4).alias("moral_weight"))


def trace_adversity(df: DataFrame) -> DataFrame:
    """Records with a word of adversity: the first kind in order that matches, severity."""
    t = df.withColumn("t", tx.stripped(F.col("content")))
    kind = None
    for g, ws in lex.ADVERSITY.items():
        hit = F.arrays_overlap("t", F.array(*map(F.lit, lex.words(ws))))
        kind = F.when(hit, F.lit(g)) if kind is None else kind.when(hit, F.lit(g))
    return t.withColumn("kind", kind).filter("kind IS NOT NULL").select("id", "domain", "kind", (F.col("importance") * (1 - F.col("valence")) / 2).alias("severity"))


def self_compassion(df: DataFrame, least: int = 2) -> DataFrame:
    t = df.withColumn("t", tx.stripped(F.col("content")))
    has = lambda ws: F.arrays_overlap("t", F.array(*map(F.lit, lex.words(ws)))).cast("long")
    g = t.groupBy("domain").agg(F.count("*").alias("n"), F.sum(has(lex.KIND)).alias("kind"), F.sum(has(lex.HARSH)).alias("harsh"))
    return g.filter(F.col("n") >= least).select("domain", "n", "kind", "harsh", ((F.col("kind") - F.col("harsh") + F.col("n")) / (2 * F.col("n"))).alias("compassion"), (F.col("harsh") / F.col("n")).alias("inner_critic"))


def self_efficacy(df: DataFrame) -> DataFrame:
    """By domain: (mean importance of successes - of failures + 1) / 2."""
    t = df.withColumn("t", tx.stripped(F.col("content")))
    has = lambda ws: F.arrays_overlap("t", F.array(*map(F.lit, lex.words(ws))))
    g = t.groupBy("domain").agg(F.sum(has(lex.SUCCESS).cast("long")).alias("successes"), F.sum(has(lex.FAILURE).cast("long")).alias("failures"),
                                F.coalesce(F.avg(F.when(has(lex.SUCCESS), F.col("importance"))), F.lit(0.0)).alias("s"), F.coalesce(F.avg(F.when(has(lex.FAILURE), F.col("importance"))), F.lit(0.0)).alias("f"))
    return g.select("domain", "successes", "failures", ((F.col("s") - F.col("f") + 1) / 2).alias("efficacy"))


def keyword_windows(df: DataFrame, triggers: str, before: int, after: int) -> DataFrame:
    """One row for each trigger word: id, domain, keyword, the words before and after it (stripped)."""
    t = df.withColumn("t", tx.stripped(F.col("content"))).select("id", "domain", "importance", "strength", "t", F.posexplode("t").alias("p", "keyword")).filter(F.col("keyword").isin(lex.words(triggers)))
    start = F.greatest(F.col("p") - before, F.lit(0))
    return t.select("id", "domain", "importance", "strength", "keyword", F.slice("t", start + 1, F.col("p") - start).alias("before"), F.slice("t", F.col("p") + 2, F.lit(after)).alias("after"))


def meaningful(c: Column) -> Column:
    return F.filter(c, lambda w: (F.length(w) >= 3) & ~w.isin(tx.STOP))


def extract_norms(df: DataFrame) -> DataFrame:
    """By domain, keyword and subject (first meaningful of the next 4 words): polarity, confidence."""
    r = keyword_windows(df, lex.PRESCRIPTIVE + " " + lex.PROHIBITIVE, 0, 4).withColumn("subject", F.get(meaningful(F.col("after")), F.lit(0))).filter("subject IS NOT NULL")
    size = df.groupBy("domain").agg(F.count("*").alias("n"))
    g = r.groupBy("domain", "keyword", "subject").agg(F.countDistinct("id").alias("docs"), F.avg("importance").alias("i")).join(size, "domain")
    return g.select("domain", "keyword", "subject", F.when(F.col("keyword").isin(lex.words(lex.PRESCRIPTIVE)), "prescriptive").otherwise("prohibitive").alias("polarity"), (0.6 * F.col("docs") / F.col("n") + 0.4 * F.col("i")).alias("confidence"))


def agent_models(df: DataFrame) -> DataFrame:
    """By agent (the word before a belief verb): statements and mean importance."""
    r = keyword_windows(df, lex.BELIEF_VERBS, 1, 7).withColumn("agent", F.get("before", F.lit(0))).filter("length(agent) >= 3")
    return r.groupBy("agent").agg(F.count("*").alias("statements"), F.avg("importance").alias("mean_importance"))


def distil_skills(df: DataFrame, least: int = 2) -> DataFrame:
    """By domain and action: records and confidence .6 share + .4 mean strength."""
    r = keyword_windows(df, lex.ACTIONS, 3, 3).groupBy("domain", "keyword", "id").agg(F.first("strength").alias("strength"))
    size = df.groupBy("domain").agg(F.count("*").alias("n"))
    g = r.groupBy("domain", "keyword").agg(F.count("*").alias("docs"), F.avg("strength").alias("s")).filter(F.col("docs") >= least)
    return g.join(size, "domain").select("domain", F.col("keyword").alias("action"), "docs", (0.6 * F.col("docs") / F.col("n") + 0.4 * F.col("s")).alias("confidence"))


def abstract_principles(df: DataFrame, least: float = 0.3) -> DataFrame:
    """Keywords in two records at least and in ``least`` of their domain's records."""
    size = df.groupBy("domain").agg(F.count("*").alias("n"))
    g = doc_tokens(df).groupBy("domain", "tok").agg(F.count("*").alias("docs"), F.avg("strength").alias("mean_strength")).filter("docs >= 2")
    return g.join(size, "domain").withColumn("generality", F.col("docs") / F.col("n")).filter(F.col("generality") >= least).select("domain", F.col("tok").alias("principle"), "docs", "generality", "mean_strength")


def assess_novelty(df: DataFrame) -> DataFrame:
    """Per record: share of keyword occurrences in fewer than max(2, 10 %) of the records."""
    occ = df.select("id", F.explode(tx.keywords(F.col("content"))).alias("tok"))
    freq = occ.groupBy("id", "tok").agg(F.count("*").alias("c"))
    common = freq.groupBy("tok").agg(F.count("*").alias("d")).crossJoin(F.broadcast(df.agg(F.greatest(F.lit(2), F.floor(F.count("*") * 0.1)).alias("cut")))).filter("d >= cut").select("tok", F.lit(True).alias("common"))
    # Common words are at most a tenth of the vocabulary's occurrences: few, but not bounded.
    return freq.join(common, "tok", "left").groupBy("id").agg((F.sum(F.when(F.col("common"), 0).otherwise(F.col("c"))) / F.sum("c")).alias("novelty"))


def predictions(df: DataFrame, least: float = 0.3) -> DataFrame:
    """Two most frequent keywords of each domain with their share of all keywords."""
    g = df.select("domain", F.explode(tx.keywords(F.col("content"))).alias("tok")).groupBy("domain", "tok").agg(F.count("*").alias("c"))
    w = Window.partitionBy("domain")
    ranked = g.withColumn("r", F.row_number().over(w.orderBy(F.desc("c"), "tok"))).filter("r <= 2")
    total = g.groupBy("domain").agg(F.sum("c").alias("total"))
    return ranked.join(total, "domain").withColumn("share", F.col("c") / F.col("total")).filter(F.col("share") >= least).select("domain", "tok", "share", F.least(F.lit(1.0), 2 * F.col("share")).alias("confidence"))


def counterfactuals(df: DataFrame, limit: int = 10) -> DataFrame:
    """Upward (+.4) for valence below .1, downward (-.4) above -.1, of the first records."""
    plaus = 0.8 * clamp(F.col("strength"))
    first = df.filter(plaus >= 0.2)
    side = lambda cond, name, d: first.filter(cond).orderBy("store_seq").limit(limit).select("id", F.lit(name).alias("direction"), clamp(F.col("valence") + d, -1.0, 1.0).alias("valence"), plaus.alias("plausibility"))
    return side("valence < 0.1", "upward", 0.4).unionByName(side("valence > -0.1", "downward", -0.4))


def curiosity(df: DataFrame, top: int = 10) -> DataFrame:
    """Domains to explore: novel (1 record), sparse (<= 3), uncertain (mean confidence below .4)."""
    g = df.withColumn("c", confidence()).groupBy("domain").agg(F.count("*").alias("n"), F.avg("c").alias("c"))
    reason = F.when(F.col("n") == 1, "novel").when(F.col("n") <= 3, "sparse").when(F.col("c") < 0.4, "uncertain")
    urgency = F.when(F.col("n") == 1, F.lit(0.75)).when(F.col("n") <= 3, 0.5 + 0.1 * (3 - F.col("n"))).otherwise(1 - F.col("c"))
    return g.withColumn("reason", reason).filter("reason IS NOT NULL").select("domain", "reason", urgency.alias("urgency")).orderBy(F.desc("urgency"), "domain").limit(top)


def domain_sequences(df: DataFrame, longest: int = 5, top: int = 10) -> DataFrame:
    """Most frequent runs of 2 to ``longest`` domains in store order, by namespace."""
    # Each record goes to the runs that begin up to longest - 1 places before it.
    p = placed(df.select("namespace", "domain", "store_seq"), "namespace", ["store_seq"])
    runs = p.select("namespace", "domain", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(longest - 1)), lambda k: F.col("place") - k)).alias("k", "start")).filter("start >= 1")
    rows = runs.groupBy("namespace", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "domain"))), lambda x: x["domain"]).alias("s"))
    grams = rows.select(F.explode(F.transform(F.filter(F.sequence(F.lit(2), F.lit(longest)), lambda k: k <= F.size("s")), lambda k: F.slice("s", F.lit(1), k))).alias("g")).filter(~F.exists("g", lambda x: x.isNull()))
    return grams.select(F.concat_ws(">", "g").alias("sequence")).groupBy("sequence").agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "sequence").limit(top)


def sequence_patterns(df: DataFrame, longest: int = 5, top: int = 10) -> DataFrame:
    """Most frequent runs of 2 to ``longest`` domains in the order of the whole store."""
    r = runs(df.select("domain", "store_seq"), "domain", ["store_seq"], longest).filter(~F.exists("run", lambda x: x.isNull()))
    return r.select(F.concat_ws(">", "run").alias("sequence")).groupBy("sequence").agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "sequence").limit(top)


def content_patterns(df: DataFrame, least: int = 3, top: int = 20) -> DataFrame:
    """Most frequent keywords of three letters at least."""
    toks = df.select(F.explode(F.filter(F.regexp_extract_all(F.regexp_replace(F.lower("content"), "[^\\x00-\\x7F]", "_"), F.lit("\\b[a-z]{3,}\\b"), 0), lambda w: ~w.isin(tx.STOP))).alias("tok"))
    return toks.groupBy("tok").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "tok").limit(top)


def domain_trends(df: DataFrame) -> DataFrame:
    """Share of each domain; odd counts grow, even ones are stable (the rule as it stands)."""
    return df.groupBy("domain").agg(F.count("*").alias("n")).crossJoin(F.broadcast(df.agg(F.count("*").alias("total")))).select("domain", "n", (F.col("n") / F.col("total")).alias("share"), F.when(F.col("n") % 2 == 1, "growing").otherwise("stable").alias("trend"))


def concept_growth(df: DataFrame) -> DataFrame:
    """By domain: early and recent halves' vocabularies compared: growth and consolidation."""
    half = placed(df.select("domain", "content", "stored_at", "store_seq"), "domain", ["stored_at", "store_seq"], total="n").withColumn("late", F.col("place") > F.floor(F.col("n") / 2))
    vocab = half.select("domain", "late", F.explode(F.array_distinct(tx.keywords(F.col("content")))).alias("tok")).groupBy("domain", "tok").agg(F.max(F.col("late").cast("int")).alias("l"), F.max((~F.col("late")).cast("int")).alias("e"))
    g = vocab.groupBy("domain").agg(F.count("*").alias("u"), F.sum(F.col("l") * F.col("e")).alias("both"), F.sum(F.col("l") * (1 - F.col("e"))).alias("new"), F.sum(F.col("e") * (1 - F.col("l"))).alias("lost"))
    return g.select("domain", ((F.col("new") - F.col("lost")) / F.col("u")).alias("growth"), (F.col("both") / F.col("u")).alias("consolidation"))
