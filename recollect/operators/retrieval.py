"""Retrieval and ranking: each operator scores records with Columns and takes the top k.

Ties go by store_seq. Reads are pure; access is folded in by maintenance (see lifecycle).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import lexicons as lex
from recollect.functions import text as tx
from recollect.operators.store import set_checkpoints
from recollect.schema import AS_OF, DAY, TIERS, live


def top(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    return df.orderBy(F.desc(score), "store_seq").limit(k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def vector_topk(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """vec_id and cosine of the k vectors nearest to query."""
    q = F.array(*map(F.lit, query))
    return vectors.select("vec_id", cosine(F.col("embedding").cast("array<double>"), q).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def term_counts(df: DataFrame, query: str, *keep: Column | str) -> tuple[DataFrame, list[str]]:
    """Per record id, keep, its length dl and the counts of the few query terms, read and written
    once; and the query's words."""
    set_checkpoints(df.sparkSession)
    asked = re.findall("[a-z0-9]+", query.lower())
    terms = sorted(set(asked))
    t = df.select("id", *keep, tx.alnum(F.col("content")).alias("t"))
    t = t.select("*", F.size("t").alias("dl"), F.filter("t", lambda w: w.isin(terms)).alias("hit"))
    return t.select(*[c for c in t.columns if c not in ("t", "hit")], *[tx.hits(F.col("hit"), [q]).alias(f"tf{i}") for i, q in enumerate(terms)]).checkpoint(), asked


def scored_by_bm25(counts: DataFrame, asked: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """term_counts with the column bm25; repeated query words count again."""
    terms = sorted(set(asked))
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))])
    part = F.lit(0.0)
    for i, q in enumerate(terms):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        part = part + asked.count(q) * idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    gone = [f"{c}{i}" for i in range(len(terms)) for c in ("tf", "df")]
    return counts.crossJoin(F.broadcast(stats)).withColumn("bm25", part).drop("n", "avgdl", "dl", *gone)


def bm25(df: DataFrame, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """id, bm25 of every record. Only the counts of query words leave the scan."""
    return scored_by_bm25(*term_counts(df, query), k1, b).select("id", "bm25")


def hybrid_retrieve(df: DataFrame, query: str, k: int = 10, rrf: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion of BM25 with the lexical similarity that stands in for embeddings.

    All records are in both rankings. Ranks of the whole table are counted by score ranges, so no
    task sorts all of it: rank = records in better ranges + place within the range.
    """
    s = scored_by_bm25(*term_counts(live(df), query, "store_seq", "domain", lexical(query).alias("lexical")))
    s = s.select("id", "store_seq", "domain", F.round("bm25", 9).alias("bm25"), F.round("lexical", 9).alias("lexical")).checkpoint()  # five narrow columns, read for either ranking
    s = global_ranks(s, {"bm25": "bm25_rank", "lexical": "lexical_rank"})
    return top(s.withColumn("score", 1 / (rrf + F.col("bm25_rank")) + 1 / (rrf + F.col("lexical_rank"))), k).select("id", "domain", "bm25_rank", "lexical_rank", "score")


def global_ranks(df: DataFrame, scores: dict[str, str], ranges: int = 1_000) -> DataFrame:
    """1-based ranks (score -> name) by (score desc, store_seq asc), by ``ranges`` hash ranges of
    store_seq within each score level of a coarse grid, so that ties and floods of equal scores are
    split too. The marks of all scores come from one pass."""
    ends = df.agg(F.min("store_seq").alias("s0"), F.max("store_seq").alias("s1"), *[F.max(c).alias(f"top_{c}") for c in scores])
    g = df.crossJoin(F.broadcast(ends))
    for c in scores:
        g = g.withColumn(f"level_{c}", F.when(F.col(f"top_{c}") > 0, F.floor(F.col(c) / F.col(f"top_{c}") * ranges)).otherwise(0).cast("long"))
        # Level 0 mixes zero and small scores: zeros follow, in slots of store order.
        slot = F.when(F.col(f"level_{c}") == 0, F.floor((F.col("store_seq") - F.col("s0")) * ranges / (F.col("s1") - F.col("s0") + 1))).otherwise(0).cast("long")
        g = g.withColumn(f"slot_{c}", F.when(F.col(c) == 0, slot).otherwise(-1))
    out = g
    for c, name in scores.items():
        at = [f"level_{c}", f"slot_{c}"]
        size = g.groupBy(*at).agg(F.count("*").alias("c"))
        order = Window.orderBy(F.desc(at[0]), at[1])  # at most 2 * ranges + 2 rows
        base = size.select(*at, (F.sum("c").over(order) - F.col("c")).alias("base"))
        inner = Window.partitionBy(*at).orderBy(F.desc(c), "store_seq")
        out = out.join(F.broadcast(base), at).withColumn(name, F.col("base") + F.row_number().over(inner)).drop("base")
    return out.select(*df.columns, *scores.values())


def lexical(query: str) -> Column:
    """Jaccard of the record's words and the query's; the words are made once."""
    qw = list(dict.fromkeys(query.lower().split()))
    asked = F.array(*[F.lit(w) for w in qw]) if qw else F.array().cast("array<string>")

    def share(t: Column) -> Column:
        both = F.size(F.array_intersect(t, asked))
        return F.when(F.size(t) + len(qw) == 0, 0.0).otherwise(both / (F.size(t) + len(qw) - both))

    return F.transform(F.array(F.array_distinct(tx.words(F.col("content")))), share)[0]


def temporal(as_of: float = AS_OF, half_life: float = DAY) -> Column:
    return 0.5 * F.exp(-0.693 * (F.lit(as_of) - F.col("stored_at")) / half_life) + 0.25 * F.least(F.lit(1.0), F.col("access_count") / 10) + 0.25 * F.col("strength")


def feeling(text: str) -> tuple[float, float]:
    """Mean valence and intensity of the text's emotion words."""
    found = [lex.EMOTIONS[w] for w in (re.sub(r"[^\w]", "", w) for w in text.lower().split()) if w in lex.EMOTIONS]
    return (sum(v for v, _ in found) / len(found), sum(i for _, i in found) / len(found)) if found else (0.0, 0.0)


def emotional(query: str) -> Column:
    v, i = feeling(query)
    if i < 0.1:
        return F.lit(0.3)
    return 0.6 * (1 - F.abs(v - F.col("valence")) / 2) + 0.4 * (1 - F.abs(i - F.col("intensity")))


def importance() -> Column:
    return 0.6 * F.col("importance") + 0.4 * F.col("strength")


def domain_match(domain: str | None) -> Column:
    return F.lit(0.3) if domain is None else F.when(F.col("domain") == domain, 1.0).otherwise(0.2)


#: Presets: weights of the strategies (``recall.ensemble`` has the graph strategy as well).
BALANCED = {"semantic": 0.6, "temporal": 0.2, "importance": 0.1, "domain": 0.1}
IDENTITY = {"semantic": 0.3, "temporal": 0.2, "importance": 0.15, "emotional": 0.15, "graph": 0.1, "domain": 0.1}


def ensemble_retrieve(df: DataFrame, query: str, domain: str | None = None, weights: dict[str, float] | None = None, k: int = 10, least: float = 0.3, as_of: float = AS_OF) -> DataFrame:
    """Weighted mean of strategies, capped at 1, with the strategies' scores as a map."""
    weights = weights or BALANCED
    parts = {"semantic": lexical(query), "temporal": temporal(as_of), "emotional": emotional(query), "importance": importance(), "domain": domain_match(domain)}
    s = live(df, as_of).select("id", "store_seq", *[parts[n].alias(n) for n in weights])
    s = s.withColumn("score", F.least(F.lit(1.0), sum((w * F.col(n) for n, w in weights.items()), F.lit(0.0)) / sum(weights.values()))).filter(F.col("score") >= least)
    return top(s, k).select("id", "score", *weights)


def staleness(as_of: float = AS_OF) -> Column:
    """Penalty of reflections, inferences and hearsay by age; 0 for observations."""
    age = F.lit(as_of) - F.col("stored_at")
    p = lambda base, days: F.round(F.least(F.lit(0.15), base * (2 - F.exp(-age / (days * DAY)))), 4)
    kind = F.col("epistemic_type")
    return F.when(kind == "reflection", p(0.05, 7)).when(kind == "inference", p(0.08, 3)).when(kind == "hearsay", p(0.12, 1)).otherwise(0.0)


def core_retrieve(df: DataFrame, query: str, k: int = 10, threshold: float = 0.05, as_of: float = AS_OF, half_life: float = DAY) -> DataFrame:
    """BM25 scaled to [0, 1] plus importance, recency and strength, boosts of tier and access,
    then at most max(2, k // 2) records of a domain if more than k are relevant."""
    n_terms = max(1, len(re.findall("[a-z0-9]+", query.lower())))
    base = live(df, as_of).filter("NOT private")
    s = scored_by_bm25(*term_counts(base, query, "store_seq", "domain", "tier", "importance", "stored_at", "strength", "access_count")).filter("bm25 > 0")
    tier = F.when(F.col("tier") == "semantic", 0.08).when(F.col("tier") == "long_term", 0.04).when(F.col("tier") == "short_term", 0.02).otherwise(0.0)
    rel = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("bm25") / (3 * n_terms)) + 0.2 * F.col("importance") + 0.1 * F.exp(-(F.lit(as_of) - F.col("stored_at")) / half_life) + 0.1 * F.col("strength"))
    s = s.withColumn("score", F.least(F.lit(1.0), rel + tier + F.least(F.lit(0.05), 0.01 * F.col("access_count")))).filter(F.col("score") > threshold)
    return top(diversify(s, k), k).select("id", "domain", "tier", "score")


def diversify(scored: DataFrame, k: int) -> DataFrame:
    """At most max(2, k // 2) records of a domain: the same as taking them greedily by score."""
    cap = max(2, k // 2)
    r = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), "store_seq"))
    return scored.withColumn("__r", r).filter(F.col("__r") <= cap).drop("__r")


def retrieve_filtered(df: DataFrame, tiers: list[str] | None = None, domain: str | None = None, namespace: str | None = None, obs_type: str | None = None, min_importance: float | None = None, min_strength: float | None = None,
                      min_confidence: float | None = None, since: float | None = None, until: float | None = None, private: bool = False, sort: str = "importance", k: int = 20, as_of: float = AS_OF) -> DataFrame:
    """Predicates first (they reach the scan), then the newest or the most important."""
    out = live(df, as_of)
    for value, cond in ((tiers, F.col("tier").isin(tiers or [])), (domain, F.col("domain") == domain), (namespace, F.col("namespace") == namespace), (obs_type, F.col("obs_type") == obs_type),
                        (min_importance, F.col("importance") >= F.lit(min_importance)), (min_strength, F.col("strength") >= F.lit(min_strength)), (min_confidence, F.col("confidence") >= F.lit(min_confidence)),
                        (since, F.col("stored_at") >= F.lit(since)), (until, F.col("stored_at") <= F.lit(until))):
        if value is not None:
            out = out.filter(cond)
    if not private:
        out = out.filter("NOT private")
    key = {"recency": F.col("stored_at"), "importance": F.col("importance"), "weighted": F.col("importance") * F.col("confidence")}[sort]
    return out.withColumn("score", key).orderBy(F.desc("score"), "store_seq").limit(k).select("id", "tier", "score")


def stream_retrieve(df: DataFrame, k: int = 20) -> DataFrame:
    """Best of each tier, tier by tier in scan order."""
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    return live(df).withColumn("score", importance()).withColumn("tier_rank", rank).orderBy("tier_rank", F.desc("score"), "store_seq").limit(k).select("id", "tier", "score")


def affective_retrieve(df: DataFrame, valence: float, intensity: float | None = None, k: int = 10) -> DataFrame:
    """Nearest in valence and intensity."""
    dv = F.col("valence") - valence
    gap = F.abs(dv) / 2 if intensity is None else F.sqrt((dv * dv + (F.col("intensity") - intensity) * (F.col("intensity") - intensity)) / 2)
    return top(df.withColumn("score", 1 - gap), k).select("id", "score")


def similar_feeling(df: DataFrame, ref: int, k: int = 10) -> DataFrame:
    """Nearest in feeling to a reference record, without it."""
    one = df.filter(F.col("id") == ref).limit(1).select(F.col("valence").alias("rv"), F.col("intensity").alias("ri"))
    dv, di = F.col("valence") - F.col("rv"), F.col("intensity") - F.col("ri")
    return top(df.filter(F.col("id") != ref).crossJoin(F.broadcast(one)).withColumn("score", 1 - F.sqrt((dv * dv + di * di) / 2)), k).select("id", "score")


def emotional_landscape(df: DataFrame) -> DataFrame:
    """Moments of valence and intensity and their histograms of four half-open bins."""
    bins = lambda c, edges: [F.sum(((F.col(c) >= a) & (F.col(c) < b)).cast("long")).alias(f"{c}_{i}") for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return df.agg(F.avg("valence").alias("mean_valence"), F.stddev_pop("valence").alias("std_valence"), F.avg("intensity").alias("mean_intensity"), F.stddev_pop("intensity").alias("std_intensity"),
                  *bins("valence", (-1.0, -0.5, 0.0, 0.5, 1.01)), *bins("intensity", (0.0, 0.25, 0.5, 0.75, 1.01)))


def contextual_salience(df: DataFrame, context: str, context_valence: float = 0.0, k: int = 10, as_of: float = AS_OF) -> DataFrame:
    """.35 overlap with the context, .30 importance, .25 recency (7 days half-life), .10 feeling."""
    s = 0.35 * lexical(context) + 0.30 * F.col("importance") + 0.25 * F.pow(F.lit(2.0), -(F.lit(as_of) - F.col("stored_at")) / (7 * DAY)) + 0.10 * F.greatest(F.lit(0.0), 1 - F.abs(F.col("valence") - context_valence))
    return top(df.withColumn("score", s).filter("score > 0"), k).select("id", "score")


def attention(df: DataFrame, goal: str, keywords: str, as_of: float = AS_OF) -> DataFrame:
    """.40 goal overlap + .30 strength + .20 overlap with keywords and goal + .10 / (1 + age in days)."""
    t = F.array_distinct(tx.keywords(F.col("content")))
    want = lambda s: F.array(*[F.lit(w) for w in dict.fromkeys(w for w in s.lower().split() if len(w) >= 4)])
    s = 0.40 * tx.jaccard(t, want(goal)) + 0.30 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("strength"))) + 0.20 * tx.jaccard(t, want(keywords + " " + goal)) + 0.10 / (1 + F.greatest(F.lit(0.0), (F.lit(as_of) - F.col("stored_at")) / DAY))
    return df.select("id", "store_seq", "domain", s.alias("score"))


def attention_profile(df: DataFrame, goal: str, keywords: str) -> DataFrame:
    return attention(df, goal, keywords).groupBy("domain").agg(F.avg("score").alias("attention"))


def mood_retrieve(df: DataFrame, valence: float, k: int = 10) -> DataFrame:
    return df.withColumn("gap", F.abs(F.col("valence") - valence)).orderBy("gap", "store_seq").limit(k).select("id", "gap")


def rag_pack(df: DataFrame, budget: int, candidates: int | None = None) -> DataFrame:
    """The most important records, best first, until the first that would pass the token budget;
    of the ``candidates`` best only, if given. Running sums are counted by score ranges."""
    if candidates is None:
        s = live(df).withColumn("score", importance()).select("id", "store_seq", "score", tx.token_estimate(F.col("content")).alias("tokens")).withColumn("slot", F.floor(F.col("score") * 4096))
        base = s.groupBy("slot").agg(F.sum("tokens").alias("sum")).withColumn("before", F.sum("sum").over(Window.orderBy(F.desc("slot"))) - F.col("sum"))  # at most 4,097 rows
        inner = Window.partitionBy("slot").orderBy(F.desc("score"), "store_seq").rowsBetween(Window.unboundedPreceding, 0)
        s = s.join(F.broadcast(base.select("slot", "before")), "slot").filter(F.col("before") <= budget).withColumn("used", F.col("before") + F.sum("tokens").over(inner))
        return s.filter(F.col("used") <= budget).select("id", "tokens", "used", "score")
    best = top(live(df).withColumn("score", importance()), candidates).select("id", "store_seq", "score", tx.token_estimate(F.col("content")).alias("tokens"))
    w = Window.orderBy(F.desc("score"), "store_seq").rowsBetween(Window.unboundedPreceding, 0)  # at most `candidates` rows
    return best.withColumn("used", F.sum("tokens").over(w)).filter(F.col("used") <= budget).select("id", "tokens", "used", "score")


def replay_priority(as_of: float = AS_OF) -> Column:
    age_days = F.greatest(F.lit(0.0), (F.lit(as_of) - F.col("stored_at")) / DAY)
    return F.greatest(F.lit(1e-6), 0.35 * F.col("importance") + 0.30 * F.least(F.lit(1.0), F.col("strength")) + 0.20 * F.exp(-0.1 * age_days) + 0.15 * F.col("novelty"))


def replay_top(df: DataFrame, k: int = 10) -> DataFrame:
    """The k records of highest replay priority."""
    return top(df.withColumn("score", replay_priority()), k).select("id", "score")


def replay_sample(df: DataFrame, k: int, alpha: float = 0.6, seed: int = 42) -> DataFrame:
    """k records without replacement, chance by priority (exponential keys, one pass)."""
    key = -F.log(1 - F.rand(seed)) / F.pow(replay_priority(), alpha)
    return df.withColumn("key", key).orderBy("key", "store_seq").limit(k).select("id", replay_priority().alias("priority"))


def search_compact(df: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Snippets of at most 80 characters with token estimates, non-private."""
    s = live(df).filter("NOT private").withColumn("score", lexical(query))
    return top(s, k).select("id", F.substring("content", 1, 80).alias("snippet"), tx.token_estimate(F.col("content")).alias("tokens"), "score")


def decompose(query: str) -> list[str]:
    """Sub-queries: at '? ', else at then/and/but/or, else at commas; two words at least, six at most."""
    for cut in (r"\?\s+", r"\s+(?:then|and|but|or)\s+", r",\s*"):
        parts = [p.strip(" ?.,") for p in re.split(cut, query, flags=re.I)]
        parts = [p for p in dict.fromkeys(parts) if len(p.split()) >= 2]
        if len(parts) > 1:
            return parts[:6]
    return [query]


def plan_retrieve(df: DataFrame, query: str, k: int = 10, per_query: int = 20) -> DataFrame:
    """Best score over the sub-queries plus .10 for each further one that finds the record."""
    found = None
    for sub in decompose(query):
        r = hybrid_retrieve(df, sub, per_query).select("id", "score")
        found = r if found is None else found.unionAll(r)
    g = found.groupBy("id").agg(F.max("score").alias("best"), F.count("*").alias("hits"))
    return g.select("id", "hits", F.least(F.lit(1.0), F.col("best") + 0.10 * (F.col("hits") - 1)).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def beta_mean(alpha: float, beta: float) -> float:
    return alpha / (alpha + beta)


def update_arm(alpha: float, beta: float, reward: float, decay: float = 0.99) -> tuple[float, float]:
    """A Beta belief after a reward in [0, 1], the past discounted."""
    return 1 + (alpha - 1) * decay + reward, 1 + (beta - 1) * decay + 1 - reward


