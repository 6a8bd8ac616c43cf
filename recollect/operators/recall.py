"""Recall to the full specification: scored over records with embeddings, provenance and tags.

A query is a text and, where there is an embedder, its vector. Scores are Columns over one scan;
ties go by store_seq. The thresholds are the specified ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import lexicons as lex
from recollect.functions import text as tx
from recollect.operators import retrieval as r
from recollect.operators.store import set_checkpoints
from recollect.schema import AS_OF, DAY, live

THRESHOLD = 0.3


def infer_domain(query: str, lexicons: dict[str, str] = lex.CORE_DOMAINS) -> str | None:
    """The domain whose words the query has most of; the first of equals; none without any."""
    words = set(query.lower().split())
    best = max(lexicons, key=lambda d: len(words & set(lexicons[d].split())))
    return best if words & set(lexicons[best].split()) else None


def stem(word: Column) -> Column:
    """The word without the first suffix of the list that leaves letters enough."""
    out = None
    for least, suffixes in lex.SUFFIXES.items():
        for s in suffixes.split():
            cond = word.endswith(s) & (F.length(word) - len(s) >= least)
            cut = F.substr(word, F.lit(1), F.length(word) - len(s))
            out = F.when(F.length(word) <= 3, word).when(cond, cut) if out is None else out.when(cond, cut)
    return out.otherwise(word)


def stem_of(word: str) -> str:
    """The same for one word of a query."""
    if len(word) > 3:
        for least, suffixes in lex.SUFFIXES.items():
            for s in suffixes.split():
                if word.endswith(s) and len(word) - len(s) >= least:
                    return word[:-len(s)]
    return word


def closeness(vector: list[float]) -> Column:
    """Cosine to the query's vector, 0 at least and for records without an embedding."""
    return F.coalesce(F.greatest(F.lit(0.0), r.cosine(F.col("embedding"), F.array(*map(F.lit, vector)))), F.lit(0.0))


def embedding_relevance(vector: list[float], as_of: float = AS_OF, half_life: float = DAY) -> Column:
    """min(1, .7 cosine + .15 importance + .1 recency + .05 strength)."""
    return F.least(F.lit(1.0), 0.7 * closeness(vector) + 0.15 * F.col("importance") + 0.1 * F.exp(-(F.lit(as_of) - F.col("stored_at")) / half_life) + 0.05 * F.col("strength"))


def boosts(query: str, as_of: float = AS_OF) -> Column:
    """Tier, domain and access boosts of the core paths."""
    tier = F.when(F.col("tier") == "semantic", 0.08).when(F.col("tier") == "long_term", 0.04).when(F.col("tier") == "short_term", 0.02).otherwise(0.0)
    domain = infer_domain(query)
    return tier + (F.when(F.col("domain") == domain, 0.05).otherwise(0.0) if domain else F.lit(0.0)) + F.least(F.lit(0.05), 0.01 * F.col("access_count"))


def stale(as_of: float = AS_OF) -> Column:
    """Penalty of what isn't first-hand, by the time since it was verified or stored."""
    age = (F.lit(as_of) - F.coalesce("verified_at", "stored_at")) / DAY
    p = lambda base, days: F.round(F.least(F.lit(0.15), base * (2 - F.exp(-age / days))), 4)
    kind = F.col("epistemic_type")
    return F.when(kind == "reflection", p(0.05, 7)).when(kind == "inference", p(0.08, 3)).when(kind == "hearsay", p(0.12, 1)).otherwise(0.0)


def stale_note(as_of: float = AS_OF) -> Column:
    """Why a record should be taken with care, or null."""
    days, kind = (F.lit(as_of) - F.col("verified_at")) / DAY, F.col("epistemic_type")
    return (F.when(F.col("superseded_by").isNotNull(), "superseded").when(kind.isin("hearsay", "inference") & F.col("verified_at").isNull(), "never verified")
            .when(kind.isin("hearsay", "inference") & (days > 3), F.concat(F.lit("verified "), F.format_string("%.0f", days), F.lit(" days ago"))))


def lexical_relevance(df: DataFrame, query: str, as_of: float = AS_OF, half_life: float = DAY, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """df with relevance and found: BM25 over the words of the query, a word's stem counting where
    the word itself is absent, scaled to [0, 1], plus importance, recency and strength.

    The counts of the few query words are read and written once, so that the table's statistics
    don't read the texts again; above 200 records the mean length is taken as 30.
    """
    set_checkpoints(df.sparkSession)
    asked = sorted(set(query.lower().split()))
    stems = {q: stem_of(q) for q in asked}
    wanted = sorted({*asked, *stems.values()})
    t = df.select("*", tx.words(F.col("content")).alias("__w"))
    t = t.select("*", F.size("__w").alias("__dl"), F.filter("__w", lambda w: w.isin(wanted)).alias("__hit"), F.array_intersect(F.array_distinct(F.transform(F.filter("__w", lambda w: F.length(w) >= 2), stem)), F.array(*map(F.lit, wanted))).alias("__st"))
    tf = {q: tx.hits(F.col("__hit"), [q]) for q in wanted}
    cols = []
    for i, q in enumerate(asked):
        own = tf[q]
        cols.append(F.when(own > 0, own).otherwise(tf[stems[q]]).alias(f"__tf{i}"))
        known = sorted({q, stems[q]})
        long = [w for w in known if len(w) >= 2]
        cols.append(((tx.hits(F.col("__hit"), long) > 0 if long else F.lit(False)) | F.arrays_overlap("__st", F.array(*map(F.lit, known)))).cast("int").alias(f"__in{i}"))
    t = t.select(*[c for c in t.columns if c not in ("__w", "__hit", "__st", "content", "embedding")], *cols).checkpoint()
    stats = t.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *[F.sum(f"__in{i}").alias(f"__df{i}") for i in range(len(asked))])
    t = t.crossJoin(F.broadcast(stats))
    avg = F.when(F.col("__n") <= 200, F.greatest(F.lit(1.0), F.col("__avg"))).otherwise(30.0)
    part = F.lit(0.0)
    for i in range(len(asked)):
        idf = F.log((F.col("__n") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5) + 1)
        part = part + F.when(F.col(f"__tf{i}") > 0, idf * F.col(f"__tf{i}") * (k1 + 1) / (F.col(f"__tf{i}") + k1 * (1 - b + b * F.col("__dl") / avg))).otherwise(0.0)
    rel = F.least(F.lit(1.0), part / (3.0 * max(1, len(asked)))) + 0.2 * F.col("importance") + 0.1 * F.exp(-(F.lit(as_of) - F.col("stored_at")) / half_life) + 0.1 * F.col("strength")
    found = reduce(lambda x, y: x | y, [F.col(f"__in{i}") > 0 for i in range(len(asked))], F.lit(False))
    out = t.withColumn("relevance", F.least(F.lit(1.0), rel)).withColumn("found", found)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def core_by_words(df: DataFrame, query: str, k: int = 10, threshold: float = THRESHOLD, as_of: float = AS_OF) -> DataFrame:
    """The core path without an embedder: records with a word of the query."""
    s = lexical_relevance(live(df, as_of).filter("NOT private"), query, as_of).filter("found")
    s = s.withColumn("score", F.least(F.lit(1.0), F.col("relevance") + boosts(query, as_of) - stale(as_of))).filter(F.col("score") > threshold)
    return r.top(_spread(s, k), k).select("id", "domain", "tier", "score", stale_note(as_of).alias("warning"))


def core_by_vector(df: DataFrame, query: str, vector: list[float], k: int = 10, threshold: float = THRESHOLD, as_of: float = AS_OF) -> DataFrame:
    """The core path with an embedder, over the max(10 k, 50) nearest records."""
    near = r.top(df.filter("embedding IS NOT NULL").withColumn("cos", r.cosine(F.col("embedding"), F.array(*map(F.lit, vector)))).drop("content", "embedding"), max(10 * k, 50), "cos")
    s = live(near, as_of).filter("NOT private").withColumn("score", F.least(F.lit(1.0), F.col("cos") + boosts(query, as_of) - stale(as_of))).filter(F.col("score") > threshold)
    return r.top(_spread(s, k), k).select("id", "domain", "tier", "score", stale_note(as_of).alias("warning"))


def _spread(scored: DataFrame, k: int) -> DataFrame:
    """r.diversify where there are more than k results."""
    few = scored.agg(F.count("*").alias("__n"))
    cap = max(2, k // 2)
    row = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), "store_seq"))
    return scored.withColumn("__r", row).crossJoin(F.broadcast(few)).filter((F.col("__n") <= k) | (F.col("__r") <= cap)).drop("__r", "__n")


def semantic(query: str, vector: list[float] | None) -> Column:
    """Cosine where there is an embedding, else word overlap."""
    if vector is None:
        return r.lexical(query)
    return F.when(F.col("embedding").isNotNull(), closeness(vector)).otherwise(r.lexical(query))


def entities(c: Column) -> Column:
    """Lower-cased capitalised words of a text, as the graph strategy compares them."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("[A-Z][a-z]{3,}"), 0), F.lower))


def graph(query: str, known: list[str]) -> Column:
    """Jaccard of the query's known entities and the record's."""
    import re

    asked = [w for w in dict.fromkeys(re.sub(r"[^\w]", "", w).lower() for w in query.split()) if w in set(known)]
    return tx.jaccard(entities(F.col("content")), F.array(*map(F.lit, asked))) if asked else F.lit(0.0)


def ensemble(df: DataFrame, query: str, weights: dict[str, float], vector: list[float] | None = None, known: list[str] | None = None, k: int = 10, least: float = THRESHOLD, as_of: float = AS_OF) -> DataFrame:
    """Weighted mean of strategies, capped at 1, with each score and the three best as explanation.

    The domain is inferred from the query; known: names of the entities the graph knows.
    """
    parts = {"semantic": semantic(query, vector), "temporal": r.temporal(as_of), "emotional": r.emotional(query), "importance": r.importance(), "graph": graph(query, known or []), "domain": r.domain_match(infer_domain(query, lex.ENSEMBLE_DOMAINS))}
    s = live(df, as_of).select("id", "store_seq", *[parts[n].cast("double").alias(n) for n in weights])
    s = s.withColumn("score", F.least(F.lit(1.0), sum((w * F.col(n) for n, w in weights.items()), F.lit(0.0)) / sum(weights.values()))).filter(F.col("score") >= least)
    best = F.slice(F.array_sort(F.array(*[F.struct(F.round(-F.col(n), 9).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(weights)])), 1, 3)
    note = F.array_join(F.transform(best, lambda x: F.concat(x["n"], F.lit("="), F.format_string("%.2f", -x["s"]))), " + ")
    return r.top(s.withColumn("explanation", note), k).select("id", "score", *weights, "explanation")


def timeline(df: DataFrame, session: str | None = None, limit: int = 50, private: bool = False) -> DataFrame:
    """The oldest records, of one session or all."""
    d = df if private else df.filter("NOT private")
    d = d if session is None else d.filter(F.col("session_id") == session)
    return d.orderBy("stored_at", "store_seq").limit(limit).select("id", "session_id", "stored_at")


def sessions(df: DataFrame) -> DataFrame:
    return df.filter("session_id IS NOT NULL").select("session_id").distinct()


def search_by_file(df: DataFrame, path: str) -> DataFrame:
    """Records that read or modified a file whose path has this part, with their age rank."""
    hit = F.exists("files_read", lambda f: F.contains(f, F.lit(path))) | F.exists("files_modified", lambda f: F.contains(f, F.lit(path)))
    return df.filter(hit).select("id", "stored_at", "files_read", "files_modified").orderBy(F.desc("stored_at"), "id")


def filtered(df: DataFrame, query: str = "", vector: list[float] | None = None, k: int = 10, *, namespace: str | None = None, obs_type: str | None = None, domain: str | None = None, session: str | None = None,
             since: float | None = None, until: float | None = None, min_confidence: float | None = None, min_importance: float | None = None, tags: list[str] | None = None, superseded: bool = False, expired: bool = False,
             sort: str = "relevance", threshold: float = THRESHOLD, as_of: float = AS_OF) -> DataFrame:
    """All thirteen predicates, which reach the scan, then the score scaled by confidence; without
    a query the newest, most important or most important and confident."""
    d = df.filter("NOT private")
    if not expired:
        d = d.filter(F.col("expires_at").isNull() | (F.lit(as_of) <= F.col("expires_at")))
    if not superseded:
        d = d.filter(F.col("superseded_by").isNull())
    for value, cond in ((namespace, F.col("namespace") == namespace), (obs_type, F.col("obs_type") == obs_type), (domain, F.col("domain") == domain), (session, F.col("session_id") == session),
                        (since, F.col("stored_at") >= F.lit(since)), (until, F.col("stored_at") <= F.lit(until)), (min_confidence, F.col("confidence") >= F.lit(min_confidence)),
                        (min_importance, F.col("importance") >= F.lit(min_importance)), (tags, F.arrays_overlap("concept_tags", F.array(*map(F.lit, tags or [""]))))):
        if value is not None:
            d = d.filter(cond)
    if not query.strip():
        key = {"recency": F.col("stored_at"), "importance": F.col("importance"), "relevance": F.col("importance") * F.col("confidence")}[sort]
        return r.top(d.withColumn("score", key), k).select("id", "tier", "score")
    s = d.withColumn("relevance", embedding_relevance(vector, as_of)) if vector is not None else lexical_relevance(d, query, as_of)
    score = F.least(F.lit(1.0), (F.col("relevance") + boosts(query, as_of)) * (0.5 + 0.5 * F.col("confidence")))
    return r.top(s.withColumn("score", score).filter(F.col("score") > threshold), k).select("id", "tier", "score")


def compact(df: DataFrame, query: str, weights: dict[str, float] = r.BALANCED, vector: list[float] | None = None, k: int = 20, obs_type: str | None = None, tags: list[str] | None = None, length: int = 120, least: float = THRESHOLD) -> DataFrame:
    """An index of matches: snippet from title and first fact or content, tokens, tags."""
    d = df.filter("NOT private")
    d = d if obs_type is None else d.filter(F.col("obs_type") == obs_type)
    for t in tags or []:
        d = d.filter(F.array_contains("concept_tags", t))
    hits = ensemble(d, query, weights, vector, k=k, least=least).select("id", F.round("score", 3).alias("score"))
    titled = F.concat(F.col("title"), F.lit(" | "), F.coalesce(F.get("facts", F.lit(0)), F.substring("content", 1, 80)))
    snippet = (F.when(F.col("title").isNotNull(), F.when(F.length(titled) > length + 40, F.concat(F.substring(titled, 1, length + 37), F.lit("…"))).otherwise(titled))
               .otherwise(F.concat(F.substring("content", 1, length), F.when(F.length("content") > length, "…").otherwise(""))))
    return d.join(F.broadcast(hits), "id").select("id", snippet.alias("snippet"), "domain", "tier", "session_id", "obs_type", F.array_join("concept_tags", ",").alias("tags"), tx.token_estimate(F.col("content")).alias("tokens"), "score")


def full(df: DataFrame, ids: list[int]) -> DataFrame:
    """The records of these ids, private ones left out."""
    return df.filter(F.col("id").isin(ids)).filter("NOT private").select("id", "content", "tier")


def affective(df: DataFrame, query: str = "", valence: float | None = None, intensity: float | None = None, k: int = 10, valence_tolerance: float = 2.0, intensity_tolerance: float = 2.0, blend: float = 0.4) -> DataFrame:
    """Nearest in feeling within the tolerances, blended with BM25 over its greatest."""
    dv = F.abs(F.col("valence") - valence) if valence is not None else F.lit(0.0)
    di = F.abs(F.col("intensity") - intensity) if intensity is not None else F.lit(0.0)
    near = 0.5 if valence is None and intensity is None else 1 - dv / 2 if intensity is None else 1 - di if valence is None else 1 - F.sqrt((dv * dv + di * di) / 2)
    near = F.lit(near) if isinstance(near, float) else near
    if query.strip():
        s = r.scored_by_bm25(*r.term_counts(df, query, "store_seq", "valence", "intensity"))
        s = s.crossJoin(F.broadcast(s.agg(F.max("bm25").alias("most")))).withColumn("words", F.when(F.col("most") > 0, F.col("bm25") / F.col("most")).otherwise(0.0))
        score = blend * F.col("words") + (1 - blend) * near
    else:
        s, score = df, near
    s = s.filter((dv <= valence_tolerance) & (di <= intensity_tolerance)).withColumn("proximity", near)
    return r.top(s.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))), k).select("id", "proximity", "score")


def poles(df: DataFrame, k: int = 3) -> DataFrame:
    """The k most positive, most negative and most intense records."""
    pick = lambda name, key: df.orderBy(key, "store_seq").limit(k).select(F.lit(name).alias("pole"), "id")
    return pick("positive", F.desc("valence")).unionByName(pick("negative", F.asc("valence"))).unionByName(pick("intense", F.desc("intensity")))


def context_blocks(df: DataFrame, budget: int, least: float = 0.0, header: str = "") -> DataFrame:
    """Records best first until the token budget; the first that doesn't fit comes as its title if
    that does, and ends the packing. Tokens: words over .75, one at least.

    Ranks and running sums are counted by score ranges, as no cut-off is known beforehand.
    """
    words = lambda c: F.greatest(F.lit(1), F.floor(F.size(tx.words(c)) / 0.75)).cast("long")
    s = live(df).withColumn("score", r.importance()).filter(F.col("score") >= least)
    s = s.select("id", "store_seq", "score", words(F.col("content")).alias("tokens"), F.when(F.col("title").isNotNull(), words(F.col("title"))).alias("tiny"))
    s = s.withColumn("slot", F.floor(F.col("score") * 4096))
    base = s.groupBy("slot").agg(F.sum("tokens").alias("sum")).withColumn("before", F.sum("sum").over(Window.orderBy(F.desc("slot"))) - F.col("sum"))  # at most 4,097 rows
    start = max(1, int(len(header.split()) / 0.75))
    inner = Window.partitionBy("slot").orderBy(F.desc("score"), "store_seq").rowsBetween(Window.unboundedPreceding, 0)
    # Only slots that begin within the budget can hold anything that fits, or the first that doesn't.
    s = s.join(F.broadcast(base.select("slot", "before")), "slot").filter(F.col("before") + start <= budget).withColumn("used", F.col("before") + start + F.sum("tokens").over(inner))
    fits = s.filter(F.col("used") <= budget).select("id", "tokens", "used", "score", F.lit(False).alias("title_only"), "store_seq")
    last = s.filter(F.col("used") > budget).orderBy(F.desc("score"), "store_seq").limit(1).filter(F.col("tiny").isNotNull() & (F.col("used") - F.col("tokens") + F.col("tiny") <= budget))
    return fits.unionByName(last.select("id", F.col("tiny").alias("tokens"), (F.col("used") - F.col("tokens") + F.col("tiny")).alias("used"), "score", F.lit(True).alias("title_only"), "store_seq")).drop("store_seq")


def render(blocks: DataFrame, df: DataFrame, form: str = "markdown") -> DataFrame:
    """One line a block, as Markdown, XML, JSON or plain text."""
    b = df.select("id", "title", "content", "domain").join(F.broadcast(blocks.select("id", "score", "title_only")), "id")
    title, body = F.coalesce("title", F.concat(F.lit("record "), "id")), F.when(F.col("title_only"), "").otherwise(F.col("content"))
    xml = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    line = {"markdown": F.concat(F.lit("### "), title, F.lit("\n"), body), "plain": F.concat(title, F.lit(": "), body), "json": F.to_json(F.struct("id", title.alias("title"), body.alias("content"), "domain")),
            "xml": F.concat(F.lit('<memory id="'), F.col("id"), F.lit('" domain="'), xml(F.coalesce("domain", F.lit(""))), F.lit('">'), xml(body), F.lit("</memory>"))}[form]
    return b.select("id", "score", line.alias("block"))


def arms(df: DataFrame, query: str, vector: list[float] | None = None, as_of: float = AS_OF) -> DataFrame:
    """The five arms of the adaptive retriever for every record: semantic, bm25 over its greatest,
    temporal by strength, domain (.6 / .4) and importance."""
    import re

    q = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    asked, over = F.array(*map(F.lit, q)), max(1, len(q))
    words = F.array_distinct(tx.alnum(F.col("content")))
    domain = 0.6 * F.size(F.array_intersect(F.array_distinct(tx.alnum(F.col("domain"))), asked)) / over + 0.4 * F.size(F.array_intersect(words, asked)) / F.greatest(F.lit(1), F.size(F.array_union(words, asked)))
    s = r.scored_by_bm25(*r.term_counts(df, query, "store_seq", closeness(vector).alias("semantic") if vector is not None else F.lit(None).cast("double").alias("semantic"),
                                        (F.exp(-0.693 * (F.lit(as_of) - F.col("stored_at")) / DAY) * F.col("strength")).alias("temporal"), domain.alias("domain"), r.importance().alias("importance")))
    s = s.crossJoin(F.broadcast(s.agg(F.max("bm25").alias("most")))).withColumn("bm25", F.when(F.col("most") > 0, F.col("bm25") / F.col("most")).otherwise(0.0))
    return s.select("id", "store_seq", F.coalesce("semantic", "bm25").alias("semantic"), "bm25", "temporal", "domain", "importance")


def adaptive(df: DataFrame, query: str, beliefs: dict[str, tuple[float, float]], vector: list[float] | None = None, k: int = 10, seed: int | None = None) -> DataFrame:
    """Thompson sampling: the arm with the greatest draw from its Beta belief (without a seed: the
    greatest mean) ranks the records. The beliefs are five pairs on the driver."""
    import random

    rnd = random.Random(seed)
    value = {a: rnd.betavariate(*ab) if seed is not None else r.beta_mean(*ab) for a, ab in beliefs.items()}
    arm = max(value, key=value.get)
    return r.top(arms(df, query, vector), k, arm).select("id", F.lit(arm).alias("arm"), F.col(arm).alias("score"))
