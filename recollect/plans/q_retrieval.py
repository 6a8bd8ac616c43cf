"""Retrieval over documents as memories and over the embeddings."""

from __future__ import annotations

from recollect.functions import text as tx
from recollect.operators import retrieval as r
from recollect.plans.registry import register
from recollect.schema import AS_OF, DAY, LIVE_SQL, MEM_SQL, documents_as_memories, table

MEM = documents_as_memories
W = f"WITH {MEM_SQL}"
QUERY = "the thing that was in the other of tion"
WORDS, ALNUM, KEYWORDS = tx.SQL_WORDS.format(c="content"), tx.SQL_ALNUM.format(c="content"), tx.SQL_KEYWORDS.format(c="content", least=4)
IMP = "0.6 * importance + 0.4 * strength"
TOK = f"floor(len({WORDS}) * 1.3)::INT"


def sql_bm25(query: str, source: str, name: str) -> str:
    """CTEs for BM25 over the table source, in the plain way: tokens, counts, frequencies."""
    asked = ", ".join(f"('{w}')" for w in query.lower().split())
    return f"""{name}_t AS (SELECT id, unnest({ALNUM}) AS tok FROM {source}), {name}_n AS (SELECT id, len({ALNUM}) AS dl FROM {source}),
  {name}_f AS (SELECT id, tok, count(*) AS tf FROM {name}_t GROUP BY id, tok), {name}_d AS (SELECT tok, count(*) AS df FROM {name}_f GROUP BY tok),
  {name}_q AS (SELECT * FROM (VALUES {asked}) AS q(tok)),
  {name} AS (SELECT n.id, coalesce(sum(ln(((SELECT count(*) FROM {name}_n) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM {name}_n)))), 0) AS bm25
    FROM {name}_n n LEFT JOIN ({name}_q JOIN {name}_f USING (tok) JOIN {name}_d USING (tok)) x ON x.id = n.id GROUP BY n.id)"""


def sql_jaccard(tokens: str, query: str) -> str:
    ws = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(query.lower().split())) + "]"
    return f"(CASE WHEN len(list_distinct(list_concat({tokens}, {ws}))) = 0 THEN 0 ELSE len(list_intersect(list_distinct({tokens}), {ws})) / len(list_distinct(list_concat({tokens}, {ws})))::DOUBLE END)"


def sql_hybrid(query: str, k: int, name: str) -> str:
    return f"""lv_{name} AS (SELECT * FROM mem WHERE {LIVE_SQL}), {sql_bm25(query, f'lv_{name}', f'b_{name}')},
  s_{name} AS (SELECT id, store_seq, domain, round(bm25, 9) AS bm25, round({sql_jaccard(WORDS, query)}, 9) AS lexical FROM lv_{name} JOIN b_{name} USING (id)),
  r_{name} AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, store_seq) AS bm25_rank, row_number() OVER (ORDER BY lexical DESC, store_seq) AS lexical_rank FROM s_{name}),
  {name} AS (SELECT id, domain, bm25_rank, lexical_rank, 1 / (60.0 + bm25_rank) + 1 / (60.0 + lexical_rank) AS score FROM r_{name} ORDER BY score DESC, store_seq LIMIT {k})"""


register("hybrid_retrieve", MEM, lambda d: r.hybrid_retrieve(d, QUERY), f"{W}, {sql_hybrid(QUERY, 10, 'h')} SELECT * FROM h", "score")
register("bm25_scores", MEM, lambda d: r.bm25(d, QUERY), f"{W}, {sql_bm25(QUERY, 'mem', 'b')} SELECT * FROM b", "bm25")
SEM, TEMP = sql_jaccard(WORDS, QUERY), f"0.5 * exp(-0.693 * ({AS_OF} - stored_at) / {DAY}) + 0.25 * least(1.0, access_count / 10.0) + 0.25 * strength"
HAPPY = "happy hope " + QUERY
_v, _i = r.feeling(HAPPY)
EMO = f"0.6 * (1 - abs({_v} - valence) / 2) + 0.4 * (1 - abs({_i} - intensity))"
register("ensemble_retrieve", MEM, lambda d: r.ensemble_retrieve(d, HAPPY, "src3", {"semantic": 0.6, "temporal": 0.2, "emotional": 0.1, "domain": 0.1}, least=0.1), f"""{W}, s AS (SELECT id, store_seq, {sql_jaccard(WORDS, HAPPY)} AS semantic, {TEMP} AS temporal, {EMO} AS emotional, CASE WHEN domain = 'src3' THEN 1.0 ELSE 0.2 END::DOUBLE AS domain FROM mem WHERE {LIVE_SQL}),
  t AS (SELECT *, least(1.0, (0.6 * semantic + 0.2 * temporal + 0.1 * emotional + 0.1 * domain) / 1.0) AS score FROM s) SELECT id, score, semantic, temporal, emotional, domain FROM t WHERE score >= 0.1 ORDER BY score DESC, store_seq LIMIT 10""", "score semantic temporal emotional domain")
register("semantic_strategy", MEM, lambda d: d.select("id", r.lexical(QUERY).alias("score")), f"{W} SELECT id, {SEM} AS score FROM mem", "score")
register("temporal_strategy", MEM, lambda d: d.select("id", r.temporal().alias("score")), f"{W} SELECT id, {TEMP} AS score FROM mem", "score")
register("emotional_strategy", MEM, lambda d: d.select("id", r.emotional(HAPPY).alias("score")), f"{W} SELECT id, {EMO} AS score FROM mem", "score")
register("importance_strategy", MEM, lambda d: d.select("id", r.importance().alias("score")), f"{W} SELECT id, {IMP} AS score FROM mem", "score")
register("domain_strategy", MEM, lambda d: d.select("id", r.domain_match("src3").alias("score")), f"{W} SELECT id, (CASE WHEN domain = 'src3' THEN 1.0 ELSE 0.2 END)::DOUBLE AS score FROM mem", "score")
_n = len(QUERY.split())
register("core_retrieve", MEM, lambda d: r.core_retrieve(d, QUERY), f"""{W}, lv AS (SELECT * FROM mem WHERE {LIVE_SQL} AND NOT private), {sql_bm25(QUERY, 'lv', 'b')},
  s AS (SELECT id, store_seq, domain, tier, least(1.0, least(1.0, least(1.0, bm25 / {3 * _n}) + 0.2 * importance + 0.1 * exp(-({AS_OF} - stored_at) / {DAY}) + 0.1 * strength)
    + CASE tier WHEN 'semantic' THEN 0.08 WHEN 'long_term' THEN 0.04 WHEN 'short_term' THEN 0.02 ELSE 0 END + least(0.05, 0.01 * access_count)) AS score FROM lv JOIN b USING (id) WHERE bm25 > 0),
  c AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, store_seq) AS r FROM s WHERE score > 0.05) SELECT id, domain, tier, score FROM c WHERE r <= 5 ORDER BY score DESC, store_seq LIMIT 10""", "score")
register("retrieve_filtered", MEM, lambda d: r.retrieve_filtered(d, tiers=["long_term", "semantic"], min_importance=0.3, min_strength=0.2, namespace="en"), f"""{W} SELECT id, tier, importance AS score FROM mem
  WHERE {LIVE_SQL} AND NOT private AND tier IN ('long_term', 'semantic') AND importance >= 0.3 AND strength >= 0.2 AND namespace = 'en' ORDER BY importance DESC, store_seq LIMIT 20""", "score")
register("stream_retrieve", MEM, r.stream_retrieve, f"""{W} SELECT id, tier, {IMP} AS score FROM mem WHERE {LIVE_SQL} ORDER BY list_position(['working', 'short_term', 'long_term', 'semantic'], tier), score DESC, store_seq LIMIT 20""", "score")
register("affective_retrieve", MEM, lambda d: r.affective_retrieve(d, 0.33, 0.41), f"{W} SELECT id, 1 - sqrt(((valence - 0.33) * (valence - 0.33) + (intensity - 0.41) * (intensity - 0.41)) / 2) AS score FROM mem ORDER BY score DESC, store_seq LIMIT 10", "score")
register("similar_feeling", MEM, lambda d: r.similar_feeling(d, 7), f"""{W}, o AS (SELECT valence AS rv, intensity AS ri FROM mem WHERE id = 7)
  SELECT id, 1 - sqrt(((valence - rv) * (valence - rv) + (intensity - ri) * (intensity - ri)) / 2) AS score FROM mem, o WHERE id <> 7 ORDER BY score DESC, store_seq LIMIT 10""", "score")
_bins = lambda c, e: ", ".join(f"sum(({c} >= {a} AND {c} < {b})::INT)::BIGINT AS {c}_{i}" for i, (a, b) in enumerate(zip(e, e[1:], strict=False)))
register("emotional_landscape", MEM, r.emotional_landscape, f"""{W} SELECT avg(valence) AS mean_valence, stddev_pop(valence) AS std_valence, avg(intensity) AS mean_intensity, stddev_pop(intensity) AS std_intensity,
  {_bins('valence', (-1.0, -0.5, 0.0, 0.5, 1.01))}, {_bins('intensity', (0.0, 0.25, 0.5, 0.75, 1.01))} FROM mem""", "mean_valence std_valence mean_intensity std_intensity")
register("contextual_salience", MEM, lambda d: r.contextual_salience(d, QUERY, 0.2), f"""{W} SELECT id, 0.35 * {SEM} + 0.30 * importance + 0.25 * pow(2.0, -({AS_OF} - stored_at) / {7 * DAY}) + 0.10 * greatest(0.0, 1 - abs(valence - 0.2)) AS score
  FROM mem ORDER BY score DESC, store_seq LIMIT 10""", "score")
GOAL, KEYS = "tion heather threst", "there their other"
_want = lambda s: " ".join(w for w in s.lower().split() if len(w) >= 4)
ATT = f"""{W}, k AS (SELECT *, list_distinct({KEYWORDS}) AS t FROM mem), a AS (SELECT id, store_seq, domain, 0.40 * {sql_jaccard('t', _want(GOAL))} + 0.30 * greatest(0.0, least(1.0, strength)) + 0.20 * {sql_jaccard('t', _want(KEYS + ' ' + GOAL))}
  + 0.10 / (1 + greatest(0.0, ({AS_OF} - stored_at) / {DAY})) AS score FROM k)"""
register("attention_spotlight", MEM, lambda d: r.top(r.attention(d, GOAL, KEYS), 10).select("id", "score"), f"{ATT} SELECT id, score FROM a ORDER BY score DESC, store_seq LIMIT 10", "score")
register("attention_profile", MEM, lambda d: r.attention_profile(d, GOAL, KEYS), f"{ATT} SELECT domain, avg(score) AS attention FROM a GROUP BY domain", "attention")
register("mood_retrieve", MEM, lambda d: r.mood_retrieve(d, 0.25), f"{W} SELECT id, abs(valence - 0.25) AS gap FROM mem ORDER BY gap, store_seq LIMIT 10", "gap")
register("rag_context", MEM, lambda d: r.rag_pack(d, 20_000, 200), f"""{W}, b AS (SELECT id, store_seq, {IMP} AS score, {TOK} AS tokens FROM mem WHERE {LIVE_SQL} ORDER BY score DESC, store_seq LIMIT 200),
  u AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, store_seq ROWS UNBOUNDED PRECEDING) AS used FROM b) SELECT id, tokens, used::BIGINT AS used, score FROM u WHERE used <= 20000""", "score")
register("replay_top", MEM, r.replay_top, f"""{W} SELECT id, greatest(1e-6, 0.35 * importance + 0.30 * least(1.0, strength) + 0.20 * exp(-0.1 * greatest(0.0, ({AS_OF} - stored_at) / {DAY})) + 0.15 * novelty) AS score FROM mem ORDER BY score DESC, store_seq LIMIT 10""", "score")
register("replay_sample", MEM, lambda d: r.replay_sample(d, 20))
register("search_compact", MEM, lambda d: r.search_compact(d, QUERY), f"{W} SELECT id, substring(content, 1, 80) AS snippet, {TOK} AS tokens, {SEM} AS score FROM mem WHERE {LIVE_SQL} AND NOT private ORDER BY score DESC, store_seq LIMIT 10", "score")
PLAN = "the thing that was in and the other of tion"
_subs = r.decompose(PLAN)
_hy = ", ".join(sql_hybrid(s, 20, f"p{i}") for i, s in enumerate(_subs))
register("plan_retrieve", MEM, lambda d: r.plan_retrieve(d, PLAN), f"""{W}, {_hy}, u AS ({' UNION ALL '.join(f'SELECT id, score FROM p{i}' for i in range(len(_subs)))})
  SELECT id, count(*) AS hits, least(1.0, max(score) + 0.10 * (count(*) - 1)) AS score FROM u GROUP BY id ORDER BY score DESC, id LIMIT 10""", "score")
_vec = [((i * 37) % 11 - 5) / 10 for i in range(64)]
register("vector_topk", lambda s, d: table(s, d, "embeddings"), lambda d: r.vector_topk(d, _vec), f"SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {_vec}::DOUBLE[]) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10", "score")
