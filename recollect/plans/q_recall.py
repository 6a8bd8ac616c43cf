"""Recall as specified: thresholds of .3, inferred domains, provenance, embeddings, tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import lexicons as lex
from recollect.operators import recall as c
from recollect.operators import retrieval as r
from recollect.plans.q_retrieval import ALNUM, IMP, TEMP, TOK, WORDS, sql_bm25, sql_jaccard
from recollect.plans.registry import register
from recollect.schema import AS_OF, DAY, LIVE_SQL, MEM_SQL, REC_SQL, documents_as_records

REC = documents_as_records
W = f"WITH {MEM_SQL}, {REC_SQL}"
#: Words of the texts among words of domains, so that a domain is inferred.
QUERY = "stock market theories of tion and thing rates in the others"
VEC = [((i * 37) % 11 - 5) / 10 for i in range(64)]
COS = f"coalesce(greatest(0.0, list_cosine_similarity(embedding, {VEC}::DOUBLE[])), 0.0)"
TIER = "CASE tier WHEN 'semantic' THEN 0.08 WHEN 'long_term' THEN 0.04 WHEN 'short_term' THEN 0.02 ELSE 0 END"


def sql_boosts(domain: str) -> str:
    return f"({TIER} + CASE WHEN domain = '{domain}' THEN 0.05 ELSE 0 END + least(0.05, 0.01 * access_count))"


_age = f"(({AS_OF} - coalesce(verified_at, stored_at)) / {DAY})"
_pen = lambda base, days: f"round(least(0.15, {base} * (2 - exp(-{_age} / {days}.0))), 4)"
STALE = f"(CASE epistemic_type WHEN 'reflection' THEN {_pen(0.05, 7)} WHEN 'inference' THEN {_pen(0.08, 3)} WHEN 'hearsay' THEN {_pen(0.12, 1)} ELSE 0 END)"
NOTE = f"""CASE WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN epistemic_type IN ('hearsay', 'inference') AND verified_at IS NULL THEN 'never verified'
  WHEN epistemic_type IN ('hearsay', 'inference') AND ({AS_OF} - verified_at) / {DAY} > 3 THEN 'verified ' || format('{{:.0f}}', ({AS_OF} - verified_at) / {DAY}) || ' days ago' END"""
EMB_REL = f"least(1.0, 0.7 * {COS} + 0.15 * importance + 0.1 * exp(-({AS_OF} - stored_at) / {DAY}) + 0.05 * strength)"


def sql_stem(w: str) -> str:
    cases = " ".join(f"WHEN length({w}) - {len(s)} >= {least} AND {w}[-{len(s)}:] = '{s}' THEN {w}[:-{len(s) + 1}]" for least, ss in lex.SUFFIXES.items() for s in ss.split())
    return f"(CASE WHEN length({w}) <= 3 THEN {w} {cases} ELSE {w} END)"


def sql_words(query: str, source: str, name: str) -> str:
    """CTEs for lexical_relevance over source: relevance of each id that has a word of the query."""
    q = sorted(set(query.lower().split()))
    values = ", ".join(f"('{w}', '{c.stem_of(w)}')" for w in q)
    return f"""{name}_q AS (SELECT * FROM (VALUES {values}) AS q(w, s)), {name}_t AS (SELECT id, {WORDS} AS t FROM {source}), {name}_o AS (SELECT id, unnest(t) AS w FROM {name}_t),
  {name}_f AS (SELECT id, w, count(*) AS n FROM {name}_o GROUP BY id, w), {name}_i AS (SELECT DISTINCT id, w FROM (SELECT id, w FROM {name}_o WHERE length(w) >= 2 UNION ALL SELECT id, {sql_stem('w')} FROM {name}_o WHERE length(w) >= 2)),
  {name}_h AS (SELECT DISTINCT i.id, q.w FROM {name}_i i JOIN {name}_q q ON i.w = q.w OR i.w = q.s), {name}_d AS (SELECT w, count(*) AS df FROM {name}_h GROUP BY w),
  {name}_c AS (SELECT t.id, q.w, len(t.t) AS dl, coalesce(a.n, b.n) AS tf FROM {name}_t t CROSS JOIN {name}_q q LEFT JOIN {name}_f a ON a.id = t.id AND a.w = q.w LEFT JOIN {name}_f b ON b.id = t.id AND b.w = q.s),
  {name}_n AS (SELECT count(*) AS n, CASE WHEN count(*) <= 200 THEN greatest(1.0, avg(len(t))) ELSE 30.0 END AS avgdl FROM {name}_t),
  {name}_b AS (SELECT id, sum(ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS b FROM {name}_c LEFT JOIN {name}_d USING (w), {name}_n WHERE tf IS NOT NULL GROUP BY id),
  {name} AS (SELECT x.*, least(1.0, least(1.0, coalesce(b, 0) / {3.0 * len(q)}) + 0.2 * importance + 0.1 * exp(-({AS_OF} - stored_at) / {DAY}) + 0.1 * strength) AS relevance, x.id IN (SELECT id FROM {name}_h) AS found FROM {source} x LEFT JOIN {name}_b ON {name}_b.id = x.id)"""


def sql_spread(source: str, k: int) -> str:
    return f"""sp AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, store_seq) AS r, count(*) OVER () AS n FROM {source}) SELECT id, domain, tier, score, {NOTE} AS warning FROM sp WHERE n <= {k} OR r <= {max(2, k // 2)} ORDER BY score DESC, store_seq LIMIT {k}"""


DOMAIN = c.infer_domain(QUERY)
register("core_by_words", REC, lambda d: c.core_by_words(d, QUERY), f"""{W}, lv AS (SELECT * FROM rec WHERE {LIVE_SQL} AND NOT private), {sql_words(QUERY, 'lv', 'b')},
  s AS (SELECT * FROM (SELECT *, least(1.0, relevance + {sql_boosts(DOMAIN)} - {STALE}) AS score FROM b WHERE found) WHERE score > 0.3), {sql_spread('s', 10)}""", "score")
register("core_by_vector", REC, lambda d: c.core_by_vector(d, QUERY, VEC), f"""{W}, nr AS (SELECT *, list_cosine_similarity(embedding, {VEC}::DOUBLE[]) AS cos FROM rec WHERE embedding IS NOT NULL ORDER BY cos DESC, store_seq LIMIT 100),
  s AS (SELECT * FROM (SELECT *, least(1.0, cos + {sql_boosts(DOMAIN)} - {STALE}) AS score FROM nr WHERE {LIVE_SQL} AND NOT private) WHERE score > 0.3), {sql_spread('s', 10)}""", "score")
register("embedding_relevance", REC, lambda d: d.select("id", c.embedding_relevance(VEC).alias("relevance")), f"{W} SELECT id, {EMB_REL} AS relevance FROM rec", "relevance")
SEM2 = f"CASE WHEN embedding IS NOT NULL THEN {COS} ELSE {sql_jaccard(WORDS, QUERY)} END"
register("semantic_by_vector", REC, lambda d: d.select("id", c.semantic(QUERY, VEC).alias("score")), f"{W} SELECT id, {SEM2} AS score FROM rec", "score")
PROPER = "The And Thon Heather is Tion"
KNOWN = ["thon", "tion", "and", "nobody"]
ENT = "list_distinct(list_transform(regexp_extract_all(content, '[A-Z][a-z]{3,}'), lambda x: lower(x)))"
GRAPH = sql_jaccard(ENT, "and thon tion")
register("graph_strategy", REC, lambda d: d.select("id", c.graph(PROPER, KNOWN).alias("score")), f"{W} SELECT id, {GRAPH} AS score FROM rec", "score")
_v, _i = r.feeling("happy hope " + QUERY)
EMO = f"0.6 * (1 - abs({_v} - valence) / 2) + 0.4 * (1 - abs({_i} - intensity))"
DOM = f"(CASE WHEN domain = '{c.infer_domain(QUERY, lex.ENSEMBLE_DOMAINS)}' THEN 1.0 ELSE 0.2 END)::DOUBLE"


def sql_ensemble(query: str, weights: dict[str, float], source: str, k: int, least: float = 0.3) -> str:
    parts = {"semantic": f"CASE WHEN embedding IS NOT NULL THEN {COS} ELSE {sql_jaccard(WORDS, query)} END", "temporal": TEMP, "importance": IMP, "emotional": EMO, "graph": GRAPH if "Thon" in query else "0.0", "domain": DOM}
    total = " + ".join(f"{w} * {n}" for n, w in weights.items())
    ranked = "list_sort([" + ", ".join(f"{{'s': round(-{n}, 9), 'i': {i}, 'n': '{n}'}}" for i, n in enumerate(weights)) + "])[1:3]"
    return f"""e0 AS (SELECT id, store_seq, {', '.join(f'({parts[n]})::DOUBLE AS {n}' for n in weights)} FROM {source} WHERE {LIVE_SQL}), e1 AS (SELECT *, least(1.0, ({total}) / {sum(weights.values())}) AS score FROM e0),
  e2 AS (SELECT *, array_to_string(list_transform({ranked}, lambda x: x.n || '=' || printf('%.2f', -x.s)), ' + ') AS explanation FROM e1 WHERE score >= {least} ORDER BY score DESC, store_seq LIMIT {k})"""


BOTH = "happy hope " + QUERY
ID_QUERY = BOTH + " " + PROPER
register("ensemble_balanced", REC, lambda d: c.ensemble(d, BOTH, r.BALANCED, VEC), f"{W}, {sql_ensemble(BOTH, r.BALANCED, 'rec', 10)} SELECT id, score, {', '.join(r.BALANCED)}, explanation FROM e2", "score " + " ".join(r.BALANCED))
register("ensemble_identity", REC, lambda d: c.ensemble(d, ID_QUERY, r.IDENTITY, VEC, KNOWN), f"{W}, {sql_ensemble(ID_QUERY, r.IDENTITY, 'rec', 10)} SELECT id, score, {', '.join(r.IDENTITY)}, explanation FROM e2", "score " + " ".join(r.IDENTITY))
register("record_timeline", REC, lambda d: c.timeline(d, "s2"), f"{W} SELECT id, session_id, stored_at FROM rec WHERE NOT private AND session_id = 's2' ORDER BY stored_at, store_seq LIMIT 50", "stored_at")
register("record_sessions", REC, c.sessions, f"{W} SELECT DISTINCT session_id FROM rec")
register("search_by_file", REC, lambda d: c.search_by_file(d, "m3"), f"{W} SELECT id, stored_at, files_read, files_modified FROM rec WHERE len(list_filter(list_concat(files_read, files_modified), lambda f: contains(f, 'm3'))) > 0", "stored_at")
_f = f"{LIVE_SQL} AND NOT private AND importance >= 0.2 AND confidence >= 0.6 AND stored_at >= 1700001000.0 AND list_has_any(concept_tags, ['pattern', 'how-it-works'])"
_kw = {"min_importance": 0.2, "min_confidence": 0.6, "since": 1700001000.0, "tags": ["pattern", "how-it-works"]}
register("filtered_by_words", REC, lambda d: c.filtered(d, QUERY, **_kw), f"""{W}, lv AS (SELECT * FROM rec WHERE {_f}), {sql_words(QUERY, 'lv', 'b')}, s AS (SELECT *, least(1.0, (relevance + {sql_boosts(DOMAIN)}) * (0.5 + 0.5 * confidence)) AS score FROM b)
  SELECT id, tier, score FROM s WHERE score > 0.3 ORDER BY score DESC, store_seq LIMIT 10""", "score")
register("filtered_by_vector", REC, lambda d: c.filtered(d, QUERY, VEC, **_kw), f"""{W}, s AS (SELECT *, least(1.0, ({EMB_REL} + {sql_boosts(DOMAIN)}) * (0.5 + 0.5 * confidence)) AS score FROM rec WHERE {_f})
  SELECT id, tier, score FROM s WHERE score > 0.3 ORDER BY score DESC, store_seq LIMIT 10""", "score")
register("filtered_without_query", REC, lambda d: c.filtered(d, superseded=True, expired=True, session="s1", obs_type="bugfix"), f"{W} SELECT id, tier, importance * confidence AS score FROM rec WHERE NOT private AND session_id = 's1' AND obs_type = 'bugfix' ORDER BY score DESC, store_seq LIMIT 10", "score")
register("compact_index", REC, lambda d: c.compact(d, BOTH, vector=VEC, tags=["pattern"]), f"""{W}, tg AS (SELECT * FROM rec WHERE NOT private AND list_contains(concept_tags, 'pattern')), {sql_ensemble(BOTH, r.BALANCED, 'tg', 20)},
  d AS (SELECT tg.*, round(e2.score, 3) AS score, title || ' | ' || coalesce(facts[1], substring(content, 1, 80)) AS t FROM tg JOIN e2 USING (id))
  SELECT id, CASE WHEN title IS NULL THEN substring(content, 1, 120) || CASE WHEN length(content) > 120 THEN '…' ELSE '' END WHEN length(t) > 160 THEN substring(t, 1, 157) || '…' ELSE t END AS snippet, domain, tier, session_id, obs_type, array_to_string(concept_tags, ',') AS tags, {TOK} AS tokens, score FROM d""", "score")
register("full_records", REC, lambda d: c.full(d, [1, 2, 29, 30]), f"{W} SELECT id, content, tier FROM rec WHERE id IN (1, 2, 29, 30) AND NOT private")
register("affective_blend", REC, lambda d: c.affective(d, QUERY, 0.33, 0.41, valence_tolerance=0.8, intensity_tolerance=0.5), f"""{W}, {sql_bm25(QUERY, 'mem', 'b')}, s AS (SELECT id, store_seq, 1 - sqrt(((valence - 0.33) * (valence - 0.33) + (intensity - 0.41) * (intensity - 0.41)) / 2) AS proximity, bm25 / (SELECT max(bm25) FROM b) AS w, valence, intensity FROM mem JOIN b USING (id))
  SELECT id, proximity, 0.4 * w + 0.6 * proximity AS score FROM s WHERE abs(valence - 0.33) <= 0.8 AND abs(intensity - 0.41) <= 0.5 ORDER BY score DESC, store_seq LIMIT 10""", "proximity score")
register("emotional_poles", REC, c.poles, f"""{W} (SELECT 'positive' AS pole, id FROM mem ORDER BY valence DESC, store_seq LIMIT 3) UNION ALL (SELECT 'negative', id FROM mem ORDER BY valence, store_seq LIMIT 3) UNION ALL (SELECT 'intense', id FROM mem ORDER BY intensity DESC, store_seq LIMIT 3)""")
_tok = lambda t: f"greatest(1, floor(len({t}) / 0.75))::BIGINT"
PACK = f"""bl AS (SELECT id, store_seq, {IMP} AS score, {_tok(WORDS)} AS tokens, {_tok("regexp_split_to_array(title, ' ')")} AS tiny, title FROM rec WHERE {LIVE_SQL}), ru AS (SELECT *, 1 + sum(tokens) OVER (ORDER BY score DESC, store_seq ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (ORDER BY score DESC, store_seq) AS r FROM bl),
  la AS (SELECT * FROM ru WHERE used > 9000 ORDER BY r LIMIT 1), pk AS (SELECT id, tokens, used::BIGINT AS used, score, false AS title_only FROM ru WHERE used <= 9000 UNION ALL SELECT id, tiny, (used - tokens + tiny)::BIGINT, score, true FROM la WHERE title IS NOT NULL AND used - tokens + tiny <= 9000)"""
register("context_blocks", REC, lambda d: c.context_blocks(d, 9000), f"{W}, {PACK} SELECT * FROM pk", "score")
register("context_rendered", REC, lambda d: c.render(c.context_blocks(d, 9000), d), f"{W}, {PACK} SELECT id, pk.score, '### ' || coalesce(title, 'record ' || id) || chr(10) || CASE WHEN title_only THEN '' ELSE content END AS block FROM pk JOIN rec USING (id)", "score")
_q = "[" + ", ".join(f"'{w}'" for w in sorted(set(QUERY.split()))) + "]"
_set = f"list_distinct({ALNUM})"
_dom = f"0.6 * len(list_intersect(list_distinct({ALNUM.replace('content', 'domain')}), {_q})) / {len(set(QUERY.split()))}.0 + 0.4 * len(list_intersect({_set}, {_q})) / len(list_distinct(list_concat({_set}, {_q})))"
ARMS = f"""{sql_bm25(QUERY, 'mem', 'b')}, ar AS (SELECT id, store_seq, {COS} AS semantic, bm25 / (SELECT max(bm25) FROM b) AS bm25, exp(-0.693 * ({AS_OF} - stored_at) / {DAY}) * strength AS temporal, {_dom} AS domain, {IMP} AS importance FROM rec JOIN b USING (id))"""
register("adaptive_five_arms", REC, lambda d: c.arms(d, QUERY, VEC).drop("store_seq"), f"{W}, {ARMS} SELECT id, semantic, bm25, temporal, domain, importance FROM ar", "semantic bm25 temporal domain importance")
BELIEFS = {"semantic": (2.0, 3.0), "bm25": (5.0, 2.0), "temporal": (1.0, 1.0), "domain": (1.0, 4.0), "importance": (2.0, 2.0)}
register("adaptive_retrieve", REC, lambda d: c.adaptive(d, QUERY, BELIEFS, VEC), f"{W}, {ARMS} SELECT id, 'bm25' AS arm, bm25 AS score FROM ar ORDER BY bm25 DESC, store_seq LIMIT 10", "score")
register("known_entities", REC, lambda d: d.select(F.explode(c.entities(F.col("content"))).alias("entity")).distinct(), f"{W} SELECT DISTINCT unnest({ENT}) AS entity FROM rec")
