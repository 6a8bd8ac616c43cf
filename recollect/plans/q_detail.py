"""The smaller operators that complete a family."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.operators import detail as t
from recollect.operators import graphs as gr
from recollect.operators.pairs import association_edges
from recollect.operators.profiles import enforce_budget
from recollect.plans.q_pairs import ASSOC
from recollect.plans.q_profiles import MORAL_SQL
from recollect.plans.q_recall import DOMAIN, QUERY, sql_boosts, sql_words
from recollect.plans.q_retrieval import TOK, WORDS
from recollect.plans.registry import ORACLE_SQL, register
from recollect.schema import AS_OF, DAY, EV_SQL, LIVE_SQL, MEM_SQL, REC_SQL, documents_as_memories, documents_as_records, events_as_memories, events_as_reports, table

MEM, REC, EV, REPORTS = documents_as_memories, documents_as_records, events_as_memories, events_as_reports
W, R, E = f"WITH {MEM_SQL}", f"WITH {MEM_SQL}, {REC_SQL}", f"WITH {EV_SQL}"
VEC = [((i * 37) % 11 - 5) / 10 for i in range(64)]
register("vector_query_where", lambda s, d: table(s, d, "embeddings"), lambda d: t.vector_query(d, VEC, "label % 2 = 0"), f"SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {VEC}::DOUBLE[]) AS score FROM embeddings WHERE label % 2 = 0 ORDER BY score DESC, vec_id LIMIT 10", "score")
register("vector_upsert", lambda s, d: table(s, d, "embeddings"), lambda d: t.vector_upsert(d, d.filter("vec_id < 9").withColumn("label", F.lit(-1))).select("vec_id", "label"), "SELECT vec_id, CASE WHEN vec_id < 9 THEN -1 ELSE label END AS label FROM embeddings")
register("concept_coverage", REC, t.concept_coverage, f"{R} SELECT tag, count(*) AS n FROM (SELECT unnest(concept_tags) AS tag FROM rec) GROUP BY tag")
register("moral_frameworks", MEM, t.framework_counts, f"SELECT dominant, count(*) AS n, avg(moral_weight) AS mean_weight FROM ({MORAL_SQL}) WHERE dominant <> 'none' GROUP BY dominant", "mean_weight")
register("bigram_patterns", MEM, t.bigram_patterns, f"""{W}, k AS (SELECT {tx.SQL_KEYWORDS.format(c='content', least=3)} AS t FROM mem), p AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS pair FROM k)
  SELECT pair, count(*) AS n FROM p GROUP BY pair HAVING count(*) >= 3 ORDER BY n DESC, pair LIMIT 10""")
_causal = "(" + ORACLE_SQL["causal_map"] + ")"
register("causal_degrees", REPORTS, t.causal_degrees, f"SELECT word, count(*) AS degree FROM (SELECT source AS word FROM {_causal} UNION ALL SELECT target FROM {_causal}) GROUP BY word ORDER BY degree DESC, word LIMIT 5")
register("effects_of", REPORTS, lambda d: t.effects_of(d, "cache"), f"SELECT target AS effect, relation, strength FROM {_causal} WHERE source = 'cache'", "strength")
register("causes_of", REPORTS, lambda d: t.causes_of(d, "cache"), f"SELECT source AS cause, relation, strength FROM {_causal} WHERE target = 'cache'", "strength")
_cons = "0.35 * importance + 0.25 * novelty + 0.25 * strength + 0.15 * least(1.0, access_count / 5.0)"
register("session_threads", REC, t.session_threads, f"""{R}, a AS (SELECT *, {_cons} AS score, concat_ws('; ', CASE WHEN importance >= 0.8 THEN 'important' END, CASE WHEN access_count = 0 THEN 'never recalled' END, CASE WHEN strength < 0.3 THEN 'fading' END, CASE WHEN abs(valence) > 0.5 THEN 'charged' END) AS reasons FROM rec WHERE importance >= 0.5),
  b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, store_seq) AS r FROM a WHERE score < 0.3) SELECT session_id, id, importance, score, reasons FROM b WHERE r <= 5""", "importance score")
register("presence_trend", EV, t.presence_trend, f"""{E}, a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY stored_at DESC, store_seq DESC) AS r FROM ev), g AS (SELECT session_id, count(*) AS n, coalesce(avg(valence) FILTER (r <= 2) - avg(valence) FILTER (r > 2), 0) AS change FROM a WHERE r <= 5 GROUP BY session_id)
  SELECT *, CASE WHEN change > 0.05 THEN 'rising' WHEN change < -0.05 THEN 'falling' ELSE 'stable' END AS trend FROM g""", "change")
RULES = lambda s, d: table(s, d, "benchmark").selectExpr("item_id DIV 3 AS id", "CASE item_id DIV 3 % 2 WHEN 0 THEN 'tech' ELSE 'general' END AS domain", "text", "(item_id % 10) / 10.0D AS importance", "CAST(item_id % 3 + 1 AS INT) AS version", "item_id % 15 = 14 AS removed")
register("rules_prompt", RULES, lambda d: t.rules_prompt(d, "tech", 20), """WITH x AS (SELECT item_id // 3 AS id, CASE item_id // 3 % 2 WHEN 0 THEN 'tech' ELSE 'general' END AS domain, text, (item_id % 10) / 10.0 AS importance, item_id % 3 AS version, item_id % 15 = 14 AS removed FROM benchmark), y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS r FROM x)
  SELECT id, '- [' || domain || '] ' || text AS line FROM y WHERE r = 1 AND NOT removed ORDER BY importance DESC, id LIMIT 20""")
register("merged_episodes", MEM, t.merged_episodes, f"""{W}, a AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY store_seq) AS p FROM mem WHERE tier = 'short_term' AND NOT pinned)
  SELECT namespace, ((p - 1) // 3)::BIGINT AS chunk, '[Compressed episode #' || ((p - 1) // 3 + 1) || '] ' || string_agg(substring(content, 1, 80), ' | ' ORDER BY p) AS content, max(importance) AS importance, max(intensity) AS intensity, max(novelty) AS novelty, avg(valence) AS valence FROM a GROUP BY namespace, (p - 1) // 3""", "importance intensity novelty valence")
register("stream_by_query", REC, lambda d: t.stream_by_query(d, QUERY), f"""{R}, lv AS (SELECT * FROM rec WHERE {LIVE_SQL} AND NOT private), {sql_words(QUERY, 'lv', 'b')}, s AS (SELECT *, least(1.0, relevance + {sql_boosts(DOMAIN)}) AS score FROM b WHERE found)
  SELECT id, tier, score FROM s WHERE score > 0.3 ORDER BY list_position(['working', 'short_term', 'long_term', 'semantic'], tier), score DESC, store_seq LIMIT 20""", "score")
_prio = f"greatest(1e-6, 0.35 * importance + 0.30 * least(1.0, strength) + 0.20 * exp(-0.1 * greatest(0.0, ({AS_OF} - stored_at) / {DAY})) + 0.15 * novelty)"
register("replay_weights", MEM, t.replay_weights, f"{W}, p AS (SELECT id, pow({_prio}, 0.6) AS p FROM mem), s AS (SELECT sum(p) AS s, count(*) AS n, min(p) AS low FROM p) SELECT id, p / s AS chance, pow(1 / (n * p / s), 0.4) / pow(1 / (n * low / s), 0.4) AS weight FROM p, s", "chance weight")
_ask = "[" + ", ".join(f"'{w}'" for w in QUERY.split()) + "]"
register("overlap_seeds", MEM, lambda d: t.overlap_seeds(d, QUERY, 10), f"{W}, x AS (SELECT id, store_seq, list_distinct({WORDS}) AS t FROM mem), y AS (SELECT id, store_seq, len(list_intersect(t, {_ask})) / (len(t) + 1)::DOUBLE AS score FROM x) SELECT id, score FROM y WHERE score > 0 ORDER BY score DESC, store_seq LIMIT 10", "score")
register("outcome_surprise", MEM, lambda d: t.resolve_outcomes(d.select("id", "confidence", (F.col("id") % 3 > 0).alias("confirmed"))), f"{W} SELECT id, CASE WHEN id % 3 > 0 THEN 'confirmed' ELSE 'violated' END AS status, CASE WHEN id % 3 > 0 THEN 1 - confidence ELSE confidence END AS surprise FROM mem", "surprise")
register("domain_changes", MEM, lambda d: t.domain_changes(d.filter("domain <> 'src1'"), d.filter("domain <> 'src2'")), f"""{W}, x AS (SELECT domain, sum(importance) AS x FROM mem WHERE domain <> 'src1' GROUP BY domain), y AS (SELECT domain, sum(importance) AS y FROM mem WHERE domain <> 'src2' GROUP BY domain)
  SELECT domain, CASE WHEN x IS NULL THEN 'new' ELSE 'lost' END AS change, 0.5 * coalesce(x / (SELECT sum(x) FROM x), y / (SELECT sum(y) FROM y)) AS drift FROM x FULL JOIN y USING (domain) WHERE x IS NULL OR y IS NULL""", "drift")
GOALS = lambda s, d: table(s, d, "benchmark").selectExpr("item_id AS id", "text AS content", "(item_id % 13) / 13.0D AS priority").unionByName(table(s, d, "benchmark").selectExpr("item_id + 1000000 AS id", "concat(text, ' again') AS content", "(item_id % 7) / 7.0D AS priority"))
_gs = f"list_distinct({tx.SQL_WORDS.format(c='content')})"
register("distinct_goals", GOALS, t.distinct_goals, f"""WITH g AS (SELECT item_id AS id, text AS content, (item_id % 13) / 13.0 AS priority FROM benchmark UNION ALL SELECT item_id + 1000000, text || ' again', (item_id % 7) / 7.0 FROM benchmark), w AS (SELECT id, priority, {_gs} AS t FROM g),
  b AS (SELECT y.id FROM w x JOIN w y ON x.id <> y.id AND (x.priority > y.priority OR (x.priority = y.priority AND x.id < y.id)) WHERE len(list_intersect(x.t, y.t)) > 0.6 * len(list_distinct(list_concat(x.t, y.t)))) SELECT id, priority FROM g WHERE id NOT IN (SELECT id FROM b) ORDER BY priority DESC, id LIMIT 10""", "priority")
register("d3_export", EV, lambda d: t.d3(association_edges(d), 20), f"""{E}, {ASSOC}, f AS (SELECT * FROM ed ORDER BY weight DESC, a, b LIMIT 20) SELECT '{{"id":"' || id || '"}}' AS line FROM (SELECT a AS id FROM f UNION SELECT b FROM f) UNION ALL SELECT '{{"source":"' || a || '","target":"' || b || '"}}' FROM f""")
register("kept_intentions", lambda s, d: table(s, d, "benchmark").selectExpr("item_id AS id", "(item_id * 7 % 10) / 10.0D AS priority"), lambda d: t.kept_intentions(d, 5), "SELECT item_id AS id, (item_id * 7 % 10) / 10.0 AS priority FROM benchmark ORDER BY priority DESC, id LIMIT 5", "priority")
_band = "CASE WHEN abs(value - 50) < 10 THEN 'calm' WHEN abs(value - 50) < 30 THEN 'mild' WHEN abs(value - 50) < 60 THEN 'active' WHEN abs(value - 50) < 120 THEN 'high' ELSE 'extreme' END"
register("modal_bands", EV, t.modal_bands, f"{E}, g AS (SELECT domain, {_band} AS band, count(*) AS n FROM ev GROUP BY ALL) SELECT domain, first(band ORDER BY n DESC, band) AS band, max(n) AS n FROM g GROUP BY domain")
register("portfolio", EV, t.portfolio, f"{E} SELECT id, domain, 1000 + sum(value - 50) OVER w AS worth, avg((value > 50)::INT) OVER w AS win_rate FROM ev WINDOW w AS (PARTITION BY domain ORDER BY stored_at, store_seq ROWS UNBOUNDED PRECEDING)", "worth win_rate")
_trend = "CASE WHEN value > 55 THEN 'up' WHEN value < 45 THEN 'down' ELSE 'flat' END"
register("trend_changes", EV, t.trend_changes, f"""{E}, x AS (SELECT id, domain, {_trend} AS t, lag({_trend}) OVER (PARTITION BY domain ORDER BY stored_at, store_seq) AS p FROM ev) SELECT id, domain, p AS "from", t AS "to" FROM x WHERE p <> t""")
register("domain_density", MEM, t.domain_density, f"""{W}, g AS (SELECT domain, count(*) AS n, count(*) / greatest((max(stored_at) - min(stored_at)) / {DAY}, 1.0) AS rate FROM mem GROUP BY domain), s AS (SELECT min(rate) AS lo, max(rate) AS hi FROM g)
  SELECT domain, n, CASE WHEN hi > lo THEN (rate - lo) / (hi - lo) ELSE 0 END::DOUBLE AS density, n < 3 AS gap FROM g, s""", "density")
register("conceptual_blends_whole", MEM, lambda d: gr.blend(d, least=0.15), f"SELECT * FROM ({ORACLE_SQL['conceptual_blends']}) WHERE score >= 0.15", "score")
register("token_estimates_packed", MEM, lambda d: d.select("id", F.greatest(F.lit(1), F.floor(F.size(tx.words(F.col("content"))) / 0.75)).cast("long").alias("tokens")), f"{W} SELECT id, greatest(1, floor(len({WORDS}) / 0.75))::BIGINT AS tokens FROM mem")
for _policy, _score in (("lru", "last_accessed"), ("lfu", "access_count::DOUBLE"), ("importance", "importance"), ("strength", "strength")):
    register(f"budget_{_policy}", MEM, lambda d, p=_policy: enforce_budget(d, 200_000, p), f"""{W}, t AS (SELECT id, store_seq, tier, importance, {TOK} AS tokens, {_score} AS score FROM mem), f AS (SELECT *, sum(tokens) OVER (ORDER BY score, store_seq ROWS UNBOUNDED PRECEDING) - tokens AS before FROM t WHERE tier <> 'semantic' AND importance < 0.8)
  SELECT id, tokens, score FROM f WHERE before < (SELECT sum(tokens) - 200000 FROM t)""", "score")
