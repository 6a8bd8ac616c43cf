"""Further record operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.operators import records as rc
from recollect.operators import retrieval
from recollect.plans.q_pairs import sim
from recollect.plans.q_profiles import DOCTOK
from recollect.plans.registry import register
from recollect.schema import AS_OF, DAY, EV_SQL, MEM_SQL, documents_as_memories, events_as_memories, table

MEM, EV = documents_as_memories, events_as_memories
W, E = f"WITH {MEM_SQL}", f"WITH {EV_SQL}"
KEYWORDS = tx.SQL_KEYWORDS.format(c="content", least=4)

register("auto_supersession", MEM, rc.auto_supersede, f"{W}, {sim(0.3, same='AND a.domain = b.domain')} SELECT a AS id, min(b) AS superseded_by FROM pr WHERE 1 - sim > 0.05 GROUP BY a")
NOTES = lambda s, d: table(s, d, "events").selectExpr("event_id AS id", "user_id AS record", "CAST(event_id * 7 % 5003 AS DOUBLE) AS at", "CASE WHEN event_id % 3 = 0 THEN event_id + 1 END AS supersedes", "value / 100 AS revised", "value / 200 AS original")
NOTES_SQL = "WITH n AS (SELECT event_id AS id, user_id AS record, (event_id * 7 % 5003)::DOUBLE AS t, CASE WHEN event_id % 3 = 0 THEN event_id + 1 END AS supersedes, value / 100 AS revised, value / 200 AS original FROM events)"
register("annotations_latest", NOTES, rc.latest_annotations, f"{NOTES_SQL} SELECT record, first(id ORDER BY t DESC, id DESC) AS id, max(t) AS noted_at FROM n WHERE id NOT IN (SELECT supersedes FROM n WHERE supersedes IS NOT NULL) GROUP BY record", "noted_at")
register("annotation_growth", NOTES, rc.growth_report, f"{NOTES_SQL} SELECT record, count(*) AS notes, first(revised ORDER BY t DESC, id DESC) - first(original ORDER BY t, id) AS drift FROM n GROUP BY record", "drift")
register("procedural_rules", lambda s, d: table(s, d, "part").selectExpr("p_size AS id", "CASE p_size % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'code' ELSE 'ops' END AS domain", "(p_size % 10) / 10.0D AS importance", "p_partkey AS version", "p_partkey % 5 = 0 AS removed"), lambda d: rc.active_rules(d, "code"),
         "WITH r AS (SELECT p_size AS id, CASE p_size % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'code' ELSE 'ops' END AS domain, (p_size % 10) / 10.0 AS importance, p_partkey AS version, p_partkey % 5 = 0 AS removed, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey DESC) AS r FROM part) SELECT id, domain, version, importance::DOUBLE AS importance FROM r WHERE r = 1 AND NOT removed AND domain IN ('code', 'general') ORDER BY importance DESC, id LIMIT 10", "importance")
register("adaptive_arms", MEM, rc.arm_scores, f"""{W}, a AS (SELECT id, exp(-({AS_OF} - stored_at) / {30 * DAY}) * strength AS temporal, importance, least(1.0, access_count / 6.0)::DOUBLE AS acc FROM mem), b AS (SELECT *, greatest(temporal, importance, acc) AS score FROM a)
  SELECT id, CASE WHEN temporal = score THEN 'temporal' WHEN importance = score THEN 'importance' ELSE 'access' END AS arm, score FROM b""", "score")
_sw = tx.SQL_WORDS.format(c="s")
SENT = f"""{W}, s AS (SELECT id, content, list_filter(regexp_split_to_array(content, '[.!?\\n]+'), lambda x: trim(x) <> '') AS ss FROM mem), u AS (SELECT id, content, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS p FROM s),
  c AS (SELECT id, p, trim(s) AS sentence, round(0.4 * len(list_distinct({_sw})) / greatest(len(list_distinct({tx.SQL_WORDS.format(c='content')})), 1) + 0.3 / (1 + p) + 0.3 * least(1.0, len({_sw}) / 20.0), 9) AS score FROM u),
  k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, p) AS r FROM c)"""
register("extractive_summary", MEM, rc.sentence_scores, f"{SENT} SELECT id, p::INT AS pos, sentence, score FROM k WHERE r <= 2", "score")
register("compression_ratio", MEM, rc.compression_ratio, f"{SENT}, g AS (SELECT id, sum(length(sentence)) AS kept FROM k WHERE r <= 2 GROUP BY id) SELECT id, kept / length(content)::DOUBLE AS ratio FROM g JOIN mem USING (id)", "ratio")
register("schema_seeds", MEM, rc.schema_seeds, f"{W}, {DOCTOK}, g AS (SELECT domain, tok, count(*) AS docs FROM doctok GROUP BY domain, tok HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY docs DESC, tok)::INT AS rank FROM g) SELECT * FROM r WHERE rank <= 30")
register("reflection_lessons", MEM, rc.reflection_lessons, f"""{W}, {DOCTOK}, g AS (SELECT doctok.domain, tok, count(*) AS n, max(valence) - min(valence) AS spread, avg(doctok.importance) AS i FROM doctok JOIN mem USING (id) WHERE doctok.importance >= 0.5 GROUP BY doctok.domain, tok HAVING count(*) >= 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, tok) AS r FROM g) SELECT domain, tok, n, CASE WHEN spread > 0.6 THEN 'contrast' WHEN i >= 0.8 THEN 'principle' WHEN n < 3 THEN 'gap' ELSE 'pattern' END AS kind FROM r WHERE r <= 3""")
register("projections", MEM, rc.projections, f"""{W}, {DOCTOK}, f AS (SELECT domain, count(*) AS n, avg(strength) AS m FROM mem GROUP BY domain ORDER BY min(store_seq) LIMIT 4), g AS (SELECT domain, n, m, tok, count(*) AS c FROM doctok JOIN f USING (domain) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY c DESC, tok) AS r FROM g) SELECT domain, tok AS theme, 0.6 * c / n + 0.4 * m AS plausibility FROM r WHERE r = 1""", "plausibility")
register("belief_revision", MEM, rc.belief_revisions, f"""{W.replace('mem AS (', 'mem0 AS (', 1)}, mem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY store_seq) AS r FROM mem0) WHERE r <= 60), {sim(0.3, same='AND a.domain = b.domain')},
  s AS (SELECT a, b, sim * abs(x.valence - y.valence) AS score, abs(x.strength - y.strength) / greatest(x.strength, y.strength) AS ratio FROM pr JOIN mem x ON x.id = a JOIN mem y ON y.id = b WHERE abs(x.valence - y.valence) >= 0.4)
  SELECT a, b, score, CASE WHEN score >= 0.5 AND ratio >= 0.3 THEN 'supersede' WHEN score >= 0.3 THEN 'merge' ELSE 'flag' END AS action FROM s""", "score")
register("bot_log_parsing", lambda s, d: table(s, d, "events").selectExpr("event_id AS id", "concat(CASE event_type WHEN 'error' THEN 'Error: ' WHEN 'purchase' THEN 'buy ' WHEN 'click' THEN 'sell ' ELSE 'note ' END, 'BTC/USD at ', CAST(user_id AS STRING), '.25') AS line"), rc.parse_bot_log,
         "SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'buy' WHEN 'click' THEN 'sell' ELSE 'note' END AS kind, 'BTC' AS symbol, (user_id || '.25')::DOUBLE AS amount FROM events", "amount")
register("trading_signals", EV, rc.trading_signals, f"""{E}, c AS (SELECT id, (value / lag(value) OVER (PARTITION BY domain ORDER BY stored_at, store_seq) - 1) * 100 AS c FROM ev), s AS (SELECT id, CASE WHEN c < -2.5 THEN 'revert_up' WHEN c > 3.5 THEN 'revert_down' WHEN c > 1.5 THEN 'long' WHEN c < -1.5 THEN 'short' END AS signal FROM c) SELECT * FROM s WHERE signal IS NOT NULL""")
register("rank_weighted_valence", EV, rc.rank_weighted_valence, f"{E}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY stored_at DESC, store_seq DESC) AS r FROM ev) SELECT domain, sum(valence / r) / sum(1.0 / r) AS outlook FROM r WHERE r <= 10 GROUP BY domain", "outlook")
register("market_wisdom", EV, rc.market_wisdom, f"""{E}, p AS (SELECT domain, value - 50 AS pnl, row_number() OVER (PARTITION BY domain ORDER BY stored_at DESC, store_seq DESC) AS r FROM ev), g AS (SELECT domain, avg((pnl > 0)::INT) AS win_rate, sum(greatest(pnl, 0)) / sum(greatest(-pnl, 0)) AS profit_factor, avg(pnl) FILTER (r <= 5) AS last, avg(pnl) AS mean FROM p GROUP BY domain)
  SELECT domain, win_rate, profit_factor, CASE WHEN last > mean + 0.05 THEN 'up' WHEN last < mean - 0.05 THEN 'down' ELSE 'flat' END AS trend FROM g""", "win_rate profit_factor")
register("milestones", EV, rc.milestones, f"{E}, r AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY stored_at, store_seq)::INT AS count FROM ev) SELECT * FROM r WHERE count IN (1, 10, 50, 100)")
register("theme_continuity", MEM, rc.theme_continuity, f"""{W}, t AS (SELECT namespace, list_distinct({KEYWORDS}) AS t, lag(list_distinct({KEYWORDS})) OVER (PARTITION BY namespace ORDER BY store_seq) AS p FROM mem)
  SELECT namespace, avg(len(list_intersect(t, p)) / greatest(len(list_distinct(list_concat(t, p))), 1)::DOUBLE) AS continuity FROM t WHERE p IS NOT NULL GROUP BY namespace""", "continuity")
register("persistent_identity", MEM, rc.persistent_identity, f"""{W}, r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY store_seq DESC) AS r FROM mem) SELECT namespace, count(*) AS n, count(DISTINCT domain) AS domains, sum((r <= 100)::INT)::BIGINT AS recent, string_agg(substring(content, 1, 20), ' | ' ORDER BY r) FILTER (r <= 3) AS narrative FROM r GROUP BY namespace""")
PAIR = lambda s, d: table(s, d, "orders").selectExpr("o_custkey AS a", "o_orderkey AS b")
register("resolution_rate", PAIR, lambda d: rc.resolution_rate(d, d.filter("b % 3 = 0")), "SELECT count(*) AS found, sum((o_orderkey % 3 = 0)::INT)::BIGINT AS resolved, avg((o_orderkey % 3 = 0)::INT) AS rate FROM orders", "rate")
register("goal_generation", MEM, rc.generate_goals, f"""{W}, g AS (SELECT 'strengthen' AS rule, id::VARCHAR AS subject, importance AS priority FROM mem WHERE importance >= 0.8 AND strength < 0.3 UNION ALL SELECT 'revisit', id::VARCHAR, 0.5 + abs(valence) / 2 - 0.1 FROM mem WHERE valence <= -0.7
  UNION ALL SELECT 'explore', domain, 1 - count(*) / (SELECT count(*) FROM mem)::DOUBLE FROM mem GROUP BY domain HAVING count(*) * 25 < (SELECT count(*) FROM mem)) SELECT * FROM g ORDER BY priority DESC, rule, subject LIMIT 10""", "priority")
register("reality_check", lambda s, d: (table(s, d, "benchmark").selectExpr("item_id AS id", "text AS content"), table(s, d, "conversations").selectExpr("conv_id * 100 + turn AS id", "text AS content")), lambda x: rc.reality_check(*x),
         f"""WITH c AS (SELECT item_id AS id, list_distinct({tx.SQL_KEYWORDS.format(c='text', least=4)}) AS t FROM benchmark), f AS (SELECT list_distinct({tx.SQL_KEYWORDS.format(c='text', least=4)}) AS t FROM conversations)
  SELECT id, CASE WHEN EXISTS (SELECT 1 FROM f WHERE len(f.t) > 0 AND len(c.t) > 0 AND len(list_intersect(c.t, f.t)) >= 0.1 * len(list_distinct(list_concat(c.t, f.t)))) THEN 'supported' ELSE 'unverified' END AS status FROM c""")
register("prompt_observer", lambda s, d: table(s, d, "conversations"), rc.observe_prompts, "SELECT conv_id, turn, 'decision' AS obs_type, 0.6::DOUBLE AS importance, substring(text, 1, 60) AS title FROM conversations WHERE role = 'user'", "importance")
ENT = lambda s, d, c: table(s, d, "events").filter(c).selectExpr("user_id AS entity", "value").groupBy("entity").agg(F.count("*").alias("mentions"), F.least(F.lit(1.0), F.avg("value") / 100).alias("strength"))
_ent = lambda c: f"SELECT user_id AS entity, count(*) AS m, least(1.0, avg(value) / 100) AS s FROM events WHERE {c} GROUP BY user_id"
register("federation_graph", lambda s, d: (ENT(s, d, "event_id % 2 = 0 AND user_id % 5 > 0"), ENT(s, d, "event_id % 2 = 1 AND user_id % 7 > 0")), lambda x: rc.merge_graphs(*x), f"""WITH a AS ({_ent('event_id % 2 = 0 AND user_id % 5 > 0')}), b AS ({_ent('event_id % 2 = 1 AND user_id % 7 > 0')})
  SELECT entity, coalesce(a.m, 0) + coalesce(b.m, 0) AS mentions, CASE WHEN a.s IS NULL THEN b.s WHEN b.s IS NULL THEN a.s ELSE least(1.0, (a.s + b.s) / 2 + 0.05) END AS strength FROM a FULL JOIN b USING (entity)""", "strength")
register("srs_due", lambda s, d: table(s, d, "events").selectExpr("event_id AS memory_id", "1700000000.0D + event_id * 100.0D AS next_review", "2.5D AS ease"), lambda d: rc.due_cards(d, 1700050000.0), f"SELECT event_id AS memory_id, (1700050000.0 - (1700000000.0 + event_id * 100.0)) / {DAY} AS overdue_days FROM events WHERE 1700000000.0 + event_id * 100.0 <= 1700050000.0 ORDER BY event_id LIMIT 20", "overdue_days")
register("staleness", MEM, lambda d: d.withColumn("epistemic_type", F.element_at(F.array(*map(F.lit, ("observation", "reflection", "inference", "hearsay"))), (F.col("id") % 4 + 1).cast("int"))).select("id", retrieval.staleness().alias("penalty"), rc.stale_warning((F.lit(AS_OF) - F.col("stored_at")) / DAY).alias("warning")),
         f"""{W}, a AS (SELECT id, {AS_OF} - stored_at AS age FROM mem) SELECT id, CASE id % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN round(least(0.15, 0.05 * (2 - exp(-age / {7 * DAY}))), 4) WHEN 2 THEN round(least(0.15, 0.08 * (2 - exp(-age / {3 * DAY}))), 4) ELSE round(least(0.15, 0.12 * (2 - exp(-age / {DAY}))), 4) END AS penalty,
  CASE WHEN age / {DAY} > 30 THEN 'stale' WHEN age / {DAY} > 7 THEN 'ageing' ELSE 'fresh' END AS warning FROM a""", "penalty")
