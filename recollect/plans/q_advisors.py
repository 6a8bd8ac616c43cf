"""Reasoning, planning and conversation helpers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.operators import advisors as ad
from recollect.plans.registry import ORACLE_SQL, register
from recollect.schema import AS_OF, DAY, EV_SQL, MEM_SQL, documents_as_memories, events_as_memories, table

MEM, EV = documents_as_memories, events_as_memories
W, E = f"WITH {MEM_SQL}", f"WITH {EV_SQL}"
KEYWORDS, BWORDS = tx.SQL_KEYWORDS.format(c="content", least=4), tx.SQL_WORDS.format(c="text")
CONV = lambda s, d: table(s, d, "conversations")

register("goal_transitions", lambda s, d: table(s, d, "events").selectExpr("user_id AS goal_id", "event_id AS at", "CASE event_type WHEN 'click' THEN 'activate' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'abandon' ELSE 'note' END AS action"), ad.goal_transitions, """WITH e AS (SELECT user_id AS goal_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'activate' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'abandon' ELSE 'note' END AS action FROM events), l AS (SELECT goal_id, list(action ORDER BY seq) AS log FROM e GROUP BY goal_id)
  SELECT goal_id, list_reduce(list_concat(['pending'], log), lambda s, a: CASE WHEN s = 'pending' AND a = 'activate' THEN 'active' WHEN s = 'active' AND a = 'complete' THEN 'completed' WHEN s = 'active' AND a = 'fail' THEN 'failed' WHEN s IN ('pending', 'active') AND a = 'abandon' THEN 'abandoned' ELSE s END) AS status, len(log)::INT AS events FROM l""")
register("goal_report", lambda s, d: table(s, d, "orders").selectExpr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'pending' END AS status"), ad.goal_report, "SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'pending' END AS status, count(*) AS n FROM orders GROUP BY 1")


def goals(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").selectExpr("item_id AS id", "concat('d', item_id % 4) AS domain", "text AS content", "(item_id % 11) / 10.0D AS priority")
    return b, b.filter("id % 7 = 0")


register("goal_push_filter", goals, lambda x: ad.goal_push(*x), f"""WITH b AS (SELECT item_id AS id, 'd' || (item_id % 4) AS domain, text AS content, (item_id % 11) / 10.0 AS priority, list_distinct({BWORDS}) AS t FROM benchmark), o AS (SELECT * FROM b WHERE id % 7 = 0),
  n AS (SELECT * FROM b WHERE content NOT IN (SELECT content FROM o) AND NOT EXISTS (SELECT 1 FROM o WHERE len(list_intersect(o.t, b.t)) >= 0.85 * len(list_distinct(list_concat(o.t, b.t))))),
  r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, id) AS r FROM n) SELECT id, domain, least(0.9, priority)::DOUBLE AS priority FROM r WHERE r <= 3""", "priority")


def predictions(spark, sf_dir):
    m = MEM(spark, sf_dir)
    recent = m.orderBy(F.desc("stored_at"), F.desc("store_seq")).limit(20).select(F.explode(tx.words(F.col("content"))).alias("tok"))
    return table(spark, sf_dir, "benchmark").selectExpr("item_id AS id", "text AS content", f"{AS_OF}D - item_id * 4000.0D AS created_at"), recent


register("prediction_resolution", predictions, lambda x: ad.resolve_predictions(*x), f"""{W}, r AS (SELECT DISTINCT unnest({tx.SQL_WORDS.format(c='content')}) AS tok FROM (SELECT * FROM mem ORDER BY stored_at DESC, store_seq DESC LIMIT 20)),
  p AS (SELECT item_id AS id, item_id * 4000.0 AS age, unnest(list_distinct({BWORDS})) AS tok FROM benchmark), s AS (SELECT id, age, avg((tok IN (SELECT tok FROM r))::INT) AS share, count(*) AS n FROM p GROUP BY id, age)
  SELECT id, CASE WHEN age > {DAY} THEN 'violated' WHEN n >= 3 AND share > 0.5 THEN 'confirmed' ELSE 'pending' END AS status, share FROM s""", "share")
CTX = ["the", "of", "and", "in", "to", "is", "that", "are"]
register("somatic_markers", lambda s, d: table(s, d, "benchmark").selectExpr("item_id AS id", "text AS content", "(item_id % 9 - 4) / 4.0D AS valence", "1.0D AS strength"), lambda d: ad.somatic_consult(d, " ".join(CTX), least=0.01), f"""WITH b AS (SELECT item_id AS id, (item_id % 9 - 4) / 4.0 AS valence, list_distinct({BWORDS}) AS t FROM benchmark),
  w AS (SELECT *, len(list_intersect(t, {CTX})) / len(list_distinct(list_concat(t, {CTX})))::DOUBLE AS w FROM b), k AS (SELECT * FROM w WHERE w > 0.01 ORDER BY w DESC, id LIMIT 5) SELECT count(*) AS markers, sum(w * valence) / sum(w) AS gut FROM k""", "gut")
register("option_weights", MEM, lambda d: d.select("id", ad.option_weight(F.col("valence")).alias("weight")), f"{W} SELECT id, greatest(0.05, least(0.95, 0.5 + 0.3 * valence)) AS weight FROM mem", "weight")
register("live_self_model", MEM, ad.running_capability, f"""{W}, c AS (SELECT domain, id, stored_at, store_seq, avg(strength) OVER w * ln(1 + count(*) OVER w) / ln(6.0) AS capability FROM mem WINDOW w AS (PARTITION BY domain ORDER BY stored_at, store_seq))
  SELECT domain, id, capability, coalesce(abs(capability - lag(capability) OVER (PARTITION BY domain ORDER BY stored_at, store_seq)) > 0.15, false) AS drift FROM c""", "capability")
register("ego_boundary", CONV, ad.ego_boundary, "SELECT conv_id, turn, (sum((role = 'assistant')::INT) OVER w + 1) / (count(*) OVER w + 2)::DOUBLE AS self_share FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)", "self_share")
register("turn_estimates", CONV, ad.turn_estimates, f"""WITH t AS (SELECT *, list_distinct({BWORDS}) AS t FROM conversations), s AS (SELECT *, flatten(list(t) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) AS seen FROM t)
  SELECT conv_id, turn, least(1.0, 0.2 * (length(text) - length(translate(text, '!?', ''))))::DOUBLE AS intensity, CASE WHEN len(t) = 0 THEN 0 ELSE 1 - coalesce(len(list_intersect(t, seen)), 0) / len(t)::DOUBLE END AS novelty FROM s""", "intensity novelty")
register("temporal_anchors", EV, lambda d: ad.temporal_anchors(d.select("id", F.col("stored_at").alias("due")), 1705300000.0, 86400.0), f"""{E}, l AS (SELECT id, stored_at AS due, stored_at - 1705300000.0 AS l FROM ev) SELECT id, (CASE WHEN l < 0 THEN 1.0 WHEN l <= 60 THEN 0.9 WHEN l <= 3600 THEN 0.7 WHEN l <= 86400 THEN 0.4 ELSE 0.1 END)::DOUBLE AS urgency,
  CASE WHEN l >= 0 THEN due ELSE due + ceil(-l / 86400.0) * 86400.0 END AS next_due FROM l""", "urgency next_due")
register("action_tiers", EV, lambda d: ad.action_tiers(d.select("id", F.col("domain").alias("action")), {"view": "free", "click": "free", "purchase": "approve"}), f"{E} SELECT id, domain AS action, CASE domain WHEN 'view' THEN 'free' WHEN 'click' THEN 'free' WHEN 'purchase' THEN 'approve' ELSE 'ask' END AS tier FROM ev")


def norms(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.keywords(F.col("text"), 3)).alias("subject")).groupBy("subject").agg((F.count("*") % 10 / 10.0).alias("confidence"))
    return CONV(spark, sf_dir).selectExpr("conv_id * 100 + turn AS id", "text"), words


_k3 = tx.SQL_KEYWORDS.format(c="text", least=3)
register("norm_filter", norms, lambda x: ad.norm_filter(*x), f"""WITH n0 AS (SELECT unnest({_k3}) AS subject FROM benchmark), n AS (SELECT subject, (count(*) % 10) / 10.0 AS confidence FROM n0 GROUP BY subject), a AS (SELECT conv_id * 100 + turn AS id, unnest(list_distinct({_k3})) AS subject FROM conversations),
  r AS (SELECT id, max(confidence) AS risk FROM a JOIN n USING (subject) GROUP BY id), s AS (SELECT c.conv_id * 100 + c.turn AS id, coalesce(risk, 0)::DOUBLE AS risk FROM conversations c LEFT JOIN r ON r.id = c.conv_id * 100 + c.turn)
  SELECT id, risk, CASE WHEN risk >= 0.5 THEN 'block' WHEN risk >= 0.2 THEN 'caution' ELSE 'allow' END AS verdict FROM s""", "risk")
register("abductive_hypotheses", lambda s, d: (CONV(s, d).selectExpr("conv_id * 100 + turn AS id", "text AS content"), table(s, d, "benchmark").selectExpr("item_id AS id", "text AS content")), lambda x: ad.abductive_hypotheses(*x, least=0.02),
         f"""WITH o AS (SELECT conv_id * 100 + turn AS id, list_distinct({tx.SQL_KEYWORDS.format(c='text', least=4)}) AS t FROM conversations), h AS (SELECT item_id AS id, list_distinct({tx.SQL_KEYWORDS.format(c='text', least=4)}) AS t FROM benchmark),
  p AS (SELECT o.id AS observation, h.id AS belief, len(list_intersect(o.t, h.t)) / greatest(len(list_distinct(list_concat(o.t, h.t))), 1)::DOUBLE AS sim FROM o, h), r AS (SELECT *, row_number() OVER (PARTITION BY observation ORDER BY sim DESC, belief)::INT AS rank FROM p WHERE sim >= 0.02) SELECT * FROM r WHERE rank <= 5""", "sim")
register("plan_progress", lambda s, d: table(s, d, "lineitem").selectExpr("l_orderkey AS plan", "l_linenumber AS step", "CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 END AS needs", "l_linestatus = 'F' AS done").distinct(), ad.plan_progress,
         """WITH s AS (SELECT DISTINCT l_orderkey AS plan, l_linenumber AS step, CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 END AS needs, l_linestatus = 'F' AS done FROM lineitem), j AS (SELECT s.*, d.step IS NOT NULL AS met FROM s LEFT JOIN s d ON d.plan = s.plan AND d.step = s.needs AND d.done)
  SELECT plan, avg(done::INT) AS progress, sum((NOT done AND (needs IS NULL OR met))::INT)::BIGINT AS ready FROM j GROUP BY plan""", "progress")
STRAINED = lambda d: d.select("session_id", "id", "stored_at", "store_seq", (F.abs("valence") / 10).alias("strain"), (F.col("intensity") / 10).alias("drift"))
register("budget_history", EV, lambda d: ad.budget_history(STRAINED(d)), f"""WITH RECURSIVE {EV_SQL}, o AS (SELECT session_id, id, 0.05 - 0.3 * abs(valence) / 10 - 0.2 * intensity / 10 AS x, row_number() OVER (PARTITION BY session_id ORDER BY stored_at, store_seq) AS n FROM ev),
  w AS (SELECT session_id, id, n, 1.0::DOUBLE AS before, greatest(0.0, least(1.0, 1 + x))::DOUBLE AS budget FROM o WHERE n = 1 UNION ALL SELECT o.session_id, o.id, o.n, w.budget, greatest(0.0, least(1.0, w.budget + x)) FROM w JOIN o ON o.session_id = w.session_id AND o.n = w.n + 1)
  SELECT session_id, id, budget - before AS delta, budget, CASE WHEN budget > 0.75 THEN 'stable' WHEN budget > 0.5 THEN 'strained' WHEN budget > 0.25 THEN 'fragile' ELSE 'critical' END AS label FROM w""", "delta budget")
register("coherence_budget", EV, lambda d: ad.coherence_budget(d.select("session_id", "stored_at", "store_seq", (F.abs("valence") / 10).alias("strain"), (F.col("intensity") / 10).alias("drift"))), f"""{E}, l AS (SELECT session_id, list_concat([1.0::DOUBLE], list(0.05 - 0.3 * abs(valence) / 10 - 0.2 * intensity / 10 ORDER BY stored_at, store_seq)) AS xs FROM ev GROUP BY session_id),
  b AS (SELECT session_id, list_reduce(xs, lambda s, x: greatest(0.0, least(1.0, s + x))) AS budget FROM l) SELECT *, CASE WHEN budget > 0.75 THEN 'stable' WHEN budget > 0.5 THEN 'strained' WHEN budget > 0.25 THEN 'fragile' ELSE 'critical' END AS label FROM b""", "budget")
register("concept_invention", MEM, lambda d: ad.inventions(d, same_rank=True), f"""{W}, t AS (SELECT domain, unnest(list_distinct({KEYWORDS})) AS tok FROM mem), n AS (SELECT domain, count(*) AS n FROM mem GROUP BY domain), g AS (SELECT t.domain, tok, count(*) AS c FROM t JOIN n USING (domain) GROUP BY t.domain, tok, n HAVING count(*) <= 0.2 * n),
  f AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY c, tok) AS r FROM g), k AS (SELECT * FROM f WHERE r <= 10), m AS (SELECT max(c) AS most FROM k)
  SELECT a.domain AS domain_a, a.tok AS tok_a, b.domain AS domain_b, b.tok AS tok_b, ((1 - a.c / most::DOUBLE) + (1 - b.c / most::DOUBLE)) / 2 AS originality FROM k a JOIN k b ON a.r = b.r AND a.domain < b.domain AND a.tok <> b.tok, m ORDER BY originality DESC, domain_a, domain_b, tok_a, tok_b LIMIT 20""", "originality")
register("concept_invention_whole", MEM, ad.inventions, ORACLE_SQL["concept_invention"].replace("a.r = b.r AND ", ""))
register("property_transfer", MEM, lambda d: ad.property_transfer(d, "src1", "src2"), f"{W}, t AS (SELECT domain, unnest({KEYWORDS}) AS property FROM mem) SELECT DISTINCT property FROM t WHERE domain = 'src1' AND property NOT IN (SELECT property FROM t WHERE domain = 'src2') ORDER BY property LIMIT 5")
register("entity_counters", MEM, ad.entity_counters, f"{W}, e AS (SELECT unnest(regexp_extract_all(content, '[A-Z][a-z]{{3,}}')) AS entity FROM mem) SELECT entity, count(*) AS mentions, least(1.0, 0.5 + 0.05 * (count(*) - 1))::DOUBLE AS importance FROM e GROUP BY entity ORDER BY mentions DESC, entity LIMIT 50", "importance")
register("entity_relations", MEM, ad.entity_relations, f"""{W}, s AS (SELECT id, unnest(regexp_split_to_array(content, '[.\\n]')) AS s, generate_subscripts(regexp_split_to_array(content, '[.\\n]'), 1) AS p FROM mem), e AS (SELECT id, p, unnest(list_distinct(regexp_extract_all(s, '[A-Z][a-z]{{3,}}'))) AS e FROM s)
  SELECT a.e AS a, b.e AS b, count(*) AS n, least(1.0, 0.4 + 0.1 * (count(*) - 1))::DOUBLE AS strength FROM e a JOIN e b ON a.id = b.id AND a.p = b.p AND a.e < b.e GROUP BY ALL HAVING count(*) >= 3""", "strength")
