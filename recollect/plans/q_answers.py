"""Questions to what profiles and graphs found."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import lexicons as lex
from recollect.functions import text as tx
from recollect.operators import answers as a
from recollect.operators.pairs import association_edges, causal_edges, hops
from recollect.operators.profiles import extract_norms
from recollect.plans.q_pairs import TWO
from recollect.plans.q_profiles import STRIPPED, sql_list
from recollect.plans.registry import ORACLE_SQL, register
from recollect.schema import AS_OF, EV_SQL, REPORTS_SQL, events_as_memories, events_as_reports, table

REP, EV = events_as_reports, events_as_memories
_causal = f"({ORACLE_SQL['causal_map']})"
register("causal_path", REP, lambda d: a.causal_path(causal_edges(d), "caching", "long"), f"""WITH RECURSIVE e AS (SELECT source AS a, target AS b, max(strength) AS s, arg_max(relation, (strength, relation)) AS r FROM {_causal} GROUP BY 1, 2),
  p AS (SELECT ['caching'] AS path, []::VARCHAR[] AS rel, 0.0::DOUBLE AS total UNION ALL SELECT list_append(path, b), list_append(rel, r), total + s FROM p JOIN e ON a = path[-1] WHERE NOT list_contains(path, b) AND path[-1] <> 'long' AND len(path) < 4),
  h AS (SELECT * FROM p WHERE path[-1] = 'long' ORDER BY len(path), path LIMIT 1) SELECT array_to_string(path, ' > ') AS nodes, array_to_string(rel, ' > ') AS relations, round(total / (len(path) - 1), 4) AS strength FROM h""", "strength")
_DEED = "The team must test the release report"
_asked = [w for w in dict.fromkeys(w.strip(tx.PUNCT).lower() for w in _DEED.split()) if len(w) >= 3 and w not in tx.STOP]
_own = "list_distinct(list_filter([keyword, subject, domain], lambda w: length(w) >= 3))"
register("relevant_norms", REP, lambda d: a.relevant_norms(extract_norms(d), _DEED), f"""SELECT * FROM (SELECT *, len(list_intersect({_own}, {_asked})) / len(list_distinct(list_concat({_own}, {_asked})))::DOUBLE AS relevance FROM ({ORACLE_SQL['norm_extraction']}))
  WHERE relevance > 0 ORDER BY relevance DESC, confidence DESC, domain, keyword, subject LIMIT 5""", "relevance confidence")
_has = lambda ws: f"list_has_any(t, {sql_list(ws)})"
_eff = lambda part: f"(coalesce(avg(importance) FILTER ({part} AND {_has(lex.SUCCESS)}), 0) - coalesce(avg(importance) FILTER ({part} AND {_has(lex.FAILURE)}), 0) + 1) / 2"
register("efficacy_trend", REP, a.efficacy_trend, f"""WITH {REPORTS_SQL}, o AS (SELECT domain, importance, {STRIPPED} AS t, row_number() OVER (PARTITION BY domain ORDER BY stored_at, store_seq) AS p, count(*) OVER (PARTITION BY domain) AS n FROM mem),
  g AS (SELECT domain, count(*) AS n, {_eff('p <= n // 2')} AS early, {_eff('p > n // 2')} AS recent FROM o GROUP BY domain)
  SELECT domain, early, recent, CASE WHEN round(recent - early, 9) > 0.1 THEN 'improving' WHEN round(recent - early, 9) < -0.1 THEN 'declining' ELSE 'stable' END AS trend FROM g WHERE n >= 2""", "early recent")
register("subgraph_edges", EV, lambda d: a.subgraph(association_edges(d), hops(association_edges(d), d.filter("id % 500 = 0").select("id"), 1)), f"""WITH {EV_SQL}, {TWO}, h AS (SELECT id FROM ev WHERE id % 500 = 0 UNION SELECT e2.b FROM ev JOIN e2 ON ev.id = e2.a WHERE ev.id % 500 = 0)
  SELECT a, b, weight FROM ed WHERE a IN (SELECT id FROM h) AND b IN (SELECT id FROM h)""", "weight")


def wishes(spark, sf_dir):
    r = events_as_reports(spark, sf_dir)
    by = r.groupBy("domain")
    p = F.col("importance") - (F.col("valence") > 0).cast("int")
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS goal", "o_orderpriority AS domain", "CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'active' END AS status", f"{AS_OF} - (o_orderkey % 20) * 86400.0D AS created_at")
    return (by.agg(F.avg("importance").alias("level"), F.count("*").alias("beliefs")), by.agg(F.avg(p * p).alias("brier")), r.select(F.col("id").alias("context"), "valence", "strength"),
            r.groupBy(F.substring_index("domain", "-", 1).alias("domain")).agg(F.count("*").alias("n")), orders)


register("goal_rules", wishes, lambda x: a.goals(*x), f"""WITH {REPORTS_SQL}, d AS (SELECT domain, avg(importance) AS level, count(*) AS beliefs, avg((importance - (valence > 0)::INT) * (importance - (valence > 0)::INT)) AS brier FROM mem GROUP BY domain)
  SELECT 'curiosity' AS source, domain, domain AS about, 0.6 * (1 - level) AS priority FROM d WHERE level < 0.4 AND beliefs > 5 UNION ALL SELECT 'calibration', domain, domain, 0.5 * least(brier, 1.0) FROM d WHERE brier > 0.3
  UNION ALL SELECT 'affect', 'reflection', id::VARCHAR, 0.4 * abs(valence) FROM mem WHERE valence < -0.3 AND strength > 0.5 UNION ALL SELECT 'maintenance', k, k, 0.3 * least(n / 500.0, 1.0) FROM (SELECT split_part(domain, '-', 1) AS k, count(*) AS n FROM mem GROUP BY 1) WHERE n > 100
  UNION ALL SELECT 'obligation', o_orderpriority, o_orderkey::VARCHAR, 0.7 * least((o_orderkey % 20) / 14.0, 1.0) FROM orders WHERE o_orderkey % 20 > 3 AND o_orderstatus <> 'F'""", "priority")
