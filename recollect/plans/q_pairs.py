"""Similarity joins, graphs and drift metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import lexicons as lex
from recollect.functions import text as tx
from recollect.operators import pairs as g
from recollect.plans.q_profiles import MORAL_SQL, STRIPPED, TRIG, sql_in
from recollect.plans.registry import register
from recollect.schema import EV_SQL, MEM_SQL, REPORTS_SQL, documents_as_memories, events_as_memories, events_as_reports

MEM, EV, REPORTS = documents_as_memories, events_as_memories, events_as_reports
W, E = f"WITH {MEM_SQL}", f"WITH {EV_SQL}"
WR = f"WITH RECURSIVE {MEM_SQL}"
def keys():
    return tx.keywords(F.col("content"))


KEYWORDS = tx.SQL_KEYWORDS.format(c="content", least=4)


def sim(least: float, name: str = "pr", same: str = "") -> str:
    """All pairs that share a token, then their Jaccard similarity: the plain way."""
    return f"""ks AS (SELECT id, domain, list_distinct({KEYWORDS}) AS t FROM mem), kt AS (SELECT id, domain, len(t) AS n, unnest(t) AS tok FROM ks),
  kc AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM kt a JOIN kt b ON a.tok = b.tok AND a.id < b.id {same} GROUP BY a.id, b.id),
  {name} AS (SELECT a, b, c / (na + nb - c)::DOUBLE AS sim FROM kc WHERE c / (na + nb - c)::DOUBLE >= {least})"""


COMP = """reach AS (SELECT id AS x, id AS y FROM mem UNION SELECT r.x, CASE WHEN r.y = p.a THEN p.b ELSE p.a END FROM reach r JOIN pr p ON r.y IN (p.a, p.b)), comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x)"""

register("jaccard_join", MEM, lambda d: g.jaccard_join(d, keys(), 0.5), f"{W}, {sim(0.5)} SELECT * FROM pr", "sim")
register("contradictions", MEM, lambda d: g.contradictions(d, keys()), f"""{W}, {sim(0.35)} SELECT a, b, sim * abs(x.valence - y.valence) AS score FROM pr JOIN mem x ON x.id = a JOIN mem y ON y.id = b WHERE abs(x.valence - y.valence) >= 0.5 ORDER BY score DESC, a, b LIMIT 10""", "score")
register("contradiction_strain", MEM, lambda d: g.contradiction_strain(d, keys()), f"""{W}, {sim(0.2, same='AND a.domain = b.domain')}, t AS (SELECT count(*) AS pairs, coalesce(sum(sim * abs(x.valence - y.valence) / 2), 0) AS tension FROM pr JOIN mem x ON x.id = a JOIN mem y ON y.id = b WHERE abs(x.valence - y.valence) >= 0.4)
  SELECT pairs, 1 - exp(-5 * tension / (SELECT count(*) FROM mem)) AS strain FROM t""", "strain")
register("rumination", MEM, lambda d: g.rumination(d, keys()), f"""{WR}, {sim(0.15)}, {COMP} SELECT component, count(*) AS size, count(*) / (SELECT count(*) FROM mem)::DOUBLE * (1 + avg((1 - valence) / 2)) AS score FROM mem JOIN comp USING (id) GROUP BY component HAVING count(*) >= 2""", "score")
register("rumination_whole", MEM, lambda d: g.rumination(d, keys()), f"""{WR}, {sim(0.15)}, {COMP} SELECT component, count(*) AS size, count(*) / (SELECT count(*) FROM mem)::DOUBLE * (1 + avg((1 - valence) / 2)) AS score FROM mem JOIN comp USING (id) GROUP BY component HAVING count(*) >= 2""", "score")
register("semantic_dedup", MEM, lambda d: g.dedup_resolve(d, keys()), f"""{WR}, {sim(0.85)}, {COMP}, v AS (SELECT id, component, row_number() OVER (PARTITION BY component ORDER BY 0.6 * importance + 0.4 * least(1.0, access_count / 10.0) DESC, id) AS r FROM mem JOIN comp USING (id))
  SELECT v.id, w.id AS superseded_by FROM v JOIN v w ON v.component = w.component AND w.r = 1 WHERE v.r > 1""")
register("dilemmas", MEM, lambda d: g.dilemmas(d, least=0.0), f"""WITH m AS ({MORAL_SQL}), k AS (SELECT * FROM m WHERE moral_weight > 0)
  SELECT x.domain, x.id AS a, y.id AS b, x.moral_weight * y.moral_weight * abs(x.valence - y.valence) AS tension FROM k x JOIN k y ON x.domain = y.domain AND x.id < y.id WHERE abs(x.valence - y.valence) > 0.5""", "tension")
register("dilemmas_whole", REPORTS, g.dilemmas, f"""WITH m AS ({MORAL_SQL.replace(MEM_SQL, REPORTS_SQL)}), k AS (SELECT * FROM m WHERE moral_weight >= 0.05)
  SELECT x.domain, x.id AS a, y.id AS b, x.moral_weight * y.moral_weight * abs(x.valence - y.valence) AS tension FROM k x JOIN k y ON x.domain = y.domain AND x.id < y.id WHERE abs(x.valence - y.valence) > 0.5 AND x.moral_weight * y.moral_weight * abs(x.valence - y.valence) >= 0.05""", "tension")
register("analogies", MEM, g.domain_analogies, f"""{W.replace('mem AS (', 'mem0 AS (', 1)}, mem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY store_seq) AS r FROM mem0) WHERE r <= 10), {sim(0.1)}
  SELECT a, b, x.domain AS domain_a, y.domain AS domain_b, sim FROM pr JOIN mem x ON x.id = a JOIN mem y ON y.id = b WHERE x.domain <> y.domain""", "sim")
ASSOC = "ed AS (SELECT x.id AS a, y.id AS b, 1 - (y.stored_at - x.stored_at) / 300.0 AS weight FROM ev x JOIN ev y ON x.domain = y.domain AND (y.stored_at > x.stored_at OR (y.stored_at = x.stored_at AND x.id < y.id)) AND y.stored_at - x.stored_at < 300)"
TWO = f"{ASSOC}, e2 AS (SELECT a, b, weight FROM ed UNION ALL SELECT b, a, weight FROM ed)"
register("association_graph", EV, g.association_edges, f"{E}, {ASSOC} SELECT * FROM ed", "weight")
register("association_stats", EV, lambda d: g.graph_stats(g.association_edges(d)), f"""{E}, {TWO}, d AS (SELECT a AS id, count(*) AS d FROM e2 GROUP BY a)
  SELECT count(*) AS nodes, (SELECT count(*) FROM ed) AS edges, avg(d) AS mean_degree, (SELECT avg(weight) FROM ed) AS mean_weight, first(id ORDER BY d DESC, id) AS top_node FROM d""", "mean_degree mean_weight")
register("spreading_activation", EV, lambda d: g.association_activation(d, d.filter("id % 50 = 0").select("id")), f"""{E}, {TWO}, s0 AS (SELECT id, 1.0::DOUBLE AS act FROM ev WHERE id % 50 = 0),
  s1 AS (SELECT b AS id, max(act * weight * 0.5) AS act FROM s0 JOIN e2 ON s0.id = a GROUP BY b HAVING max(act * weight * 0.5) >= 0.01), s2 AS (SELECT b AS id, max(act * weight * 0.5) AS act FROM s1 JOIN e2 ON s1.id = a GROUP BY b HAVING max(act * weight * 0.5) >= 0.01),
  s3 AS (SELECT b AS id, max(act * weight * 0.5) AS act FROM s2 JOIN e2 ON s2.id = a GROUP BY b HAVING max(act * weight * 0.5) >= 0.01)
  SELECT id, max(act) AS activation FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) WHERE id % 50 <> 0 GROUP BY id""", "activation")
register("k_hop_subgraph", EV, lambda d: g.hops(g.association_edges(d), d.filter("id % 500 = 0").select("id")), f"""{E}, {TWO}, h0 AS (SELECT id, 0 AS hops FROM ev WHERE id % 500 = 0), h1 AS (SELECT b AS id, 1 AS hops FROM h0 JOIN e2 ON id = a), h2 AS (SELECT b AS id, 2 AS hops FROM h1 JOIN e2 ON id = a), h3 AS (SELECT b AS id, 3 AS hops FROM h2 JOIN e2 ON id = a)
  SELECT id, min(hops)::INT AS hops FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY id""")
_ok = f"lambda w: length(w) >= 3 AND w NOT IN {sql_in(' '.join(tx.STOP))}"
register("causal_map", REPORTS, g.causal_edges, f"""WITH {REPORTS_SQL}, {TRIG.format(s=STRIPPED, ws=sql_in(lex.CAUSAL))}, r AS (SELECT id, keyword AS relation, list_filter(t[greatest(p - 4, 1):p - 1], {_ok})[-1] AS source, list_filter(t[p + 1:p + 4], {_ok})[1] AS target FROM kw)
  SELECT source, relation, target, count(DISTINCT id) AS docs, count(DISTINCT id) / (SELECT count(*) FROM mem)::DOUBLE AS strength FROM r WHERE source IS NOT NULL AND target IS NOT NULL AND source <> target GROUP BY ALL""", "strength")
register("concept_hierarchy", MEM, g.concept_hierarchy, f"""{W}, t AS (SELECT id, unnest(list_distinct({KEYWORDS})) AS tok FROM mem), b AS (SELECT tok, count(*) AS d FROM t GROUP BY tok HAVING count(*) >= 2 ORDER BY d DESC, tok LIMIT 40),
  k AS (SELECT *, row_number() OVER (ORDER BY d DESC, tok) AS r FROM b), c AS (SELECT x.tok, kx.d, y.tok AS root, ky.r, count(*) AS c FROM t x JOIN k kx ON kx.tok = x.tok AND kx.r > 13 JOIN t y ON y.id = x.id JOIN k ky ON ky.tok = y.tok AND ky.r <= 13 GROUP BY ALL)
  SELECT tok, d AS docs, first(root ORDER BY c DESC, r) AS parent FROM c GROUP BY tok, d""")
register("structural_holes", MEM, g.structural_holes, f"""{W}, w AS (SELECT domain, {tx.SQL_WORDS.format(c='content')} AS t FROM mem), p AS (SELECT domain, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS pair FROM w)
  SELECT pair, count(DISTINCT domain) AS domains FROM p GROUP BY pair HAVING count(DISTINCT domain) >= 2 AND count(DISTINCT domain) < (SELECT count(DISTINCT domain) FROM mem)""")
register("identity_coherence", MEM, g.identity_coherence, f"""{W}, o AS (SELECT domain, unnest({KEYWORDS}) AS tok FROM mem), t AS (SELECT domain, tok, count(*) AS c FROM o GROUP BY ALL), n AS (SELECT count(DISTINCT domain) AS n FROM mem), i AS (SELECT tok, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM t, n GROUP BY tok, n),
  v AS (SELECT domain, tok, c * idf AS w FROM t JOIN i USING (tok)), l AS (SELECT domain, sqrt(sum(w * w)) AS len FROM v GROUP BY domain), u AS (SELECT domain, tok, w / len AS u FROM v JOIN l USING (domain)),
  d AS (SELECT x.domain AS a, y.domain AS b, sum(x.u * y.u) AS cos FROM u x JOIN u y ON x.tok = y.tok AND x.domain < y.domain GROUP BY ALL) SELECT sum(cos) / ((SELECT n * (n - 1) / 2 FROM n)) AS coherence, (SELECT n FROM n) AS sessions FROM d""", "coherence")
register("values_drift", MEM, lambda d: g.values_drift(d.filter("id % 3 <> 0"), d.filter("id % 3 <> 1")), f"""{W}, x AS (SELECT domain, sum(importance) AS x FROM mem WHERE id % 3 <> 0 GROUP BY domain), y AS (SELECT domain, sum(importance) AS y FROM mem WHERE id % 3 <> 1 GROUP BY domain),
  j AS (SELECT coalesce(x, 0) / (SELECT sum(x) FROM x) AS p, coalesce(y, 0) / (SELECT sum(y) FROM y) AS q FROM x FULL JOIN y USING (domain)), k AS (SELECT *, (p + q) / 2 AS m FROM j)
  SELECT sum((CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END) + (CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END)) / 2 / ln(2.0) AS drift FROM k""", "drift")
register("metrics_dashboard", MEM, g.metrics_dashboard, f"{W} SELECT count(*) AS records, count(DISTINCT domain) AS domains, avg(importance) AS mean_importance, avg(strength) AS mean_strength, stddev_pop(valence) AS valence_spread, count(superseded_by) AS superseded FROM mem", "mean_importance mean_strength valence_spread")
