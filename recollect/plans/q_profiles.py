"""Profiles over documents as memories."""

from __future__ import annotations

from recollect.functions import lexicons as lex
from recollect.functions import text as tx
from recollect.operators import profiles as p
from recollect.plans.registry import register
from recollect.schema import AS_OF, MEM_SQL, REPORTS_SQL, documents_as_memories, events_as_reports

MEM, REPORTS = documents_as_memories, events_as_reports
W, WP = f"WITH {MEM_SQL}", f"WITH {REPORTS_SQL}"
CONS = "0.35 * importance + 0.25 * novelty + 0.25 * strength + 0.15 * least(1.0, access_count / 5.0)"
TOK = f"floor(len({tx.SQL_WORDS.format(c='content')}) * 1.3)::INT"
CONF = (f"greatest(0.0, least(1.0, exp(0.35 * ln(least(1.0, strength / 2) + 1e-9) + 0.25 * ln(exp(-0.05 * greatest(0.0, ({AS_OF} - last_accessed) / 86400.0)) + 1e-9)"
        f" + 0.20 * ln(least(1.0, access_count / 10.0) + 1e-9) + 0.20 * ln(({CONS}) + 1e-9))))")
STRIPPED, KEYWORDS = tx.SQL_STRIPPED.format(c="content"), tx.SQL_KEYWORDS.format(c="content", least=4)
BARE = "list_transform(" + tx.SQL_WORDS.format(c="content") + ", lambda w: trim(w, '.,!?;:\"''()'))"


def sql_list(ws: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in lex.words(ws)) + "]"


def sql_in(ws: str) -> str:
    return "(" + ", ".join(f"'{w}'" for w in lex.words(ws)) + ")"


def pairs(groups: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{w}', '{g}')" for g, ws in groups.items() for w in lex.words(ws)) + ") AS lx(tok, grp)"


DOCTOK = f"doctok AS (SELECT id, domain, importance, strength, unnest(list_distinct({KEYWORDS})) AS tok FROM mem)"
OCC = f"occ AS (SELECT id, domain, unnest({KEYWORDS}) AS tok FROM mem)"
SIZE = "size AS (SELECT domain, count(*) AS n FROM mem GROUP BY domain)"

register("consolidation_score", MEM, p.consolidation_score, f"{W} SELECT id, {CONS} AS score FROM mem", "score")
register("tier_distribution", MEM, lambda d: p.counts(d, "tier"), f"{W} SELECT tier, count(*) AS n FROM mem GROUP BY tier")
register("domain_coverage", MEM, lambda d: p.counts(d, "domain"), f"{W} SELECT domain, count(*) AS n FROM mem GROUP BY domain")
register("obs_type_distribution", MEM, lambda d: p.counts(d, "obs_type", "unclassified"), f"{W} SELECT coalesce(obs_type, 'unclassified') AS obs_type, count(*) AS n FROM mem GROUP BY 1")
register("strength_distribution", MEM, p.strength_distribution, f"{W} SELECT tier, min(strength) AS min_strength, avg(strength) AS mean_strength, max(strength) AS max_strength FROM mem GROUP BY tier", "min_strength mean_strength max_strength")
register("privacy_audit", MEM, p.privacy_audit, f"{W} SELECT count(*) AS total, sum(private::INT)::BIGINT AS private, avg(private::INT) AS share FROM mem", "share")
register("health_score", MEM, p.health_score, f"""{W}, r AS (SELECT avg((superseded_by IS NULL)::INT) AS live_ratio, avg((obs_type IS NOT NULL)::INT) AS typed_ratio, avg((strength >= 0.5)::INT) AS strong_ratio,
  avg((access_count > 0)::INT) AS accessed_ratio FROM mem) SELECT *, (live_ratio + typed_ratio + strong_ratio + accessed_ratio) / 4 AS health FROM r""", "live_ratio typed_ratio strong_ratio accessed_ratio health")
register("token_footprint", MEM, p.token_footprint, f"{W} SELECT coalesce(tier, 'all') AS tier, sum({TOK})::BIGINT AS tokens FROM mem GROUP BY ROLLUP (tier)")
register("budget_enforcement", MEM, lambda d: p.enforce_budget(d, 200_000), f"""{W}, t AS (SELECT id, store_seq, tier, importance, {TOK} AS tokens, round(0.4 * importance + 0.4 * strength + 0.2 * least(1.0, access_count / 10.0), 9) AS score FROM mem),
  need AS (SELECT sum(tokens) - 200000 AS need FROM t), r AS (SELECT id, tokens, score, sum(tokens) OVER (ORDER BY score, store_seq) - tokens AS freed FROM t WHERE tier <> 'semantic' AND importance < 0.8)
  SELECT id, tokens, score FROM r, need WHERE freed < need""", "score")
register("trust_ledger", MEM, p.trust_ledger, f"{W} SELECT domain, count(*) AS n, 0.4 * avg(importance) + 0.4 * (1 - stddev_pop(valence)) + 0.2 * least(1.0, count(*) / 10.0) AS trust FROM mem GROUP BY domain", "trust")
KM = f"{W} SELECT domain, count(*) AS n, avg({CONF}) AS mean_confidence, avg(importance) AS mean_importance, avg(strength) AS mean_strength, count(*) / (SELECT count(*) FROM mem)::DOUBLE AS coverage FROM mem GROUP BY domain"
register("knowledge_map", MEM, p.knowledge_map, KM, "mean_confidence mean_importance mean_strength coverage")
register("knowledge_gaps", MEM, p.find_gaps, f"SELECT domain, mean_confidence, coverage FROM ({KM}) WHERE mean_confidence < 0.3 OR coverage < 0.05", "mean_confidence coverage")
register("capability_profile", MEM, p.capability_profile, f"{W} SELECT domain, least(1.0, avg(strength) * ln(1 + count(*)) / ln(6.0)) AS capability FROM mem GROUP BY domain", "capability")
register("self_beliefs", MEM, p.self_beliefs, f"""{W}, {DOCTOK}, {SIZE}, g AS (SELECT domain, tok, count(*) AS df, avg(strength) AS s FROM doctok GROUP BY domain, tok),
  r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY df DESC, tok) AS r FROM g) SELECT domain, tok AS belief, df, 0.6 * df / n + 0.4 * s AS confidence FROM r JOIN size USING (domain) WHERE r = 1""", "confidence")
register("emotional_coherence", MEM, p.emotional_coherence, f"{W} SELECT greatest(0.0, least(1.0, 1 - stddev_pop(valence))) AS coherence FROM mem", "coherence")
register("emotional_state", MEM, p.emotional_state, f"""{W}, n AS (SELECT * FROM mem ORDER BY stored_at DESC, store_seq DESC LIMIT 20)
  SELECT avg(valence) AS valence, avg(intensity) AS arousal, stddev_pop(valence) AS volatility, (SELECT domain FROM n GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 1) AS dominant_domain FROM n""", "valence arousal volatility")
register("reappraisal", MEM, p.reappraise, f"{W} SELECT id, valence, least(1.0, valence + 0.3) AS reappraised, 'Reappraisal: ' || substring(content, 1, 60) AS note FROM mem WHERE valence < -0.3", "valence reappraised")
register("bias_detection", REPORTS, p.detect_biases, f"""{WP}, t AS (SELECT id, importance, unnest({STRIPPED}) AS tok FROM mem), h AS (SELECT DISTINCT grp, id, importance FROM t JOIN {pairs(lex.BIAS)} USING (tok))
  SELECT grp AS bias, count(*) AS n_affected, least(1.0, count(*) / (SELECT count(*) FROM mem)::DOUBLE * avg(importance)) AS strength FROM h GROUP BY grp HAVING strength >= 0.05""", "strength")
register("value_mapping", MEM, p.map_values, f"""{W}, t AS (SELECT id, importance, unnest({STRIPPED}) AS tok FROM mem)
  SELECT grp AS category, tok AS value, count(DISTINCT id) AS n_docs, least(1.0, avg(importance) * count(DISTINCT id) / (SELECT count(*) FROM mem) * 5) AS strength FROM t JOIN {pairs(lex.VALUES)} USING (tok) GROUP BY grp, tok""", "strength")
_m = {g: f"round(len(list_filter(t, lambda w: w IN {sql_in(ws)})) / greatest(len(t), 1)::DOUBLE, 4)" for g, ws in lex.MORAL.items()}
MORAL_SQL = f"""{W}, a AS (SELECT id, domain, importance, valence, {BARE} AS t FROM mem), b AS (SELECT id, domain, importance, valence, {', '.join(f'{x} AS {g}' for g, x in _m.items())} FROM a),
  c AS (SELECT *, greatest(consequentialist, deontological, virtue) AS top FROM b) SELECT id, domain, valence, consequentialist, deontological, virtue,
  CASE WHEN top < 0.01 THEN 'none' WHEN consequentialist = top THEN 'consequentialist' WHEN deontological = top THEN 'deontological' ELSE 'virtue' END AS dominant,
  round(least(1.0, importance * abs(valence) * (top + 0.1)), 4) AS moral_weight FROM c"""
register("moral_reasoning", MEM, p.moral_scores, MORAL_SQL, "valence moral_weight")
_adv = " ".join(f"WHEN list_has_any(t, {sql_list(ws)}) THEN '{g}'" for g, ws in lex.ADVERSITY.items())
register("adversity_trace", REPORTS, p.trace_adversity, f"""{WP}, a AS (SELECT *, {STRIPPED} AS t FROM mem), b AS (SELECT id, domain, CASE {_adv} END AS kind, importance * (1 - valence) / 2 AS severity FROM a) SELECT * FROM b WHERE kind IS NOT NULL""", "severity")
register("self_compassion", MEM, p.self_compassion, f"""{W}, a AS (SELECT domain, {STRIPPED} AS t FROM mem), g AS (SELECT domain, count(*) AS n, sum(list_has_any(t, {sql_list(lex.KIND)})::INT)::BIGINT AS kind, sum(list_has_any(t, {sql_list(lex.HARSH)})::INT)::BIGINT AS harsh FROM a GROUP BY domain)
  SELECT domain, n, kind, harsh, (kind - harsh + n) / (2.0 * n) AS compassion, harsh / n::DOUBLE AS inner_critic FROM g WHERE n >= 2""", "compassion inner_critic")
register("self_efficacy", MEM, p.self_efficacy, f"""{W}, a AS (SELECT domain, importance, list_has_any({STRIPPED}, {sql_list(lex.SUCCESS)}) AS s, list_has_any({STRIPPED}, {sql_list(lex.FAILURE)}) AS f FROM mem)
  SELECT domain, sum(s::INT)::BIGINT AS successes, sum(f::INT)::BIGINT AS failures, (coalesce(avg(importance) FILTER (s), 0) - coalesce(avg(importance) FILTER (f), 0) + 1) / 2 AS efficacy FROM a GROUP BY domain""", "efficacy")
TRIG = "t AS (SELECT id, domain, importance, strength, {s} AS t FROM mem), k AS (SELECT *, unnest(range(1, len(t) + 1)) AS p FROM t), kw AS (SELECT *, t[p] AS keyword FROM k WHERE t[p] IN {ws})"
_mean = f"list_filter(t[p + 1:p + 4], lambda w: length(w) >= 3 AND w NOT IN {sql_in(' '.join(tx.STOP))})[1]"
register("norm_extraction", REPORTS, p.extract_norms, f"""{WP}, {TRIG.format(s=STRIPPED, ws=sql_in(lex.PRESCRIPTIVE + ' ' + lex.PROHIBITIVE))}, r AS (SELECT *, {_mean} AS subject FROM kw), {SIZE}
  SELECT r.domain, keyword, subject, CASE WHEN keyword IN {sql_in(lex.PRESCRIPTIVE)} THEN 'prescriptive' ELSE 'prohibitive' END AS polarity, 0.6 * count(DISTINCT id) / any_value(n) + 0.4 * avg(importance) AS confidence
  FROM r JOIN size USING (domain) WHERE subject IS NOT NULL GROUP BY r.domain, keyword, subject""", "confidence")
register("agent_models", MEM, p.agent_models, f"""{W}, {TRIG.format(s=STRIPPED, ws=sql_in(lex.BELIEF_VERBS))} SELECT t[p - 1] AS agent, count(*) AS statements, avg(importance) AS mean_importance FROM kw WHERE p > 1 AND length(t[p - 1]) >= 3 GROUP BY 1""", "mean_importance")
register("skill_distillation", MEM, p.distil_skills, f"""{W}, {TRIG.format(s=STRIPPED, ws=sql_in(lex.ACTIONS))}, {SIZE}, u AS (SELECT DISTINCT domain, keyword, id, strength FROM kw)
  SELECT domain, keyword AS action, count(*) AS docs, 0.6 * count(*) / any_value(n) + 0.4 * avg(strength) AS confidence FROM u JOIN size USING (domain) GROUP BY domain, keyword HAVING count(*) >= 2""", "confidence")
register("principle_abstraction", MEM, p.abstract_principles, f"""{W}, {DOCTOK}, {SIZE} SELECT domain, tok AS principle, count(*) AS docs, count(*) / any_value(n)::DOUBLE AS generality, avg(strength) AS mean_strength
  FROM doctok JOIN size USING (domain) GROUP BY domain, tok HAVING count(*) >= 2 AND generality >= 0.3""", "generality mean_strength")
register("novelty_assessment", MEM, p.assess_novelty, f"""{W}, {OCC}, d AS (SELECT tok, count(DISTINCT id) AS d FROM occ GROUP BY tok)
  SELECT id, avg((d < (SELECT greatest(2, floor(count(*) * 0.1)) FROM mem))::INT) AS novelty FROM occ JOIN d USING (tok) GROUP BY id""", "novelty")
register("domain_predictions", MEM, lambda d: p.predictions(d, 0.01), f"""{W}, {OCC}, g AS (SELECT domain, tok, count(*) AS c FROM occ GROUP BY domain, tok), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY c DESC, tok) AS r, sum(c) OVER (PARTITION BY domain) AS total FROM g)
  SELECT domain, tok, c / total AS share, least(1.0, 2 * c / total) AS confidence FROM r WHERE r <= 2 AND c / total >= 0.01""", "share confidence")
register("counterfactuals", MEM, p.counterfactuals, f"""{W}, f AS (SELECT *, 0.8 * greatest(0.0, least(1.0, strength)) AS plausibility FROM mem WHERE 0.8 * greatest(0.0, least(1.0, strength)) >= 0.2)
  (SELECT id, 'upward' AS direction, greatest(-1.0, least(1.0, valence + 0.4)) AS valence, plausibility FROM f WHERE f.valence < 0.1 ORDER BY store_seq LIMIT 10) UNION ALL
  (SELECT id, 'downward', greatest(-1.0, least(1.0, valence - 0.4)), plausibility FROM f WHERE f.valence > -0.1 ORDER BY store_seq LIMIT 10)""", "valence plausibility")
register("curiosity_scan", MEM, p.curiosity, f"""{W}, g AS (SELECT domain, count(*) AS n, avg({CONF}) AS c FROM mem GROUP BY domain), r AS (SELECT domain, CASE WHEN n = 1 THEN 'novel' WHEN n <= 3 THEN 'sparse' WHEN c < 0.4 THEN 'uncertain' END AS reason,
  CASE WHEN n = 1 THEN 0.75 WHEN n <= 3 THEN 0.5 + 0.1 * (3 - n) ELSE 1 - c END AS urgency FROM g) SELECT * FROM r WHERE reason IS NOT NULL ORDER BY urgency DESC, domain LIMIT 10""", "urgency")
_lead = ", ".join(f"lead(domain, {k}) OVER w AS d{k}" for k in range(1, 5))
_runs = " UNION ALL ".join("SELECT " + " || '>' || ".join(["d0", *[f"d{k}" for k in range(1, n)]]) + " AS sequence FROM o" for n in range(2, 6))
register("sequence_patterns", MEM, p.sequence_patterns, f"""{W}, o AS (SELECT domain AS d0, {", ".join(f"lead(domain, {k}) OVER (ORDER BY store_seq) AS d{k}" for k in range(1, 5))} FROM mem),
  r AS ({_runs}) SELECT sequence, count(*) AS n FROM r WHERE sequence IS NOT NULL GROUP BY sequence HAVING count(*) >= 2 ORDER BY n DESC, sequence LIMIT 10""")
register("domain_sequences", MEM, p.domain_sequences, f"""{W}, s AS (SELECT domain AS d0, {_lead} FROM mem WINDOW w AS (PARTITION BY namespace ORDER BY store_seq)),
  g AS (SELECT d0 || '>' || d1 AS sequence FROM s UNION ALL SELECT d0 || '>' || d1 || '>' || d2 FROM s UNION ALL SELECT d0 || '>' || d1 || '>' || d2 || '>' || d3 FROM s UNION ALL SELECT d0 || '>' || d1 || '>' || d2 || '>' || d3 || '>' || d4 FROM s)
  SELECT sequence, count(*) AS n FROM g WHERE sequence IS NOT NULL GROUP BY sequence HAVING count(*) >= 2 ORDER BY n DESC, sequence LIMIT 10""")
register("content_patterns", MEM, p.content_patterns, f"""{W}, t AS (SELECT unnest(regexp_extract_all(regexp_replace(lower(content), '[^\\x00-\\x7F]', '_', 'g'), '\\b[a-z]{{3,}}\\b')) AS tok FROM mem) SELECT tok, count(*) AS n FROM t WHERE tok NOT IN ({", ".join(repr(x) for x in tx.STOP)}) GROUP BY tok HAVING count(*) >= 3 ORDER BY n DESC, tok LIMIT 20""")
register("domain_trends", MEM, p.domain_trends, f"{W} SELECT domain, count(*) AS n, count(*) / (SELECT count(*) FROM mem)::DOUBLE AS share, CASE WHEN count(*) % 2 = 1 THEN 'growing' ELSE 'stable' END AS trend FROM mem GROUP BY domain", "share")
register("epistemic_growth", MEM, p.concept_growth, f"""{W}, h AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY stored_at, store_seq) > floor(count(*) OVER (PARTITION BY domain) / 2) AS late FROM mem),
  v AS (SELECT domain, late::INT AS late, unnest(list_distinct({KEYWORDS})) AS tok FROM h), u AS (SELECT domain, tok, max(late) AS l, max(1 - late) AS e FROM v GROUP BY domain, tok)
  SELECT domain, (sum(l * (1 - e)) - sum(e * (1 - l))) / count(*) AS growth, sum(l * e) / count(*) AS consolidation FROM u GROUP BY domain""", "growth consolidation")
