"""Duplicates, summaries, episodes, features and checks as specified."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import lexicons as lex
from recollect.functions import text as tx
from recollect.operators import condense as c
from recollect.operators import talk
from recollect.plans.q_retrieval import WORDS
from recollect.plans.registry import register
from recollect.schema import MEM_SQL, REC_SQL, documents_as_memories, documents_as_records, events_as_reports, table

MEM, REC, REPORTS = documents_as_memories, documents_as_records, events_as_reports
W, R = f"WITH {MEM_SQL}", f"WITH {MEM_SQL}, {REC_SQL}"
TALK = lambda s, d: table(s, d, "conversations")
_set = lambda e: f"list_distinct({tx.SQL_WORDS.format(c=e)})"
_tri = lambda e: f"list_distinct(list_transform(range(1, length({e}) - 1), lambda i: substring(lower({e}), i, 3)))"
_jac = lambda x, y: f"(CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))::DOUBLE END)"


def sql_similar(least: float, source: str = "mem") -> str:
    """Pairs by shared words, then by the whole measure: the plain way."""
    floor = (least - 0.4) / 0.6
    return f"""sw AS (SELECT id, content, {_set('content')} AS t FROM {source}), sk AS (SELECT id, len(t) AS n, unnest(t) AS tok FROM sw), sc AS (SELECT a.id AS a, b.id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM sk a JOIN sk b ON a.tok = b.tok AND a.id < b.id GROUP BY a.id, b.id),
  sp AS (SELECT a, b, 0.6 * k / (na + nb - k)::DOUBLE + 0.4 * {_jac(_tri('x.content'), _tri('y.content'))} AS sim FROM sc JOIN sw x ON x.id = a JOIN sw y ON y.id = b WHERE k / (na + nb - k)::DOUBLE >= {floor} - 1e-9), pr AS (SELECT * FROM sp WHERE sim >= {least} - 1e-12)"""


register("similar_contents", MEM, lambda d: c.similar_contents(d, 0.7), f"{W}, {sql_similar(0.7)} SELECT a, b, sim FROM pr", "sim")
# record after record in SQL: who is free leads and takes its later free neighbours
GREEDY = """lk AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM al), nb AS (SELECT a, list(b) AS bs FROM lk GROUP BY a), oo AS (SELECT m.id, row_number() OVER (ORDER BY m.store_seq) AS n, coalesce(bs, []) AS bs FROM mem m LEFT JOIN nb ON nb.a = m.id),
  gd AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS ids, []::BIGINT[] AS leads UNION ALL SELECT oo.n, CASE WHEN list_contains(ids, oo.id) THEN ids ELSE list_concat(ids, [oo.id], list_filter(bs, lambda x: NOT list_contains(ids, x))) END,
    CASE WHEN list_contains(ids, oo.id) THEN leads ELSE list_concat(leads, [oo.id], list_transform(list_filter(bs, lambda x: NOT list_contains(ids, x)), lambda x: oo.id)) END FROM gd JOIN oo ON oo.n = gd.n + 1),
  gg AS (SELECT unnest(ids) AS id, unnest(leads) AS leader FROM gd WHERE n = (SELECT max(n) FROM oo))"""
_alike = f"{sql_similar(0.85)}, vp AS (SELECT x.id AS a, y.id AS b FROM rec x JOIN rec y ON x.id < y.id WHERE list_cosine_similarity(x.embedding, y.embedding) >= 0.92), al AS (SELECT a, b FROM pr UNION SELECT a, b FROM vp), {GREEDY}"
RG = f"WITH RECURSIVE {MEM_SQL}, {REC_SQL}"
register("duplicate_groups", REC, c.duplicate_groups, f"{RG}, {_alike} SELECT id, leader FROM gg")
register("duplicates_resolved", REC, lambda d: c.resolve_groups(d, c.duplicate_groups(d)), f"""{RG}, {_alike}, v AS (SELECT gg.leader, m.id, m.superseded_by, row_number() OVER (PARTITION BY leader ORDER BY round(0.6 * importance + 0.4 * least(1.0, access_count / 10.0), 9) DESC, store_seq, m.id) AS r FROM gg JOIN mem m ON m.id = gg.id)
  SELECT v.id, w.id AS superseded_by FROM v JOIN v w ON w.leader = v.leader AND w.r = 1 WHERE v.r > 1 AND v.superseded_by IS NULL""")
_parts = "list_filter(list_transform(string_split(regexp_replace(trim(content), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
SUMMARY = f"""sn AS (SELECT id, trim(content) AS whole, {_parts} AS ss, greatest(1, len({_set('content')})) AS n FROM mem), so AS (SELECT id, n, len(ss) AS k, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM sn),
  sx AS (SELECT *, round(0.4 * len({_set('s')}) / n + 0.3 * CASE WHEN i = 0 THEN 1.0 WHEN i = k - 1 THEN 0.8 ELSE 0.5 END + 0.3 * least(1.0, len({_set('s')}) / 15.0), 9) AS score, len({tx.SQL_WORDS.format(c='s')}) AS words FROM so),
  sy AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, i DESC) AS r, sum(words) OVER (PARTITION BY id ORDER BY score DESC, i DESC ROWS UNBOUNDED PRECEDING) AS total FROM sx),
  sz AS (SELECT id, string_agg(s, ' ' ORDER BY i) AS joined FROM sy WHERE r = 1 OR total <= 50 GROUP BY id), su AS (SELECT id, CASE WHEN len(ss) <= 1 THEN whole ELSE joined END AS summary FROM sn LEFT JOIN sz USING (id))"""
FIDELITY = f"CASE WHEN len({_set('content')}) = 0 THEN 1.0 ELSE least(1.0, 0.7 * len(list_intersect({_set('content')}, {_set('summary')})) / len({_set('content')}) + 0.3 * least(1.0, length(summary) / greatest(length(content) * 0.3, 1.0))) END"
register("summaries", MEM, c.summaries, f"{W}, {SUMMARY} SELECT * FROM su")
register("compressed", MEM, c.compress, f"{W}, {SUMMARY} SELECT id, domain, importance, summary, length(content) / greatest(length(summary), 1)::DOUBLE AS ratio, {FIDELITY} AS fidelity FROM mem JOIN su USING (id)", "importance ratio fidelity")
register("compressed_batch", MEM, lambda d: c.compress_batch(d, c.greedy_groups(d, c.similar_contents(d, 0.85))), f"""WITH RECURSIVE {MEM_SQL}, {SUMMARY}, {sql_similar(0.85)}, al AS (SELECT a, b FROM pr), {GREEDY},
  hd AS (SELECT leader, first(m.id ORDER BY importance DESC, store_seq, m.id) AS id, count(*) AS sources, sum(length(content)) AS chars FROM gg JOIN mem m ON m.id = gg.id GROUP BY leader)
  SELECT id, sources, importance, summary, chars / greatest(length(summary), 1)::DOUBLE AS ratio, {FIDELITY} AS fidelity FROM hd JOIN mem USING (id) JOIN su USING (id)""", "importance ratio fidelity")
register("expanded", MEM, lambda d: c.expand(c.compress(d), d.filter("tier = 'working'")), f"{W}, {SUMMARY} SELECT id, CASE WHEN tier = 'working' THEN content ELSE summary END AS content FROM mem JOIN su USING (id)")
register("consolidated", MEM, c.consolidate, f"""WITH RECURSIVE {MEM_SQL}, {SUMMARY}, {sql_similar(0.7)}, reach AS (SELECT id AS x, id AS y FROM mem UNION SELECT r.x, CASE WHEN r.y = p.a THEN p.b ELSE p.a END FROM reach r JOIN pr p ON r.y IN (p.a, p.b)), comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x),
  g AS (SELECT component, first(id ORDER BY importance DESC, store_seq) AS id, count(*) AS members, greatest(0.8, max(importance)) AS importance, avg(valence) AS valence FROM mem JOIN comp USING (id) GROUP BY component HAVING count(*) >= 2) SELECT component, members, importance, valence, summary FROM g JOIN su USING (id)""", "importance valence")
register("episode_segments", REC, c.episode_segments, f"""{R}, t AS (SELECT session_id, id, store_seq, stored_at, domain, valence, {_set('content')} AS t FROM rec), l AS (SELECT *, lag(t) OVER w AS p, lag(domain) OVER w AS pd, lag(stored_at) OVER w AS pt FROM t WINDOW w AS (PARTITION BY session_id ORDER BY stored_at, store_seq)),
  n AS (SELECT *, CASE WHEN pt IS NULL OR 0.5 * {_jac('t', 'p')} + 0.2 * CASE WHEN domain = pd THEN 1.0 ELSE 0.3 END + 0.3 * exp(-0.693 * (stored_at - pt) / 300.0) < 0.3 THEN 1 ELSE 0 END AS new FROM l), e AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY stored_at, store_seq ROWS UNBOUNDED PRECEDING) AS episode FROM n)
  SELECT session_id, episode::BIGINT AS episode, count(*) AS records, min(stored_at) AS opened_at, max(stored_at) AS closed_at, avg(valence) AS mean_valence, first(valence ORDER BY abs(valence) DESC, store_seq) AS peak_valence FROM e GROUP BY session_id, episode""", "opened_at closed_at mean_valence peak_valence")
_stakes = "[" + ", ".join(f"'{w}'" for w in lex.words(lex.HIGH_STAKES)) + "]"
_raw = "list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')"
_sig = f"""s AS (SELECT id, novelty, {_raw} AS raw, CASE WHEN title IS NOT NULL THEN 0.4 ELSE 0 END + least(0.4, 0.1 * len(facts)) AS structure, least(1.0, 0.5 * abs(valence) + 0.5 * intensity) AS emotional, least(1.0, len(list_intersect(list_distinct(regexp_extract_all(lower(content), '[a-z]+')), {_stakes})) / 3.0) AS keyword FROM rec),
  v AS (SELECT id, (CASE WHEN len(raw) = 0 THEN 0 ELSE least(1.0, len(list_filter(raw, lambda x: regexp_matches(x, '^\\p{{Lu}}') AND length(x) > 2)) / greatest(len(raw) * 0.3, 1.0)) END)::DOUBLE AS entity, novelty, emotional::DOUBLE AS emotional, least(1.0, len(raw) / 200.0)::DOUBLE AS length, keyword::DOUBLE AS keyword, least(1.0, structure)::DOUBLE AS structure FROM s)"""
register("importance_signals", REC, c.importance_signals, f"{R}, {_sig} SELECT *, 0.2 * entity + 0.2 * novelty + 0.15 * emotional + 0.1 * length + 0.2 * keyword + 0.15 * structure AS total FROM v", "entity novelty emotional length keyword structure total")
_h, _belief = "the thing that tion never was in ther", "the thing that tion was in other ther"
_steps = lambda s, d: table(s, d, "conversations").selectExpr("conv_id AS chain", "turn AS step", "text")
_in = lambda ws: "[" + ", ".join(f"'{w}'" for w in sorted(set(ws))) + "]"
_known = lambda s, d: table(s, d, "benchmark").select(F.col("text").alias("content"))


def checked(spark, sf_dir):
    return c.verify_chain(_steps(spark, sf_dir), _h, _known(spark, sf_dir), [_belief, "other"], against=True)


register("reasoning_checks", checked, lambda d: d, f"""WITH t AS (SELECT conv_id AS chain, turn AS step, {_set('text')} AS t FROM conversations), l AS (SELECT *, lag(t) OVER (PARTITION BY chain ORDER BY step) AS p FROM t), k AS (SELECT DISTINCT unnest({_set('text')}) AS w FROM benchmark),
  u AS (SELECT chain, step, avg((w IN (SELECT w FROM k))::INT) AS share FROM (SELECT chain, step, unnest(t) AS w FROM t WHERE len(t) > 5) GROUP BY chain, step)
  SELECT chain, 'step ' || step AS place, 'unsupported_premise' AS issue FROM u WHERE share < 0.2 UNION ALL SELECT chain, 'step ' || step, 'circular' FROM t WHERE len(list_intersect(t, {_in(_h.split())})) > 0.8 * {len(set(_h.split()))}
  UNION ALL SELECT chain, 'step ' || step, 'non_sequitur' FROM l WHERE len(p) >= 4 AND len(t) >= 4 AND {_jac('t', 'p')} < 0.05 UNION ALL SELECT chain, 'step ' || step, 'overgeneralization' FROM t WHERE list_has_any(t, {_in(lex.words(lex.ABSOLUTES))})
  UNION ALL SELECT DISTINCT chain, 'hypothesis', 'overgeneralization' FROM t UNION ALL SELECT DISTINCT chain, 'hypothesis', 'contradiction' FROM t
  UNION ALL SELECT DISTINCT chain, 'chain', 'ignored_counterevidence' FROM t WHERE chain NOT IN (SELECT chain FROM t WHERE list_has_any(t, {_in(lex.words(lex.HEDGES))}))""")
_strip = "trim(w, '.,!?;:\"''()')"
_rel = _in(lex.words(lex.RELATIONAL))
register("structural_analogies", MEM, lambda d: c.structural_analogies(d, least=0.02), f"""{W}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY store_seq) AS r FROM mem) WHERE r <= 10),
  t AS (SELECT id, domain, list_distinct(list_filter(list_transform({WORDS}, lambda w: {_strip}), lambda w: list_contains({_rel}, w))) AS rel, list_distinct(list_transform(list_filter({WORDS}, lambda w: length(w) >= 4 AND NOT list_contains({_in(lex.words(lex.ANALOGY_STOP))}, w) AND NOT list_contains({_rel}, w)), lambda w: {_strip})) AS con FROM f),
  p AS (SELECT x.domain AS domain_a, y.domain AS domain_b, x.id AS a, y.id AS b, round(0.7 * {_jac('x.rel', 'y.rel')} + 0.3 * {_jac('x.con', 'y.con')}, 5) AS sim, array_to_string(list_sort(list_intersect(x.rel, y.rel)), ' ') AS shared FROM t x JOIN t y ON x.domain < y.domain),
  q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain_a, domain_b ORDER BY sim DESC, a, b) AS r FROM p WHERE sim >= 0.02) WHERE r <= 3), b AS (SELECT domain_a, domain_b, round(avg(sim), 4) AS strength FROM q GROUP BY ALL ORDER BY strength DESC, domain_a, domain_b LIMIT 6)
  SELECT domain_a, domain_b, a, b, sim, shared, strength FROM q JOIN b USING (domain_a, domain_b)""", "sim strength")
register("buffer_chunks", TALK, lambda d: c.buffer_chunks(d, 3, 1).select("conv_id", "turn", "chunk"), """SELECT conv_id, turn, CASE WHEN i < greatest(0, n - 3) THEN i::INT END AS chunk FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
# documents as the turns of one long talk a source
LONG_TALK = lambda s, d: table(s, d, "documents").selectExpr("CAST(substring(source, 4) AS long) AS conv_id", "doc_id AS turn", "lang AS role", "text")
_long = """lt AS (SELECT substring(source, 4)::BIGINT AS conv_id, doc_id AS turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL),
  go AS (SELECT conv_id, turn, text, i::INT AS i, CASE WHEN i < greatest(0, ceil((n - 20) / 5.0)) * 5 THEN (i // 5)::INT END AS chunk FROM lt)"""
register("buffer_chunks_whole", LONG_TALK, lambda d: c.buffer_chunks(d.filter("conv_id IS NOT NULL")).select("conv_id", "turn", "chunk"), f"WITH {_long} SELECT conv_id, turn, chunk FROM go")
_stop = _in(lex.words(lex.TALK_STOP))
_pick = lambda k: "".join(f" AND len(list_intersect(x.w, k{j}.w)) <= 0.7 * len(list_distinct(list_concat(x.w, k{j}.w)))" for j in range(1, k))
_picks = ", ".join(f"k{k} AS (SELECT x.* FROM (SELECT x.conv_id, x.chunk, min(x.r) AS r FROM rk x " + "".join(f"JOIN k{j} ON k{j}.conv_id = x.conv_id AND k{j}.chunk = x.chunk " for j in range(1, k)) + (f"WHERE x.r > k{k - 1}.r{_pick(k)} " if k > 1 else "") + "GROUP BY x.conv_id, x.chunk) m JOIN rk x USING (conv_id, chunk, r))" for k in range(1, 5))
register("chunk_summaries", LONG_TALK, lambda d: talk.chunk_summaries(d.filter("conv_id IS NOT NULL")), f"""WITH {_long}, g AS (SELECT * FROM go WHERE chunk IS NOT NULL), sp AS (SELECT conv_id, chunk, min(i) AS first_turn, max(i) AS last_turn, string_agg(substring(text, 1, 80), ' ' ORDER BY i) AS starts FROM g GROUP BY ALL),
  wl AS (SELECT conv_id, chunk, i, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{4,}}')) AS t FROM g), we AS (SELECT conv_id, chunk, i, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM wl),
  wc AS (SELECT conv_id, chunk, w, count(*) AS n, min(i * 10000000 + p) AS said FROM we WHERE NOT list_contains({_stop}, w) GROUP BY ALL), kw AS (SELECT conv_id, chunk, list(w) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, chunk ORDER BY n DESC, said) AS r FROM wc) WHERE r <= 20 GROUP BY ALL),
  sl AS (SELECT conv_id, chunk, i, {_parts.replace('content', 'text')} AS ss FROM g), se AS (SELECT conv_id, chunk, i, unnest(ss) AS s, generate_subscripts(ss, 1) AS j FROM sl),
  sw AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}'))) AS w FROM se WHERE length(s) > 10), so AS (SELECT *, list_filter(w, lambda x: NOT list_contains({_stop}, x)) AS own FROM sw),
  sc AS (SELECT o.*, round(CASE WHEN len(own) = 0 THEN 0 ELSE (len(list_intersect(own, coalesce(keys, []))) + least(1.0, len(own) / 15::DOUBLE)) / (1 + len(own) / 30::DOUBLE) END, 9) AS score FROM so o LEFT JOIN kw USING (conv_id, chunk)),
  rk AS (SELECT conv_id, chunk, i, j, s, w, row_number() OVER (PARTITION BY conv_id, chunk ORDER BY score DESC, i, j) AS r FROM sc), {_picks}, al AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4),
  jn AS (SELECT conv_id, chunk, string_agg(s, ' ' ORDER BY i, j) AS best FROM al GROUP BY ALL) SELECT conv_id, chunk, first_turn, last_turn, coalesce(best, starts) AS summary FROM sp LEFT JOIN jn USING (conv_id, chunk)""")
STRATEGIES = lambda s, d: table(s, d, "supplier").selectExpr("CAST(s_nationkey AS string) AS domain", "s_name AS name", "concat('p', s_suppkey % 5) AS prefix", "concat('t', s_suppkey % 7) AS template", "1.0D + s_suppkey % 4 AS alpha", "1.0D + s_suppkey % 3 AS beta", "CAST(s_suppkey % 11 AS long) AS pulls")
_strategies = "st AS (SELECT s_nationkey::VARCHAR AS domain, s_name AS name, 'p' || s_suppkey % 5 AS prefix, 't' || s_suppkey % 7 AS template, 1.0::DOUBLE + s_suppkey % 4 AS alpha, 1.0::DOUBLE + s_suppkey % 3 AS beta, s_suppkey % 11 AS pulls FROM supplier)"


def outcomes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    met = lines.join(table(spark, sf_dir, "supplier"), lines.l_suppkey == F.col("s_suppkey"))
    return STRATEGIES(spark, sf_dir), met.selectExpr("CAST(s_nationkey AS string) AS domain", "s_name AS name", "CASE l_returnflag WHEN 'R' THEN 0.0D WHEN 'A' THEN 0.5D ELSE 1.0D END AS reward")


register("strategy_outcomes", outcomes, lambda d: talk.by_outcome(*d), f"""WITH {_strategies}, o AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem), g AS (SELECT s_name AS name, sum(CASE l_returnflag WHEN 'R' THEN 0.0 WHEN 'A' THEN 0.5 ELSE 1.0 END)::DOUBLE AS won, count(*) AS n FROM o JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_name)
  SELECT domain, st.name, prefix, template, alpha + coalesce(won, 0) AS alpha, beta + coalesce(n - won, 0) AS beta, (pulls + coalesce(n, 0))::BIGINT AS pulls FROM st LEFT JOIN g USING (name)""", "alpha beta")
register("strategy_evolution", STRATEGIES, lambda d: talk.next_generation(d, 4), f"""WITH {_strategies}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY alpha / (alpha + beta) DESC, name) AS k, count(*) OVER (PARTITION BY domain) AS n FROM st),
  c AS (SELECT x.domain, x.name || '+' || y.name AS name, x.prefix, y.template, 1.0 AS alpha, 1.0 AS beta, 0 AS pulls FROM r x JOIN r y ON x.domain = y.domain AND x.k = 1 AND y.k = 2 WHERE x.n < 4),
  v AS (SELECT x.domain, x.name || '*' AS name, x.prefix, y.template, 1.0, 1.0, 0 FROM r x JOIN r y ON x.domain = y.domain AND y.k = 1 WHERE x.n >= 3 AND x.k = x.n // 2 + 1 AND x.pulls >= 3),
  e AS (SELECT domain, name, prefix, template, alpha, beta, pulls FROM st UNION ALL SELECT * FROM c UNION ALL SELECT * FROM v), o AS (SELECT *, count(*) OVER (PARTITION BY domain) - 4 AS over, row_number() OVER (PARTITION BY domain, pulls >= 5 ORDER BY alpha / (alpha + beta), name DESC) AS q FROM e)
  SELECT domain, name, prefix, template, alpha::DOUBLE AS alpha, beta::DOUBLE AS beta, pulls::BIGINT AS pulls FROM o WHERE NOT (pulls >= 5 AND q <= over)""", "alpha beta")
TOKENS = lambda s, d: table(s, d, "conversations").select(F.col("conv_id").alias("stream"), F.posexplode(F.split(F.regexp_replace("text", r"\s+", " "), " ")).alias("p", "token"), "turn").selectExpr("stream", "turn * 1000000L + p AS pos", "token").filter("token <> ''")
_toks = """k0 AS (SELECT conv_id AS stream, turn, unnest(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS token, generate_subscripts(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1) - 1 AS p FROM conversations), k1 AS (SELECT stream, turn * 1000000 + p AS pos, token FROM k0 WHERE token <> ''),
  k2 AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY stream) AS n, count(*) OVER (PARTITION BY stream, token) AS f FROM k1),
  k3 AS (SELECT stream, pos, token, n, 40 * (n - i) + n * (2 * least(10, length(token)) + CASE WHEN upper(token) = token AND lower(token) <> token THEN 18 WHEN regexp_matches(token, '^[0-9]+$') THEN 16 WHEN length(token) > 8 THEN 18 ELSE 10 END + 2 * least(10, f)) AS parts FROM k2),
  ev AS (SELECT *, ((parts * 2000000 + 100 * n) // (200 * n)) / 1e6 AS worth FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY parts, pos) AS r FROM k3) WHERE r <= n - 40)"""
register("evicted_tokens", TOKENS, lambda d: c.evicted_tokens(d, 40), f"WITH {_toks} SELECT stream, pos, token, worth FROM ev", "worth")
_match = lambda w: f"len(list_intersect(list_distinct(string_split(lower(token), '')), {_in(w)})) / greatest(length(token), {len(w)})::DOUBLE"
register("relevant_tokens", TOKENS, lambda d: c.relevant_tokens(c.evicted_tokens(d, 40), ["tion", "heather"]), f"""WITH {_toks}, m AS (SELECT *, CASE WHEN lower(token) IN ('tion', 'heather') THEN 1.0 ELSE greatest(0.0, {_match('tion')}, {_match('heather')}) END AS match FROM ev),
  q AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY match DESC, token DESC, pos) AS k FROM m WHERE match > 0.6) SELECT stream, pos, token, match FROM q WHERE k <= 200""", "match")
register("rolling_context", TALK, c.rolling_context, f"""WITH t AS (SELECT conv_id, turn, role, text, {tx.SQL_WORDS.format(c='text')} AS t FROM conversations) SELECT conv_id, turn, role, len(list_distinct(flatten(list(t) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS 5 PRECEDING))))::INT AS words FROM t""")
NOTES = lambda s, d: table(s, d, "events").selectExpr("event_id AS id", "event_id AS at", "CASE WHEN event_id % 3 = 0 THEN concat('cycle: Confirmed=', event_id % 7, ', violated=', event_id % 4, ', surprise') ELSE 'Confirmed=x' END AS content")
register("rolling_accuracy", NOTES, c.rolling_accuracy, """WITH n AS (SELECT event_id AS id FROM events ORDER BY event_id DESC LIMIT 20), g AS (SELECT sum(id % 7)::BIGINT AS confirmed, sum(id % 4)::BIGINT AS violated FROM n WHERE id % 3 = 0), a AS (SELECT *, confirmed / greatest(confirmed + violated, 1)::DOUBLE AS accuracy FROM g)
  SELECT *, CASE WHEN accuracy > 0.7 THEN 'calibrated' WHEN accuracy > 0.4 THEN 'adjusting' ELSE 'recalibrating' END AS state FROM a""", "accuracy")
register("belief_conflicts", REPORTS, c.belief_conflicts)
EXAMPLES = lambda s, d: table(s, d, "benchmark").selectExpr("item_id AS id", "CASE item_id % 3 WHEN 0 THEN 'tech' ELSE 'general' END AS domain", "text AS query", "(item_id % 10) / 10.0D AS quality")
register("few_shot", EXAMPLES, lambda d: c.few_shot(d, "the thing in tion", "tech", 5), f"""SELECT item_id AS id, 0.3 * len(list_intersect({_set('text')}, ['the', 'thing', 'in', 'tion'])) + 0.7 * (item_id % 10) / 10.0 AS score FROM benchmark WHERE item_id % 3 = 0 ORDER BY score DESC, id LIMIT 5""", "score")
register("cross_modal", MEM, lambda d: c.cross_modal(d, 7))
register("modality_features", MEM, lambda d: c.modalities(d).select("id", F.posexplode(F.concat("text", "emotional", "temporal", "visual")).alias("dim", "value")))
register("emotional_temporal_features", MEM, lambda d: c.modalities(d).select("id", *[F.col("emotional")[i].alias(f"e{i}") for i in range(4)], *[F.col("temporal")[i].alias(f"t{i}") for i in range(3)]), f"""{W}, x AS (SELECT *, make_timestamp((stored_at * 1000000)::BIGINT) AS ts FROM mem)
  SELECT id, (valence + 1) / 2 AS e0, intensity AS e1, importance AS e2, novelty AS e3, hour(ts) / 24.0 AS t0, ((isodow(ts) - 1) / 7.0)::DOUBLE AS t1, dayofyear(ts) / 366.0 AS t2 FROM x""", "e0 e1 e2 e3 t0 t1 t2")
