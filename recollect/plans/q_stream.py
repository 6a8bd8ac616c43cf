"""Ingest, parsing, scalar rules and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import lexicons as lex
from recollect.functions import text as tx
from recollect.operators import pairs, rules
from recollect.plans.registry import register
from recollect.schema import AS_OF, EV_SQL, MEM_SQL, documents_as_memories, events_as_memories, table
from recollect.sources import files

MEM, EV = documents_as_memories, events_as_memories
W, E = f"WITH {MEM_SQL}", f"WITH {EV_SQL}"
WORDS = tx.SQL_WORDS.format(c="content")
STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOP) + ")"
STRIPPED = tx.SQL_STRIPPED.format(c="content")


def neighbours(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return b.select(F.col("item_id").alias("a"), F.col("text").alias("ta")).join(b.select((F.col("item_id") - 1).alias("a"), F.col("text").alias("tb")), "a")


_bw = lambda c: f"list_distinct({tx.SQL_WORDS.format(c=c)})"
_tri = lambda c: f"list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substring(lower({c}), i, 3)))"
_jac = lambda x, y: f"len(list_intersect({x}, {y})) / greatest(len(list_distinct(list_concat({x}, {y}))), 1)::DOUBLE"
register("content_similarity", neighbours, lambda d: d.select("a", rules.content_similarity(F.col("ta"), F.col("tb")).alias("sim")),
         f"WITH p AS (SELECT x.item_id AS a, x.text AS ta, y.text AS tb FROM benchmark x JOIN benchmark y ON y.item_id - 1 = x.item_id) SELECT a, 0.6 * {_jac(_bw('ta'), _bw('tb'))} + 0.4 * {_jac(_tri('ta'), _tri('tb'))} AS sim FROM p", "sim")
register("keyword_extraction", MEM, rules.top_keywords, f"""{W}, l AS (SELECT id, regexp_extract_all(lower(content), '[a-z]{{3,}}') AS t FROM mem), p AS (SELECT id, unnest(t) AS tok, generate_subscripts(t, 1) AS p FROM l),
  g AS (SELECT id, tok, count(*) AS n, min(p) AS f FROM p WHERE tok NOT IN {STOP} GROUP BY id, tok), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, f)::INT AS rank FROM g) SELECT id, tok, n, rank FROM r WHERE rank <= 15""")
register("quality_filter", MEM, rules.quality_filter, f"{W}, t AS (SELECT id, length(content) AS c, {WORDS} AS w FROM mem) SELECT id FROM t WHERE c >= 20 AND len(w) >= 5 AND len(list_distinct(w)) >= 0.3 * len(w)")
register("content_fingerprint", MEM, lambda d: d.select("id", rules.fingerprint(F.col("content")).alias("fp")),
         f"{W} SELECT id, md5(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda x: x <> '')))[1:20], ' ')) AS fp FROM mem")
_key = "(" + ", ".join(f"'{w}'" for w in lex.words(lex.PRESCRIPTIVE + " " + lex.CAUSAL + " " + lex.ACTIONS)) + ")"
register("importance_classifier", MEM, rules.importance_score, f"""{W}, t AS (SELECT *, {STRIPPED} AS w, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') AS raw FROM mem), n AS (SELECT *, greatest(len(w), 1) AS n FROM t)
  SELECT id, 0.2 * least(1.0, len(list_filter(raw, lambda x: regexp_matches(x, '^[A-Z]'))) / n::DOUBLE * 3) + 0.2 * novelty + 0.15 * least(1.0, abs(valence) + 0.5 * intensity) + 0.1 * least(1.0, n / 50.0) + 0.2 * least(1.0, len(list_filter(w, lambda x: x IN {_key})) / 3.0)
    + 0.15 * ((CASE WHEN contains(content, chr(10)) THEN 0.5 ELSE 0 END) + (CASE WHEN regexp_matches(content, '[0-9]') THEN 0.5 ELSE 0 END)) AS importance FROM n""", "importance")
register("elapsed_feel", EV, lambda d: d.select("id", rules.elapsed_feel(1706659200.0 - F.col("stored_at")).alias("feel")), f"""{E}, s AS (SELECT id, 1706659200.0 - stored_at AS s FROM ev) SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 600 THEN 'a few minutes ago' WHEN s < 3600 THEN 'within the hour' WHEN s < 21600 THEN 'earlier today'
  WHEN s < 86400 THEN 'today' WHEN s < 172800 THEN 'yesterday' WHEN s < 604800 THEN 'this week' WHEN s < 2592000 THEN 'this month' WHEN s < 31536000 THEN 'this year' ELSE 'long ago' END AS feel FROM s""")
register("token_estimates", MEM, lambda d: d.select("id", tx.token_estimate(F.col("content")).alias("by_words"), F.floor(F.length("content") / 4).alias("by_chars")), f"{W} SELECT id, floor(len({WORDS}) * 1.3)::INT AS by_words, length(content) // 4 AS by_chars FROM mem")
register("props_parsing", lambda s, d: table(s, d, "events"), rules.parse_props, "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
register("rest_parsing", lambda s, d: table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.to_json(F.struct(F.array(F.struct(F.col("text").alias("description"), F.lit("t").alias("title")), F.struct(F.lit(None).cast("string").alias("description"), F.concat(F.lit("title "), "item_id").alias("title"))).alias("items"))).alias("body")), rules.api_records,
         "SELECT item_id AS id, 0 AS pos, text AS content FROM benchmark UNION ALL SELECT item_id, 1, 'title ' || item_id FROM benchmark")
register("feed_parsing", lambda s, d: table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("<rss><channel><item><title>T"), F.col("item_id"), F.lit("</title><description><![CDATA["), "text", F.lit("]]></description></item><item><title></title></item></channel></rss>")).alias("body")), rules.feed_records,
         "SELECT item_id AS id, 0 AS pos, 'T' || item_id || '. ' || trim(text) AS content FROM benchmark")
register("tool_observer", lambda s, d: table(s, d, "events").select(F.col("event_id").alias("id"), F.element_at(F.array(*map(F.lit, ("Edit", "Read", "Bash", "Fetch"))), (F.col("event_id") % 4 + 1).cast("int")).alias("tool_name"),
                                                               F.create_map(F.lit("file_path"), F.concat(F.lit("/src/f"), F.col("user_id"))).alias("tool_input"), F.when(F.col("event_type") == "error", "Error: x").otherwise("ok").alias("tool_response")), lambda d: rules.observe_tools(d).drop("files"),
         """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'change' WHEN 1 THEN 'discovery' WHEN 2 THEN 'command' ELSE 'observation' END AS obs_type, ['Edit', 'Read', 'Bash', 'Fetch'][event_id % 4 + 1] || ' /src/f' || user_id AS title,
  (CASE WHEN event_type = 'error' THEN 0.8 WHEN event_id % 4 = 0 THEN 0.7 WHEN event_id % 4 = 2 THEN 0.5 ELSE 0.3 END)::DOUBLE AS importance FROM events""", "importance")
register("reasoning_verifier", lambda s, d: table(s, d, "conversations").selectExpr("conv_id AS chain", "turn AS step", "text"), rules.verify_steps, f"""WITH t AS (SELECT conv_id AS chain, turn AS step, list_distinct({tx.SQL_STRIPPED.format(c='text')}) AS t FROM conversations), l AS (SELECT *, lag(t) OVER (PARTITION BY chain ORDER BY step) AS p FROM t),
  o AS (SELECT *, {_jac('t', 'p')} AS o FROM l) SELECT chain, step, 'circular' AS issue FROM o WHERE p IS NOT NULL AND o > 0.8 UNION ALL SELECT chain, step, 'non_sequitur' FROM o WHERE p IS NOT NULL AND o < 0.05
  UNION ALL SELECT chain, step, 'absolute' FROM o WHERE list_has_any(t, ['always', 'never', 'all', 'none', 'every', 'impossible', 'certainly', 'obviously'])""")
register("hash_embedding", lambda s, d: table(s, d, "benchmark"), lambda d: d.select("item_id", F.posexplode(rules.hash_embedding()(F.col("text"))).alias("dim", "value")))
register("temporal_awareness", MEM, rules.temporal_awareness, f"""{W} SELECT avg(CASE WHEN regexp_matches(lower(content), '\\b(yesterday|tomorrow|before|after|since|ago|version|license)\\b') THEN 1 WHEN regexp_matches(lower(content), '\\b(always|never|forever)\\b') THEN -1 ELSE 0 END) AS awareness, count(*) AS n FROM mem""", "awareness")
register("financial_valence", EV, lambda d: rules.financial_valence(d.select("id", (F.col("value") - 60).alias("pnl"))), f"""{E}, p AS (SELECT id, value - 60 AS pnl FROM ev) SELECT id, greatest(-1.0, least(1.0, pnl / 100)) AS valence, 0.5 + 0.4 * tanh(abs(pnl) / 50) AS importance,
  CASE WHEN abs(pnl) < 10 THEN 'calm' WHEN abs(pnl) < 30 THEN 'mild' WHEN abs(pnl) < 60 THEN 'active' WHEN abs(pnl) < 120 THEN 'high' ELSE 'extreme' END AS band FROM p""", "valence importance")
register("prediction_calibration", EV, lambda d: rules.calibration(d.select("domain", F.col("importance").alias("confidence"), (F.col("value") > 50).cast("int").alias("outcome"))), f"""{E}, p AS (SELECT domain, importance AS c, (value > 50)::INT AS o FROM ev)
  SELECT domain, avg((c - o) * (c - o)) AS brier, avg(c - o) AS bias, avg(((c >= 0.5)::INT = o)::INT) AS accuracy, count(*) AS n FROM p GROUP BY domain""", "brier bias accuracy")
register("task_queue", MEM, lambda d: rules.task_queue(d.select("id", "importance", "novelty", (F.col("id") % 72).alias("deadline_hours"), ((F.lit(AS_OF) - F.col("last_accessed")) / 3600).alias("idle_hours"))), f"""{W} SELECT id, 0.3 / (1 + exp((id % 72 - 24) / 8.0)) + 0.3 * importance + 0.25 * novelty + 0.15 * least(1.0, ({AS_OF} - last_accessed) / 3600 / 48) AS priority FROM mem ORDER BY priority DESC, id LIMIT 20""", "priority")
register("markdown_export", MEM, files.markdown, f"""{W} SELECT DISTINCT domain, '## ' || domain AS line FROM mem UNION ALL SELECT domain, '- ' || replace(substring(content, 1, 500), chr(10), ' ') FROM mem WHERE NOT private""")
register("dot_export", EV, lambda d: files.dot(pairs.association_edges(d), 20), f"""{E}, ed AS (SELECT x.id AS a, y.id AS b, 1 - (y.stored_at - x.stored_at) / 300.0 AS weight FROM ev x JOIN ev y ON x.domain = y.domain AND (y.stored_at > x.stored_at OR (y.stored_at = x.stored_at AND x.id < y.id)) AND y.stored_at - x.stored_at < 300)
  SELECT printf('  "%d" -> "%d" [weight=%.3f];', a, b, weight) AS line FROM ed ORDER BY weight DESC, a, b LIMIT 20""")
