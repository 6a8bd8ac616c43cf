"""Timelines, sessions and runs over events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.operators import sequences as s
from recollect.plans.registry import register
from recollect.schema import EV_SQL, MEM_SQL, documents_as_memories, events_as_memories, table

EV, MEM = events_as_memories, documents_as_memories
E, W = f"WITH {EV_SQL}", f"WITH {MEM_SQL}"
SEG = f"""{E}, s AS (SELECT session_id, valence, ntile(5) OVER (PARTITION BY session_id ORDER BY stored_at, store_seq) AS segment FROM ev),
  g AS (SELECT session_id, segment::INT AS segment, avg(valence) AS mean_valence, stddev_pop(valence) AS spread FROM s GROUP BY ALL)"""

register("timeline_gaps", MEM, s.timeline_gaps, f"""{W}, g AS (SELECT domain, id, lead(id) OVER w AS next_id, lead(stored_at) OVER w - stored_at AS gap FROM mem WINDOW w AS (PARTITION BY domain ORDER BY stored_at, store_seq))
  SELECT * FROM g WHERE gap >= 300""", "gap")
register("timeline_density", EV, s.timeline_density, f"""{E}, b AS (SELECT min(stored_at) AS t0, greatest(1, ceil((max(stored_at) - min(stored_at)) / 3600))::BIGINT AS n FROM ev),
  k AS (SELECT t0, n, unnest(range(0, n)) AS bucket FROM b), c AS (SELECT least(floor((stored_at - t0) / 3600), n - 1)::BIGINT AS bucket, count(*) AS c FROM ev, b GROUP BY 1)
  SELECT k.bucket, t0 + k.bucket * 3600.0 AS start, coalesce(c, 0)::BIGINT AS n FROM k LEFT JOIN c USING (bucket)""", "start")
register("timeline_stats", EV, s.timeline_stats, f"{E} SELECT domain, count(*) AS n, min(stored_at) AS first_at, max(stored_at) AS last_at, avg(importance) AS mean_importance FROM ev GROUP BY domain", "first_at last_at mean_importance")
register("mood_trajectory", EV, s.mood_trajectory, f"""{SEG} SELECT *, CASE WHEN spread > 0.4 THEN 'volatile' WHEN mean_valence > 0.2 THEN 'positive' WHEN mean_valence < -0.2 THEN 'negative' ELSE 'neutral' END AS label FROM g""", "mean_valence spread")
register("mood_trend", EV, s.mood_trend, f"""{SEG}, r AS (SELECT session_id, regr_slope(mean_valence, segment) AS slope FROM g GROUP BY session_id)
  SELECT *, CASE WHEN slope > 0.05 THEN 'rising' WHEN slope < -0.05 THEN 'falling' ELSE 'stable' END AS trend FROM r""", "slope")
register("resilience_arcs", EV, s.resilience_arcs, f"""{E}, a AS (SELECT *, row_number() OVER w AS r, avg(valence) OVER (PARTITION BY session_id ORDER BY stored_at, store_seq ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS nx, valence < -0.2 AS bad
    FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY stored_at, store_seq)),
  b AS (SELECT *, r - row_number() OVER (PARTITION BY session_id, bad ORDER BY stored_at, store_seq) AS run FROM a),
  c AS (SELECT session_id, count(*) AS length, min(r)::INT AS start, avg(valence) AS depth, arg_max(nx, r) AS nx0, last(nx ORDER BY r) AS nx FROM b WHERE bad GROUP BY session_id, run HAVING count(*) >= 2)
  SELECT session_id, start, length, depth, nx - depth AS slope, coalesce(nx - depth > 0.2, false) AS recovered FROM c""", "depth slope")
register("narrative_threads", EV, s.narrative_threads, f"""{E}, a AS (SELECT *, floor((row_number() OVER (PARTITION BY domain ORDER BY stored_at, store_seq) - 1) / 5)::BIGINT AS chapter FROM ev)
  SELECT domain, chapter, count(*) AS n, min(stored_at) AS from_at, max(stored_at) AS to_at, avg(valence) AS mood, first(id ORDER BY importance DESC, store_seq) AS theme_id FROM a GROUP BY domain, chapter""", "from_at to_at mood")
register("presence", EV, s.presence, f"""{E}, a AS (SELECT *, row_number() OVER w AS t, avg(valence) OVER (PARTITION BY session_id ORDER BY stored_at, store_seq ROWS 4 PRECEDING) AS mood FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY stored_at, store_seq))
  SELECT session_id, id, 1 / (1 + pow(t / 20.0, 1.5)) AS presence, greatest(0.0, 1 - t / 50.0)::DOUBLE AS budget, mood FROM a""", "presence budget mood")
register("episode_boundaries", EV, s.episodes, f"""{E}, a AS (SELECT *, lag(domain) OVER w AS pd, lag(stored_at) OVER w AS pt FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY stored_at, store_seq)),
  b AS (SELECT *, coalesce((0.4 * (CASE WHEN domain = pd THEN 1.0 ELSE 0.3 END) + 0.6 * exp(-0.693 * (stored_at - pt) / 3600) < 0.5)::INT, 1) AS new FROM a),
  c AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY stored_at, store_seq)::BIGINT AS episode FROM b)
  SELECT session_id, episode, count(*) AS turns, min(stored_at) AS opened_at, max(stored_at) AS closed_at, avg(valence) AS mean_valence, first(valence ORDER BY abs(valence) DESC, store_seq) AS peak_valence FROM c GROUP BY session_id, episode""", "opened_at closed_at mean_valence peak_valence")
register("session_summary", EV, lambda d: s.session_summary(d).drop("types"), f"{E} SELECT session_id, count(*) AS n, min(stored_at) AS started_at, max(stored_at) AS ended_at, avg(valence) AS mean_valence FROM ev GROUP BY session_id", "started_at ended_at mean_valence")
register("open_threads", MEM, s.open_threads, f"""{W}, a AS (SELECT *, 0.35 * importance + 0.25 * novelty + 0.25 * strength + 0.15 * least(1.0, access_count / 5.0) AS score FROM mem WHERE importance >= 0.5),
  b AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY importance DESC, store_seq) AS r FROM a WHERE score < 0.5) SELECT namespace, id, importance, score FROM b WHERE r <= 5""", "importance score")
register("rolling_coherence", EV, s.rolling_coherence, f"""{E}, a AS (SELECT id, session_id, domain, floor(stored_at)::BIGINT AS t FROM ev)
  SELECT id, count(*) OVER (PARTITION BY session_id, domain ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)::DOUBLE AS coherence FROM a""", "coherence")
register("streaming_novelty", MEM, lambda d: s.streaming_novelty(d, tx.words(d["content"])), f"""{W}, t AS (SELECT id, namespace, store_seq, unnest(list_distinct({tx.SQL_WORDS.format(c='content')})) AS tok FROM mem),
  f AS (SELECT namespace, tok, min(store_seq) AS first FROM t GROUP BY ALL) SELECT id, avg((store_seq = first)::INT) AS novelty FROM t JOIN f USING (namespace, tok) GROUP BY id""", "novelty")
register("ema_affect", EV, s.ema_affect, f"""{E}, l AS (SELECT session_id, list(valence ORDER BY stored_at, store_seq) AS xs FROM ev GROUP BY session_id)
  SELECT session_id, list_reduce(list_concat([0.0::DOUBLE], xs), lambda v, x: 0.85 * v + 0.15 * x) AS valence, list_reduce(list_concat([0.3::DOUBLE], xs), lambda a, x: 0.9 * greatest(a, least(1.0, abs(x) * 1.5)) + 0.03) AS arousal FROM l""", "valence arousal")
_AFF = f"""WITH RECURSIVE {EV_SQL}, o AS (SELECT session_id, id, valence AS x, row_number() OVER (PARTITION BY session_id ORDER BY stored_at, store_seq) AS n FROM ev),
  w AS (SELECT session_id, id, n, greatest(-1.0, least(1.0, 0.15 * x))::DOUBLE AS valence, least(1.0, 0.9 * greatest(0.3, least(1.0, abs(x) * 1.5)) + 0.03)::DOUBLE AS arousal FROM o WHERE n = 1
    UNION ALL SELECT o.session_id, o.id, o.n, greatest(-1.0, least(1.0, 0.85 * w.valence + 0.15 * x)), least(1.0, 0.9 * greatest(w.arousal, least(1.0, abs(x) * 1.5)) + 0.03) FROM w JOIN o ON o.session_id = w.session_id AND o.n = w.n + 1)"""
# a billionth more, as first states lie on halves of the last place that is compared
register("affect_history", EV, lambda d: s.affect_history(d).withColumns({c: F.col(c) + 1e-9 for c in ("valence", "arousal")}), f"{_AFF} SELECT session_id, id, valence + 1e-9 AS valence, arousal + 1e-9 AS arousal FROM w", "valence arousal")
register("affect_traits", EV, s.affect_traits, f"""{_AFF}, e AS (SELECT session_id, arg_max(valence, n) AS v, arg_max(arousal, n) AS a FROM w GROUP BY session_id)
  SELECT session_id, v AS valence, a AS arousal, (1 - a) * 0.5 + (v + 1) / 4 AS breadth, 1 - a AS depth, greatest(0.0, least(1.0, (v + 1) / 2 + 0.1 * (0.5 - abs(a - 0.5)))) AS risk, greatest(0.0, least(1.0, 0.3 * (v + 1) + 0.4 * greatest(0.0, 1 - 2 * abs(a - 0.5)))) AS novelty_seeking,
    CASE WHEN v >= 0 AND a >= 0.5 THEN 'excited' WHEN v >= 0 THEN 'calm' WHEN a >= 0.5 THEN 'anxious' ELSE 'sad' END AS label FROM e""", "valence arousal breadth depth risk novelty_seeking")
register("conversation_chunks", lambda sp, d: table(sp, d, "conversations"), s.conversation_chunks, """WITH a AS (SELECT *, floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) / 5)::BIGINT AS chunk FROM conversations)
  SELECT conv_id, chunk, count(*) AS turns, count(DISTINCT role) AS speakers, sum(length(text))::BIGINT AS chars, substring(first(text ORDER BY turn, role, text), 1, 40) AS opening FROM a GROUP BY conv_id, chunk""")
register("market_moves", EV, s.market_moves, f"""{E}, a AS (SELECT id, domain, (value / lag(value) OVER (PARTITION BY domain ORDER BY stored_at, store_seq) - 1) * 100 AS change FROM ev)
  SELECT id, domain, change, greatest(-1.0, least(1.0, change / 5)) AS valence, least(1.0, abs(change) / 10 + 0.3) AS importance FROM a WHERE abs(change) > 1.5""", "change valence importance")
