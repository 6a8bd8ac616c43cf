"""Schemas and lessons: seed after seed in SQL, all at once here."""

from __future__ import annotations

from recollect.functions import text as tx
from recollect.operators import groups as g
from recollect.plans.registry import register
from recollect.schema import REPORTS_SQL, events_as_reports

KEYWORDS = tx.SQL_KEYWORDS.format(c="content", least=4)


def greedy(seeds: int, most: int, shown: int, where: str = "true") -> str:
    return f"""WITH RECURSIVE {REPORTS_SQL}, df AS (SELECT * FROM mem WHERE {where}), kw AS (SELECT id, domain, unnest(list_distinct({KEYWORDS})) AS tok FROM df),
  bs AS (SELECT * FROM (SELECT domain, tok, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, tok) - 1 AS r FROM kw GROUP BY domain, tok HAVING count(*) >= 2) WHERE r < {seeds}),
  mk AS (SELECT domain, id, bit_or(1::BIGINT << r::INT) AS mask FROM kw JOIN bs USING (domain, tok) GROUP BY domain, id),
  st AS (SELECT domain, 0 AS r, 0::BIGINT AS taken, 0 AS n FROM bs GROUP BY domain
    UNION ALL SELECT domain, r + 1, taken | CASE WHEN c >= 2 AND n < {most} THEN 1::BIGINT << r ELSE 0::BIGINT END, n + CASE WHEN c >= 2 AND n < {most} THEN 1 ELSE 0 END
      FROM (SELECT st.domain, st.r, st.taken, st.n, count(*) FILTER (mask & (1::BIGINT << st.r) <> 0 AND mask & st.taken = 0) AS c FROM st JOIN mk ON mk.domain = st.domain WHERE st.r < {seeds} GROUP BY st.domain, st.r, st.taken, st.n)),
  fin AS (SELECT domain, arg_max(taken, r) AS taken FROM st GROUP BY domain), gr AS (SELECT kw.id, kw.domain, min(bs.r) AS rank FROM kw JOIN bs USING (domain, tok) JOIN fin USING (domain) WHERE taken & (1::BIGINT << bs.r::INT) <> 0 GROUP BY kw.id, kw.domain),
  sa AS (SELECT domain, rank, tok, row_number() OVER (PARTITION BY domain, rank ORDER BY count(*) DESC, tok) AS q FROM kw JOIN gr USING (id, domain) GROUP BY domain, rank, tok HAVING count(*) >= 2),
  wd AS (SELECT domain, rank, string_agg(tok, ', ' ORDER BY q) AS keywords FROM sa WHERE q <= {shown} GROUP BY domain, rank),
  ge AS (SELECT gr.domain, gr.rank, count(*) AS members, avg(valence) AS valence, max(valence) - min(valence) AS spread FROM gr JOIN df USING (id) GROUP BY gr.domain, gr.rank),
  ou AS (SELECT ge.domain, bs.tok AS seed, ge.rank::INT AS rank, members, members / (SELECT count(*) FROM df x WHERE x.domain = ge.domain)::DOUBLE AS confidence, coalesce(keywords, bs.tok) AS keywords,
    CASE WHEN spread > 0.6 THEN 'contrast' WHEN abs(valence) < 0.1 AND members >= 3 THEN 'principle' WHEN members <= 2 THEN 'gap' ELSE 'pattern' END AS kind FROM ge JOIN bs ON bs.domain = ge.domain AND bs.r = ge.rank LEFT JOIN wd ON wd.domain = ge.domain AND wd.rank = ge.rank)"""


register("schemas", events_as_reports, g.schemas, f"{greedy(30, 12, 6)} SELECT domain, seed, rank, members, confidence, keywords FROM ou", "confidence")
register("lessons", events_as_reports, g.lessons, f"{greedy(20, 8, 4, 'importance >= 0.5')} SELECT * FROM ou", "confidence")
_ask = "CASE kind WHEN 'contrast' THEN 'Why do records on ' || keywords || ' disagree?' WHEN 'gap' THEN 'What is missing on ' || keywords || '?' ELSE 'What follows from ' || keywords || '?' END"
register("open_questions", events_as_reports, lambda d: g.open_questions(g.lessons(d)), f"{greedy(20, 8, 4, 'importance >= 0.5')} SELECT domain, kind, keywords, {_ask} AS question FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY members DESC, rank) AS q FROM ou) WHERE q <= 3")
