"""Episodes of sessions of documents."""

from __future__ import annotations

from recollect.operators import splitting as sp
from recollect.operators.clustering import clusters
from recollect.plans.q_condense import _jac, _set
from recollect.plans.registry import register
from recollect.schema import MEM_SQL, REC_SQL, documents_as_records

REC = documents_as_records
_pairs = f"""WITH {MEM_SQL}, {REC_SQL}, o AS (SELECT session_id, id, stored_at, domain, {_set('content')} AS t, row_number() OVER (PARTITION BY session_id ORDER BY stored_at, store_seq) - 1 AS p FROM rec),
  b AS (SELECT *, p // 64 AS buffer, (p % 64)::INT AS n FROM o), pr AS (SELECT x.session_id, x.buffer, x.n AS i, y.n AS j, x.id AS a, y.id AS b, 0.5 * {_jac('x.t', 'y.t')} + 0.2 * CASE WHEN x.domain IS NOT DISTINCT FROM y.domain THEN 1.0 ELSE 0.3 END + 0.3 * exp(-0.693 * abs(y.stored_at - x.stored_at) / 300.0) AS sim
    FROM b x JOIN b y ON x.session_id = y.session_id AND x.buffer = y.buffer AND x.n < y.n)"""
register("episode_similarities", REC, lambda d: sp.pairs(sp.buffers(d)), f"{_pairs} SELECT * FROM pr", "sim")
_heur = f"""{_pairs}, s AS (SELECT b.session_id, b.buffer, b.n, b.id, 1 + sum(coalesce((pr.sim < 0.35)::INT, 0)) OVER (PARTITION BY b.session_id, b.buffer ORDER BY b.n) AS episode FROM b LEFT JOIN pr ON pr.session_id = b.session_id AND pr.buffer = b.buffer AND pr.j = b.n AND pr.i = b.n - 1),
  m AS (SELECT x.session_id, x.buffer, x.episode, avg(sim) AS c FROM pr JOIN s x ON x.id = pr.a JOIN s y ON y.id = pr.b WHERE x.episode = y.episode GROUP BY ALL)
  SELECT session_id, buffer, episode::INT AS episode, count(*) AS records, min(n) AS first, max(n) AS last, coalesce(any_value(c), 1.0) AS coherence FROM s LEFT JOIN m USING (session_id, buffer, episode) GROUP BY session_id, buffer, episode"""
register("episodes_by_likeness", REC, lambda d: sp.split(d, "heuristic", least=0.35)[1], _heur, "coherence")
for _way in ("graph", "conductance", "spectral", "multi"):
    register(f"episodes_by_{_way}", REC, lambda d, w=_way: sp.split(d, w)[1])
register("topic_clusters", REC, clusters)
