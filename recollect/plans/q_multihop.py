"""Hops over the relations that documents and reports state."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators import knowledge as k
from recollect.operators import multihop as m
from recollect.plans.q_knowledge import sql_relations
from recollect.plans.registry import register
from recollect.schema import MEM_SQL, documents_as_memories


def frequent(relations, n: int = 5):
    """The entities with most relations."""
    return m.two_way(relations).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "node").limit(n)


def hopped(df):
    relations = k.relation_table(df).checkpoint()
    return relations, m.paths_from(relations, frequent(relations))


def _round(n: int) -> str:
    prev = f"f{n - 1}"
    out = f""", n{n} AS (SELECT seed, e.b AS node, list_append(path, e.b) AS path, list_append(types, e.type) AS types, f.strength * e.strength AS strength, {n} AS hops FROM {prev} f JOIN e ON e.a = f.path[-1] WHERE NOT list_contains(path, e.b))"""
    if n < 3:
        earlier = " UNION ALL ".join(["SELECT seed, seed AS node, 1.0::DOUBLE AS strength FROM f0"] + [f"SELECT seed, node, strength FROM n{i}" for i in range(1, n)])
        out += f""", f{n} AS (SELECT seed, path, types, strength FROM (SELECT x.*, row_number() OVER (PARTITION BY x.seed, x.node ORDER BY round(x.strength, 12) DESC, x.path) AS r FROM n{n} x
          LEFT JOIN (SELECT seed, node, max(strength) AS was FROM ({earlier}) GROUP BY seed, node) b ON b.seed = x.seed AND b.node = x.node WHERE was IS NULL OR round(x.strength, 12) > round(was, 12)) WHERE r <= 5)"""
    return out


PATHS = f"""WITH {MEM_SQL}, {sql_relations()}, rel AS (SELECT source, target, type, round(least(1.0, base + 0.1 * (mentions - 1)), 6)::DOUBLE AS strength FROM rt),
  bw AS (SELECT source AS a, target AS b, type, strength FROM rel WHERE source <> target UNION ALL SELECT target, source, type, strength FROM rel WHERE source <> target), e AS (SELECT a, b, first(type ORDER BY strength DESC, type DESC) AS type, max(strength) AS strength FROM bw GROUP BY a, b),
  f0 AS (SELECT a AS seed, [a] AS path, []::VARCHAR[] AS types, 1.0::DOUBLE AS strength FROM e GROUP BY a ORDER BY count(*) DESC, a LIMIT 5){_round(1)}{_round(2)}{_round(3)},
  p AS (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY hops, round(strength, 12) DESC, path) <= 5 AS kept FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3))"""
register("entity_paths", documents_as_memories, lambda d: hopped(d)[1].filter("kept").select("seed", "node", F.array_join("path", " > ").alias("path"), F.array_join("types", " > ").alias("types"), "strength", "hops"),
         f"{PATHS} SELECT seed, node, array_to_string(path, ' > ') AS path, array_to_string(types, ' > ') AS types, strength, hops FROM p WHERE kept", "strength")
register("entity_reach", documents_as_memories, lambda d: m.reachable(hopped(d)[1]), f"""{PATHS}, b AS (SELECT seed, node, first(strength ORDER BY round(strength, 12) DESC, hops, path DESC) AS strength, min(hops) AS hops, count(*) AS n_paths, first(path ORDER BY round(strength, 12) DESC, hops, path DESC) AS path,
  first(types ORDER BY round(strength, 12) DESC, hops, path DESC) AS types FROM p WHERE kept GROUP BY seed, node), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(strength, 12) DESC, node) AS r FROM b)
  SELECT seed, node, strength, hops, n_paths, array_to_string(path, ' > ') AS path, array_to_string(types, ' > ') AS types FROM r WHERE r <= 20""", "strength")
_bridges = f"""{PATHS}, i AS (SELECT seed, unnest(path[2:-2]) AS node, strength FROM p WHERE hops > 1), g AS (SELECT seed, node, sum(strength) AS score, count(*) AS paths FROM i GROUP BY seed, node),
  r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, node) AS r FROM g) SELECT seed, node, score, paths FROM r WHERE r <= 10"""
register("entity_bridges", documents_as_memories, lambda d: m.bridging(hopped(d)[1]), _bridges, "score")
