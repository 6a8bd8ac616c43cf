"""Lifecycle over documents as memories; logs and snapshots come from the other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.operators import lifecycle as lc
from recollect.plans.registry import register
from recollect.schema import AS_OF, DAY, MEM_SQL, documents_as_memories, table

MEM = documents_as_memories
W = f"WITH {MEM_SQL}"
RET = f"exp(-greatest(0.0, ({AS_OF} - last_accessed) / {DAY}) / greatest((7 + 2 * access_count) * (1 + 3 * importance), 0.1))"
CONS = "0.35 * importance + 0.25 * novelty + 0.25 * strength + 0.15 * least(1.0, access_count / 5.0)"
PRI = f"greatest(1e-6, 0.35 * importance + 0.30 * least(1.0, strength) + 0.20 * exp(-0.1 * greatest(0.0, ({AS_OF} - stored_at) / {DAY})) + 0.15 * novelty)"
HASH = "sha256(substring(lower(trim(content)), 1, 200))"

register("decay_report", MEM, lc.decay_report, f"{W} SELECT domain, count(*) AS n, avg({RET}) AS mean_retention, sum((strength * {RET} < 0.05)::INT)::BIGINT AS prunable FROM mem GROUP BY domain", "mean_retention")
register("decay_apply", MEM, lc.apply_decay, f"{W} SELECT id, strength * {RET} AS strength FROM mem WHERE strength * {RET} >= 0.05", "strength")
register("item_decay", MEM, lc.item_decay, f"{W} SELECT id, strength * exp(-0.693 * ({AS_OF} - last_accessed) / {DAY}) AS strength FROM mem", "strength")
_t = 1 / (1 + 1 / 3)
register("annealing", MEM, lc.anneal, f"""{W}, a AS (SELECT id, importance, CASE WHEN 0.03 * {_t} * (1 - importance) > 0.001 THEN greatest(0.01, strength - 0.03 * {_t} * (1 - importance)) ELSE strength END AS s, valence - 0.08 * {_t} * valence AS valence FROM mem)
  SELECT id, CASE WHEN importance >= 0.7 THEN least(2.0, s + 0.05 * (1 - {_t})) ELSE s END AS strength, valence FROM a""", "strength valence")
register("reconsolidation", MEM, lambda d: lc.reconsolidate(d, 0.3), f"""{W}, a AS (SELECT *, least(1.0, 1 / ln(1 + 1.5 * greatest(1, access_count))) AS k FROM mem)
  SELECT id, least(2.0, strength + 0.08 * k) AS strength, greatest(-1.0, least(1.0, valence + 0.06 * k * sign(0.3 - valence))) AS valence, access_count + 1 AS access_count FROM a""", "strength valence")
register("dream_cycle", MEM, lc.dream, f"""{W}, p AS (SELECT *, {PRI} AS p FROM mem), u AS (SELECT id FROM p ORDER BY p DESC, store_seq LIMIT 20), w AS (SELECT id FROM p ORDER BY p, store_seq DESC LIMIT 10),
  a AS (SELECT id, id IN (SELECT id FROM u) AS reinforced, id IN (SELECT id FROM w) AS weakened, strength FROM mem), b AS (SELECT *, greatest(0.0, least(2.0, strength + 0.05 * reinforced::INT) - 0.05 * weakened::INT) AS s FROM a)
  SELECT id, s AS strength, reinforced, weakened, s < 0.05 AS pruned FROM b""", "strength")
register("motivated_forgetting", MEM, lambda d: lc.suppress(d.filter("domain = 'src5'")), f"{W} SELECT id, strength * 0.6 AS strength, strength * 0.6 < 0.05 AS pruned FROM mem WHERE domain = 'src5'", "strength")
register("tier_promotion", MEM, lc.promote, f"""{W}, a AS (SELECT *, {CONS} AS score FROM mem) SELECT id, tier, CASE WHEN tier = 'working' AND pinned THEN 'long_term' WHEN tier = 'working' AND score >= 0.55 THEN 'short_term'
  WHEN tier = 'short_term' AND ((score >= 0.55 AND access_count >= 2) OR importance >= 0.8 OR pinned) THEN 'long_term' WHEN tier = 'short_term' AND strength <= 0.1 THEN NULL
  WHEN tier = 'long_term' AND access_count >= 5 AND strength > 0.5 THEN 'semantic' ELSE tier END AS new_tier FROM a""")
register("capacity_eviction", MEM, lambda d: lc.evict_overflow(d, {"working": 7, "short_term": 50}), f"""{W}, a AS (SELECT namespace, tier, id, row_number() OVER (PARTITION BY namespace, tier ORDER BY store_seq DESC) AS r FROM mem WHERE tier IN ('working', 'short_term'))
  SELECT namespace, tier, id FROM a WHERE r > CASE tier WHEN 'working' THEN 7 ELSE 50 END""")
register("ttl_purge", MEM, lc.purge_expired, f"{W} SELECT id, '__expired__' AS superseded_by FROM mem WHERE expires_at < {AS_OF} AND superseded_by IS NULL")
register("feedback_votes", lambda s, d: (MEM(s, d), table(s, d, "labels").selectExpr("doc_id AS id", "quality AS up", "toxic AS down")), lambda x: lc.vote(*x), f"""{W}, f AS (SELECT doc_id AS id, sum(quality) AS up, sum(toxic) AS down FROM labels GROUP BY doc_id)
  SELECT id, greatest(0.0, least(1.0, strength + 0.1 * up - 0.2 * down)) AS strength, (access_count + up)::BIGINT AS access_count FROM mem JOIN f USING (id)""", "strength")
register("patch_supersession", MEM, lambda d: lc.supersede_by_key(d, "domain"), f"{W}, a AS (SELECT id, lead(id) OVER (PARTITION BY domain ORDER BY store_seq) AS superseded_by FROM mem) SELECT * FROM a WHERE superseded_by IS NOT NULL")
register("compaction_index", MEM, lc.duplicate_contents, f"{W} SELECT {HASH} AS content_hash, count(*) AS n, min(id) AS first_id FROM mem GROUP BY 1 HAVING count(*) > 1")
register("endless_compression", MEM, lc.compress_episodes, f"""{W}, a AS (SELECT *, floor((row_number() OVER (PARTITION BY namespace ORDER BY store_seq) - 1) / 3)::BIGINT AS chunk FROM mem WHERE tier = 'short_term' AND NOT pinned)
  SELECT namespace, chunk, count(*) AS n, min(id) AS first_id, max(importance) AS importance, max(novelty) AS novelty, avg(valence) AS valence, CASE WHEN min(domain) = max(domain) THEN min(domain) ELSE 'multi' END AS domain FROM a GROUP BY namespace, chunk""", "importance novelty valence")


def two_snapshots(spark, sf_dir):
    m = MEM(spark, sf_dir)
    later = m.filter("id % 9 <> 0").withColumn("strength", F.col("strength") * (0.5 + (F.col("id") % 10) / 10.0)).withColumn("superseded_by", F.when(F.col("id") % 40 == 1, F.lit(1)).otherwise(F.col("superseded_by")))
    return m.filter("id % 11 <> 0"), later


SNAP = f"{W}, a AS (SELECT * FROM mem WHERE id % 11 <> 0), b AS (SELECT id, strength * (0.5 + (id % 10) / 10.0) AS strength, CASE WHEN id % 40 = 1 THEN 1 ELSE superseded_by END AS superseded_by FROM mem WHERE id % 9 <> 0)"
register("snapshot_diff", two_snapshots, lambda x: lc.snapshot_diff(*x), f"""{SNAP}, j AS (SELECT coalesce(a.id, b.id) AS id, a.id AS i1, b.id AS i2, a.strength AS s1, b.strength AS s2, a.superseded_by AS p1, b.superseded_by AS p2 FROM a FULL JOIN b ON a.id = b.id),
  c AS (SELECT id, CASE WHEN i1 IS NULL THEN 'added' WHEN i2 IS NULL THEN 'removed' WHEN p1 IS NULL AND p2 IS NOT NULL THEN 'superseded' WHEN s2 - s1 > 0.05 THEN 'strengthened' WHEN s2 - s1 < -0.05 THEN 'weakened' END AS change, s2 - s1 AS delta FROM j)
  SELECT * FROM c WHERE change IS NOT NULL""", "delta")


def two_stores(spark, sf_dir):
    m = MEM(spark, sf_dir)
    return m.filter("id % 3 <> 0"), m.filter("id % 2 = 0 OR id % 3 = 0").withColumn("content", F.when(F.col("id") % 4 == 0, F.concat(F.lit("new "), F.col("content"))).otherwise(F.col("content"))).withColumn("stored_at", F.col("stored_at") + F.col("id") % 8 - 3)


register("federation_merge", two_stores, lambda x: lc.federate(*x), f"""{W}, t AS (SELECT *, {HASH} AS h FROM mem WHERE id % 3 <> 0), s0 AS (SELECT * REPLACE (CASE WHEN id % 4 = 0 THEN 'new ' || content ELSE content END AS content, stored_at + id % 8 - 3 AS stored_at) FROM mem WHERE id % 2 = 0 OR id % 3 = 0),
  s AS (SELECT *, {HASH} AS h FROM s0), n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY store_seq) AS r FROM s WHERE h NOT IN (SELECT h FROM t)), m AS (SELECT * FROM n WHERE r = 1)
  SELECT coalesce(t.id, m.id) AS id, CASE WHEN m.id IS NULL THEN 'local' WHEN t.id IS NULL THEN 'merged' WHEN m.stored_at > t.stored_at THEN 'replaced' ELSE 'local' END AS origin FROM t FULL JOIN m ON t.id = m.id""")
register("spaced_repetition", lambda s, d: table(s, d, "events").selectExpr("user_id AS memory_id", "CAST(event_id AS DOUBLE) AS reviewed_at", "CAST(event_id * 7 % 6 AS INT) AS quality"), lc.sm2, f"""WITH RECURSIVE lg AS (SELECT user_id AS memory_id, event_id::DOUBLE AS reviewed_at, (event_id * 7 % 6)::INT AS q, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
  st AS (SELECT DISTINCT memory_id, 0::BIGINT AS i, 0 AS reps, 2.5::DOUBLE AS ease, 0.0::DOUBLE AS days, 0 AS lapses FROM lg UNION ALL SELECT st.memory_id, lg.i, CASE WHEN q >= 3 THEN reps + 1 ELSE 0 END, greatest(1.3, ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))::DOUBLE,
    (CASE WHEN q < 3 OR reps = 0 THEN 1.0 WHEN reps = 1 THEN 6.0 ELSE days * ease END)::DOUBLE, lapses + CASE WHEN q >= 3 THEN 0 ELSE 1 END FROM st JOIN lg ON lg.memory_id = st.memory_id AND lg.i = st.i + 1)
  SELECT lg.memory_id, n::INT AS reviews, reps, ease, days AS interval_days, lapses, reviewed_at + days * {DAY} AS next_review FROM lg JOIN st ON st.memory_id = lg.memory_id AND st.i = lg.i WHERE lg.i = n""", "ease interval_days next_review")
register("prospective_check", lambda s, d: table(s, d, "benchmark").selectExpr("item_id AS id", "text AS trigger_context", "(item_id % 10) / 10.0D AS priority"), lambda d: lc.check_intentions(d, "the of and in to is that are", 0.05),
         f"""WITH b AS (SELECT item_id AS id, (item_id % 10) / 10.0 AS priority, list_distinct({tx.SQL_WORDS.format(c='text')}) AS t FROM benchmark), o AS (SELECT id, priority, len(list_intersect(t, ['the', 'of', 'and', 'in', 'to', 'is', 'that', 'are'])) / len(list_distinct(list_concat(t, ['the', 'of', 'and', 'in', 'to', 'is', 'that', 'are'])))::DOUBLE AS o FROM b)
  SELECT id, o * (0.5 + 0.5 * priority) AS score FROM o WHERE o >= 0.05""", "score")
register("citation_check", lambda s, d: (MEM(s, d), table(s, d, "documents").selectExpr("doc_id AS id", "doc_id * 3 AS cited")), lambda x: lc.citations_found(*x), f"{W} SELECT d.doc_id AS id, d.doc_id * 3 AS cited, m.id IS NOT NULL AS found, CASE WHEN m.id IS NOT NULL THEN least(1.0, m.strength + 0.1) ELSE 1.0 END AS strength FROM documents d LEFT JOIN mem m ON m.id = d.doc_id * 3", "strength")
register("access_fold", lambda s, d: (MEM(s, d), table(s, d, "events").selectExpr("user_id AS id", "1700000000.0D + event_id * 50 AS at")), lambda x: lc.fold_access(*x), f"""{W}, g AS (SELECT user_id AS id, count(*)::INT AS c, max(1700000000.0 + event_id * 50)::DOUBLE AS seen FROM events GROUP BY user_id)
  SELECT id, access_count + c AS access_count, greatest(last_accessed, seen) AS last_accessed FROM mem JOIN g USING (id)""", "last_accessed")
register("source_monitor", MEM, lc.source_monitor, f"""{W} SELECT CASE WHEN contains(lower(substring(content, 1, 200)), 'licens') OR contains(lower(substring(content, 1, 200)), 'copyright') THEN 'documentation' WHEN importance >= 0.8 THEN 'observation' WHEN importance < 0.3 THEN 'inference' ELSE 'experience' END AS source, count(*) AS n FROM mem GROUP BY 1""")
register("token_eviction", MEM, lc.token_importance, f"{W} SELECT id, 0.4 * exp(-0.693 * ({AS_OF} - last_accessed) / {DAY}) + 0.4 * importance + 0.2 * least(1.0, access_count / 10.0) AS keep FROM mem", "keep")
