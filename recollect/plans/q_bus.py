"""Events of the driver's table as events of the bus."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.plans.registry import register
from recollect.schema import table
from recollect.streaming import bus

TOPICS = list(bus.ROUTES)


def events(spark, sf_dir):
    topics = "array(" + ", ".join(f"'{t}'" for t in [*TOPICS, "other"]) + ")"
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", f"element_at({topics}, CAST((event_id * 5 + user_id) % 8 AS INT) + 1) AS topic", "event_type AS domain", "least(1.0D, value / 80.0D) AS importance", "CASE WHEN event_id % 3 > 0 THEN least(1.0D, value / 150.0D) END AS surprise")


_topics = "[" + ", ".join(f"'{t}'" for t in [*TOPICS, "other"]) + "]"
BUS = f"WITH e AS (SELECT event_id AS id, {_topics}[(event_id * 5 + user_id) % 8 + 1] AS topic, event_type AS domain, least(1.0, value / 80.0)::DOUBLE AS importance, CASE WHEN event_id % 3 > 0 THEN least(1.0, value / 150.0)::DOUBLE END AS surprise FROM events)"
register("event_tasks", events, bus.tasks, f"""{BUS} SELECT id, CASE topic WHEN 'memory.stored' THEN 'self_model_update' WHEN 'identity.updated' THEN 'self_model_update' WHEN 'memory.patterns_detected' THEN 'reflection' WHEN 'goal.pushed' THEN 'goal_check' WHEN 'emotion.state_changed' THEN 'emotion_regulation' ELSE 'belief_revision' END AS task, topic, domain,
  CASE topic WHEN 'memory.stored' THEN importance WHEN 'prediction.resolved' THEN 0.8 WHEN 'surprise.threshold_exceeded' THEN 0.9 WHEN 'emotion.state_changed' THEN 0.5 ELSE 0.6 END::DOUBLE AS importance, CASE topic WHEN 'surprise.threshold_exceeded' THEN 1.0 ELSE coalesce(surprise, 0) END::DOUBLE AS surprise
  FROM e WHERE topic <> 'other' AND (topic <> 'memory.stored' OR importance > 0.7) AND (topic <> 'prediction.resolved' OR coalesce(surprise, 0) > 0.3)""", "importance surprise")
LISTENERS = [bus.Listener("all"), bus.Listener("goals", ("goal.pushed", "identity.updated")), bus.Listener("surprised", (), "surprise > 0.5")]
register("event_listeners", events, lambda d: bus.heard(d, LISTENERS), f"{BUS} SELECT 'all' AS listener, topic, count(*) AS n FROM e GROUP BY topic UNION ALL SELECT 'goals', topic, count(*) FROM e WHERE topic IN ('goal.pushed', 'identity.updated') GROUP BY topic UNION ALL SELECT 'surprised', topic, count(*) FROM e WHERE surprise > 0.5 GROUP BY topic")
register("event_history", events, lambda d: bus.history(d).select("id", "topic", F.col("domain")), f"{BUS} SELECT id, topic, domain FROM e ORDER BY id DESC LIMIT 100")
