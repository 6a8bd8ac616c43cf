"""Delivery of events exactly once, and what they ask for."""

from recollect.streaming import bus

SCHEMA = "id long, topic string, domain string, importance double, surprise double"
LISTENERS = [bus.Listener("all"), bus.Listener("goals", ("goal.pushed",)), bus.Listener("odd", (), "surprise > 0.5")]


def test_tasks_of_events(spark):
    rows = [(1, "memory.stored", "d", .8, None), (2, "memory.stored", None, .7, .9), (3, "prediction.resolved", None, None, .31), (4, "prediction.resolved", "d", 1.0, .3), (5, "surprise.threshold_exceeded", "d", None, None), (6, "unknown", "d", 1.0, 1.0), (7, None, "d", 1.0, 1.0), (8, "goal.pushed", "d", .1, None)]
    got = {r.id: (r.task, r.domain, r.importance, r.surprise) for r in bus.tasks(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("self_model_update", "d", .8, 0.0), 3: ("belief_revision", "general", .8, .31), 5: ("belief_revision", "d", .9, 1.0), 8: ("goal_check", "d", .6, 0.0)}


def test_delivery_is_exactly_once(spark, tmp_path):
    src, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    part = lambda a, b: spark.createDataFrame([(i, "goal.pushed" if i % 2 else "other", "d", .5, i / 10) for i in range(a, b)], SCHEMA)
    for a, b in ((0, 4), (4, 9)):
        part(a, b).coalesce(1).write.mode("append").parquet(src)
        bus.subscribe(spark.readStream.schema(SCHEMA).parquet(src), out, check, LISTENERS)
    ids = lambda name: sorted(r.id for r in bus.received(spark, out, name).collect())
    want = (list(range(9)), [1, 3, 5, 7], [6, 7, 8], [1, 3, 5, 7])
    assert tuple(map(ids, ("all", "goals", "odd", "tasks"))) == want
    bus.deliver(part(4, 9), 1, out, LISTENERS)  # the second batch once more
    assert tuple(map(ids, ("all", "goals", "odd", "tasks"))) == want
    assert [r.id for r in bus.history(part(0, 9), 3).collect()] == [8, 7, 6]
