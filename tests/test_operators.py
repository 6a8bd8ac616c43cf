"""Closed forms, invariants and edge cases of the operators."""

import json
import math

import pytest
import numpy as np
from pyspark.sql import functions as F

from recollect import schema
from recollect.functions import text as tx
from recollect.operators import lifecycle as lc
from recollect.operators import advisors, graphs, pairs, profiles, records, retrieval, rules, sequences
from recollect.sources import files
from recollect.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mem(spark):
    return schema.documents_as_memories(spark, SF).cache()


def test_tokenizers(spark):
    r = spark.createDataFrame([("  The cat, the (Hat)!  It's on",)], "c string").select(tx.words(F.col("c")).alias("w"), tx.stripped(F.col("c")).alias("s"), tx.keywords(F.col("c"), 3).alias("k"), tx.alnum(F.col("c")).alias("a")).first()
    assert r.w == ["the", "cat,", "the", "(hat)!", "it's", "on"]
    assert r.s == ["the", "cat", "the", "hat", "it's", "on"]
    assert r.k == ["cat", "hat", "it's"]
    assert r.a == ["the", "cat", "the", "hat", "it", "s", "on"]


def test_jaccard_of_empty_sets(spark):
    e = F.array().cast("array<string>")
    assert spark.range(1).select(tx.jaccard(e, e)).first()[0] == 0


def test_empty_input_keeps_schema(spark, mem):
    none = mem.filter("false")
    for op in (profiles.trust_ledger, profiles.knowledge_map, profiles.detect_biases, lc.apply_decay, lc.dream, retrieval.replay_top, sequences.timeline_gaps):
        assert op(none).schema == op(mem).schema
        assert op(none).count() == 0


def test_results_do_not_depend_on_partitions(spark, mem):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "4", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append([tuple(r) for r in retrieval.hybrid_retrieve(mem, "the thing of tion").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]


def test_rrf_of_equal_lists_keeps_order(mem):
    r = [x.score for x in retrieval.hybrid_retrieve(mem, "the of", 20).collect()]
    assert r == sorted(r, reverse=True) and len(r) == 20


def test_decay_never_strengthens(mem):
    assert lc.apply_decay(mem).alias("n").join(mem.alias("o"), "id").filter("n.strength > o.strength").isEmpty()


def test_diff_of_itself_is_empty_and_federation_adds_nothing(mem):
    assert lc.snapshot_diff(mem, mem).isEmpty()
    assert lc.federate(mem, mem).filter("origin <> 'local'").isEmpty()


def test_sm2_intervals(spark):
    log = spark.createDataFrame([(1, float(i), 5) for i in range(3)] + [(2, 0.0, 5), (2, 1.0, 1)], "memory_id long, reviewed_at double, quality int")
    r = {x.memory_id: x for x in lc.sm2(log).collect()}
    assert r[1].reps == 3 and math.isclose(r[1].interval_days, 6 * 2.7) and math.isclose(r[1].ease, 2.8)
    assert r[2].reps == 0 and r[2].interval_days == 1 and r[2].lapses == 1 and r[2].ease >= 1.3


def test_feeling_and_query_planning():
    assert retrieval.feeling("So happy!") == (0.8, 0.6)
    assert retrieval.feeling("nothing here") == (0.0, 0.0)
    assert retrieval.decompose("red apples and green pears") == ["red apples", "green pears"]
    assert retrieval.decompose("one") == ["one"]
    a, b = retrieval.update_arm(1, 1, 1.0)
    assert retrieval.beta_mean(a, b) > 0.5


def test_jaccard_join_equals_all_pairs(mem):
    keys = tx.keywords(F.col("content"))
    t = mem.select("id", F.array_distinct(keys).alias("t")).collect()
    sets = {r.id: set(r.t) for r in t if r.t}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]) - 1e-12}
    assert {(r.a, r.b) for r in pairs.jaccard_join(mem, keys, 0.5).collect()} == want


def test_ema_batch_fold(spark):
    ev = spark.createDataFrame([(1, 1.0, 1, 1.0), (1, 2.0, 2, -1.0)], "session_id long, stored_at double, store_seq long, valence double")
    r = sequences.ema_affect(ev).first()
    assert math.isclose(r.valence, 0.85 * 0.15 - 0.15)


def test_streaming_equals_batch(spark, tmp_path):
    rows = [("a good record with six words", "2024-01-01 00:00:00"), ("a good record with six words", "2024-01-01 00:01:00"), ("short", "2024-01-01 00:02:00"), ("another good record with seven words here", "2024-01-01 00:03:00")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text("\n".join(json.dumps({"content": c, "ts": t}) for c, t in rows))
    s = ingest.clean(ingest.read_feed(spark, str(tmp_path / "in"), "content string, ts timestamp"))
    ingest.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    ingest.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_affect_stream_equals_fold(spark, tmp_path):
    ev = schema.events_as_memories(spark, SF).select("session_id", "stored_at", "store_seq", "valence")
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    s = ingest.affect_stream(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")))
    q = s.writeStream.format("memory").queryName("affect").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = {r.session_id: r.valence for r in spark.table("affect").collect()}
    want = {r.session_id: r.valence for r in sequences.ema_affect(ev).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_snapshot_and_jsonl_round_trip(spark, mem, tmp_path):
    files.save_snapshot(mem, str(tmp_path / "snap"), 1)
    back = files.load_snapshot(spark, str(tmp_path / "snap"), 1)
    assert back.count() == mem.count()
    with pytest.raises(Exception):
        files.save_snapshot(mem, str(tmp_path / "snap"), 1)
    files.export_jsonl(mem, str(tmp_path / "jsonl"))
    new = files.import_jsonl(spark, str(tmp_path / "jsonl"), mem.schema, mem.filter("id < 100"))
    assert new.filter("id < 100").isEmpty() and set(r.tier for r in new.select("tier").distinct().collect()) == {"working"}


def test_lexicon_profiles_on_injected_text(spark, mem):
    rows = [(1, "a", "We should always test and never avoid it"), (2, "a", "Bob thinks the trust and honest care failed"), (3, "a", "stress causes damage and growth")]
    df = spark.createDataFrame(rows, "id long, domain string, content string").selectExpr("*", "0.9D AS importance", "-0.5D AS valence", "0.5D AS strength")
    assert {r.subject for r in profiles.extract_norms(df).collect()} >= {"always", "test"}
    assert [r.agent for r in profiles.agent_models(df).collect()] == ["bob"]
    assert {r.value for r in profiles.map_values(df).collect()} == {"trust", "honest", "care", "growth"}
    assert [r.kind for r in profiles.trace_adversity(df).collect()] == ["failure"]
    e = pairs.causal_edges(df).first()
    assert (e.source, e.relation, e.target) == ("stress", "causes", "damage")


def test_budget_frees_just_enough(mem):
    total = mem.select(F.sum(tx.token_estimate(F.col("content")))).first()[0]
    out = profiles.enforce_budget(mem, total - 5000)
    freed = [r.tokens for r in out.orderBy("score").collect()]
    assert sum(freed) >= 5000 and all(f >= 0 for f in freed)
    assert profiles.enforce_budget(mem, total + 1).isEmpty()


def test_hash_embedding_is_unit(spark):
    r = spark.createDataFrame([("some text",), ("",)], "t string").select(rules.hash_embedding(64)("t").alias("e")).collect()
    assert math.isclose(sum(x * x for x in r[0].e), 1.0) and sum(map(abs, r[1].e)) == 0


def test_rumination_links_from_015(spark):
    texts = ["alpha beta gamma delta", "alpha epsilon zeta theta", "omega sigma kappa lambda", "kappa phoenix quartz raven", "solo words here only"]
    df = spark.createDataFrame([(i, t, -0.5) for i, t in enumerate(texts)], "id long, content string, valence double")
    sim = dict(((r.a, r.b), r.sim) for r in pairs.jaccard_join(df, tx.keywords(F.col("content")), 0.01).collect())
    assert {k for k, v in sim.items() if v >= 0.15} == set() and round(sim[0, 1], 4) == round(1 / 7, 4)
    df = df.withColumn("content", F.regexp_replace("content", " (theta|raven)$", ""))
    got = {(r.component, r.size, round(r.score, 6)) for r in pairs.rumination(df, tx.keywords(F.col("content"))).collect()}
    assert got == {(0, 2, 0.7), (2, 2, 0.7)}


def test_dilemmas_pair_all_records(spark):
    rows = [(i, "d", "honest duty fair harm " * 3, 1.0, (-1) ** (i >= 40) * (0.9 - 0.005 * (i % 40))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, domain string, content string, importance double, valence double")
    m = [r.asDict() for r in profiles.moral_scores(df).collect()]
    want = {(x["id"], y["id"]) for x in m for y in m if x["id"] < y["id"] and min(x["moral_weight"], y["moral_weight"]) >= 0.05 and abs(x["valence"] - y["valence"]) > 0.5 and x["moral_weight"] * y["moral_weight"] * abs(x["valence"] - y["valence"]) >= 0.05}
    got = [(r.a, r.b) for r in pairs.dilemmas(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30 * 30


def best_labels(edges, label):
    votes = {n: {label[n]: 0.001} for n in label}
    for a, b, w in edges:
        votes[a][label[b]] = votes[a].get(label[b], 0) + w
        votes[b][label[a]] = votes[b].get(label[a], 0) + w
    return {n: min(v, key=lambda x: (-round(v[x], 6), x)) for n, v in votes.items()}


def test_communities_run_until_nothing_changes(spark):
    edges = [(i, i + 1, 1.0 - 0.01 * i) for i in range(12)] + [(40, 41, 0.5), (41, 42, 0.5), (40, 42, 0.5), (50, 51, 1.0)]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    got = {r.id: r.label for r in graphs.communities(df).collect()}
    assert best_labels(edges, got) == got and got[50] == got[51]
    assert len({got[i] for i in range(13)}) == 1
    label = {n: n for e in edges for n in e[:2]}
    for _ in range(3):
        label = best_labels(edges, label)
    assert {r.id: r.label for r in graphs.communities(df, 3, at_once=True).collect()} == label != got


def test_inventions_cross_all_ranks(spark):
    rows = [(k * 100 + i, f"d{k}", f"common{'abc'[k]} rare{'abc'[k]}{i % 9}") for k in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, domain string, content string")
    got = {(r.domain_a, r.tok_a, r.domain_b, r.tok_b) for r in advisors.inventions(df, top=1000).collect()}
    assert got == {(f"d{i}", f"rare{'abc'[i]}{x}", f"d{j}", f"rare{'abc'[j]}{y}") for i in range(3) for j in range(i + 1, 3) for x in range(9) for y in range(9)}


def test_associations_are_made_once_and_not_shuffled(spark):
    df = spark.createDataFrame([(i, "d", i * 40.0) for i in range(30)], "id long, domain string, stored_at double")
    plan = graphs.degrees(pairs.association_edges(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1
    got = {r.id: r.degree for r in graphs.degrees(pairs.association_edges(df)).collect()}
    assert got == {i: sum(0 < abs(i - j) * 40 < 300 for j in range(30)) for i in range(30)}


def test_communities_of_associations_store_no_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"d{i % 2}", float(rng.integers(0, 9_000)) + 9_000 * (i % 3)) for i in range(400)] + [(900, "d0", 90_000.0), (901, None, 100.0), (902, None, 101.0)]
    df = spark.createDataFrame(rows, "id long, domain string, stored_at double")
    edges = pairs.association_edges(df).cache()
    for args in ((3, True), (100, False)):
        want, got = graphs.communities(edges, *args), graphs.association_communities(df, *args, most=500)
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 300
    assert sorted(graphs.association_bridges(df, got).collect()) == sorted(graphs.bridges(edges, want).collect())
    a, b = graphs.association_modularity(df, got).first(), graphs.modularity(edges, want).first()
    assert a.communities == b.communities and abs(a.modularity - b.modularity) < 1e-9


@pytest.mark.parametrize("sent", [1_000, 0])
def test_two_sides_are_compared_with_each_other_only(spark, monkeypatch, sent):
    monkeypatch.setattr(pairs, "token_sets", None)  # sets of both sides together
    monkeypatch.setattr(pairs, "SENT", sent)
    text = lambda i: " ".join(f"word{(i * k) % 11}" for k in range(1, 2 + i % 5))
    sides = [{i: text(i + s) for i in range(20)} | {99: None} for s in (0, 3)]
    left, right = (spark.createDataFrame(list(x.items()), "id long, content string") for x in sides)
    x, y = ({i: set((t or "").split()) for i, t in s.items()} for s in sides)
    sim = {(i, j): len(x[i] & y[j]) / len(x[i] | y[j]) for i in x for j in y if x[i] & y[j]}
    want = {(i, j, round(sim[i, j], 6), r + 1) for i in x for r, j in enumerate(sorted((j for j in y if sim.get((i, j), 0) >= 0.3), key=lambda j: (-sim[i, j], j))[:5])}
    assert {(r[0], r[1], round(r[2], 6), r[3]) for r in advisors.abductive_hypotheses(left, right, 0.3).collect()} == want and len(want) > 40
    got = {r.id: r.status for r in records.reality_check(right, left, 0.9).collect()}
    assert got == {j: "supported" if any(sim.get((i, j), 0) >= 0.9 for i in x) else "unverified" for j in y} and len(set(got.values())) == 2
