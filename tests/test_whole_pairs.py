"""Registered queries pair all records of their tables."""

import duckdb
import pytest

from recollect.operators import graphs, pairs, profiles
from recollect.plans import registry
from recollect.schema import documents_as_memories


@pytest.fixture(scope="module")
def one_domain(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS doc_id, 'honest duty number' || i // 2 || ' kept' AS text, 'en' AS lang, 'src' AS source, 20::BIGINT AS n_chars FROM range(80) t(i)) TO '{d}/documents.parquet'")
    con.execute(f"COPY (SELECT 0::BIGINT AS doc_id, 1 AS quality, 0 AS toxic) TO '{d}/labels.parquet'")
    return d


@pytest.mark.parametrize("paired", [8_192, 9])
def test_dilemmas_of_all_records_of_a_domain(spark, one_domain, monkeypatch, paired):
    monkeypatch.setattr(pairs, "PAIRED", paired)
    m = [r for r in profiles.moral_scores(documents_as_memories(spark, one_domain)).collect() if r.moral_weight > 0]
    want = sorted((x.id, y.id) for x in m for y in m if x.id < y.id and abs(x.valence - y.valence) > 0.5)
    got = sorted((r.a, r.b) for r in registry.QUERIES["dilemmas"](spark, one_domain).collect())
    assert got == want and len(want) > 30 * 29 // 2


def test_rumination_links_all_that_the_reference_links(spark, tmp_path):
    con, d = duckdb.connect(), str(tmp_path)
    texts = ["alpha beta gamma delta", "alpha epsilon zeta", "omega sigma kappa lambda", "kappa phoenix quartz", "solo words here only"]
    con.execute(f"COPY (SELECT i - 1 AS doc_id, {texts}[i] AS text, 'en' AS lang, 'src' AS source, 20::BIGINT AS n_chars FROM range(1, 6) t(i)) TO '{d}/documents.parquet'")
    con.execute(f"COPY (SELECT 0::BIGINT AS doc_id, 1 AS quality, 0 AS toxic) TO '{d}/labels.parquet'")
    assert {(r.component, r["size"]) for r in registry.QUERIES["rumination"](spark, d).collect()} == {(0, 2), (2, 2)}  # similarity 1 / 6 each


def test_activation_spreads_without_stored_edges(spark):
    rows = [(i, f"d{i % 2}" if i % 7 else None, float((i * 7919) % 6_000)) for i in range(200)] + [(900, "d0", 60_000.0), (901, "d0", 60_300.0), (902, "d0", 60_300.0)]
    df = spark.createDataFrame(rows, "id long, domain string, stored_at double")
    seeds = spark.createDataFrame([(3,), (8,), (900,), (901,)], "id long")
    want = {r.id: r.activation for r in pairs.spreading_activation(pairs.association_edges(df), seeds).collect()}
    got = {r.id: r.activation for r in pairs.association_activation(df, seeds).collect()}
    assert got == want and len(want) > 20 and 902 in want


def test_strongest_paths_without_stored_edges(spark):
    rows = [(i, f"d{i % 2}" if i % 7 else None, float((i * 7919) % 6_000)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, domain string, stored_at double")
    want = {r.id: r.strength for r in graphs.strongest_paths(pairs.association_edges(df), 8, 4).collect()}
    got = {r.id: r.strength for r in graphs.association_strongest_paths(df, 8, 4).collect()}
    assert got == want and len(want) > 10
