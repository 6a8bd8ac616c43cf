"""Rows that stand on a threshold or on half of the last place, against SQL."""

import duckdb
import pytest

from recollect.plans import registry


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """documents and labels of 10,000 numbers: their folder, and DuckDB over it."""
    d, con = str(tmp_path_factory.mktemp("sf")), duckdb.connect()
    con.execute(f"COPY (SELECT i AS doc_id, 'a text' AS text, 'l' || i % 1000 AS lang, 's' || i % 3 AS source, 6 AS n_chars FROM range(10000) r(i)) TO '{d}/documents.parquet'")
    con.execute(f"COPY (SELECT i AS doc_id, 1 AS quality, 0 AS toxic FROM range(10000) r(i) WHERE i % 3 < 2) TO '{d}/labels.parquet'")
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return d, con


@pytest.mark.parametrize("name", ["open_threads", "tier_promotion"])
def test_scores_on_a_threshold(spark, whole, name):
    d, con = whole
    cur = con.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    got = [tuple(r) for r in registry.QUERIES[name](spark, d).select(*cols).collect()]
    assert sorted(got, key=repr) == sorted(cur.fetchall(), key=repr)


def test_halves_of_the_last_place(spark):
    x = [(2 * k + 1) / 2e6 * s for k in range(5_000) for s in (1, -1)]
    got = [r.x for r in registry.rounded(spark.createDataFrame([(v,) for v in x], "x double").coalesce(1)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] + 0.0 for v in x]
