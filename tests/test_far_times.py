"""Records long after the present: recency grows beyond what six places can be scaled to, then to infinity."""

import math

import duckdb
import pytest

from recollect.plans import registry

IDS = [0, 7, 34_007, 250_003, 330_003, 330_009, 462_048, 464_096, 466_356, 599_998, 599_999]


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("far"))
    ids = "FROM (SELECT unnest([" + ", ".join(map(str, IDS)) + "])::BIGINT AS i)"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS doc_id, 'the stock market thing ' || i AS text, 'en' AS lang, 'src' || i % 3 AS source, 20::BIGINT AS n_chars {ids}) TO '{d}/documents.parquet'")
    con.execute(f"COPY (SELECT i AS doc_id, (i % 2)::INT AS quality, 0 AS toxic {ids} WHERE i % 5 = 0) TO '{d}/labels.parquet'")
    con.execute(f"COPY (SELECT i AS vec_id, list_transform(range(64), lambda x: (x + i) % 5)::FLOAT[] AS embedding {ids}) TO '{d}/embeddings.parquet'")
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return d, con


def norm(v):
    return float(f"{v:.7g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["item_decay", "adaptive_five_arms", "staleness", "temporal_strategy", "token_eviction"])
def test_great_values_stay(spark, far, name):
    d, con = far
    df, sql = registry.QUERIES[name](spark, d), con.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in sql.description]
    got, want = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()), sorted(tuple(map(norm, r)) for r in sql.fetchall())
    assert got == want
    great = [abs(v) for r in want for v in r if isinstance(v, float) and abs(v) > 1e303]
    assert any(math.isinf(v) for v in great) and not all(math.isinf(v) for v in great)
