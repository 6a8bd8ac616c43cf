"""The Merkle manifest against a plain recursion."""

import hashlib

import pytest
from pyspark.sql import functions as F

from recollect.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r) -> str:
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def path(nodes: list[str], at: int) -> tuple[str, list[tuple[str, str]]]:
    """Root of nodes, and what stands beside node `at` and its ancestors."""
    if len(nodes) == 1:
        return nodes[0], []
    first = at // 16 * 16
    run = nodes[first:first + 16]
    root, rest = path([H("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)], at // 16)
    return root, [("".join(run[:at - first]), "".join(run[at - first + 1:])), *rest]


def plain(rows, changed):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    tops = [path([leaf_of(r) for r in groups[s]], 0)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        leaves = [leaf_of(r) for r in groups[s]]
        root, upper = path(tops, k)
        for i, r in enumerate(groups[s]):
            sub, lower = path(leaves, i)
            acc = leaf_of(changed(r))
            for a, b in lower + upper:
                acc = H(a + acc + b)
            out.append((r[0], leaves[i], sub, root, H("".join(a + b for a, b in lower + upper)), acc, acc == root))
    return sorted(map(repr, out))


def upper_a(r):
    return (*r[:4], r[4].replace("A", "a")) if r[4] is not None and r[0] is not None and r[0] % 5 == 0 else r


ODD = [(None, "zz", None, None, "X"), (3, "é", None, 1, "q"), (3, "é", None, 1, "q"), (4, "", "", 0, ""), (5, "￿", "x", 9, "A" * 100_000), (6, "\U0001f600", "x", 9, "A\x00"), (None, None, None, None, None)]


@pytest.mark.parametrize("rows", [
    [(i // 2, None if i % 7 == 0 else "hot" if i % 3 else "b", None, i, None if i % 11 == 0 else "Ab" * (i % 9)) for i in range(600)] + ODD,
    [(i, f"s{i}", "x", i, "A") for i in range(40)], [(1, "s", None, None, "A")], [(i, "s", None, 2, "A") for i in range(17)]])
def test_manifest_equals_the_plain_recursion(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("idx", F.lit(1)).withColumn("total", F.lit("x"))
    got = merkle.manifest(docs, F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("A"), F.lit("a"))).otherwise(F.col("text")))
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(rows, upper_a)


def test_untouched_rows_verify_and_any_change_shows(spark):
    rows = [(i, f"s{i % 3}", "en", 5, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert merkle.manifest(docs).filter("verified").count() == 100
    assert [r.doc_id for r in merkle.manifest(docs, F.when(F.col("doc_id") == 41, F.lit("text 41 ")).otherwise(F.col("text"))).filter("NOT verified").collect()] == [41]


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_partitions_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    one = sorted(map(tuple, merkle.manifest(docs).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert sorted(map(tuple, merkle.manifest(docs.repartition(5)).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
