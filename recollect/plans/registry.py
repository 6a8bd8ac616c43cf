"""Queries over the driver's tables and the SQL that gives the same rows.

Doubles are rounded to six places on both sides, as sums depend on their order in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from recollect.functions import text as tx

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select([(tx.rounded(F.col(f"`{f.name}`"), 6) + 0.0).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def register(name: str, source: Callable, operator: Callable, sql: str | None = None, doubles: str = "") -> None:
    """source(spark, sf_dir) gives the input of operator; doubles names the columns to round in SQL."""
    QUERIES[name] = lambda spark, sf_dir: rounded(operator(source(spark, sf_dir)))
    if sql:
        each = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split())
        ORACLE_SQL[name] = f"SELECT * {f'REPLACE ({each})' if each else ''} FROM ({sql})"


for _family in ("q_profiles", "q_retrieval", "q_windows", "q_pairs", "q_lifecycle", "q_stream", "q_advisors", "q_graphs", "q_records", "q_recall", "q_knowledge", "q_condense", "q_detail", "q_index", "q_multihop", "q_splitting", "q_groups", "q_bus", "q_answers", "q_hypotheses"):
    import_module(f"recollect.plans.{_family}")
