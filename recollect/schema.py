"""The record model and the adapters from source tables to it.

A memory is one row; ``store_seq`` gives the order that all ties follow. Times are epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every operator that depends on the present takes it as a parameter; queries use this one.
AS_OF = 1_705_000_000.0
DAY = 86_400.0

#: Order of the tiers in a scan.
TIERS = ("working", "short_term", "long_term", "semantic")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as memories; what the tables lack is derived from doc_id."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").selectExpr(
        "doc_id AS id", "doc_id AS store_seq", "text AS content", "source AS domain", "lang AS namespace",
        # decimals, as sums of doubles miss the last place that thresholds and ranks meet
        "CAST(coalesce(0.3BD + 0.6BD * quality, 0.1BD + (doc_id % 10) * 0.08BD) AS double) AS importance",
        "coalesce((1 - 2 * toxic) * 0.5D, ((doc_id * 7) % 21 - 10) / 12.5D) AS valence",
        "(doc_id % 9) / 10.0D AS intensity", "((doc_id * 3) % 11) / 10.0D AS novelty",
        "0.05D + (doc_id % 19) / 20.0D AS strength", "CAST(doc_id % 7 AS INT) AS access_count",
        "CASE doc_id % 4 WHEN 0 THEN 'working' WHEN 1 THEN 'short_term' WHEN 2 THEN 'long_term' ELSE 'semantic' END AS tier",
        "1700000000.0D + doc_id * 180.0D + (doc_id DIV 50) * 1000.0D AS stored_at",
        "1700000000.0D + doc_id * 180.0D + (doc_id DIV 50) * 1000.0D + (doc_id % 13) * 3600.0D AS last_accessed",
        "CASE WHEN doc_id % 17 = 0 THEN 1700000000.0D + doc_id * 181.0D END AS expires_at",
        "CASE WHEN doc_id % 23 = 0 THEN doc_id - 1 END AS superseded_by",
        "CASE doc_id % 6 WHEN 0 THEN 'bugfix' WHEN 1 THEN 'feature' WHEN 2 THEN 'discovery' WHEN 3 THEN 'decision' END AS obs_type",
        "doc_id % 29 = 0 AS private", "doc_id % 31 = 0 AS pinned", "CAST(1.0BD - (doc_id % 5) * 0.1BD AS double) AS confidence")


MEM_SQL = """mem AS (
  SELECT d.doc_id AS id, d.doc_id AS store_seq, d.text AS content, d.source AS domain, d.lang AS namespace,
    coalesce(0.3 + 0.6 * quality, 0.1 + (d.doc_id % 10) * 0.08)::DOUBLE AS importance,
    coalesce((1 - 2 * toxic) * 0.5, ((d.doc_id * 7) % 21 - 10) / 12.5)::DOUBLE AS valence,
    ((d.doc_id % 9) / 10.0)::DOUBLE AS intensity, (((d.doc_id * 3) % 11) / 10.0)::DOUBLE AS novelty,
    (0.05 + (d.doc_id % 19) / 20.0)::DOUBLE AS strength, (d.doc_id % 7)::INT AS access_count,
    CASE d.doc_id % 4 WHEN 0 THEN 'working' WHEN 1 THEN 'short_term' WHEN 2 THEN 'long_term' ELSE 'semantic' END AS tier,
    (1700000000.0 + d.doc_id * 180.0 + (d.doc_id // 50) * 1000.0)::DOUBLE AS stored_at,
    (1700000000.0 + d.doc_id * 180.0 + (d.doc_id // 50) * 1000.0 + (d.doc_id % 13) * 3600.0)::DOUBLE AS last_accessed,
    CASE WHEN d.doc_id % 17 = 0 THEN (1700000000.0 + d.doc_id * 181.0)::DOUBLE END AS expires_at,
    CASE WHEN d.doc_id % 23 = 0 THEN d.doc_id - 1 END AS superseded_by,
    CASE d.doc_id % 6 WHEN 0 THEN 'bugfix' WHEN 1 THEN 'feature' WHEN 2 THEN 'discovery' WHEN 3 THEN 'decision' END AS obs_type,
    d.doc_id % 29 = 0 AS private, d.doc_id % 31 = 0 AS pinned, (1.0 - (d.doc_id % 5) * 0.1)::DOUBLE AS confidence
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
)"""


def documents_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents_as_memories with what richer records hold: embeddings (by id, where there is one),
    sessions, files, tags, titles, facts and provenance, derived from the id."""
    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "CAST(embedding AS array<double>) AS embedding")
    return documents_as_memories(spark, sf_dir).join(vectors, "id", "left").selectExpr(
        "*", "concat('s', id DIV 40) AS session_id", "array(concat('src/f', id % 7, '.py')) AS files_read",
        "CASE WHEN id % 3 = 0 THEN array(concat('lib/m', id % 5, '.py')) ELSE CAST(array() AS array<string>) END AS files_modified",
        "CASE id % 4 WHEN 0 THEN array('how-it-works') WHEN 1 THEN array('gotcha', 'pattern') ELSE CAST(array() AS array<string>) END AS concept_tags",
        "CASE WHEN id % 3 = 1 THEN concat('note ', id) END AS title", "CASE WHEN id % 6 = 1 THEN array(concat('fact ', id), 'more') ELSE CAST(array() AS array<string>) END AS facts",
        "CASE id % 8 WHEN 5 THEN 'inference' WHEN 6 THEN 'hearsay' WHEN 7 THEN 'reflection' ELSE 'observation' END AS epistemic_type",
        "CASE WHEN id % 16 IN (5, 6) THEN stored_at + 86400.0D END AS verified_at")


REC_SQL = """rec AS (
  SELECT m.*, e.embedding::DOUBLE[] AS embedding, 's' || (id // 40) AS session_id, ['src/f' || (id % 7) || '.py'] AS files_read,
    CASE WHEN id % 3 = 0 THEN ['lib/m' || (id % 5) || '.py'] ELSE []::VARCHAR[] END AS files_modified,
    CASE id % 4 WHEN 0 THEN ['how-it-works'] WHEN 1 THEN ['gotcha', 'pattern'] ELSE []::VARCHAR[] END AS concept_tags,
    CASE WHEN id % 3 = 1 THEN 'note ' || id END AS title, CASE WHEN id % 6 = 1 THEN ['fact ' || id, 'more'] ELSE []::VARCHAR[] END AS facts,
    CASE id % 8 WHEN 5 THEN 'inference' WHEN 6 THEN 'hearsay' WHEN 7 THEN 'reflection' ELSE 'observation' END AS epistemic_type,
    CASE WHEN id % 16 IN (5, 6) THEN stored_at + 86400.0 END AS verified_at
  FROM mem m LEFT JOIN embeddings e ON e.vec_id = m.id
)"""


def events_as_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as memories: one domain an event type, one session a user."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "event_id AS store_seq", "event_type AS domain", "user_id AS session_id",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1000000.0D AS stored_at", "value", "greatest(-1.0D, least(1.0D, (value - 50.0D) / 60.0D)) AS valence",
        "least(1.0D, 0.1D + value / 150.0D) AS importance", "least(1.0D, value / 200.0D) AS intensity",
        "0.1D + (event_id % 17) / 20.0D AS strength", "CAST(event_id % 6 AS INT) AS access_count", "props")


EV_SQL = """ev AS (
  SELECT event_id AS id, event_id AS store_seq, event_type AS domain, user_id AS session_id, epoch_us(ts) / 1000000.0 AS stored_at, value,
    greatest(-1.0, least(1.0, (value - 50.0) / 60.0))::DOUBLE AS valence, least(1.0, 0.1 + value / 150.0)::DOUBLE AS importance,
    least(1.0, value / 200.0)::DOUBLE AS intensity, (0.1 + (event_id % 17) / 20.0)::DOUBLE AS strength, (event_id % 6)::INT AS access_count, props
  FROM events
)"""


#: What a report says, by its number; {a} and {b} stand for two words that its event names.
REPORTS = (
    "The {a} team should verify the {b} report before release.", "Slow {a} causes long {b} queues.", "Better {b} reduces {a} errors.", "Growing {a} increases {b} costs.",
    "We always trust our {a} and never question the {b}.", "The {a} plan failed and the {b} work was lost.", "Nobody should avoid {a} when {b} tests are required.",
    "It was obvious that {a} would succeed, certainly a win for {b}.", "Justice and duty: a right rule must be right for {a} and {b}.", "Honest, brave and kind: {a} keeps {b} loyal, just and prudent.",
    "An uncertain {b} outcome made the {a} group unsure.", "The first {a} estimate remains the baseline for {b}.", "Hostile {b} traffic attacked the {a} service, an unsafe state.",
    "The {a} request was rejected and the {b} ticket ignored.", "Caching enables {a} for every {b}.", "Strict {a} prevents {b} and never reduces trust.", "We must build {a} and test {b} to improve the result.",
    "The {b} audit confirms what {a} reports validates as expected.", "Already invested in {a}, they continue to persist with {b}.",
)
SUBJECTS = "cache index queue router backup ledger parser planner monitor gateway sensor archive scheduler".split()


def events_as_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as memories in words: a sentence of REPORTS about two SUBJECTS, chosen by the event's numbers."""
    lit = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")"
    ev = events_as_memories(spark, sf_dir).selectExpr(
        "* EXCEPT (domain, props)", "concat(domain, '-', session_id % 20) AS domain", f"element_at({lit(REPORTS)}, CAST((id * 7 + session_id) % {len(REPORTS)} AS INT) + 1) AS said",
        f"element_at({lit(SUBJECTS)}, CAST(id % {len(SUBJECTS)} AS INT) + 1) AS a", f"element_at({lit(SUBJECTS)}, CAST((id + 1 + session_id % {len(SUBJECTS) - 1}) % {len(SUBJECTS)} AS INT) + 1) AS b")
    return ev.selectExpr("* EXCEPT (said, a, b, session_id)", "replace(replace(said, '{a}', a), '{b}', b) AS content", "domain AS namespace", "session_id",
                         "CASE id % 4 WHEN 0 THEN 'working' WHEN 1 THEN 'short_term' WHEN 2 THEN 'long_term' ELSE 'semantic' END AS tier", "(id * 3 % 11) / 10.0D AS novelty")


def _reports_sql() -> str:
    lit = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    n = len(SUBJECTS)
    return f"""{EV_SQL}, said AS (SELECT *, {lit(REPORTS)}[(id * 7 + session_id) % {len(REPORTS)} + 1] AS said, {lit(SUBJECTS)}[id % {n} + 1] AS a, {lit(SUBJECTS)}[(id + 1 + session_id % {n - 1}) % {n} + 1] AS b FROM ev), mem AS (
  SELECT id, store_seq, domain || '-' || session_id % 20 AS domain, session_id, stored_at, value, valence, importance, intensity, strength, access_count, replace(replace(said, '{{a}}', a), '{{b}}', b) AS content,
    domain || '-' || session_id % 20 AS namespace, CASE id % 4 WHEN 0 THEN 'working' WHEN 1 THEN 'short_term' WHEN 2 THEN 'long_term' ELSE 'semantic' END AS tier, (id * 3 % 11) / 10.0 AS novelty FROM said
)"""


#: events_as_reports, under the name mem.
REPORTS_SQL = _reports_sql()


def live(df: DataFrame, as_of: float = AS_OF) -> DataFrame:
    """Records neither expired nor superseded."""
    return df.filter((F.col("expires_at").isNull() | (F.lit(as_of) <= F.col("expires_at"))) & F.col("superseded_by").isNull())


LIVE_SQL = f"(expires_at IS NULL OR {AS_OF} <= expires_at) AND superseded_by IS NULL"
