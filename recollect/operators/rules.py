"""Record-at-a-time rules: scalar functions, observers and checks, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from recollect.functions import lexicons as lex
from recollect.functions import text as tx


def content_similarity(a: Column, b: Column) -> Column:
    """.6 Jaccard of words + .4 Jaccard of character trigrams."""
    return 0.6 * tx.jaccard(F.array_distinct(tx.words(a)), F.array_distinct(tx.words(b))) + 0.4 * tx.jaccard(tx.trigrams(a), tx.trigrams(b))


def top_keywords(df: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent words of three letters at least, first seen first on ties."""
    t = df.select("id", F.posexplode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{3,}"), 0)).alias("p", "tok")).filter(~F.col("tok").isin(tx.STOP))
    g = t.groupBy("id", "tok").agg(F.count("*").alias("n"), F.min("p").alias("first"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "first"))).filter(F.col("r") <= k).select("id", "tok", "n", F.col("r").cast("int").alias("rank"))


def quality_filter(df: DataFrame) -> DataFrame:
    """At least 20 characters, 5 words, and 30 % distinct words."""
    w = tx.words(F.col("content"))
    return df.select("id", F.length("content").alias("chars"), w.alias("w")).filter((F.col("chars") >= 20) & (F.size("w") >= 5) & (F.size(F.array_distinct("w")) >= 0.3 * F.size("w"))).select("id")


def fingerprint(c: Column) -> Column:
    """md5 of the first 20 sorted distinct words without punctuation."""
    w = F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9\\s]", ""), "\\s+"), lambda x: x != "")))
    return F.md5(F.concat_ws(" ", F.slice(w, 1, 20)).cast("binary"))


def importance_score(df: DataFrame) -> DataFrame:
    """.2 entities + .2 novelty + .15 emotion + .1 length + .2 key words + .15 structure."""
    w = tx.stripped(F.col("content"))
    raw = F.filter(F.split("content", "\\s+"), lambda x: x != "")
    n = F.greatest(F.size(w), F.lit(1))
    entity = F.least(F.lit(1.0), F.size(F.filter(raw, lambda x: x.rlike("^[A-Z]"))) / n * 3)
    key = F.least(F.lit(1.0), tx.hits(w, lex.words(lex.PRESCRIPTIVE + " " + lex.CAUSAL + " " + lex.ACTIONS)) / 3.0)
    emotion = F.least(F.lit(1.0), F.abs("valence") + 0.5 * F.col("intensity"))
    structure = F.when(F.col("content").contains("\n"), 0.5).otherwise(0.0) + F.when(F.col("content").rlike("[0-9]"), 0.5).otherwise(0.0)
    return df.select("id", (0.2 * entity + 0.2 * F.col("novelty") + 0.15 * emotion + 0.1 * F.least(F.lit(1.0), n / 50.0) + 0.2 * key + 0.15 * structure).alias("importance"))


def elapsed_feel(seconds: Column) -> Column:
    """A phrase for a span of time, by nine thresholds."""
    steps = ((60, "just now"), (600, "a few minutes ago"), (3600, "within the hour"), (21600, "earlier today"), (86400, "today"), (172800, "yesterday"), (604800, "this week"), (2592000, "this month"), (31536000, "this year"))
    out = None
    for limit, name in steps:
        out = F.when(seconds < limit, name) if out is None else out.when(seconds < limit, name)
    return out.otherwise("long ago")


def parse_props(events: DataFrame) -> DataFrame:
    """The JSON column of events as typed columns."""
    return events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


def api_records(raw: DataFrame) -> DataFrame:
    """Records of REST answers: lists under the first known key, text by the first known field.

    raw has id and body (JSON).
    """
    item = "array<struct<content:string,text:string,description:string,title:string>>"
    keys = ("articles", "results", "data", "items", "entries")  # fixed order of lookup
    body = F.from_json("body", "struct<" + ",".join(f"{k}:{item}" for k in keys) + ">")
    found = raw.select("id", F.posexplode(F.coalesce(*[body[k] for k in keys])).alias("pos", "r"))
    return found.select("id", "pos", F.coalesce("r.content", "r.text", "r.description", "r.title").alias("content")).filter("content IS NOT NULL")


def feed_records(raw: DataFrame) -> DataFrame:
    """Items of RSS and Atom documents (id, body): 'title. description', empty ones left out."""
    items = raw.select("id", F.posexplode(F.regexp_extract_all("body", F.lit("(?s)<(?:item|entry)\\b.*?</(?:item|entry)>"), 0)).alias("pos", "x"))
    tag = lambda *names: F.coalesce(*[F.nullif(F.trim(F.regexp_extract("x", f"(?s)<{n}\\b[^>]*>(?:<!\\[CDATA\\[)?(.*?)(?:\\]\\]>)?</{n}>", 1)), F.lit("")) for n in names])
    t = items.select("id", "pos", tag("title").alias("t"), tag("description", "summary", "content").alias("d"))
    return t.select("id", "pos", F.concat_ws(". ", "t", "d").alias("content")).filter("content <> ''")


def observe_tools(calls: DataFrame) -> DataFrame:
    """Tool calls (id, tool_name, tool_input map, tool_response) as records: type, files, importance."""
    name = F.lower("tool_name")
    kind = F.when(name.isin("edit", "write", "multiedit"), "change").when(name.isin("read", "grep", "glob", "ls"), "discovery").when(name == "bash", "command").otherwise("observation")
    files = F.array_compact(F.array(F.col("tool_input")["file_path"], F.col("tool_input")["path"]))
    failed = F.lower("tool_response").rlike("error|failed|exception")
    return calls.select("id", kind.alias("obs_type"), files.alias("files"), F.concat_ws(" ", F.col("tool_name"), F.try_element_at(files, F.lit(1))).alias("title"),
                        F.when(failed, 0.8).when(kind == "change", 0.7).when(kind == "command", 0.5).otherwise(0.3).alias("importance"))


def verify_steps(steps: DataFrame) -> DataFrame:
    """Issues of reasoning steps (chain, step, text): circular, non sequitur, absolute wording."""
    w = Window.partitionBy("chain").orderBy("step")
    t = steps.select("chain", "step", F.array_distinct(tx.stripped(F.col("text"))).alias("t"))
    s = t.withColumn("overlap", tx.jaccard(F.col("t"), F.coalesce(F.lag("t").over(w), F.array().cast("array<string>")))).withColumn("first", F.row_number().over(w) == 1)
    issue = lambda cond, name: F.when(cond, F.lit(name))
    words = "always never all none every impossible certainly obviously"
    found = F.array_compact(F.array(issue(~F.col("first") & (F.col("overlap") > 0.8), "circular"), issue(~F.col("first") & (F.col("overlap") < 0.05), "non_sequitur"), issue(F.arrays_overlap("t", F.array(*map(F.lit, words.split()))), "absolute")))
    return s.select("chain", "step", F.explode(found).alias("issue"))


def hash_embedding(dim: int = 128):
    """A deterministic embedding as a pandas UDF (hashing needs whole 128- and 256-bit numbers):
    character 2- to 4-grams, words, pairs of words, scaled to length 1.

    Each distinct gram, word and pair of a batch is hashed once.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts):
        import hashlib
        from math import cos, sin

        import numpy as np
        import pandas as pd

        met: dict[tuple[str, str], tuple[tuple[int, float], ...]] = {}

        def parts(kind, s):
            if (got := met.get((kind, s))) is None:
                h = int((hashlib.sha256 if kind == "word" else hashlib.md5)(s.encode("utf-8", "surrogatepass")).hexdigest(), 16)
                if kind == "gram":
                    got = (h % dim, cos(h * 0.0001)), ((h + 1) % dim, sin(h * 0.0001))
                elif kind == "word":
                    got = tuple(((h + o * 31) % dim, 1.0 / (1 + o * 0.3)) for o in (0, 3, 7, 13))
                else:
                    got = (h % dim, 0.8), ((h + 5) % dim, 0.4)
                met[kind, s] = got
            return got

        def one(text):
            v, low = np.zeros(dim), (text or "").lower().strip()
            words = [w for w in low.split() if len(w) >= 2]
            keys = [("gram", low[i:i + n]) for n in (2, 3, 4) for i in range(len(low) - n + 1)] + [("word", w) for w in words] + [("pair", f"{a}_{b}") for a, b in zip(words, words[1:])]
            pairs = [p for k in keys for p in parts(*k)]
            if pairs:
                np.add.at(v, [i for i, _ in pairs], [x for _, x in pairs])
            norm = np.linalg.norm(v)
            return (v / norm if norm else v).tolist()

        return pd.Series([one(t) for t in texts])

    return embed


def temporal_awareness(df: DataFrame) -> DataFrame:
    """+1 for records that speak of time passing, -1 for claims of timelessness, else 0; the mean."""
    c = F.lower("content")
    s = F.when(c.rlike("\\b(yesterday|tomorrow|before|after|since|ago|version|license)\\b"), 1).when(c.rlike("\\b(always|never|forever)\\b"), -1).otherwise(0)
    return df.agg(F.avg(s.cast("double")).alias("awareness"), F.count("*").alias("n"))


def financial_valence(df: DataFrame, scale: float = 100.0) -> DataFrame:
    """Valence, importance and volatility band of profits and losses (id, pnl)."""
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("pnl") / scale))
    return df.select("id", v.alias("valence"), (0.5 + 0.4 * F.tanh(F.abs("pnl") / (scale / 2))).alias("importance"),
                     F.when(F.abs("pnl") < 10, "calm").when(F.abs("pnl") < 30, "mild").when(F.abs("pnl") < 60, "active").when(F.abs("pnl") < 120, "high").otherwise("extreme").alias("band"))


def calibration(df: DataFrame) -> DataFrame:
    """By domain of predictions (domain, confidence, outcome 0/1): Brier score, bias, accuracy."""
    d = F.col("confidence") - F.col("outcome")
    return df.groupBy("domain").agg(F.avg(d * d).alias("brier"), F.avg(d).alias("bias"), F.avg(((F.col("confidence") >= 0.5).cast("int") == F.col("outcome")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def task_queue(df: DataFrame, k: int = 20) -> DataFrame:
    """Priorities .3 urgency (sigmoid of the deadline) + .3 importance + .25 novelty + .15 staleness."""
    urgency = 1 / (1 + F.exp((F.col("deadline_hours") - 24) / 8))
    s = 0.3 * urgency + 0.3 * F.col("importance") + 0.25 * F.col("novelty") + 0.15 * F.least(F.lit(1.0), F.col("idle_hours") / 48)
    return df.withColumn("priority", s).orderBy(F.desc("priority"), "id").limit(k).select("id", "priority")
