"""Language identification by rank-order n-gram profiles (out-of-place distance).

A text is folded to lower-case letters with every run of other characters as one boundary;
its 1- to 3-grams, 21 bits a letter, are ranked by frequency (ties by code) and the ``PROFILE`` most frequent are
compared with each language's ranked profile. A gram the profile lacks costs ``PROFILE``.

Defined cases: null text or one without a letter gives ``und`` with score 0; learning skips
null languages and texts; no learned language gives ``und`` for all; repeated rows are
predicted alike; an empty table gives an empty result; extra columns pass through; languages as
near as each other go by name. Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import small_batches

#: Grams in a profile.
PROFILE = 300
#: Below this score a text is taken for no language at all (stage of the pipeline).
MIN_SCORE = 0.2
_ALPHA: np.ndarray | None = None


def _alpha() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, else the code point and 2."""
    global _ALPHA
    if _ALPHA is None:
        ok = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _ALPHA = np.where(ok, np.arange(2, 0x110002), 0).astype(np.uint32)
    return _ALPHA


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the text's 1- to 3-grams. A boundary's symbol is 1, so shorter grams have
    smaller codes and no two are the same."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _alpha()[cp]
    s = np.concatenate(([0], s, [0])).astype(np.int64)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = s[keep]
    if len(s) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one = s[s != 0]
    s[s == 0] = 1
    two = s[:-1] << 21 | s[1:]
    g = np.sort(np.concatenate((one, two, two[:-1] << 21 | s[2:])))
    at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[at], np.diff(np.append(at, len(g)))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[int]]:
    """Profiles from all rows of docs with a text and a language: lang -> gram codes by rank.

    Counts are summed per partition, then over the cluster; only PROFILE grams a language reach
    the driver.
    """
    small_batches(docs.sparkSession)

    def count(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for name, texts in pdf.groupby("lang").text:
                got = [grams(x) for x in texts] + [held.get(name, (np.empty(0, np.int64), np.empty(0, np.int64)))]
                codes, inv = np.unique(np.concatenate([g for g, _ in got]), return_inverse=True)
                held[name] = codes, np.bincount(inv, np.concatenate([c for _, c in got]), len(codes)).astype(np.int64)
        for name, (codes, n) in held.items():
            yield pd.DataFrame({"lang": name, "gram": codes, "n": n})

    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    top = (rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
           .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= PROFILE))
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def classifier(profiles: dict[str, list[int]]):
    """text -> (language, score): score = 1 - distance / largest possible distance."""
    names = sorted(profiles)
    known = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    rank = np.full((len(known) + 1, len(names)), -1, np.int64)
    for j, name in enumerate(names):
        rank[np.searchsorted(known, np.array(profiles[name], np.int64)), j] = np.arange(len(profiles[name]))

    def classify(text: str | None) -> tuple[str, float]:
        codes, n = grams(text)
        if not len(codes) or not names:
            return "und", 0.0
        # The most frequent, ties by code.
        order = np.argsort(-n, kind="stable")[:PROFILE]
        top = codes[order]
        at = np.minimum(np.searchsorted(known, top), len(known) - 1)
        r = rank[np.where(known[at] == top, at, len(known))]
        gap = np.minimum(np.where(r < 0, PROFILE, np.abs(r - np.arange(len(top))[:, None])), PROFILE).sum(0)
        best = int(gap.argmin())
        return names[best], float(1 - gap[best] / (PROFILE * len(top)))

    return classify


def predict(text: Column, profiles: dict[str, list[int]]) -> Column:
    """struct<lang_pred string, score double> for a text column."""
    made = []

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def tell(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(classifier(profiles))
        return pd.DataFrame([made[0](x) for x in texts], columns=["lang_pred", "score"])

    return tell(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Learns from rows not held out."""
    profiles = learn(docs.filter(~held_out(F.col("doc_id"))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), profiles).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Pipeline stage: drops documents that are no language at all (no letters, or far from
    every profile); all columns of docs come back."""
    profiles = learn(docs.filter(~held_out(F.col("doc_id"))))
    cols = docs.columns
    tagged = docs.withColumn("__rc_lang", predict(F.col("text"), profiles))
    return tagged.filter((F.col("__rc_lang.lang_pred") != "und") & (F.col("__rc_lang.score") >= min_score)).select(*[F.col(f"`{c}`") for c in cols])
