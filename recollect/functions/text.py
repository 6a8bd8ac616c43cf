"""Tokenizers and set measures, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the profile operators.
STOP = "a an the and or in on to for of with by from is was are be it this that as at but not so if do did has have had will would could should may might".split()
PUNCT = ".,!?;:\"'()"


def words(c: Column) -> Column:
    """Lower-cased runs of other than white space, in order (T0)."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def stripped(c: Column) -> Column:
    """Words without punctuation at their ends, empty ones left out."""
    return F.filter(F.transform(words(c), lambda w: F.trim(w, F.lit(PUNCT))), lambda w: w != "")


def alnum(c: Column) -> Column:
    """Runs of [a-z0-9] of the lower-cased text (T1)."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def keywords(c: Column, least: int = 4) -> Column:
    """Stripped words of at least ``least`` characters that are no stop words (T5, T6)."""
    return F.filter(stripped(c), lambda w: (F.length(w) >= least) & ~w.isin(STOP))


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard similarity of two arrays, 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def hits(tokens: Column, lexicon: list[str]) -> Column:
    """Number of tokens (with repeats) in the lexicon."""
    return F.size(F.filter(tokens, lambda w: w.isin(list(lexicon))))


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles, by 0 too: infinite, or no number for 0 / 0."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def rounded(c: Column, places: int) -> Column:
    """c to so many places, halves away from zero, by scaling: SQL's way, which decides what stands on
    a half by the scaled double; F.round does by the shortest decimal. What is too great to be scaled
    stays as it is."""
    scale = float(10**places)
    r = F.round(c * scale, 0) / scale
    return F.when(F.abs(r) < float("inf"), r).otherwise(c)


def trigrams(c: Column) -> Column:
    """Distinct character trigrams of the lower-cased text, in one pass over its characters."""
    chars = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("(?s)."), 0)

    def runs(x: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 3, F.lit(0))), lambda i: F.concat(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)))
        return F.when(F.size(x) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(every))

    return F.transform(F.array(chars), runs)[0]


def token_estimate(c: Column) -> Column:
    """int(1.3 * words)."""
    return F.floor(F.size(words(c)) * 1.3).cast("int")


#: The same tokenizers in DuckDB, as format strings over a column.
SQL_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '\\s+'), lambda w: w <> '')"
SQL_STRIPPED = "list_filter(list_transform(" + SQL_WORDS + ", lambda w: trim(w, '.,!?;:\"''()')), lambda w: w <> '')"
SQL_KEYWORDS = "list_filter(" + SQL_STRIPPED + ", lambda w: length(w) >= {least} AND w NOT IN (" + ", ".join(f"'{s}'" for s in STOP) + "))"
SQL_ALNUM = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"
