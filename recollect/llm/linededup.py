"""Removal of repeated runs of lines, found by winnowing, in DataFrame functions only.

1. A text's non-blank lines are hashed, twice. The gram at a line is the hash of the fewest lines
   from there on that hold ``NOISE`` words.
2. Winnowing: among the grams that start within ``WINDOW`` words of a line the smallest is a
   fingerprint. Equal runs of ``NOISE + WINDOW - 1`` words contain equal windows, so every
   repeated run of that length shares at least one fingerprint (the guarantee). Only fingerprints
   that stand at two places go on.
3. Their positions are joined where the text around agrees: the shortest run of
   ``NOISE + WINDOW - 1`` words from a line of the fingerprint's window on, and the shortest one that
   ends at a line, as a repeated run's last lines may start none of that length. Each place of a
   run is joined with its first one, in the order of (doc_id, line). A place joined with the next
   occurrence of its fingerprint alone would miss runs: that one may share less than another.
4. Matches extend both ways: joined runs of two documents whose lines are equally far apart
   are on one diagonal, and those that overlap or touch make one match, as long as it goes.
5. The lines of all later places are deleted. Each deleted line equals one that stands earlier, so
   the first copy of everything stays.

A line of a repeated run either starts a shortest run within it or lies in the shortest one that
ends where it ends, so exactly the lines of all repeated runs of that length are deleted.

Words are counted by spaces, a line has one at least. Lines are compared without spaces at
their ends. Blank lines between deleted lines stay as they are. Documents and runs are told apart
by 128 bits: runs by a hash of their lines' hashes and the sum without carry of others of them.

Defined cases: null text has no lines and stays null; rows equal in doc_id and text count as one
document and are cut alike; a null doc_id sorts first; repeats within a document count too; an
empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import discard, materialize

NOISE, WINDOW = 25, 26


def document_key() -> Column:
    """128 bits that tell documents apart by doc_id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary")))


def lines_of(docs: DataFrame) -> DataFrame:
    """Per non-blank line: key, doc_id, pos (in the text), n (among non-blank ones), start (words
    before it), h, words; one set for rows equal in doc_id and text."""
    part = docs.filter("text IS NOT NULL").select(document_key().alias("key"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    part = part.select("key", "doc_id", "pos", F.trim("line").alias("line")).filter("line <> ''").select(
        "key", "doc_id", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("words"))
    once = part.repartition("key").groupBy("key", "pos").agg(F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), F.first("g").alias("g"), F.first("words").alias("words"))
    w = Window.partitionBy("key").orderBy("pos")
    return once.select("key", "doc_id", "pos", F.row_number().over(w).alias("n"), (F.sum("words").over(w) - F.col("words")).alias("start"), "h", "g", "words")


def fingerprints(lines: DataFrame, noise: int, window: int) -> DataFrame:
    """Per line: key, doc_id, n, start, h, words, f (n and gram of its window's fingerprint, null if none)."""
    ahead = Window.partitionBy("key").orderBy("start")
    span = ahead.rangeBetween(0, noise - 1)
    grams = lines.select("key", "doc_id", "n", "start", "h", "g", "words", F.when(F.sum("words").over(span) >= noise, F.xxhash64(F.collect_list("h").over(span))).alias("gram"))
    least = F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", "n"))).over(ahead.rangeBetween(0, window - 1))
    return grams.select("key", "doc_id", "n", "start", "h", "g", "words", least.alias("f"))


def shortest_runs(lines: DataFrame, noise: int, window: int) -> DataFrame:
    """Shortest runs of noise + window - 1 words from a line on or up to a line: key, doc_id, n
    (first line), last, run (hash of the lines), f (fingerprint of the first line's window)."""
    least = noise + window - 1
    marked = fingerprints(lines, noise, window).withColumn("end", F.col("start") + F.col("words"))
    on = Window.partitionBy("key").orderBy("start").rangeBetween(0, least - 1)
    upto = Window.partitionBy("key").orderBy("end").rangeBetween(1 - least, 0)
    run = lambda w: F.when(F.sum("words").over(w) >= least, F.struct(F.min(F.struct("n", "f")).over(w).alias("first"), F.max("n").over(w).alias("last"), F.xxhash64(F.collect_list("h").over(w)).alias("run"), F.bit_xor("g").over(w).alias("also")))
    # without its last line a run that also starts shortest is too short
    other = F.when(F.sum("words").over(upto) - F.col("words") >= least, run(upto))
    both = marked.select("key", "doc_id", run(on).alias("starts"), other.alias("ends")).select("key", "doc_id", F.explode(F.array_compact(F.array("starts", "ends"))).alias("r"))
    return both.select("key", "doc_id", F.col("r.first.n").alias("n"), "r.last", "r.run", "r.also", F.col("r.first.f").alias("f"))


def matches(docs: DataFrame, noise: int = NOISE, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(matches, lines). A match is a run of lines that stands earlier: key (hash of doc_id and text),
    n to last (its non-blank lines), of and at (document and line where it stands first)."""
    lines = materialize(lines_of(docs), "lines")
    every = shortest_runs(lines, noise, window).select("key", "doc_id", "n", "last", "run", "also", F.col("f.n").alias("at"), F.col("f.gram").alias("gram"))
    runs = materialize(every, "runs")
    shared = runs.select("key", "at", "gram").distinct().groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram")
    joined = materialize(runs.join(shared, "gram", "left_semi").select("key", "doc_id", "n", "last", "run", "also"), "candidates")
    first = joined.groupBy("run", "also").agg(F.min(F.struct("doc_id", "key", "n")).alias("first"), F.count("*").alias("c")).filter("c > 1").select("run", "also", F.col("first.key").alias("of"), F.col("first.n").alias("at"))
    later = joined.join(first, ["run", "also"]).filter("key <> of OR n <> at").select("key", "n", "last", "of", (F.col("n") - F.col("at")).alias("shift")).distinct()
    diagonal = Window.partitionBy("key", "of", "shift").orderBy("n", "last")
    reach = F.max("last").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    grown = later.withColumn("new", F.coalesce((F.col("n") > reach + 1).cast("int"), F.lit(1))).withColumn("match", F.sum("new").over(diagonal))
    spans = grown.groupBy("key", "of", "shift", "match").agg(F.min("n").alias("n"), F.max("last").alias("last"))
    out = materialize(spans.select("key", "n", "last", "of", (F.col("n") - F.col("shift")).alias("at")), "matches", small=True)
    discard(runs, joined)
    return out, lines


def repeated_lines(docs: DataFrame, noise: int = NOISE, window: int = WINDOW) -> DataFrame:
    """Per deleted line: key (hash of doc_id and text), pos."""
    found, lines = matches(docs, noise, window)
    spans = found.groupBy("key", "n").agg(F.max("last").alias("last"))
    own = lines.select("key", "n", "pos", F.lit(None).cast("int").alias("last")).join(spans.select("key").distinct(), "key", "left_semi")
    reach = own.unionByName(spans.select("key", "n", F.lit(None).cast("int").alias("pos"), "last"))
    upto = Window.partitionBy("key").orderBy("n").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = materialize(reach.withColumn("reach", F.max("last").over(upto)).filter("pos IS NOT NULL AND reach >= n").select("key", "pos"), "cut", small=True)
    discard(found, lines)
    return cut


def dedup_lines(docs: DataFrame, noise: int = NOISE, window: int = WINDOW) -> DataFrame:
    """docs with two more columns, __rc_lines (all lines) and __rc_cut (positions to delete)."""
    cut = repeated_lines(docs, noise, window).groupBy("key").agg(F.collect_set("pos").alias("__rc_cut"))
    keyed = docs.withColumn("__rc_key", document_key())
    # a merge at every size: a broadcast of few cuts would only serve small tables
    return (keyed.hint("merge").join(cut.withColumnRenamed("key", "__rc_key"), "__rc_key", "left").drop("__rc_key")
            .withColumn("__rc_lines", F.split("text", "\n")))


def _kept() -> Column:
    every = F.sequence(F.lit(0), F.size("__rc_lines") - 1)
    return F.array_join(F.transform(F.array_except(every, "__rc_cut"), lambda i: F.get("__rc_lines", i)), "\n")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, text after deletion."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size("__rc_lines")).cast("long").alias("n_lines"),
        F.when(F.col("__rc_cut").isNull(), 0).otherwise(F.size("__rc_cut")).cast("long").alias("n_removed"),
        F.when(F.col("__rc_cut").isNull(), F.col("text")).otherwise(_kept()).alias("text"))


def drop_repeated(docs: DataFrame) -> DataFrame:
    """Pipeline stage: repeated runs leave the texts (n_chars follows, if there), and documents
    that were copies through and through, without a word left, go."""
    cut = dedup_lines(docs)
    out = cut.withColumn("__rc_text", F.when(F.col("__rc_cut").isNull(), F.col("text")).otherwise(_kept()))
    out = out.filter(F.col("__rc_cut").isNull() | (F.trim(F.replace("__rc_text", F.lit("\n"), F.lit(""))) != ""))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("__rc_text").alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("__rc_cut").isNull(), F.col("n_chars")).otherwise(F.length("__rc_text")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)
