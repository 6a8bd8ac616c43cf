"""N-gram Jaccard join by prefix filters under several token orders.

Two documents link when the Jaccard similarity of their sets of word shingles reaches the
threshold. Sets that similar share a token among the first ``n - ceil(t * n) + 1`` of each under
ANY order of tokens. Order 1 is by rarity, rare first; orders 2 and 3 are two unrelated
orders by hash, frequent tokens last. Candidates come from order 1's buckets, must also share prefix tokens under
orders 2 and 3, and only then are verified on the whole sets. Between the two stands one exact
bound: tokens are counted in cells modulo 16, and two sets differ in as many tokens at least as
their cells do; pairs just below the threshold end there, and their texts never travel.

What keeps it near linear on groups of copies: equal sets are one class from the start; a first
round pairs each class with one leader of its two smallest tokens under orders 2 and 3 and with
the best connected document of each of its buckets of order 1, filtered and verified like all
others. Only pairs of documents that are still in different components are then listed
bucket by bucket: links within a component change nothing, so none that matters is lost. A large
bucket's rows are split into blocks; pairs of blocks go to different tasks. What is written on
the way is deleted after its last use.

Rarity is read from a sketch of all documents' tokens with a fixed number of counters, as any
order of tokens gives right results; only its size is fixed, not what it counts.

Defined cases: null texts and those without words have an empty set and link with nothing; a
doc_id on several rows counts as one document with the links of each row; rows without doc_id
are left out; an empty table gives an empty result; extra columns play no part. Texts of any
length are read whole; equal sets tie to the smallest doc_id.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import connected_components, discard, materialize, parallelism, small_batches
from .words import shingle_hashes, splitmix, word_hashes

#: Words of a shingle and least similarity, as a fraction, for stages without a contract.
WORDS, SIMILARITY = 5, (4, 5)
#: Counters of the sketch (a power of two), rows of a block of a bucket or group, pairs of a key,
#: marks in the prefilter of what travels, cells of the bound (a power of two).
COUNTERS, BLOCK, PAIRS, PREFILTER, CELLS = 1 << 16, 256, 4096, 1 << 20, 512
U64 = np.uint64


def least_overlap(n: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """ceil(similarity * n) in whole numbers."""
    a, b = similarity
    return -(-a * n // b)


def tokens_of(texts: list[str | None], words: int):
    """(index, sorted distinct shingle hashes) of every text."""
    for i, h in word_hashes(texts):
        yield i, shingle_hashes(h, words)


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    """Documents of each counter's tokens, over all documents."""
    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for pdf in batches:
            for k in range(0, len(pdf), 200):
                got = [t & U64(COUNTERS - 1) for _, t in tokens_of(pdf.text.iloc[k:k + 200].tolist(), words)]
                total += np.bincount(np.concatenate(got).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"c": at, "n": total[at]})

    found = docs.select("text").mapInPandas(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[found.c.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
    return out


def by_rarity(tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order 1 as 64-bit numbers, one for one with the tokens."""
    return rank[(tokens & U64(COUNTERS - 1)).astype(np.int64)] << U64(48) | tokens >> U64(16)


def by_hash(tokens: np.ndarray, order: int, rank: np.ndarray) -> np.ndarray:
    """Orders 2 and 3: by hash, tokens of the fullest sixteenth of the counters last."""
    frequent = rank[(tokens & U64(COUNTERS - 1)).astype(np.int64)] >= U64(COUNTERS - COUNTERS // 16)
    return splitmix(tokens + U64(order * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(1) | frequent.astype(U64) << U64(63)


def smallest(x: np.ndarray, k: int) -> np.ndarray:
    return np.sort(np.partition(x, k - 1)[:k]) if k < len(x) else np.sort(x)


def signatures(docs: DataFrame, words: int, similarity: tuple[int, int], rank: np.ndarray) -> DataFrame:
    """Per row: uid, doc_id, n, s1, s2 (of the whole set), p1 (prefix under order 1), l2 and l3
    (first tokens under orders 2 and 3), orders (16 bits of each prefix token, order by order)
    and counts, the tokens in each of ``CELLS`` cells modulo 16."""
    def run(batches):
        for pdf in batches:
            ids = pdf.doc_id.to_numpy()
            cols = {c: [] for c in ("doc_id", "n", "s1", "s2", "p1", "l2", "l3", "orders", "counts")}
            for i, t in tokens_of(pdf.text.tolist(), words):
                n = len(t)
                k = n - int(least_overlap(np.int64(n), similarity)) + 1 if n else 0
                two, three = by_hash(t, 2, rank), by_hash(t, 3, rank)
                cols["doc_id"].append(ids[i])
                cols["n"].append(n)
                cols["s1"].append(int(two.sum(dtype=U64).astype(np.int64)))
                cols["s2"].append(int(np.bitwise_xor.reduce(three).astype(np.int64)) if n else 0)
                prefixes = [smallest(by_rarity(t, rank), k), smallest(two, k), smallest(three, k)] if n else [t, t, t]
                cols["p1"].append(prefixes[0].astype(np.int64))
                for c, p in (("l2", prefixes[1]), ("l3", prefixes[2])):
                    cols[c].append(int(p[0].astype(np.int64)) if n else 0)
                cols["orders"].append(np.concatenate([p >> U64(20) for p in prefixes]).astype(np.uint16).tobytes())
                cols["counts"].append(cell_counts(t))
            yield pd.DataFrame(cols)

    made = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, s1 long, s2 long, p1 array<long>, l2 long, l3 long, orders binary, counts binary")
    return made.withColumn("uid", F.monotonically_increasing_id())


def cell_counts(tokens: np.ndarray) -> bytes:
    """Tokens in each cell modulo 16, two cells a byte."""
    c = np.bincount((tokens >> U64(7) & U64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 15
    return (c[0::2] | c[1::2] << 4).astype(np.uint8).tobytes()


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """No more than the tokens that two sets don't share: the differences of their cells, taken
    round the circle of 16, so that counts of any size give a true bound."""
    total = 0
    for shift in (0, 4):
        d = (x >> shift) - (y >> shift) & 15
        total += int(np.minimum(d, 16 - d).sum())
    return total


def grouped(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with a key k of tasks, written.

    A pair's group is the smallest id that either of its documents is paired with; a group's
    documents fall into blocks of BLOCK, a pair belongs to its two blocks, and the pairs of two
    blocks are dealt to keys of about PAIRS. So no key has many documents or pairs, and what a
    key needs of a document goes to it once.
    """
    least = pairs.select("a", "b").unionAll(pairs.select("b", "a")).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    pairs = pairs.join(least.withColumnRenamed("least", "la"), "a").join(least.select(F.col("a").alias("b"), F.col("least").alias("lb")), "b").select("a", "b", F.least("la", "lb").alias("g"))
    size = pairs.select("g", F.explode(F.array("a", "b")).alias("id")).distinct().groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    cells = pairs.join(size, "g").select("a", "b", "g", F.least(block("a"), block("b")).alias("x"), F.greatest(block("a"), block("b")).alias("y"))
    parts = cells.groupBy("g", "x", "y").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"))
    return materialize(cells.join(parts, ["g", "x", "y"]).select("a", "b", F.xxhash64("g", "x", "y", F.pmod(F.xxhash64("a", "b"), F.col("parts"))).alias("k")), "pairs", small=True)


def checked(keyed: DataFrame, data: DataFrame, prepare, holds) -> DataFrame:
    """The pairs (a, b) of keyed (k, a, b) for which holds(x, y) is true of any of their rows of
    data (doc_id and other columns), each row as prepare(batch) gives it."""
    spark = data.sparkSession
    cols = [c for c in data.columns if c != "doc_id"]
    # Rows that no pair wants stay where they are; the list of marks has PREFILTER rows at most.
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(PREFILTER))
    wanted = keyed.select(F.explode(F.array("a", "b")).alias("id")).select(mark("id").alias("mark")).distinct()
    data = data.withColumn("mark", mark("doc_id")).join(F.broadcast(wanted), "mark", "left_semi").drop("mark")
    sent = keyed.select("k", F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(data, "doc_id")
    rows = sent.select("k", F.lit(0).alias("kind"), F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b"), *cols).unionByName(
        keyed.select("k", F.lit(1).alias("kind"), "a", "b"), allowMissingColumns=True)

    def check(batches):
        key, held = None, {}
        for pdf in batches:
            new = np.flatnonzero((pdf.kind == 0).to_numpy())
            at = dict(zip(new.tolist(), prepare(pdf.iloc[new]), strict=True))
            keep = np.zeros(len(pdf), bool)
            for i, (k, kind, a, b) in enumerate(zip(pdf.k, pdf.kind, pdf.a, pdf.b, strict=True)):
                if k != key:
                    key, held = k, {}
                if kind == 0:
                    held.setdefault(a, []).append(at[i])
                else:
                    keep[i] = any(holds(x, y) for x in held.get(a, ()) for y in held.get(b, ()))
            yield pdf.loc[keep, ["a", "b"]]

    return rows.repartition(parallelism(spark), "k").sortWithinPartitions("k", "kind").mapInPandas(check, "a long, b long").distinct()


def similar(x: np.ndarray, y: np.ndarray, need: int, out_of: int) -> bool:
    """Whether two sorted sets reach the similarity, in whole numbers."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or len(x) * out_of < need * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = int((y[at] == x).sum())
    return out_of * same >= need * (len(x) + len(y) - same)


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that pass all filters and whose whole sets are similar enough.

    First a pair must share prefix tokens under all three orders, and the bound on what its sets
    don't share, from their cells, must allow a link; only for what is left do texts travel.
    """
    need, out_of = similarity

    def prepare(pdf):
        return [(int(n), [frozenset(p) for p in np.frombuffer(o, np.uint16).reshape(3, -1).tolist()], np.frombuffer(c, np.uint8)) for n, o, c in zip(pdf.n, pdf.orders, pdf.counts, strict=True)]

    def may_link(x, y):
        if any(p.isdisjoint(q) for p, q in zip(x[1], y[1], strict=True)):
            return False
        both = x[0] + y[0]
        most = (both - least_difference(x[2], y[2])) // 2
        return out_of * most >= need * (both - most)

    def sets(pdf):
        return [t for _, t in tokens_of(pdf.text.tolist(), words)]

    keyed = grouped(pairs)
    left = materialize(checked(keyed, nodes.select("doc_id", "n", "orders", "counts"), prepare, may_link), "filtered", small=True)
    again = grouped(left)
    links = materialize(checked(again, docs.select("doc_id", "text"), sets, lambda x, y: similar(x, y, need, out_of)), "links", small=True)
    discard(keyed, left, again)
    return links


def leader_pairs(nodes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Each class with the smallest id of its smallest tokens under orders 2 and 3, if their
    sizes allow a link."""
    need, out_of = similarity
    keys = nodes.select("doc_id", "n", F.explode(F.array(F.struct(F.lit(2).alias("o"), F.col("l2").alias("t")), F.struct(F.lit(3).alias("o"), F.col("l3").alias("t")))).alias("k")).select("doc_id", "n", "k.*")
    lead = keys.groupBy("o", "t").agg(F.min(F.struct("doc_id", "n")).alias("lead"), F.count("*").alias("c")).filter("c > 1").select("o", "t", F.col("lead.doc_id").alias("a"), F.col("lead.n").alias("m"))
    pairs = keys.join(lead, ["o", "t"]).filter("a <> doc_id").filter(F.least("n", "m") * out_of >= F.greatest("n", "m") * need)
    return pairs.select("a", F.col("doc_id").alias("b")).distinct()


def of_several(rows: DataFrame, comp: str) -> DataFrame:
    """The rows of buckets t that hold more than one component, with the bucket's size c."""
    w = Window.partitionBy("t")
    return rows.select("*", F.count("*").over(w).alias("c"), F.min(comp).over(w).alias("lo"), F.max(comp).over(w).alias("hi")).filter("lo <> hi").drop("lo", "hi")


def mixed_rows(nodes: DataFrame) -> DataFrame:
    """Rows of order 1's buckets (tokens) of more than one document, with the bucket's size c;
    prev is the token before in the document's prefix."""
    rows = nodes.select("doc_id", F.col("n").cast("int").alias("n"), F.posexplode("p1").alias("pos", "t"), "p1").select(
        "t", "doc_id", "n", "pos", F.when(F.col("pos") > 0, F.get("p1", F.col("pos") - 1)).otherwise(F.col("doc_id")).alias("prev"))
    return materialize(of_several(rows, "doc_id"), "buckets")


def star_pairs(mixed: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """In each bucket all rows with the best supported one: its document has most company in its
    buckets, as the original of a family of edited copies has."""
    need, out_of = similarity
    support = mixed.groupBy("doc_id").agg(F.sum("c").alias("s"))
    rows = mixed.select("t", "doc_id", "n").join(support, "doc_id")
    best = rows.groupBy("t").agg(F.min(F.struct((-F.col("s")).alias("s"), "doc_id", "n")).alias("best")).select("t", F.col("best.doc_id").alias("a"), F.col("best.n").alias("m"))
    return mixed.select("t", "doc_id", "n").join(best, "t").filter("a <> doc_id").filter(F.least("n", "m") * out_of >= F.greatest("n", "m") * need).select("a", F.col("doc_id").alias("b")).distinct()


@contextmanager
def wide_batches(spark):
    """Narrow rows travel in larger Arrow batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def whole_runs(keys: list[str], of):
    """A mapInPandas function over rows sorted by keys: of(rows, starts of runs), runs kept whole."""
    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat((held, pdf), ignore_index=True)
            k = pdf[keys].to_numpy()
            edge = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            last = int(edge[-1]) if len(edge) else 0
            if last:
                yield of(pdf.iloc[:last], np.append(0, edge[:-1]))
            held = pdf.iloc[last:]
        if held is not None and len(held):
            yield of(held.reset_index(drop=True), np.array([0]))

    return run


def bucket_pairs(mixed: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Candidates (a, b) between different components of a bucket, written.

    A pair is given at those shared tokens only whose predecessors in the two prefixes differ:
    the first shared token is one of them. A bucket's rows are split into blocks of BLOCK, and
    each pair of blocks is a unit of its own, so a task never holds more than two blocks.
    """
    need, out_of = similarity
    spark = mixed.sparkSession
    rows = of_several(mixed.drop("c"), "comp").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("m", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    spread = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "t", "doc_id", "n", "comp", "pos", "prev", F.least("m", "o").alias("x"), F.greatest("m", "o").alias("y"), (F.col("m") <= F.col("o")).alias("left"), (F.col("m") >= F.col("o")).alias("right"))

    def of(pdf, starts):
        a, b = pairs_in(pdf, starts, np.append(starts[1:], len(pdf)), pdf["left"].to_numpy(), pdf["right"].to_numpy(), need, out_of)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    with wide_batches(spark):
        found = spread.repartition(parallelism(spark), "t", "x", "y").sortWithinPartitions("t", "x", "y").mapInPandas(whole_runs(["t", "x", "y"], of), "a long, b long")
        return materialize(found.distinct(), "candidates")


def pairs_in(pdf: pd.DataFrame, starts: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray, need: int, out_of: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs in each run of rows with one key."""
    doc, n, comp, pos, prev = (pdf[c].to_numpy() for c in ("doc_id", "n", "comp", "pos", "prev"))
    out: list[np.ndarray] = []
    for s, e in zip(starts, ends, strict=True):
        i = np.arange(s, e)
        a, b = (x.ravel() for x in np.meshgrid(i[left[s:e]], i[right[s:e]], indexing="ij"))
        # Within one block each pair stands in both orders, between two blocks in one.
        once = (doc[a] < doc[b]) | ((doc[a] > doc[b]) & (left[a] != left[b]))
        a, b = a[once], b[once]
        short, long = np.minimum(n[a], n[b]).astype(np.int64), np.maximum(n[a], n[b]).astype(np.int64)
        # Position and size filters: what can still overlap after the first shared token.
        least = -(-need * (short + long) // (need + out_of))
        rest = np.minimum(n[a] - pos[a], n[b] - pos[b])
        ok = (comp[a] != comp[b]) & (prev[a] != prev[b]) & (short * out_of >= need * long) & (rest >= least)
        out.append(np.stack((np.minimum(doc[a[ok]], doc[b[ok]]), np.maximum(doc[a[ok]], doc[b[ok]]))))
    pairs = np.concatenate(out, 1) if out else np.empty((2, 0), np.int64)
    return pairs[0], pairs[1]


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (doc_id, comp) after links (a, b): components that a link joins become one."""
    side = lambda c: labels.select(F.col("doc_id").alias(c), F.col("comp").alias(f"c{c}"))
    up = links.join(side("a"), "a").join(side("b"), "b").filter("ca <> cb")
    joined = connected_components(up, "ca", "cb").select(F.col("id").alias("comp"), F.col("component_id").alias("to"))
    return materialize(labels.join(joined, "comp", "left").select("doc_id", F.coalesce("to", "comp").alias("comp")), "labels", small=True)


def classes_of(rows: DataFrame) -> DataFrame:
    """Per row with a set: uid, doc_id, n, rep and first (smallest doc_id of the equal sets and one
    row of it). Classes of over a thousandth of all rows, a thousand at most, are broadcast, so a
    large class of copies doesn't meet in one task."""
    key = ["n", "s1", "s2"]
    rows = rows.filter("n > 0").select("uid", "doc_id", *key)
    total = rows.count()
    classes = rows.groupBy(*key).agg(F.min(F.struct("doc_id", "uid")).alias("rep"), F.count("*").alias("c"))
    hot = F.broadcast(classes.filter(F.col("c") * 1000 > total).select(*key, F.col("rep").alias("hot")))
    tagged = rows.join(hot, key, "left")
    cold = tagged.filter("hot IS NULL").drop("hot").join(classes.filter(F.col("c") * 1000 <= total), key).select("uid", "doc_id", "n", "rep")
    return cold.unionByName(tagged.filter("hot IS NOT NULL").select("uid", "doc_id", "n", F.col("hot").alias("rep"))).select("uid", "doc_id", "n", F.col("rep.doc_id").alias("rep"), F.col("rep.uid").alias("first"))


def similar_groups(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    small_batches(docs.sparkSession)
    docs = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count = sketch(docs, words)
    rank = np.empty(COUNTERS, U64)
    rank[np.argsort(count, kind="stable")] = np.arange(COUNTERS, dtype=U64)
    rows = materialize(signatures(docs, words, similarity, rank), "signatures")
    member = materialize(classes_of(rows), "members")
    nodes = materialize(rows.join(member.filter("uid = first").select("uid"), "uid", "left_semi").drop("uid", "s1", "s2"), "nodes")
    sizes = materialize(rows.groupBy("doc_id").agg(F.max("n").alias("n_shingles")), "sizes")
    discard(rows)
    # A doc_id on several rows ties its classes together.
    tied = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    labels = merged(nodes.select("doc_id", F.col("doc_id").alias("comp")).distinct(), tied)
    mixed = mixed_rows(nodes)
    near = materialize(leader_pairs(nodes, similarity).unionByName(star_pairs(mixed, similarity)).distinct(), "near", small=True)
    labels = merged(labels, linked(near, nodes, docs, words, similarity))
    candidates = bucket_pairs(mixed.join(labels, "doc_id"), similarity)
    discard(near, mixed)
    labels = merged(labels, linked(candidates, nodes, docs, words, similarity))
    discard(candidates, nodes)
    comps = member.select("doc_id", F.col("rep").alias("r")).join(labels.select(F.col("doc_id").alias("r"), "comp"), "r").groupBy("doc_id").agg(F.min("comp").alias("comp"))
    return sizes.join(comps, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def drop_similar(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Pipeline stage: of each group the smallest doc_id stays, with its rows; rows without doc_id
    stay."""
    gone = similar_groups(docs, words, similarity).filter("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
