"""A Merkle manifest of a dataset: one tree a source, one tree over the sources' roots.

Bottom up: every row is a leaf, the hash of its fields. Within a source leaves stand by doc_id;
``FAN`` consecutive nodes become their parent until one is left, the subroot. Subroots, ordered by
source, become the root in the same way. Each level is written as rows of a parent and its
children, so a task never holds more of a source than ``FAN`` nodes.

Top down: a level's rows are joined to the proof suffixes of their parents; each child prepends its
siblings to the suffix that it inherits. What arrives at a leaf is its proof, and folding the leaf
with it gives the root again, or shows that the row was changed.

Places within a source come from ranges over (source, doc_id), so a source of any size is spread.

Defined cases: a null field hashes as ``-``, which no value gives, and a null or very long text is
hashed whole; a null source forms the first group, a null doc_id sorts first in its own; equal
doc_ids stand by leaf hash, so repeated rows are leaves of their own with equal digests; a lone
leaf is its source's subroot, a lone subroot is the root; an empty table gives an empty result;
columns beyond FIELDS play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import discard, materialize

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """UTF-8 byte count, a colon, the value; ``-`` for null."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def digest(parts: Column) -> Column:
    """Hash of an array of digests, as hex text, one after another."""
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def placed(rows: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """rows, written, with idx (from 0 in the order of its key) and total (rows of the key).

    rows must be written already: the ranges are taken from a sample of them.
    """
    by = [key, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = materialize(ranged.select("*", F.spark_partition_id().alias("part"), row.alias("row")), label)
    w = Window.partitionBy("k")
    parts = ranged.groupBy(F.col(key).alias("k"), F.col("part").alias("p")).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    parts = parts.select("k", "p", (F.sum("n").over(w.orderBy("p")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(w).alias("total"))
    out = ranged.join(parts, F.col(key).eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
    return out.withColumn("idx", F.col("row") + F.col("shift")).drop("part", "row", "k", "p", "shift")


def grown(nodes: DataFrame, label: str, payload: tuple[str, ...] = ()) -> list[DataFrame]:
    """The written levels of the trees of nodes (key, idx, total, digest), lowest first.

    A level's row is a parent: key, idx, children (place, digest, in the lowest level the payload
    too), total (parents of the key), lone (the parent is an only node itself), digest.
    """
    levels = []
    while True:
        child = F.struct((F.col("idx") % FAN).cast("int").alias("at"), "digest", *(payload if not levels else ()))
        level = nodes.groupBy("key", F.floor(F.col("idx") / FAN).alias("idx"), "total").agg(F.sort_array(F.collect_list(child)).alias("children"))
        lone = F.col("total") == 1
        level = level.select("key", "idx", "children", F.ceil(F.col("total") / FAN).alias("total"), lone.alias("lone"),
                             F.when(lone, F.col("children")[0]["digest"]).otherwise(digest(F.col("children.digest"))).alias("digest"))
        levels.append(materialize(level, label))
        nodes = levels[-1].filter("total > 1").select("key", "idx", "total", "digest")
        if nodes.isEmpty():
            return levels


def pushed(levels: list[DataFrame], tops: DataFrame, label: str, payload: tuple[str, ...] = ()) -> DataFrame:
    """Per lowest node: key, its payload, digest, steps (siblings left and right of it and of its
    ancestors, upwards) and what tops (key, steps, carried columns) says of its root, steps of the
    root being the end of its own."""
    carried = [c for c in tops.columns if c not in ("key", "steps")]
    inherited, passed = None, []
    for n, level in reversed(list(enumerate(levels))):
        roots = level.filter("total = 1").select("key", "idx").alias("r").join(tops.alias("t"), F.col("r.key").eqNullSafe(F.col("t.key"))).select("r.key", "r.idx", "t.steps", *[f"t.{c}" for c in carried])
        above = roots if inherited is None else roots.unionByName(inherited)
        above = above.select(F.col("key").alias("k"), F.col("idx").alias("i"), F.col("steps").alias("suffix"), *carried)
        both = level.join(above, F.col("key").eqNullSafe(F.col("k")) & (F.col("idx") == F.col("i")))
        both = both.select("key", "idx", "lone", "children", "suffix", *carried, F.posexplode("children").alias("at", "own"))
        digests = F.col("children.digest")
        left, right = F.slice(digests, F.lit(1), F.col("at")), F.slice(digests, F.col("at") + 2, F.size(digests))
        step = F.array(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
        steps = F.when(F.col("lone"), F.col("suffix")).otherwise(F.concat(step, "suffix"))
        if n:
            inherited = materialize(both.select("key", (F.col("idx") * FAN + F.col("at")).alias("idx"), steps.alias("steps"), *carried), label)
            passed.append(inherited)
        else:
            out = both.select("key", *[F.col(f"own.{c}").alias(c) for c in payload], F.col("own.digest").alias("digest"), steps.alias("steps"), *carried)
    discard(*passed[:-1])
    return out


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256 (digest of all siblings, upwards),
    folded_root (from the row as found and the proof), verified (folded_root is the root).

    tampered: the text as found now; by default the text itself.
    """
    as_found = [F.col(c) if c != "text" or tampered is None else tampered for c in FIELDS]
    leaves = materialize(docs.select("doc_id", F.col("source").alias("key"), leaf_hash([F.col(c) for c in FIELDS]).alias("digest"), leaf_hash(as_found).alias("found")), "leaves")
    own = placed(leaves, "key", ["doc_id", "digest"], "placed")
    trees = grown(own, "level", ("doc_id", "found"))
    discard(leaves)

    subroots = reduce(DataFrame.unionByName, [t.filter("total = 1").select("key", "digest") for t in trees])
    subroots = materialize(subroots, "subroots", small=True)
    over = placed(subroots.select(F.lit(0).alias("all"), F.col("key").alias("source"), "digest"), "all", ["source"], "sources")
    top = grown(over.select(F.col("all").alias("key"), "source", "digest", "idx", "total"), "top", ("source",))
    root = top[-1].select("key", F.array().cast("array<struct<left:string,right:string>>").alias("steps"), F.col("digest").alias("root"))
    sources = materialize(pushed(top, root, "proofs", ("source",)).select(F.col("source").alias("key"), "steps", F.col("digest").alias("subroot"), "root"), "proofs", small=True)

    out = pushed(trees, sources, "proofs", ("doc_id", "found"))
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded(F.col("found"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

