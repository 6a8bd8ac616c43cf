"""Typed entities and relations of texts, and paths over graphs that run to their end."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import lexicons as lex
from recollect.operators.cells import cosine_pairs
from recollect.operators.pairs import both_ways
from recollect.operators.store import set_checkpoints

WORD = r"[\p{L}\p{N}_]"
#: Names of several words, on texts whose characters beyond ASCII stand as underscores.
NAMES = r"\b[A-Z][a-z]+(?:\s+(?:of|the|and|for|in|on|at|to|de|van|von|al|el))?(?:\s+[A-Z][a-z]+)+\b"


def entity_mentions(df: DataFrame) -> DataFrame:
    """Per record and entity: id, store_seq, pos, key, name, type, in the order they are found.

    Names of several words, capitalised words inside sentences, then terms with hyphens or inner
    capitals (ten a record). A text's first type word types its names; the terms are concepts.
    """
    t = df.select("id", "store_seq", "content", F.lower("content").alias("low"), F.filter(F.split("content", r"(?U)\s+"), lambda w: w != "").alias("w"))
    kind = None
    for name, words in lex.ENTITY_TYPES.items():
        has = F.col("low").rlike("|".join(words.split()))
        kind = F.when(has, name) if kind is None else kind.when(has, name)
    several = F.regexp_extract_all(F.regexp_replace("content", r"[^\x00-\x7F]", "_"), F.lit(NAMES), 0)

    def inside(w: Column, i: Column) -> Column:
        return w.rlike(r"^\p{Lu}") & (F.length(w) >= 3) & ~F.lower(w).isin(lex.NO_ENTITY.split()) & (i > 0) & ~F.get("w", i - 1).rlike("[.!?]$")

    single = F.filter(F.transform(F.filter("w", inside), lambda w: F.regexp_replace(w, f"[^{WORD[1:-1]}]", "")), lambda w: F.length(w) >= 3)
    hyphens = F.filter(F.regexp_extract_all("content", F.lit(f"{WORD}+-{WORD}+(?:-{WORD}+)?"), 0), lambda x: F.length(x) >= 5)
    camels = F.filter(F.regexp_extract_all("content", F.lit(f"{WORD}+"), 0), lambda x: x.rlike(f"^[a-z]+[A-Z]{WORD}+$"))
    typed = lambda names, of: F.transform(names, lambda n: F.struct(n.alias("name"), of.alias("type")))
    kind = kind.otherwise("concept")
    found = t.select("id", "store_seq", F.posexplode(F.concat(typed(several, kind), typed(single, kind), typed(F.slice(F.concat(hyphens, camels), 1, 10), F.lit("concept")))).alias("pos", "e"))
    return found.groupBy("id", "store_seq", F.lower("e.name").alias("key")).agg(F.min(F.struct("pos", "e.name", "e.type")).alias("f")).select("id", "store_seq", "f.pos", "key", "f.name", "f.type")


def entity_table(df: DataFrame) -> DataFrame:
    """Per entity: key, name and type of its first record, records, importance min(1, .5 + .05 (n - 1))."""
    g = entity_mentions(df).groupBy("key").agg(F.min(F.struct("store_seq", "pos", "name", "type")).alias("f"), F.count("*").alias("records"))
    return g.select("key", "f.name", "f.type", "records", F.round(F.least(F.lit(1.0), 0.5 + 0.05 * (F.col("records") - 1)), 6).alias("importance"))


def relation_mentions(df: DataFrame) -> DataFrame:
    """Per record: source, target, type and strength of what six patterns say (.6), and of entities
    that a sentence names together (.4)."""
    out = None
    for i, (name, pattern) in enumerate(lex.RELATIONS.items()):
        p = F.lit(pattern.replace(r"\w", WORD))
        both = F.zip_with(F.regexp_extract_all("content", p, 1), F.regexp_extract_all("content", p, 2), lambda a, b: F.struct(F.lower(a).alias("source"), F.lower(b).alias("target")))
        rows = df.select("id", "store_seq", F.posexplode(both).alias("pos", "r")).filter("length(r.source) >= 3 AND length(r.target) >= 3").select("id", "store_seq", F.lit(i).alias("rank"), F.lit(name).alias("type"), "r.source", "r.target", F.lit(0.6).alias("strength"))
        out = rows if out is None else out.unionByName(rows)
    sentences = df.select("id", F.posexplode(F.split(F.lower("content"), "[.!?]+")).alias("s", "sentence"))
    named = sentences.join(entity_mentions(df), "id").filter(F.contains("sentence", "key")).select("id", "store_seq", "s", "pos", "key")
    side = lambda c: named.select("id", "s", F.col("pos").alias(f"p{c}"), F.col("key").alias(c))
    pairs = named.select("id", "store_seq", "s", F.col("pos").alias("pa"), F.col("key").alias("source")).join(side("target").withColumnRenamed("ptarget", "pb"), ["id", "s"]).filter("pa < pb")
    return out.unionByName(pairs.select("id", "store_seq", F.lit(len(lex.RELATIONS)).alias("rank"), F.lit("co_occurs_with").alias("type"), "source", "target", F.lit(0.4).alias("strength")))


def relation_table(df: DataFrame) -> DataFrame:
    """Per (source, target): type and strength of the first mention, plus .1 for each further one, 1
    at most; naming a known pair together again in a later record adds nothing."""
    co = F.col("type") == "co_occurs_with"
    each = relation_mentions(df).groupBy("source", "target", "store_seq").agg(F.min(F.struct("rank", "type", "strength")).alias("first"), F.sum((~co).cast("long")).alias("said"), F.sum(co.cast("long")).alias("together"))
    g = each.groupBy("source", "target").agg(F.min_by("first", "store_seq").alias("f"), (F.sum("said") + F.min_by("together", "store_seq")).alias("mentions"))
    return g.select("source", "target", "f.type", "mentions", F.round(F.least(F.lit(1.0), F.col("f.strength") + 0.1 * (F.col("mentions") - 1)), 6).alias("strength"))


def entity_query(relations: DataFrame, name: str) -> DataFrame:
    """What an entity is related to, either way, strongest first."""
    away = relations.filter(F.col("source") == name.lower()).select(F.col("target").alias("other"), "type", "strength")
    back = relations.filter(F.col("target") == name.lower()).select(F.col("source").alias("other"), "type", "strength")
    return away.unionByName(back).groupBy("other").agg(F.max(F.struct("strength", "type")).alias("m")).select("other", "m.type", "m.strength")


def shortest_paths(edges: DataFrame, source: int, most: int | None = None) -> DataFrame:
    """Fewest edges from source to each node it reaches and the path, the first in order of the
    ids on ties: level by level until a level is empty, or ``most`` levels."""
    set_checkpoints(edges.sparkSession)
    e = both_ways(edges).select("a", "b").distinct().checkpoint()
    front = e.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(0).alias("hops"), F.array(F.lit(source).cast("long")).alias("path"))
    seen, level = front, 0
    while most is None or level < most:
        level += 1
        step = front.join(e, front.id == e.a).select("b", F.concat("path", F.array("b")).alias("path")).groupBy(F.col("b").alias("id")).agg(F.min("path").alias("path"))
        front = step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("hops"), "path").checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front).checkpoint()
    return seen


def strongest_paths(edges: DataFrame, source: int) -> DataFrame:
    """Strength (product of weights, each in [0, 1]) of the best path from source to each node and
    the path, relaxed until nothing improves; the first in order of the ids on ties."""
    set_checkpoints(edges.sparkSession)
    e = both_ways(edges).checkpoint()
    best = e.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(1.0).alias("strength"), F.array(F.lit(source).cast("long")).alias("path"))
    front = best
    while True:
        step = front.join(e, front.id == e.a).filter(~F.array_contains("path", F.col("b"))).select(F.col("b").alias("id"), F.round(F.col("strength") * F.col("weight"), 12).alias("strength"), F.concat("path", F.array("b")).alias("path"))
        step = step.filter("strength > 0").groupBy("id").agg(F.min(F.struct((-F.col("strength")).alias("s"), "path")).alias("n"))
        old = best.select(F.col("id").alias("i"), F.col("strength").alias("was"))
        front = step.join(old, step.id == old.i, "left").filter("was IS NULL OR -n.s > was").select("id", (-F.col("n.s")).alias("strength"), "n.path").checkpoint()
        if front.isEmpty():
            break
        best = front.unionByName(best.join(front.select("id"), "id", "left_anti").select(*front.columns)).checkpoint()
    return best.filter(F.col("id") != source)


def merged_communities(edges: DataFrame, label: DataFrame, smallest: int = 2) -> DataFrame:
    """Communities under ``smallest`` nodes go to the largest one (the lowest label of equals)."""
    size = label.groupBy("label").agg(F.count("*").alias("n"))
    big = size.agg(F.max(F.struct("n", (-F.col("label")).alias("neg")))["neg"].alias("neg")).select((-F.col("neg")).alias("big"))
    return label.join(size, "label").crossJoin(F.broadcast(big)).select("id", F.when(F.col("n") < smallest, F.col("big")).otherwise(F.col("label")).alias("label"))


def ancestors(tree: DataFrame) -> DataFrame:
    """Every node (node, parent) with each of its ancestors and the steps between them, to the
    roots. A cycle is an error: no path is longer than the tree has nodes."""
    set_checkpoints(tree.sparkSession)
    up = tree.filter("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor")).checkpoint()
    out = front = up.withColumn("steps", F.lit(1))
    most, step = up.count(), 1
    while not front.isEmpty():
        step += 1
        if step > most + 1:
            raise ValueError("the tree has a cycle")
        front = front.join(up.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next")), "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(step).alias("steps")).checkpoint()
        out = out.unionByName(front)
    return out


def tree_distance(tree: DataFrame, a: int, b: int) -> DataFrame:
    """Steps between two nodes by their nearest common ancestor."""
    up = ancestors(tree).unionByName(tree.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps")))
    side = lambda n, s: up.filter(F.col("node") == n).select("ancestor", F.col("steps").alias(s))
    return side(a, "x").join(side(b, "y"), "ancestor").agg(F.min(F.col("x") + F.col("y")).alias("distance"))


def semantic_edges(df: DataFrame, least: float = 0.5, by: str | None = None) -> DataFrame:
    """Pairs of records with embeddings of cosine >= least: a < b, weight; by: of one value of it."""
    return cosine_pairs(df, least, by)


def associations(df: DataFrame, semantic: float = 0.5, window: float = 300.0, tolerance: float = 0.3) -> DataFrame:
    """The strongest association of every pair of records that has one: a, b, type, weight.

    A semantic edge wins over all; else the greatest of closeness in time, closeness in valence and
    a common domain (.6), time before valence before domain on ties. Every pair of a domain or of
    like valence is an edge, as specified, so the result grows with the square of those groups:
    for large tables take ``pairs.association_edges``. Blocks of records meet in tasks; no pair is shuffled.
    """
    from recollect.operators.cells import row_blocks

    blocks = row_blocks(df.filter("id IS NOT NULL").select("id", F.xxhash64("domain").alias("d"), F.col("domain").isNotNull().alias("has"), F.col("stored_at").cast("double").alias("t"), F.col("valence").cast("double").alias("v"), F.col("embedding").cast("array<double>").alias("embedding")))
    n = blocks.count()
    x, y = (blocks.repartition(max(1, k)).select(*[F.col(c).alias(f"{s}_{c}") for c in blocks.columns]) for s, k in (("x", n), ("y", -(-n // 8))))

    def edges(p: dict, q: dict, same: bool):
        """Of some rows of p with all of q."""
        for s in range(0, len(p["id"]), 128):
            at = slice(s, s + 128)
            gap, feel = np.abs(p["t"][at, None] - q["t"]), np.abs(p["v"][at, None] - q["v"])
            time, affect = np.where(gap <= window, 1 - gap / window, 0.0), np.where(feel <= tolerance, 1 - feel / tolerance, 0.0)
            domain = np.where((p["d"][at, None] == q["d"]) & p["has"][at, None] & q["has"], 0.6, 0.0)
            best = np.maximum(np.maximum(time, affect), domain)
            kind = np.where(time == best, 1, np.where(affect == best, 2, 3)).astype(np.int32)
            if p["unit"].shape[1] == q["unit"].shape[1]:
                i, j = np.flatnonzero(p["good"][at]), np.flatnonzero(q["good"])
                cos = p["unit"][at][i] @ q["unit"][j].T
                r, c = np.nonzero(cos >= semantic)
                best[i[r], j[c]], kind[i[r], j[c]] = cos[r, c], 0
            a, b = p["id"][at, None], q["id"]
            some = ((best > 0) | (kind == 0)) & (a != b)
            if same:
                some &= np.arange(s, s + len(a))[:, None] < np.arange(len(b))
            a, b = np.minimum(a, b)[some], np.maximum(a, b)[some]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(kind[some]), pa.array(best[some])], ["a", "b", "kind", "weight"])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                p, q = ({c: np.frombuffer(row[f"{s}_{c}"], kind) for c, kind in (("id", np.int64), ("d", np.int64), ("has", bool), ("t", np.float64), ("v", np.float64), ("good", bool), ("unit", np.float64))} for s in "xy")
                for o in (p, q):
                    o["unit"] = o["unit"].reshape(len(o["id"]), -1)
                yield from edges(p, q, row["x_no"] == row["y_no"])

    once = F.when((F.col("x_no") + F.col("y_no")) % 2 == 0, F.col("x_no") <= F.col("y_no")).otherwise(F.col("x_no") > F.col("y_no"))
    found = x.hint("shuffle_replicate_nl").join(y, once).mapInArrow(run, "a long, b long, kind int, weight double")
    names = F.when(F.col("kind") == 0, "semantic").when(F.col("kind") == 1, "temporal").when(F.col("kind") == 2, "affective").otherwise("domain")
    return found.select("a", "b", names.alias("type"), "weight")


def dot(entities: DataFrame, relations: DataFrame, top: int = 20) -> DataFrame:
    """Lines of a DOT graph of the most important entities and the relations between them."""
    few = entities.orderBy(F.desc("importance"), F.desc("records"), "key").limit(top)
    key = F.broadcast(few.select("key"))
    e = relations.join(key.withColumnRenamed("key", "source"), "source", "left_semi").join(key.withColumnRenamed("key", "target"), "target", "left_semi")
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit("'")), F.lit('"'))
    nodes = few.select(F.concat(q("key"), F.lit(" [label="), q("name"), F.lit("];")).alias("line"))
    return nodes.unionByName(e.select(F.concat(q("source"), F.lit(" -> "), q("target"), F.lit(" [label="), q("type"), F.lit("];")).alias("line")))
