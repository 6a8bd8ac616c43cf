"""Similarity joins and graph operators.

Similar pairs come from ``blocks``: a pair must share a token of the prefixes that its similarity
needs (rare tokens first). Walks are bounded loops of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import lexicons as lex
from recollect.functions import text as tx
from recollect.operators.blocks import best_pairs, similar_groups, similar_pairs, token_sets
from recollect.operators.profiles import keyword_windows, meaningful, moral_scores
from recollect.operators.store import cut, set_checkpoints


def jaccard_join(df: DataFrame, tokens: Column, least: float, by: list[str] | None = None) -> DataFrame:
    """Pairs a < b of ids whose token sets have Jaccard similarity >= least: a, b, sim; rows of
    ``by`` columns must agree. Written; see ``blocks`` for the way."""
    return similar_pairs(token_sets(df, tokens, by), least)


#: Tokens of a side that are sent to every task at most.
SENT = 1_000_000


def jaccard_across(left: DataFrame, right: DataFrame, tokens: Column, least: float) -> DataFrame:
    """Pairs of a row of left and one of right (id) whose token sets have Jaccard similarity >= least
    and share a token: a, b, sim. Rows of one side never meet.

    A small right side goes to every task, where left's rows lie whole, so that shared tokens are
    counted before anything is dealt out.
    """
    def side(df: DataFrame, s: str) -> DataFrame:
        t = df.select(F.col("id").alias(s), F.array_distinct(F.transform(tokens, lambda w: F.xxhash64(w))).alias("t"))
        return t.filter("size(t) > 0").select(s, F.size("t").alias(f"n{s}"), "t")

    a, b = side(left, "a"), side(right, "b")
    small = (b.agg(F.sum("nb")).first()[0] or 0) <= SENT
    each = lambda x, s: x.select(s, f"n{s}", F.explode("t").alias("tok"))
    one, other = (each(a.repartition("a"), "a"), F.broadcast(each(b, "b"))) if small else (each(a, "a"), each(b, "b"))
    fit = F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9
    hits = one.join(other, "tok").filter(fit).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return hits.withColumn("sim", F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).filter(F.col("sim") >= least).select("a", "b", "sim")


def similar_links(df: DataFrame, tokens: Column, least: float, by: list[str] | None = None) -> DataFrame:
    """Enough of jaccard_join's pairs to connect the same records: a, b."""
    return similar_groups(token_sets(df, tokens, by), least)


def _with(df: DataFrame, pairs: DataFrame, *cols: str) -> DataFrame:
    side = lambda s: df.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def contradictions(df: DataFrame, tokens: Column, least: float = 0.35, apart: float = 0.5, top: int = 10) -> DataFrame:
    """Similar records of opposite valence: score = similarity * distance."""
    span = df.agg(F.max("valence") - F.min("valence")).first()[0] or 0.0
    return best_pairs(token_sets(df, tokens, value=F.col("valence")), least, apart, span, top)


def contradiction_strain(df: DataFrame, tokens: Column, least: float = 0.2, apart: float = 0.4) -> DataFrame:
    """1 - exp(-5 * sum of tension / records), tension = similarity * distance / 2."""
    total = lambda p: p.agg(F.count("*").alias("pairs"), F.coalesce(F.sum(F.col("sim") * F.col("gap") / 2), F.lit(0.0)).alias("tension"))
    return similar_pairs(token_sets(df, tokens, ["domain"], value=F.col("valence")), least, apart=apart, then=total).crossJoin(df.agg(F.count("*").alias("n"))).select("pairs", (1 - F.exp(-5 * F.col("tension") / F.greatest("n", F.lit(1)))).alias("strain"))


def components(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Smallest id connected to each: min-label rounds with shortcuts until nothing changes."""
    set_checkpoints(ids.sparkSession)
    edges = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().transform(cut)
    label = ids.select("id", F.col("id").alias("c")).transform(cut)
    while True:
        low = edges.join(label, edges.b == label.id).groupBy("a").agg(F.min("c").alias("m"))
        # A root takes the smallest label met by any of its tree, so trees merge whole.
        step = label.join(low, label.id == low.a, "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("n"))
        hook = step.groupBy(F.col("c").alias("id")).agg(F.min("n").alias("h"))
        step = step.join(hook, "id", "left").select("id", "c", F.least("n", F.coalesce("h", "n")).alias("n")).transform(cut)
        jump = step.select(F.col("id").alias("n"), F.col("n").alias("j"))
        new = step.join(jump, "n").select("id", F.least("n", "j").alias("c"), (F.col("c") != F.least("n", "j")).alias("moved")).transform(cut)
        label = new.select("id", "c")
        if new.filter("moved").isEmpty():
            break
    return label.select("id", F.col("c").alias("component"))


def rumination(df: DataFrame, tokens: Column, least: float = 0.15, smallest: int = 2) -> DataFrame:
    """Clusters of similar records: score (size / n) * (1 + mean (1 - valence) / 2)."""
    c = df.join(components(similar_links(df, tokens, least), df), "id")
    g = c.groupBy("component").agg(F.count("*").alias("size"), F.avg((1 - F.col("valence")) / 2).alias("gloom")).filter(F.col("size") >= smallest)
    return g.crossJoin(F.broadcast(df.agg(F.count("*").alias("n")))).select("component", "size", (F.col("size") / F.col("n") * (1 + F.col("gloom"))).alias("score"))


def dedup_resolve(df: DataFrame, tokens: Column, least: float = 0.85) -> DataFrame:
    """Of each group of near-equal records the best stays: .6 importance + .4 min(1, access / 10)."""
    c = df.join(components(similar_links(df, tokens, least), df), "id").withColumn("v", 0.6 * F.col("importance") + 0.4 * F.least(F.lit(1.0), F.col("access_count") / 10))
    best = c.groupBy("component").agg(F.max(F.struct("v", (-F.col("id")).alias("neg")))["neg"].alias("neg"), F.count("*").alias("k")).filter("k > 1").select("component", (-F.col("neg")).alias("winner"))
    return c.join(best, "component").filter("id <> winner").select("id", F.col("winner").alias("superseded_by"))


#: Records of a domain that one task pairs with those of a valence at most, on the average.
PAIRED = 8_192


def dilemmas(df: DataFrame, apart: float = 0.5, least: float = 0.05) -> DataFrame:
    """Pairs of a domain's moral records of opposite valence: tension = w * w * distance.

    All records whose weight reaches ``least`` are paired. A band join: valences are bucketed by a
    quarter of ``apart`` and meet buckets apart only; a large domain meets itself in parts.
    Records too light for ``least`` with even the weightiest of their domain are left out before.
    Texts are read once, for the weights, which are written.
    """
    m = moral_scores(df).filter((F.col("moral_weight") > 0) & (F.col("moral_weight") >= least)).select("domain", "id", "valence", "moral_weight").transform(cut)
    parts = -(-(m.groupBy("domain").count().agg(F.max("count")).first()[0] or 0) // PAIRED) or 1
    most = m.groupBy("domain").agg(F.max("moral_weight").alias("most"), F.max("valence").alias("high"), F.min("valence").alias("low"))
    bucket = lambda c: F.floor(F.col(c) * 4 / apart)
    m = m.join(most, "domain").filter(F.col("moral_weight") * F.col("most") * (F.col("high") - F.col("low")) >= least - 1e-9).withColumn("k", bucket("valence"))
    a = m.select("domain", "k", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.col("id").alias("ia"), F.col("valence").alias("va"), F.col("moral_weight").alias("wa"))
    b = m.withColumn("lowest", bucket("low")).filter(F.col("k") - 3 >= F.col("lowest"))
    b = b.select("domain", F.explode(F.sequence("lowest", F.col("k") - 3)).alias("k"), F.col("id").alias("ib"), F.col("valence").alias("vb"), F.col("moral_weight").alias("wb"))
    b = b.withColumn("part", F.explode(F.array(*[F.lit(i).cast("long") for i in range(parts)])))
    p = a.join(b, ["domain", "k", "part"]).withColumn("gap", F.col("vb") - F.col("va")).filter(F.col("gap") > apart)
    return p.withColumn("tension", F.col("wa") * F.col("wb") * F.col("gap")).filter(F.col("tension") >= least).select("domain", F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "tension")


def domain_analogies(df: DataFrame, per_domain: int = 10, least: float = 0.1) -> DataFrame:
    """Similar records of different domains, of the first ``per_domain`` of each."""
    w = Window.partitionBy("domain").orderBy("store_seq")
    few = df.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_domain)
    p = _with(few, jaccard_join(few, tx.keywords(F.col("content")), least), "domain").filter("domain_a <> domain_b")
    return p.select("a", "b", "domain_a", "domain_b", "sim")


def association_edges(df: DataFrame, window: float = 300.0, keep: list[str] | None = None) -> DataFrame:
    """Temporal edges of a domain: neighbours within ``window`` seconds, weight 1 - gap / window; keep:
    columns of both ends, as a_name and b_name.

    A band join: records are bucketed by window and meet the same and the next bucket only.
    """
    keep = keep or []
    t = df.select("id", "domain", "stored_at", F.floor(F.col("stored_at") / window).alias("k"), *keep)
    a = t.toDF("a", "domain", "ta", "k", *[f"a_{c}" for c in keep])
    b = t.withColumn("k", F.explode(F.array(F.col("k"), F.col("k") - 1))).toDF("b", "domain", "tb", "k", *[f"b_{c}" for c in keep])
    p = a.join(b, ["domain", "k"]).filter((F.col("tb") > F.col("ta")) | ((F.col("tb") == F.col("ta")) & (F.col("a") < F.col("b")))).withColumn("w", 1 - (F.col("tb") - F.col("ta")) / window).filter("w > 0")
    # A pair meets in the bucket of its earlier record only.
    return p.select("a", "b", F.col("w").alias("weight"), *[f"{s}_{c}" for c in keep for s in "ab"])


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges, mean degree and weight, node of highest degree."""
    d = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    g = d.agg(F.count("*").alias("nodes"), F.avg("d").alias("mean_degree"), F.max(F.struct("d", (-F.col("id")).alias("neg")))["neg"].alias("neg"))
    return g.crossJoin(edges.agg(F.count("*").alias("edges"), F.avg("weight").alias("mean_weight"))).select("nodes", "edges", "mean_degree", "mean_weight", (-F.col("neg")).alias("top_node"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends, edges being made once."""
    end = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col("weight").alias("weight"))
    return edges.select(F.inline(F.array(end("a", "b"), end("b", "a"))))


def spreading_activation(edges: DataFrame, seeds: DataFrame, decay: float = 0.5, least: float = 0.01, steps: int = 3) -> DataFrame:
    """Strongest activation reached from the seeds (id) in at most ``steps`` steps, seeds left out."""
    e = both_ways(edges)
    front = reached = seeds.select("id", F.lit(1.0).alias("act"))
    for _ in range(steps):
        front = front.join(e, front.id == e.a).groupBy("b").agg(F.max(F.col("act") * F.col("weight") * decay).alias("act")).filter(F.col("act") >= least).withColumnRenamed("b", "id")
        reached = reached.unionByName(front)
    return reached.groupBy("id").agg(F.max("act").alias("activation")).join(seeds.select("id"), "id", "left_anti")


def association_activation(df: DataFrame, seeds: DataFrame, decay: float = 0.5, least: float = 0.01, steps: int = 3, window: float = 300.0) -> DataFrame:
    """spreading_activation over association_edges(df), whose edges are never shuffled: active records
    go to the blocks of time of their neighbours, whose greatest activation is taken there."""
    set_checkpoints(df.sparkSession)
    block = lambda t: F.floor(t / (2 * window))
    t = F.col("stored_at")
    nodes = df.select("id", "domain", "stored_at").withColumn("k", block(t))
    front = reached = seeds.select("id", F.lit(1.0).alias("act"))
    for _ in range(steps):
        a = front.join(df.select("id", "domain", "stored_at"), "id").select(F.col("id").alias("a"), "domain", t.alias("ta"), "act", F.explode(F.array_distinct(F.array(block(t - window), block(t), block(t + window)))).alias("k"))
        p = a.join(nodes, ["domain", "k"]).filter((t != F.col("ta")) | (F.col("id") != F.col("a"))).withColumn("weight", 1 - F.abs(t - F.col("ta")) / window).filter("weight > 0")
        front = p.groupBy("id").agg(F.max(F.col("act") * F.col("weight") * decay).alias("act")).filter(F.col("act") >= least).transform(cut)
        reached = reached.unionByName(front)
    return reached.groupBy("id").agg(F.max("act").alias("activation")).join(seeds.select("id"), "id", "left_anti")


def hops(edges: DataFrame, seeds: DataFrame, k: int = 3) -> DataFrame:
    """Nodes within k hops with their distance."""
    e = both_ways(edges)
    seen = seeds.select("id", F.lit(0).alias("hops"))
    front = seen
    for step in range(1, k + 1):
        front = front.join(e, front.id == e.a).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(step))
        seen = seen.unionByName(front)
    return seen


def causal_edges(df: DataFrame, least: float = 0.0) -> DataFrame:
    """Causal triples: nearest meaningful word before and after a causal verb, by share of records."""
    r = keyword_windows(df, lex.CAUSAL, 4, 4)
    r = r.select("id", F.col("keyword").alias("relation"), F.try_element_at(meaningful(F.col("before")), F.lit(-1)).alias("source"), F.get(meaningful(F.col("after")), F.lit(0)).alias("target")).filter("source IS NOT NULL AND target IS NOT NULL AND source <> target")
    g = r.groupBy("source", "relation", "target").agg(F.countDistinct("id").alias("docs"))
    return g.crossJoin(F.broadcast(df.agg(F.count("*").alias("n")))).withColumn("strength", F.col("docs") / F.col("n")).filter(F.col("strength") >= least).select("source", "relation", "target", "docs", "strength")


def concept_hierarchy(df: DataFrame, top: int = 40) -> DataFrame:
    """The most common keywords; all but the first third get the root they occur with most often."""
    toks = df.select("id", F.explode(F.array_distinct(tx.keywords(F.col("content")))).alias("tok"))
    best = toks.groupBy("tok").agg(F.count("*").alias("d")).filter("d >= 2").orderBy(F.desc("d"), "tok").limit(top)
    best = best.withColumn("r", F.row_number().over(Window.orderBy(F.desc("d"), "tok")))  # at most `top` rows
    few = toks.join(F.broadcast(best), "tok")
    roots, kids = few.filter(F.col("r") <= top // 3).select("id", F.col("tok").alias("root"), F.col("r").alias("rr")), few.filter(F.col("r") > top // 3).select("id", "tok", "d")
    co = kids.join(roots, "id").groupBy("tok", "d", "root", "rr").agg(F.count("*").alias("c"))
    return co.groupBy("tok", "d").agg(F.max(F.struct("c", (-F.col("rr")).alias("neg"), "root"))["root"].alias("parent")).select("tok", F.col("d").alias("docs"), "parent")


def structural_holes(df: DataFrame) -> DataFrame:
    """Word pairs that stand in two domains at least but not in all of them."""
    t = df.select("domain", tx.words(F.col("content")).alias("w")).filter("size(w) > 1")
    n = F.size("w") - 1
    big = t.select("domain", F.explode(F.array_distinct(F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))).alias("pair"))
    g = big.groupBy("pair").agg(F.countDistinct("domain").alias("domains"))
    return g.crossJoin(F.broadcast(df.agg(F.countDistinct("domain").alias("n")))).filter("domains >= 2 AND domains < n").select("pair", "domains")


def identity_coherence(df: DataFrame) -> DataFrame:
    """Mean cosine of the domains' keyword counts (idf-weighted) over pairs of domains."""
    t = df.select("domain", F.explode(tx.keywords(F.col("content"))).alias("tok")).groupBy("domain", "tok").agg(F.count("*").alias("c"))
    n = df.select("domain").distinct().agg(F.count("*").alias("n"))
    idf = t.groupBy("tok").agg(F.count("*").alias("d")).crossJoin(F.broadcast(n)).select("tok", (F.log((1 + F.col("n")) / (1 + F.col("d"))) + 1).alias("idf"))
    v = t.join(idf, "tok").select("domain", "tok", (F.col("c") * F.col("idf")).alias("w"))
    v = v.join(v.groupBy("domain").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len")), "domain").select("domain", "tok", (F.col("w") / F.col("len")).alias("u"))
    # Sum over pairs of dot products = (|sum of units|^2 - n) / 2, so no pair is formed.
    s = v.groupBy("tok").agg(F.sum("u").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    return s.crossJoin(n).select(((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"), F.col("n").alias("sessions"))


def values_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence (over ln 2) of the importance mass by domain of two snapshots."""
    mass = lambda df, s: df.groupBy("domain").agg(F.sum("importance").alias(s))
    j = mass(a, "x").join(mass(b, "y"), "domain", "full_outer").select("domain", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    j = j.crossJoin(F.broadcast(j.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy")))).select((F.col("x") / F.col("sx")).alias("p"), (F.col("y") / F.col("sy")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / m)).otherwise(0.0)
    return j.agg((F.sum(kl("p") + kl("q")) / 2 / F.log(F.lit(2.0))).alias("drift"))


def metrics_dashboard(df: DataFrame) -> DataFrame:
    """One row of headline metrics of a snapshot."""
    return df.agg(F.count("*").alias("records"), F.countDistinct("domain").alias("domains"), F.avg("importance").alias("mean_importance"), F.avg("strength").alias("mean_strength"), F.stddev_pop("valence").alias("valence_spread"), F.sum(F.col("superseded_by").isNotNull().cast("long")).alias("superseded"))
