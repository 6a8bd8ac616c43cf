"""Reasoning, planning and conversation helpers over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import text as tx
from recollect.operators.folds import Line, fold, fold_states, scan
from recollect.operators.ordered import running
from recollect.operators.pairs import jaccard_across, jaccard_join
from recollect.schema import AS_OF, DAY


def goal_push(candidates: DataFrame, accepted: DataFrame, least: float = 0.85, per_domain: int = 3) -> DataFrame:
    """Goals (id, domain, content, priority) to push: new by text, not too like accepted ones, at
    most ``per_domain``, priority at most .9. Candidates are compared with accepted goals only."""
    new = candidates.join(accepted.select("content").distinct(), "content", "left_anti")
    both = new.select("id", F.lit(0).alias("old"), "content").unionByName(accepted.select((-F.col("id") - 1).alias("id"), F.lit(1).alias("old"), "content"))
    near = jaccard_join(both, tx.words(F.col("content")), least).filter("a < 0 AND b >= 0").select(F.col("b").alias("id"))
    out = new.join(near, "id", "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("priority"), "id")))
    return out.filter(F.col("r") <= per_domain).select("id", "domain", F.least(F.lit(0.9), F.col("priority")).alias("priority"))


STATUS = ["pending", "active", "completed", "failed", "abandoned"]


def goal_transitions(events: DataFrame) -> DataFrame:
    """State of each goal after its events (goal_id, at, action): pending, active, then completed,
    failed or abandoned; an action that the state does not allow changes nothing."""
    a = F.col("action")
    after = {"pending": F.when(a == "activate", "active").when(a == "abandon", "abandoned").otherwise("pending"),
             "active": F.when(a == "complete", "completed").when(a == "fail", "failed").when(a == "abandon", "abandoned").otherwise("active")}
    moves = F.array(*[after.get(s, F.lit(s)) for s in STATUS])
    out = fold_states(events.select("goal_id", "at", F.coalesce(a, F.lit("")).alias("action")), "goal_id", ["at", "action"], moves, STATUS)
    return out.select("goal_id", F.col("state").alias("status"), F.col("n").cast("int").alias("events"))


def goal_report(goals: DataFrame) -> DataFrame:
    return goals.groupBy("status").agg(F.count("*").alias("n"))


def resolve_predictions(pending: DataFrame, recent_words: DataFrame, as_of: float = AS_OF, least: float = 0.5) -> DataFrame:
    """Predictions (id, content, created_at): violated after a day, else confirmed if more than
    ``least`` of their words are among the recent ones (tok), surprise = violated / all."""
    t = pending.select("id", "created_at", F.explode(F.array_distinct(tx.words(F.col("content")))).alias("tok"))
    share = t.join(recent_words.select("tok").distinct().withColumn("hit", F.lit(1.0)), "tok", "left").groupBy("id", "created_at").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"), F.count("*").alias("n"))
    return share.select("id", F.when(F.lit(as_of) - F.col("created_at") > DAY, "violated").when((F.col("n") >= 3) & (F.col("share") > least), "confirmed").otherwise("pending").alias("status"), "share")


def somatic_consult(markers: DataFrame, context: str, k: int = 5, least: float = 0.1) -> DataFrame:
    """Markers (id, content, valence, strength) that the context wakes: weight = overlap * strength."""
    ctx = F.array(*[F.lit(w) for w in dict.fromkeys(context.lower().split())])
    m = markers.withColumn("w", tx.jaccard(F.array_distinct(tx.words(F.col("content"))), ctx) * F.col("strength")).filter(F.col("w") > least)
    return m.orderBy(F.desc("w"), "id").limit(k).agg(F.count("*").alias("markers"), (F.sum(F.col("w") * F.col("valence")) / F.sum("w")).alias("gut"))


def option_weight(valence: Column) -> Column:
    """.5 + .3 valence, within [.05, .95]."""
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.5 + 0.3 * valence))


def running_capability(df: DataFrame, by: str = "domain") -> DataFrame:
    """Capability after each record of a domain: mean strength * ln(1 + n) / ln 6; drift beyond .15."""
    order = ["stored_at", "store_seq"]
    s = running(df.select(by, "id", *order, "strength"), by, order, F.col("strength"), "sum", "n").withColumn("capability", F.col("sum") / F.col("n") * F.log(1 + F.col("n")) / F.log(F.lit(6.0)))
    # The capability before follows from the same sums.
    before = F.when(F.col("n") > 1, (F.col("sum") - F.col("strength")) / (F.col("n") - 1) * F.log(F.col("n")) / F.log(F.lit(6.0)))
    return s.select(by, "id", "capability", F.coalesce(F.abs(F.col("capability") - before) > 0.15, F.lit(False)).alias("drift"))


def ego_boundary(turns: DataFrame) -> DataFrame:
    """Share of self in a conversation so far: (own + 1) / (all + 2), by turn."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = F.sum((F.col("role") == "assistant").cast("int")).over(w)
    return turns.select("conv_id", "turn", ((own + 1) / (F.count("*").over(w) + 2)).alias("self_share"))


def turn_estimates(turns: DataFrame) -> DataFrame:
    """Per turn: intensity from marks and capitals, novelty against the five turns before."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(-5, -1)
    t = turns.withColumn("t", F.array_distinct(tx.words(F.col("text"))))
    seen = F.array_distinct(F.flatten(F.collect_list("t").over(w)))
    marks = F.length("text") - F.length(F.translate("text", "!?", ""))
    return t.select("conv_id", "turn", F.least(F.lit(1.0), 0.2 * marks).alias("intensity"), F.when(F.size("t") == 0, 0.0).otherwise(1 - F.size(F.array_intersect("t", seen)) / F.size("t")).alias("novelty"))


def temporal_anchors(anchors: DataFrame, now: float, every: float) -> DataFrame:
    """Recurring anchors (id, due): urgency ladder and the next occurrence after now."""
    left = F.col("due") - now
    urgency = F.when(left < 0, 1.0).when(left <= 60, 0.9).when(left <= 3600, 0.7).when(left <= DAY, 0.4).otherwise(0.1)
    nxt = F.when(left >= 0, F.col("due")).otherwise(F.col("due") + F.ceil(-left / every) * every)
    return anchors.select("id", urgency.alias("urgency"), nxt.alias("next_due"))


def action_tiers(actions: DataFrame, tiers: dict[str, str], default: str = "ask") -> DataFrame:
    """Autonomy tier of each action (id, action), by lookup."""
    table = F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])
    return actions.select("id", "action", F.coalesce(table[F.col("action")], F.lit(default)).alias("tier"))


def norm_filter(actions: DataFrame, norms: DataFrame, block: float = 0.5, caution: float = 0.2, least: float = 0.05) -> DataFrame:
    """Actions (id, text) against prohibitive norms (subject, confidence): allow, caution or block.

    Only norms that share a word with the action are met.
    """
    a = actions.select("id", F.explode(F.array_distinct(tx.keywords(F.col("text"), 3))).alias("subject"))
    risk = a.join(norms, "subject").groupBy("id").agg(F.max("confidence").alias("risk"))
    r = actions.select("id").join(risk, "id", "left").select("id", F.coalesce("risk", F.lit(0.0)).alias("risk"))
    return r.select("id", "risk", F.when(F.col("risk") >= block, "block").when((F.col("risk") >= caution) & (F.col("risk") > least), "caution").otherwise("allow").alias("verdict"))


def abductive_hypotheses(observations: DataFrame, beliefs: DataFrame, least: float = 0.1, shared: int = 2, k: int = 5) -> DataFrame:
    """Beliefs (id, content) that may explain observations (id, content): similar and with two
    shared words at least; the k most similar each."""
    p = jaccard_across(observations, beliefs, tx.keywords(F.col("content")), least)
    r = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return p.withColumn("rank", r.cast("int")).filter(F.col("rank") <= k).select(F.col("a").alias("observation"), F.col("b").alias("belief"), "sim", "rank")


def plan_progress(steps: DataFrame) -> DataFrame:
    """Plans of steps (plan, step, needs, done): share done and steps whose need is done."""
    done = steps.filter("done").select("plan", F.col("step").alias("needs"), F.lit(True).alias("met"))
    s = steps.join(done, ["plan", "needs"], "left")
    ready = ~F.col("done") & (F.col("needs").isNull() | F.col("met").isNotNull())
    return s.groupBy("plan").agg(F.avg(F.col("done").cast("double")).alias("progress"), F.sum(ready.cast("long")).alias("ready"))


def budget_line() -> Line:
    return Line(1.0, 0.05 - 0.3 * F.col("strain") - 0.2 * F.col("drift"), 0.0, 1.0, 1.0)


def budget_label(c: Column) -> Column:
    return F.when(c > 0.75, "stable").when(c > 0.5, "strained").when(c > 0.25, "fragile").otherwise("critical")


def coherence_budget(events: DataFrame) -> DataFrame:
    """A session's budget after its events (strain, drift): -.3 strain - .2 drift + .05, within [0, 1]."""
    out = fold(events.select("session_id", "stored_at", "store_seq", "strain", "drift"), "session_id", ["stored_at", "store_seq"], {"budget": budget_line()})
    return out.select("session_id", "budget", budget_label(F.col("budget")).alias("label"))


def budget_history(events: DataFrame) -> DataFrame:
    """The audit of a session's budget: each event's change as it took effect, and the score after it."""
    s = scan(events.select("session_id", "id", "stored_at", "store_seq", "strain", "drift"), "session_id", ["stored_at", "store_seq"], {"budget": budget_line()})
    return s.select("session_id", "id", (F.col("budget") - F.col("budget_before")).alias("delta"), "budget", budget_label(F.col("budget")).alias("label"))


def inventions(df: DataFrame, share: float = 0.2, per_domain: int = 10, top: int = 20, same_rank: bool = False) -> DataFrame:
    """Rare words of two domains paired: originality = mean of 1 - frequency / largest frequency.

    All words of one domain meet all of the other; same_rank: only those of equal rank.
    """
    t = df.select("id", "domain", F.explode(F.array_distinct(tx.keywords(F.col("content")))).alias("tok"))
    n = df.groupBy("domain").agg(F.count("*").alias("n"))
    g = t.groupBy("domain", "tok").agg(F.count("*").alias("c")).join(n, "domain").filter(F.col("c") <= share * F.col("n"))
    few = g.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy("c", "tok"))).filter(F.col("r") <= per_domain)
    few = few.crossJoin(F.broadcast(few.agg(F.max("c").alias("most"))))
    side = lambda s: few.select(F.col("domain").alias(f"domain_{s}"), F.col("tok").alias(f"tok_{s}"), (1 - F.col("c") / F.col("most")).alias(f"o_{s}"), F.col("r").alias(f"r_{s}"))
    p = side("a").join(F.broadcast(side("b")), F.expr("domain_a < domain_b AND tok_a <> tok_b" + " AND r_a = r_b" * same_rank))
    return p.withColumn("originality", (F.col("o_a") + F.col("o_b")) / 2).orderBy(F.desc("originality"), "domain_a", "domain_b", "tok_a", "tok_b").limit(top).select("domain_a", "tok_a", "domain_b", "tok_b", "originality")


def property_transfer(df: DataFrame, source: str, target: str, k: int = 5) -> DataFrame:
    """First k words that a source domain has and a target lacks."""
    words = lambda d: df.filter(F.col("domain") == d).select(F.explode(F.array_distinct(tx.keywords(F.col("content")))).alias("property")).distinct()
    return words(source).join(words(target), "property", "left_anti").orderBy("property").limit(k)


def entity_counters(df: DataFrame, top: int = 50) -> DataFrame:
    """Capitalised words as entities: mentions, importance min(1, .5 + .05 (n - 1))."""
    e = df.select("id", F.explode(F.regexp_extract_all("content", F.lit("[A-Z][a-z]{3,}"), 0)).alias("entity"))
    g = e.groupBy("entity").agg(F.count("*").alias("mentions"))
    return g.select("entity", "mentions", F.least(F.lit(1.0), 0.5 + 0.05 * (F.col("mentions") - 1)).alias("importance")).orderBy(F.desc("mentions"), "entity").limit(top)


def entity_relations(df: DataFrame, least: int = 3) -> DataFrame:
    """Entities in one sentence: strength min(1, .4 + .1 (n - 1)); a sentence's entities are few."""
    s = df.select("id", F.posexplode(F.split("content", "[.\\n]")).alias("p", "s"))
    e = s.select("id", "p", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit("[A-Z][a-z]{3,}"), 0))).alias("e"))
    p = e.select("id", "p", F.col("e").alias("a")).join(e.select("id", "p", F.col("e").alias("b")), ["id", "p"]).filter("a < b")
    g = p.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return g.select("a", "b", "n", F.least(F.lit(1.0), 0.4 + 0.1 * (F.col("n") - 1)).alias("strength"))
