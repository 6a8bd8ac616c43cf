"""Chat formatting with a grammar round trip, in DataFrame functions only.

    text  := turn*
    turn  := "### " role ": " body "</turn>" newline

A turn is rendered as it is and reparsed; if the parse does not give back its role and text, the
conflicting content is escaped and the turn reparsed again. Control strings are ``</turn>``,
``###`` and the backslash (in roles the colon too); texts without them stay untouched.

Turns are gathered in blocks of ``BLOCK`` turn numbers first and then by conversation, so that a
long conversation is not sorted row by row in one task.

Defined cases: null text and null role count as empty; a null turn sorts first; equal turn
numbers go by role, then text; rows with a null conv_id form one conversation; repeated rows are
repeated turns; texts of any length are kept whole; an empty table gives an empty result; extra
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
#: Fixed values of the template: control string -> escape, in the order of escaping.
ESCAPES = {"\\": "\\s", "</turn>": "\\e", "###": "\\h"}
ROLE_ESCAPES = ESCAPES | {":": "\\c"}
BLOCK = 64


def escape(c: Column, table: dict[str, str] = ESCAPES) -> Column:
    for raw, coded in table.items():
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def unescape(c: Column, table: dict[str, str] = ESCAPES) -> Column:
    for raw, coded in reversed(table.items()):
        c = F.replace(c, F.lit(coded), F.lit(raw))
    return c


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(SEP), body, F.lit(CLOSE))


def parse(text: Column) -> Column:
    """array<struct<role, text, body, head>> of a rendered text; null entries where the grammar fails.

    body is the text and head the role as they stand, still escaped.
    """
    def turn(part: Column) -> Column:
        head = F.substring_index(F.substr(part, F.lit(len(OPEN) + 1)), SEP, 1)
        body = F.substr(part, F.length(head) + len(OPEN) + len(SEP) + 1)
        ok = part.startswith(OPEN) & F.contains(part, F.lit(SEP)) & ~F.contains(head, F.lit("###")) & ~F.contains(body, F.lit("###"))
        return F.when(ok, F.struct(unescape(head, ROLE_ESCAPES).alias("role"), unescape(body).alias("text"), body.alias("body"), head.alias("head")))

    parts = F.split(text, CLOSE)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def format_turns(rows: DataFrame) -> DataFrame:
    """Per row: conv_id, turn, role, text, rendered, escaped (whether escaping was needed)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    base = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    raw = base.withColumn("raw", render(F.col("role"), F.col("text"))).withColumn("escaped", ~_gives_back(F.col("raw")))
    coded = render(escape(F.col("role"), ROLE_ESCAPES), escape(F.col("text")))
    # what the escaped turn says is read again as well; escapes leave no control string, so it can't fail
    sure = F.when(_gives_back(coded), coded).otherwise(F.raise_error(F.lit("an escaped turn does not read back")).cast("string"))
    return raw.select("conv_id", "turn", "role", "text", "escaped", F.when(~F.col("escaped"), F.col("raw")).otherwise(sure).alias("rendered"))


def _gives_back(rendered: Column) -> Column:
    """Whether a rendered text reads as the one turn of this row's role and text."""
    back = parse(rendered)
    first = F.get(back, F.lit(0))
    return (F.size(back) == 1) & F.coalesce((first["role"] == F.col("role")) & (first["text"] == F.col("text")), F.lit(False))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, loss_mask (array<struct<length int, loss boolean>>,
    runs of code points from the start; assistant texts count), n_escaped."""
    head = F.length("rendered") - len(CLOSE)
    turns = format_turns(rows).withColumn("body_chars", F.when(F.col("escaped"), F.length(escape(F.col("text")))).otherwise(F.length("text")))
    turns = turns.withColumn("mask", F.array(
        F.struct((head - F.col("body_chars")).cast("int").alias("length"), F.lit(False).alias("loss")),
        F.struct(F.col("body_chars").cast("int").alias("length"), (F.col("role") == "assistant").alias("loss")),
        F.struct(F.lit(len(CLOSE)).cast("int").alias("length"), F.lit(False).alias("loss"))))
    block = (turns.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"))
             .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered", "mask"))).alias("t"), F.sum(F.col("escaped").cast("long")).alias("n_escaped"))
             .select("conv_id", "block", F.array_join("t.rendered", "").alias("formatted"), F.flatten("t.mask").alias("mask"), "n_escaped"))
    return (block.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "formatted", "mask"))).alias("b"), F.sum("n_escaped").alias("n_escaped"))
            .select("conv_id", F.array_join("b.formatted", "").alias("formatted"), F.flatten("b.mask").alias("loss_mask"), "n_escaped"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted text says when read back: the columns of the chat query.

    The text under the mask is what the mask's runs cut out of the formatted text. Where the runs'
    lengths are those of each parsed turn's head, body and end, that is the bodies of the marked
    turns; if any differs, the runs are cut out one by one.
    """
    turns = formatted.withColumn("turns", parse(F.col("formatted")))
    run = lambda i, k: F.get("loss_mask", (i * 3 + k).cast("int"))
    fits = lambda t, i: (run(i, 0)["length"] == len(OPEN) + F.length(t["head"]) + len(SEP)) & (run(i, 1)["length"] == F.length(t["body"])) & (run(i, 2)["length"] == len(CLOSE)) & ~run(i, 0)["loss"] & ~run(i, 2)["loss"]
    agree = (F.size("loss_mask") == 3 * F.size("turns")) & F.forall(F.transform("turns", fits), lambda x: F.coalesce(x, F.lit(False)))
    lit = F.filter("turns", lambda t, i: run(i, 1)["loss"])
    bodies = F.array_join(F.transform(lit, lambda t: unescape(t["body"])), "")
    step = lambda s, r: F.struct((s["at"] + r["length"]).alias("at"), F.when(r["loss"], F.concat(s["out"], unescape(F.substr(F.col("formatted"), s["at"], r["length"])))).otherwise(s["out"]).alias("out"))
    slices = F.aggregate("loss_mask", F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), step)["out"]
    marked = F.when(agree, bodies).otherwise(slices)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(marked).cast("long").alias("loss_chars"), F.sha2(marked.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
