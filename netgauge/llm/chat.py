"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation (every role but `system`) the dialogue
is rendered with that speaker as `assistant`, the others as users named after
their roles, and loss masks (character spans) over what the speaker says.

A conversation is rendered in blocks of BLOCK turn numbers, so that a very long
one spreads over many tasks. A block of more than MOST turns (equal or null turn
numbers) is cut into parts of MOST turns, in order. Where a block begins comes
from sums over narrow rows, one a block, part and speaker: no text is gathered
beyond its part. Joining a conversation's blocks and parts in order gives its
whole text, and spans count from its beginning.

Defined cases: null text is empty; null role is the participant `unknown`; null
turn counts as -1; equal turns are ordered by role and text; repeated rows stay;
a conversation with system turns only has no perspective and so no row; null
conv_id is a conversation of its own; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgauge.llm.common import written

BLOCK, MOST = 128, 512
#: Characters of a text by which turns are dealt in order; those that agree in them stay together.
PREFIX = 64
TAIL, STOP = "<|im_end|>\n", "<|im_end|>"
OWN, SYSTEM, OTHER = "<|im_start|>assistant\n", "<|im_start|>system\n", "<|im_start|>user name="


def same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"_{k}"])
    return out


def named(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"_{k}" for k in keys})


def in_parts(c: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, block) with their part of the block: 0, but for blocks of more than MOST turns."""
    full = c.groupBy("conv_id", "block").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("conv_id", "block")
    full = named(written(full), "conv_id", "block")
    if full.isEmpty():
        return c.withColumn("part", F.lit(0).cast("long"))
    fits = same(c, full, "conv_id", "block")
    order = [F.col("conv_id").asc_nulls_first(), "block", F.coalesce("turn", F.lit(-1)), "role", F.left("text", F.lit(PREFIX))]
    parts = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = c.join(full, fits, "left_semi").repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    # The ids count within a partition; its number is in their upper bits.
    inside = written(inside.withColumn("id", F.monotonically_increasing_id())).withColumn("pid", F.shiftright("id", 33))
    runs = inside.groupBy("conv_id", "block", "pid").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id", "block").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = named(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "conv_id", "block", "pid")
    placed = inside.join(runs, same(inside, runs, "conv_id", "block", "pid"))
    placed = placed.withColumn("part", F.floor((F.col("before") + F.col("id") - F.col("first")) / MOST))
    return c.join(full, fits, "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(placed.select(*c.columns, "part"))


def offsets(c: DataFrame) -> DataFrame:
    """Turns -> conv_id, block, part, who: (speaker, first_char) of every participant, from counts and lengths alone."""
    at = ["conv_id", "block", "part"]
    roles = c.groupBy(*at, "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    head = F.when(F.col("role") == "system", len(SYSTEM)).otherwise(F.length("role") + len(OTHER) + 1)
    base = roles.groupBy(*at).agg(F.sum(F.col("n") * (head + len(TAIL)) + F.col("chars")).alias("base"))
    who = named(roles.where("role <> 'system'").select("conv_id", F.col("role").alias("speaker")).distinct(), "conv_id")
    each = base.join(who, same(base, who, "conv_id")).drop("_conv_id")
    own = named(roles.select(*at, F.col("role").alias("speaker"), "n"), *at, "speaker")
    each = each.join(own, same(each, own, *at, "speaker"), "left")
    shorter = F.length("speaker") + len(OTHER) + 1 - len(OWN)
    each = each.withColumn("length", F.col("base") - F.coalesce("n", F.lit(0)) * shorter)
    before = Window.partitionBy("conv_id", "speaker").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*at, "speaker", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("first_char"))
    return each.groupBy(*at).agg(F.collect_list(F.struct("speaker", "first_char")).alias("who"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, speaker, block, part, n_turns, text, spans, first_char, n_chars, masked_chars."""
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = in_parts(c.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("long")))
    at = ["conv_id", "block", "part"]
    blocks = c.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), "role", "text"))).alias("turns"))
    who = named(offsets(c), *at)
    both = blocks.join(who, same(blocks, who, *at)).select(*at, "turns", F.explode("who").alias("w")).select(*at, "turns", "w.speaker", "w.first_char")
    head = lambda t: F.when(t["role"] == F.col("speaker"), OWN).when(t["role"] == "system", SYSTEM).otherwise(F.concat(F.lit(OTHER), t["role"], F.lit("\n")))
    parts = both.withColumn("parts", F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["text"].alias("body"), (t["role"] == F.col("speaker")).alias("own"))))
    # (start, end) of what each turn says, from the conversation's beginning; the end token is learnt too.
    spans = F.aggregate(
        "parts",
        F.struct(F.col("first_char").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(TAIL)).cast("long").alias("at"),
            F.when(p["own"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).cast("long").alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(STOP)).cast("long").alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), "")
    r = parts.select("conv_id", "speaker", "block", "part", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), spans.alias("spans"), "first_char").withColumn("n_chars", F.length("text").cast("long"))
    masked = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return r.withColumn("masked_chars", masked)
