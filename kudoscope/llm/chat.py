"""Preference formatting of chat turns.

Chosen and rejected conversations share their first turns. The shared turns are
rendered once, as the prompt; what follows is rendered for each side, with a mask
over the assistant's words. A rendered turn is a row: no conversation is gathered in
one task, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kudoscope.llm import common
from kudoscope.session import materialise

OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
NO_ROLE = "unknown"
SEED = 23
_FIRST = -(1 << 63)  # stands for a null turn, which comes before all others


def render(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """A turn as text, and where its body starts and ends in it (code points)."""
    head, tail = OPEN.split("{role}")
    opening = F.concat(F.lit(head), F.coalesce(role, F.lit(NO_ROLE)), F.lit(tail))
    body = F.coalesce(text, F.lit(""))
    start = F.length(opening)
    return F.concat(opening, body, F.lit(CLOSE)), start, start + F.length(body)


def preference_segments(sides: DataFrame) -> DataFrame:
    """Render the turns ``pair_id, side ('chosen' or 'rejected'), turn, role, text``.

    Gives ``pair_id, part, turn, role, rendered, mask``. ``part`` is
    ``prompt`` for turns before the first one at which the sides differ, taken once,
    and ``chosen`` or ``rejected`` from there on. ``mask`` lists the spans of
    ``rendered`` to train on: the body of an assistant's turn after the prompt, with its
    end mark; it is empty for all else.

    Turns are ordered by ``turn``, a null one before all others; several rows of one
    turn count as one step and must all agree. Nulls in role or text equal each other
    and are rendered as an unknown role and an empty body. Sides that do not differ give
    a prompt only; a side with no turn left gives no row of its part; a null pair_id is
    a pair like any other; an empty table gives an empty result; other columns are not
    read.
    """
    turns = sides.select("pair_id", "side", F.coalesce("turn", F.lit(_FIRST)).alias("step"), "turn", "role", "text")
    content = F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("role").isNull(),
                         F.col("text").isNull()).cast("decimal(38,0)")
    chosen = F.col("side") == "chosen"

    def total(side: Column) -> Column:
        return F.sum(F.when(side, content))

    steps = turns.groupBy("pair_id", "step").agg(
        total(chosen).alias("a"), total(~chosen).alias("b"),
        F.count(F.when(chosen, 1)).alias("n_a"), F.count(F.when(~chosen, 1)).alias("n_b"))
    differ = ~(F.col("a").eqNullSafe(F.col("b")) & (F.col("n_a") == F.col("n_b")))
    first = steps.groupBy("pair_id").agg(F.min(F.when(differ, F.col("step"))).alias("parting"))
    first = materialise(first, "chat-parting").withColumnRenamed("pair_id", "_pair")
    placed = turns.join(first, turns["pair_id"].eqNullSafe(F.col("_pair"))).drop("_pair")
    shared = F.col("parting").isNull() | (F.col("step") < F.col("parting"))
    placed = placed.filter(chosen | ~shared)
    rendered, start, end = render(F.col("role"), F.col("text"))
    trained = ~shared & (F.col("role") == "assistant")
    span = F.array(F.struct(start.alias("start"), (end + len(CLOSE)).alias("end")))
    return placed.select(
        "pair_id", F.when(shared, "prompt").otherwise(F.col("side")).alias("part"), "turn", "role",
        rendered.alias("rendered"),
        F.when(trained, span).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("mask"))


def assemble(segments: DataFrame) -> DataFrame:
    """One row per pair: ``prompt, chosen, rejected`` and the masks of the two completions.

    A row holds a whole conversation, so this is for pairs that fit one training example;
    the segments themselves have no such limit.
    """
    step = F.coalesce("turn", F.lit(_FIRST))
    parts = (segments.groupBy("pair_id", "part")
             .agg(F.sort_array(F.collect_list(F.struct(step.alias("step"), "rendered", "mask"))).alias("turns")))
    before = F.transform("turns", lambda t, i: F.aggregate(
        F.slice("turns", 1, i), F.lit(0), lambda a, u: a + F.length(u["rendered"])))
    shifted = F.flatten(F.zip_with("turns", before, lambda t, b: F.transform(t["mask"], lambda m: F.struct(
        (m["start"] + b).alias("start"), (m["end"] + b).alias("end")))))
    text = F.array_join(F.transform("turns", lambda t: t["rendered"]), "")
    whole = parts.select("pair_id", "part", text.alias("text"), shifted.alias("mask"))

    def of(part: str, column: str) -> Column:
        return F.max(F.when(F.col("part") == part, F.col(column)))

    return whole.groupBy("pair_id").agg(
        F.coalesce(of("prompt", "text"), F.lit("")).alias("prompt"),
        F.coalesce(of("chosen", "text"), F.lit("")).alias("chosen"), of("chosen", "mask").alias("chosen_mask"),
        F.coalesce(of("rejected", "text"), F.lit("")).alias("rejected"), of("rejected", "mask").alias("rejected_mask"))


def borrowed_replies(turns: DataFrame, seed: int = SEED) -> DataFrame:
    """Both sides of a pair per conversation of ``conv_id, turn, role, text``.

    Chosen is the conversation as it is. Rejected is the same up to its last assistant
    turn, which is answered with the last assistant turn of another conversation and
    ends there. The other conversation is the next one by a seeded hash of conv_id,
    inside runs of about 256, so a large table is never ordered in one task. A
    conversation without an assistant turn, or one that borrows from itself or from an
    equal reply, has equal sides as far as they go.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    step = F.coalesce("turn", F.lit(_FIRST))
    last = F.max(F.when(F.col("role") == "assistant", F.struct(step.alias("step"), "turn", "text")))
    replies = materialise(turns.groupBy("conv_id").agg(last.alias("last")), "chat-replies")
    drawn = F.xxhash64(F.lit(seed), "conv_id")
    bits = common.run_bits(replies.count())
    ring = Window.partitionBy("run").orderBy("draw", "conv_id")
    whole = Window.partitionBy("run").orderBy("draw", "conv_id").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    partners = (replies.filter("last is not null")
                .select("conv_id", "last", drawn.alias("draw"), F.shiftrightunsigned(drawn, 64 - bits).alias("run"))
                .withColumn("other", F.coalesce(F.lead("last").over(ring), F.first("last").over(whole)))
                .select(F.col("conv_id").alias("_conv"), F.col("last.step").alias("_at"),
                        F.col("last.turn").alias("_turn"), F.col("other.text").alias("_reply")))
    partners = materialise(partners, "chat-partners")
    joined = turns.join(partners, turns["conv_id"].eqNullSafe(F.col("_conv")), "left")
    columns = [F.col("conv_id").alias("pair_id"), "side", "turn", "role", "text"]
    chosen = turns.withColumn("side", F.lit("chosen")).select(*columns)
    kept = joined.filter(F.col("_at").isNull() | (step < F.col("_at"))).withColumn("side", F.lit("rejected"))
    swapped = partners.select(F.col("_conv").alias("conv_id"), F.lit("rejected").alias("side"),
                              F.col("_turn").alias("turn"), F.lit("assistant").alias("role"),
                              F.col("_reply").alias("text"))
    return chosen.unionByName(kept.select(*columns)).unionByName(swapped.select(*columns))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a preference pair with a borrowed reply, one row per rendered turn."""
    segments = preference_segments(borrowed_replies(common.table(spark, sf_dir, "conversations")))
    return segments.select(F.col("pair_id").alias("conv_id"), "part", "turn", "role", "rendered",
                           F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])).alias("mask"))
