"""Chat formatting: every dialogue rendered from the seat of each of its speakers.

For each participant the dialogue is written once: its own turns as the assistant's,
those of others as a user's with the speaker's name, system turns as they are.  The mask
has the character ranges to train on, which are the assistant's words and the mark that
ends them.  Marks inside a turn's text are broken up, so a text can't open a turn.

A dialogue of more than ``part_turns`` turns is rendered in parts, numbered from 0, whose
texts follow each other; no task gets a whole dialogue of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.operators.ranking import group_rank
from sigframe.runtime import durable

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PART_TURNS = 512


def _plain(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<\|", "< |")


def rotate_speakers(
    turns: DataFrame, system: str = "system", part_turns: int = PART_TURNS
) -> DataFrame:
    """``conv_id, speaker, part, n_turns, text, mask`` for each dialogue and participant.

    Reads ``conv_id, turn, role, text``; other columns are ignored.  Turns are ordered by
    ``turn`` (null first), then role and text; repeated rows are turns of their own.  A
    null text is an empty turn, a null role the participant ``unknown``.  Null
    ``conv_id`` is a dialogue like any other.  A dialogue of system turns only has no
    participant and gives no row; an empty table gives an empty result.  ``mask`` lists
    ``start, length`` in characters of ``text``.
    """
    named = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        _plain("text").alias("text"),
        F.coalesce(_plain_name("role"), F.lit("unknown")).alias("role"),
    )
    place = F.coalesce(F.floor(F.col("turn") / 64), F.lit(-(2**62))).cast("long")
    ranked = durable(
        group_rank(named, ["conv_id"], ["turn", "role", "text"], out="place", slice_of=place)
        .withColumn("part", F.floor(F.col("place") / part_turns).cast("long")),
        "turns",
    )
    seats = ranked.filter(F.col("role") != system).select("conv_id", F.col("role").alias("speaker")).distinct()
    seats = seats.withColumnRenamed("conv_id", "seat_conv")
    seated = ranked.join(seats, F.col("conv_id").eqNullSafe(F.col("seat_conv"))).drop("seat_conv")
    own = F.col("role") == F.col("speaker")
    head = (
        F.when(own, F.lit("assistant"))
        .when(F.col("role") == system, F.lit("system"))
        .otherwise(F.concat(F.lit("user name="), "role"))
    )
    lead = F.concat(F.lit(OPEN), head, F.lit("\n"))
    piece = F.struct(
        "place",
        F.concat(lead, "text", F.lit(CLOSE + "\n")).alias("shown"),
        F.length(lead).alias("lead"),
        F.when(own, F.length("text") + len(CLOSE)).otherwise(0).alias("trained"),
    )
    parts = seated.groupBy("conv_id", "speaker", "part").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    spans = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<struct<start:int,length:int>>").alias("mask")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["shown"])).alias("at"),
            F.when(
                x["trained"] > 0,
                F.concat(
                    acc["mask"],
                    F.array(F.struct((acc["at"] + x["lead"]).alias("start"), x["trained"].alias("length"))),
                ),
            ).otherwise(acc["mask"]).alias("mask"),
        ),
        lambda acc: acc["mask"],
    )
    return parts.select(
        "conv_id", "speaker", "part",
        F.size("p").cast("long").alias("n_turns"),
        F.array_join(F.transform("p", lambda x: x["shown"]), "").alias("text"),
        spans.alias("mask"),
    )


def _plain_name(role: str) -> Column:
    """Speaker's name on one line without marks."""
    return F.regexp_replace(F.regexp_replace(F.col(role), r"<\|", "< |"), "[\r\n]", " ")
