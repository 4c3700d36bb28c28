"""Perspective rotation of dialogues: every participant in turn is the assistant, all others are users with a name.

DataFrame functions only. Turns are gathered in parts of PART_TURNS consecutive turn numbers, so that no row grows with the
length of a dialogue; the parts of a perspective, one after the other, are the whole rendered dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import number_sorted
from .common import query, table

#: Consecutive turn numbers that share a row.
PART_TURNS = 64
# Fixed values of the chat format.
BEGIN, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
#: The speaker of turns without one.
NOBODY = "unknown"


def _quoted(text: Column) -> Column:
    """Markers inside a text lose their meaning: a space parts their first two characters."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, speaker: str = "role", part_turns: int = PART_TURNS) -> DataFrame:
    """One row per dialogue, participant and part: conv_id, perspective, part, n_turns, text, masks.

    ``turns`` has conv_id, turn, ``speaker`` and text. Participants are the distinct speakers but ``system``, whose turns stay
    system turns in every perspective; a dialogue without participants has no rows. In a perspective the participant's turns have
    the role assistant, all others the role user and the speaker as name. ``masks`` are the spans (start, end exclusive, in
    characters of the row's text) to learn from: the assistant's texts with their end markers.

    Turns are counted in the order of their numbers (null ones first), those with the same number in that of speaker and text, and each ``part_turns`` of them are a part, so
    a dialogue without turn numbers has parts like any other; repeated rows stay repeated. Null speakers are ``unknown``, null texts
    empty, a null conv_id is a dialogue of its own. Other columns are ignored.
    """
    clean = turns.select(
        "conv_id", F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"),
        F.coalesce(F.col(speaker), F.lit(NOBODY)).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"),
    )
    numbered = number_sorted(clean, ["conv_id"], ["turn", "speaker", "text"], "no")
    parts = (
        numbered.groupBy("conv_id", F.floor((F.col("no") - 1) / part_turns).cast("long").alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))
    )
    participants = clean.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("own_id"), F.col("speaker").alias("perspective")).distinct()
    rows = parts.join(participants, F.col("conv_id").eqNullSafe(F.col("own_id")))

    def head(t: Column) -> Column:
        role = F.when(t["speaker"] == F.col("perspective"), "assistant").when(t["speaker"] == SYSTEM, SYSTEM)
        return F.concat(F.lit(BEGIN), F.coalesce(role, F.concat(F.lit("user name="), _quoted(t["speaker"]))), F.lit("\n"))

    pieces = F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), F.concat(_quoted(t["text"]), F.lit(END)).alias("body"), (t["speaker"] == F.col("perspective")).alias("learn"),
    ))
    empty = F.lit(None).cast("array<struct<start: int, end: int>>")
    walked = F.aggregate(
        "pieces", F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<struct<start: int, end: int>>")).alias("masks")),
        lambda seen, p: F.struct(
            (seen["at"] + F.length(p["head"]) + F.length(p["body"]) + 1).alias("at"),
            F.when(p["learn"], F.concat(seen["masks"], F.array(F.struct(
                (seen["at"] + F.length(p["head"])).alias("start"), (seen["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"),
            )))).otherwise(seen["masks"]).alias("masks"),
        ),
    )
    return rows.withColumn("pieces", pieces).select(
        "conv_id", "perspective", "part", F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        walked["masks"].alias("masks"),
    )


@query("op4_perspectives", f"""
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '{NOBODY}') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker, text) - 1) // {PART_TURNS} AS part FROM t),
s AS (SELECT t.conv_id, p.perspective, part, turn, speaker, t.text,
  '{BEGIN}' || CASE WHEN speaker = p.perspective THEN 'assistant' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user name=' || replace(speaker, '<|', '< |') END || chr(10) AS head,
  replace(t.text, '<|', '< |') || '{END}' AS body, speaker = p.perspective AS learn
  FROM n t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
r AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING) AS upto FROM s)
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY turn, speaker, text) AS text,
  coalesce(string_agg(CAST(CAST(upto - 1 - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(upto - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY turn, speaker, text) FILTER (learn), '') AS masks
FROM r GROUP BY conv_id, perspective, part""")
def op4(spark, sf_dir):
    """Every dialogue from the view of each of its participants, with the spans to learn from."""
    rows = rotate(table(spark, sf_dir, "conversations"))
    return rows.withColumn("masks", F.concat_ws(",", F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"]))))
