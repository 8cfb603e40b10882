"""Multi-party perspective rotation of dialogues (operator 2), with DataFrame functions alone.

For every participant of a conversation the whole dialogue is rendered with
that speaker as the assistant and all others as named users:

    <|assistant|>\\n{text}\\n          <|user name={role}|>\\n{text}\\n          <|system|>\\n{text}\\n

The result has one row per (conversation, speaker, message): its place, the
rendered segment, the character span of its content in the rendering of the
whole dialogue, and ``loss``, true for the speaker's own messages; joined in
the order of ``pos`` the segments are the rendering.  A row is never larger
than a message, so a conversation of any length can be rendered: offsets are
running sums within blocks of ``BLOCK`` turns plus those of the blocks before.

Defined results: the system role is shown but is no participant.  A null text
is empty; a null role is the user ``unknown`` and no participant; a null
conversation id is a conversation of its own.  Messages are ordered by turn
(null first), role and text; repeated rows are kept as often as they occur.
Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.common import salted_join

ASSISTANT, SYSTEM = "<|assistant|>\n", "<|system|>\n"
USER_BEFORE, USER_AFTER = "<|user name=", "|>\n"
TAIL = "\n"
UNKNOWN = "unknown"
BLOCK = 1024
_NO_CONVERSATION = -(2**63)


def rotate(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """conv_id, speaker, pos, turn, role, name, segment, start, end, loss of every message in every perspective."""
    rows = messages.select(
        F.coalesce(F.col(conv).cast("long"), F.lit(_NO_CONVERSATION)).alias("c"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).alias("who"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62)))
    rows = rows.groupBy("c", "turn", "who", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("block", block)
    speakers = rows.where(F.col("who").isNotNull() & (F.col("who") != system)).select("c", F.col("who").alias("speaker")).dropDuplicates()
    seen = salted_join(rows, speakers, ["c"])
    own = F.coalesce(F.col("who") == F.col("speaker"), F.lit(False))
    name = F.coalesce("who", F.lit(UNKNOWN))
    head = F.when(own, ASSISTANT).when(F.col("who") == system, SYSTEM).otherwise(F.concat(F.lit(USER_BEFORE), name, F.lit(USER_AFTER)))
    seen = seen.withColumn("own", own).withColumn("head", head)
    seen = seen.withColumn("size", F.length("head") + F.length("text") + len(TAIL))
    key = ["c", "speaker", "block"]
    sums = seen.groupBy(*key).agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n"))
    before = Window.partitionBy("c", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, _total("size", before).alias("size_before"), _total("n", before).alias("n_before"))
    inside = Window.partitionBy(*key).orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("who"), "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumn("at", _total("size * n", inside)).withColumn("nth", _total("n", inside)).join(sums, key)
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start = F.col("size_before") + F.col("at") + F.col("copy") * F.col("size") + F.length("head")
    return copies.select(
        F.when(F.col("c") != _NO_CONVERSATION, F.col("c")).alias("conv_id"),
        "speaker",
        (F.col("n_before") + F.col("nth") + F.col("copy")).alias("pos"),
        "turn",
        F.when(F.col("own"), "assistant").when(F.col("who") == system, system).otherwise("user").alias("role"),
        F.when(~F.col("own") & ~F.coalesce(F.col("who") == system, F.lit(False)), name).alias("name"),
        F.concat("head", "text", F.lit(TAIL)).alias("segment"),
        start.alias("start"),
        (start + F.length("text")).alias("end"),
        F.col("own").alias("loss"),
    )


def _total(what: str, window) -> Column:
    return F.coalesce(F.sum(F.expr(what)).over(window), F.lit(0)).cast("long")


ORACLE = """
WITH m AS (SELECT conv_id, turn, role AS who, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS speaker FROM m WHERE who IS NOT NULL AND who <> 'system'),
s AS (
  SELECT m.*, p.speaker, coalesce(who = speaker, false) AS own,
    CASE WHEN coalesce(who = speaker, false) THEN '<|assistant|>' || chr(10) WHEN who = 'system' THEN '<|system|>' || chr(10)
         ELSE '<|user name=' || coalesce(who, 'unknown') || '|>' || chr(10) END AS head
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, row_number() OVER w - 1 AS pos,
    coalesce(sum(length(head) + length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who NULLS FIRST, text))
SELECT conv_id, speaker, CAST(pos AS BIGINT) AS pos, turn,
  CASE WHEN own THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user' END AS role,
  CASE WHEN NOT own AND NOT coalesce(who = 'system', false) THEN coalesce(who, 'unknown') END AS name,
  head || text || chr(10) AS segment,
  CAST(before + length(head) AS BIGINT) AS start, CAST(before + length(head) + length(text) AS BIGINT) AS "end", own AS loss
FROM o
"""
