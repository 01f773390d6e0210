r"""Chat formatting by event-sourced reconstruction.

A log has rows (conv_id, seq, turn, kind, role, text). Partitioned by conversation and sorted by seq it is
folded into final messages:

* ``message`` opens (or replaces) the message of a turn, ``delta`` appends streamed text to it;
* ``edit`` replaces a turn's text and ``regenerate`` empties it (new deltas follow); both also end the old
  branch: what later turns said before that moment is gone;
* the role of a turn is the last one given.

The messages are rendered in turn order. A rendered turn is ``<turn>### Role: text</turn>`` and a newline.
Inside role and text three strings are escaped, so that every mark in the output is a real mark and reading
back is exact: ``\`` becomes ``\b``, ``<`` becomes ``\l``, ``###`` becomes ``\h``; a role's ``: `` becomes ``:\s``.

Defined results: null text and role are empty; null turn sorts first; null conv_id is a conversation of its
own; rows of a turn with equal seq and kind are one event delivered again, of which the last text in order counts
once; a turn's rows of equal seq and other kinds are ordered with deltas last; very long texts are kept whole; columns other than
the six are not read, whatever their names; an empty log gives no rows. A rendered conversation is one
value, so its size bounds the task that joins its turns; folding and rendering need no more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import table, text_or_empty

OPEN, CLOSE = "<turn>### ", "</turn>\n"


def _replace(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _replace(c, [("\\", "\\b"), ("<", "\\l"), ("###", "\\h")])


def unescape(c: Column) -> Column:
    """Every backslash in escaped text starts a pair, so the order is free except that ``\\b`` comes last."""
    return _replace(c, [("\\h", "###"), ("\\l", "<"), ("\\s", " "), ("\\b", "\\")])


def fold(log: DataFrame) -> DataFrame:
    """The log -> a row for each final message: conv_id, turn, role, text. One shuffle, by conv_id."""
    cuts = F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))
    resets = F.when(F.col("kind").isin("edit", "regenerate", "message"), F.col("seq"))
    earlier = W.partitionBy("conv_id").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("conv_id", "turn")
    role = F.max(F.when(F.col("role") != "", F.struct("seq", "role"))).over(own)["role"]
    alive = log.withColumn("_cut", F.max(cuts).over(earlier)).where("_cut is null or seq > _cut")
    alive = alive.withColumns({"_reset": F.max(resets).over(own), "_role": role}).where("_reset is null or seq >= _reset")
    part = F.struct("seq", (F.col("kind") == "delta").alias("later"), "kind", text_or_empty("text").alias("text"))
    sent = F.array_sort(F.collect_list(part))
    out = alive.groupBy("conv_id", "turn").agg(sent.alias("_s"), F.coalesce(F.first("_role"), F.lit("")).alias("role"))
    after = lambda i: F.get(F.col("_s"), i + 1)
    once = F.filter("_s", lambda x, i: after(i).isNull() | (after(i)["seq"] != x["seq"]) | (after(i)["kind"] != x["kind"]))
    return out.select("conv_id", "turn", "role", F.array_join(F.transform(once, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Messages -> a row for each conversation: conv_id, formatted, and loss_spans, an array of (turn: index of
    the rendered turn, start: code points before the span in that turn, length) under the loss mask."""
    head = F.concat(F.lit(OPEN), _replace(escape(F.col("role")), [(": ", ":\\s")]), F.lit(": "))
    turn = F.struct(F.col("turn"), head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("loss"))
    grouped = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_t"))
    spans = F.filter(
        F.transform("_t", lambda x, i: F.struct(i.alias("turn"), F.length(x["head"]).alias("start"), F.length(x["body"]).alias("length"), x["loss"].alias("loss"))),
        lambda s: s["loss"],
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("_t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(spans, lambda s: s.dropFields("loss")).alias("loss_spans"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Read rendered conversations back: conv_id, turns (array of role, text), loss (array of texts under the mask)."""
    pieces = F.split("formatted", CLOSE)
    body = F.col("_pieces")
    content = lambda p: F.substr(p, F.lit(len(OPEN) + 1))
    return (
        formatted.withColumn("_pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
        .withColumn("turns", F.transform(body, lambda p: F.struct(
            unescape(F.substring_index(content(p), ": ", 1)).alias("role"),
            unescape(F.substr(content(p), F.instr(content(p), ": ") + 2)).alias("text"))))
        .withColumn("loss", F.transform("loss_spans", lambda s: unescape(F.substr(F.get(body, s["turn"]), s["start"] + 1, s["length"]))))
        .drop("_pieces")
    )


def as_log(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: one message each. Equal turns of a conversation stay apart, by role and text."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), "role", "text")
    return rows.select("conv_id", "seq", F.col("seq").alias("turn"), F.lit("message").alias("kind"), "role", "text")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
    back = parse(render(fold(as_log(rows))))
    loss = F.array_join("loss", "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(20 + length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '###', '\h'), ': ', ':\s'))
      + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '###', '\h')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
