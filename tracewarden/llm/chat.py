"""Conversations as training windows with a loss mask.

Prefix sums of turn tokens place every turn on a ruler that is cut every
``stride`` tokens.  The turns within one stretch are a window's new turns; a
turn across a cut has a window of its own.  So a window's new turns fit the
stride unless a single turn is longer, whatever came before, and windows are
found without walking through the conversation, and no task gets a whole one.
Only :func:`window_digests` gathers a conversation, as its digests are of the
whole.  Each window starts with the
system turn and the turns of the last ``history`` tokens; these are repeated
and carry no loss.  Loss lies on the texts of new assistant turns.

Everything is a Column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.operators.ordered import running_sums, same_keys
from tracewarden.session import freeze

# The template.
OPEN, CLOSE = "<turn ", "</turn>\n"
WORD = r"[^\x20\x09-\x0D]+"
#: Tokens that the marks of a turn count.
MARKS = 4
STRIDE = 384
HISTORY = 96
#: Turns that one task looks up history in.
BLOCK = 4096


def escaped(text: Column) -> Column:
    """No mark can be written in the result; see :func:`unescaped`."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(text: Column) -> Column:
    """Each back slash is followed by a code; that of itself comes last."""
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _formatted(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(turn["role"]), F.lit(">"), escaped(turn["text"]), F.lit(CLOSE))


def _loss(turns: Column) -> Column:
    """``array<(start, end)>`` of the texts of new assistant turns."""

    def step(acc, t):
        begin = acc["at"] + F.length(F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(">")))
        end = begin + F.length(escaped(t["text"]))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        scored = t["new"] & (t["role"] == "assistant")
        return F.struct(
            (end + len(CLOSE)).alias("at"), F.when(scored, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out")
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(turns, begin, step, lambda acc: acc["out"])


def training_windows(
    conversations: DataFrame, stride: int = STRIDE, history: int = HISTORY, chunks: int | None = None, block: int = BLOCK
) -> DataFrame:
    """``(conv_id, first_turn, n_tokens, formatted, n_repeated, loss)`` of
    ``conversations(conv_id, turn, role, text)``.

    ``first_turn`` numbers a conversation's turns from 1 in the order of
    ``turn``, role and text (null turns first); null roles and texts are empty.
    The system turn is the first turn of role ``system``; windows that begin
    after it repeat it.  ``n_repeated`` turns at the start of a window were new
    in earlier ones.  Rows of null ``conv_id`` are one conversation; repeated
    rows are turns of their own.  Other columns are not read.  Conversations may
    have any length: turns are numbered in chunks and looked up in blocks of
    ``block`` turns.  Runs jobs and writes tables while it is built.
    """
    # A block's history must lie in the block before it.
    block = max(block, math.ceil(history / MARKS))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.select("conv_id", "turn", blank("role"), blank("text"))
    # Equal turns are interchangeable; numbering their copies lets them be dealt to several tasks.
    rows = rows.withColumn("copy", F.monotonically_increasing_id())
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(WORD)) + MARKS)
    rows = running_sums(
        rows, ["conv_id"], ["turn", "role", "text", "copy"], {"i": F.lit(1), "end": F.col("tokens")}, chunks
    )
    rows = rows.withColumn("begin", F.col("end") - F.col("tokens"))
    rows = freeze(rows.drop("turn", "copy").withColumn("block", F.floor((F.col("i") - 1) / block)))
    turn = F.struct("i", "role", "text", "tokens")
    # A turn has MARKS tokens at least, so so many turns of a block are history of the next.
    last = F.col("i") > (F.col("block") + 1) * block - math.ceil(history / MARKS)
    own = F.struct(F.col("block").alias("at"), F.lit(True).alias("own"))
    carried = F.struct((F.col("block") + 1).alias("at"), F.lit(False).alias("own"))
    dealt = rows.withColumn("to", F.explode(F.when(last, F.array(own, carried)).otherwise(F.array(own))))
    dealt = dealt.select("conv_id", "to.*", "i", "role", "text", "tokens", "begin", "end")
    near = Window.partitionBy("conv_id", "at").orderBy("begin").rangeBetween(-history, -1)
    dealt = dealt.withColumn("near", F.collect_list(turn).over(near)).filter("own")
    low, high = F.floor(F.col("begin") / stride), F.floor((F.col("end") - 1) / stride)
    grouped = dealt.groupBy("conv_id", low.alias("low"), high.alias("high")).agg(
        F.min_by(F.struct("near", "at"), "i").alias("past"),
        F.array_sort(F.collect_list(turn)).alias("fresh"),
    )
    systems = rows.filter("role = 'system'").groupBy("conv_id").agg(F.min_by(turn, "i").alias("system"))
    blocks = rows.groupBy("conv_id").agg(F.max("block").alias("top"))
    # One row for each block, so that the join has no large key.
    systems = same_keys(systems, blocks, ["conv_id"], "inner")
    systems = systems.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("at"), "system")
    grouped = same_keys(grouped.withColumn("at", F.col("past.at")), systems, ["conv_id", "at"], "left")
    system = F.when(F.col("system.i") < F.col("fresh")[0]["i"], F.col("system"))
    grouped = grouped.withColumn("past", F.struct(F.col("past.near").alias("near"), system.alias("system")))
    past = F.array_sort(F.col("past.near"))
    with_system = F.when(
        F.col("past.system").isNull() | F.exists(past, lambda t: t["i"] == F.col("past.system.i")), past
    ).otherwise(F.concat(F.array("past.system"), past))
    marked = lambda turns, new: F.transform(
        turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"), F.lit(new).alias("new"))
    )
    turns = F.concat(marked(with_system, False), marked(F.col("fresh"), True))
    windows = grouped.select("conv_id", F.col("fresh")[0]["i"].alias("first_turn"), turns.alias("turns"))
    return windows.select(
        "conv_id",
        "first_turn",
        F.aggregate("turns", F.lit(0), lambda n, t: n + t["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("turns", _formatted), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: ~t["new"])).alias("n_repeated"),
        _loss(F.col("turns")).alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """``(conv_id, first_turn, chars, turns, targets)`` from windows' texts and masks:
    the new turns ``(role, text)`` and the texts under the mask."""
    parts = F.split("formatted", CLOSE, -1)
    parts = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))
    head = lambda p: F.substring_index(p, ">", 1)
    read = lambda p: F.struct(
        unescaped(F.substring(head(p), F.lit(len(OPEN) + 1), F.length(p))).alias("role"),
        unescaped(F.substring(p, F.length(head(p)) + 2, F.length(p))).alias("text"),
    )
    target = lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    return windows.select(
        "conv_id", "first_turn", F.length("formatted").alias("chars"), F.transform(parts, read).alias("turns"), F.transform("loss", target).alias("targets")
    )


def window_digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows: ``(conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``.

    A digest is of one string, so a conversation's turns and scored texts must
    fit the 2 GB of one row together."""
    read = read_windows(windows)
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    each = read.select(
        "conv_id",
        F.struct(
            "first_turn",
            F.size("turns").alias("n"),
            "chars",
            F.array_join(F.transform("turns", line), "").alias("lines"),
            F.array_join("targets", "").alias("loss"),
        ).alias("part"),
    )
    parts = F.array_sort(F.collect_list("part"))
    whole = each.groupBy("conv_id").agg(parts.alias("parts"))
    joined = lambda f: F.array_join(F.transform("parts", lambda p: p[f]), "")
    return whole.select(
        "conv_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_turns"),
        F.sha2(joined("lines"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["chars"]).alias("formatted_chars"),
    )
