"""Temporal checks over the ordered rows of each key, as partial aggregates.

Every check gives one row per key with nullable booleans: NULL means
undecided.  ``holds`` is judged on sequences that are ``closed`` (no more rows
will come) or not; with ``closed=None`` one pass gives both judgements, in the
columns ``closed`` and ``open``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tracewarden.functions.spans import is_root
from tracewarden.operators.ordered import same_keys
from tracewarden.operators.sessions import sessionize, sessions, tumbling_letters
from tracewarden.session import freeze


def _flag(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def _judged(df: DataFrame, keys: list[str], ended: Column, running: Column, closed: bool | None) -> DataFrame:
    if closed is None:
        return df.select(*keys, ended.alias("closed"), running.cast("boolean").alias("open"))
    return df.select(*keys, (ended if closed else running.cast("boolean")).alias("holds"))


def always(rows: DataFrame, keys: list[str], p: Column, closed: bool | None = True) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.bool_and(_flag(p)).alias("kept"))
    return _judged(found, keys, F.col("kept"), F.when(~F.col("kept"), False), closed)


def eventually(rows: DataFrame, keys: list[str], p: Column, closed: bool | None = True) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.bool_or(_flag(p)).alias("met"))
    return _judged(found, keys, F.col("met"), F.when(F.col("met"), True), closed)


def eventually_always(
    rows: DataFrame, keys: list[str], order: list[str], p: Column, closed: bool | None = True
) -> DataFrame:
    """From some point on ``p`` holds to the end: it holds on the last row."""
    found = rows.groupBy(*keys).agg(F.max_by(_flag(p), F.struct(*order)).alias("last"))
    return _judged(found, keys, F.col("last"), F.lit(None), closed)


def response(
    rows: DataFrame, keys: list[str], order: list[str], p: Column, q: Column, closed: bool | None = True
) -> DataFrame:
    """Every ``p`` is followed, at or after it, by a ``q``."""
    place = F.struct(*order)
    ends = rows.groupBy(*keys).agg(
        F.max(F.when(_flag(p), place)).alias("last_p"), F.max(F.when(_flag(q), place)).alias("last_q")
    )
    answered = F.when(F.col("last_p").isNull(), True).otherwise(
        F.coalesce(F.col("last_p") <= F.col("last_q"), F.lit(False))
    )
    return _judged(ends, keys, answered, F.lit(None), closed)


def bounded_response(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    position: str,
    p: Column,
    q: Column,
    within: int,
    closed: bool | None = True,
) -> DataFrame:
    """Every ``p`` has a ``q`` at or after it, at most ``within`` positions on.

    ``position`` is the whole number that counts events, letters or
    nanoseconds, and never falls along ``order``, by which rows are ordered.
    While rows may still come, a ``p`` whose bound has not passed yet leaves
    the check undecided.  Rows without a position count as neither.

    Nothing is ordered.  Positions are cut into slots as wide as the bound, so
    an answer lies in the slot of its ``p`` or in the next one: it is enough to
    know the last ``q`` of the one and the first ``q`` of the other, which are
    partial aggregates.  Writes the narrow rows once while it is built.
    """
    if within < 0 or not isinstance(rows.schema[position].dataType, IntegralType):
        raise ValueError(f"{position} and its bound of {within} are to be whole numbers, the bound not below 0")
    width, at = max(within, 1), F.col(position).cast("long")
    needed = freeze(
        rows.select(
            *keys, at.alias("_at"), (at - F.pmod(at, F.lit(width))).alias("_slot"), F.struct(*order).alias("_place"),
            (_flag(p) & at.isNotNull()).alias("_p"), (_flag(q) & at.isNotNull()).alias("_q"),
        )
    )
    place, mark = needed.schema["_place"].dataType, F.col("_at")
    seen = F.array(
        F.struct(F.col("_slot"), F.col("_place").alias("_last"), F.lit(None).cast("long").alias("_next")),
        F.struct((F.col("_slot") - width).alias("_slot"), F.lit(None).cast(place).alias("_last"), mark.alias("_next")),
    )
    slots = needed.filter("_q").select(*keys, F.inline(seen)).groupBy(*keys, "_slot").agg(
        F.max("_last").alias("_last"), F.min("_next").alias("_next")
    )
    answered = F.coalesce(F.col("_last") >= F.col("_place"), F.lit(False)) | F.coalesce(
        F.col("_next") - mark <= within, F.lit(False)
    )
    met = same_keys(needed.filter("_p"), slots, [*keys, "_slot"], "left").filter(~answered)
    none = F.lit(None).cast("long")
    # The first open p of each key, and its end, from one aggregate.
    both = needed.select(*keys, mark.alias("_end"), none.alias("_first")).unionAll(
        met.select(*keys, none.alias("_end"), mark.alias("_first"))
    )
    found = both.groupBy(*keys).agg(F.max("_end").alias("_end"), F.min("_first").alias("_first"))
    passed = F.coalesce(F.col("_first") + within < F.col("_end"), F.lit(False))
    return _judged(found, keys, F.col("_first").isNull(), F.when(passed, False), closed)


def implies(a: Column, b: Column) -> Column:
    """Three-valued implication; ``&``, ``|`` and ``~`` are three-valued as they are."""
    return ~a | b


def combine(keys: list[str], **checks: DataFrame) -> DataFrame:
    """One row per key with a column per named check."""
    out = None
    for name, check in checks.items():
        column = check.select(*keys, F.col("holds").alias(name))
        out = column if out is None else out.join(column, keys, "full_outer")
    return out


def first_session(spans: DataFrame, gap_ms: int) -> DataFrame:
    """Spans of the first session of each key."""
    first = sessions(spans, gap_ms).groupBy("key").agg(F.min("session_start").alias("session_start"))
    return sessionize(spans, gap_ms).join(first, ["key", "session_start"], "left_semi")


def letters_of_first_session(
    spans: DataFrame, gap_ms: int, tick_ms: int, tests: dict[str, Column]
) -> DataFrame:
    """Letters that a formula reads: those of the session that holds the root."""
    return tumbling_letters(first_session(spans, gap_ms), tick_ms, tests)


def task_has_result(
    events: DataFrame, keys: list[str], order: list[str], requested: str, stored: str, closed: bool = True
) -> DataFrame:
    """Every requested task has its result stored, by span name."""
    return response(
        events, keys, order, F.col("name") == requested, F.col("name") == stored, closed
    )


def has_root(spans: DataFrame) -> DataFrame:
    return eventually(spans, ["key"], is_root(F.col("parent_span_id")))
