"""Throughput tables: rows per second and running counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_minute(df: DataFrame, ms: Column, label: Column | None = None) -> DataFrame:
    """Rows per minute and the rate per second, by the minute of a time in ms."""
    minute = F.call_function("div", ms, F.lit(60_000).cast("bigint")) * 60_000
    by = [minute.alias("minute_ms")] + ([label.alias("label")] if label is not None else [])
    names = ["minute_ms", "label"][: len(by)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(
        *names, "n", (F.col("n") / 60).alias("per_second")
    )


def processed_total(counters: DataFrame, ignored: Column) -> DataFrame:
    """Spans of the sessions that were not ignored."""
    return counters.filter(~F.coalesce(ignored, F.lit(False))).agg(
        F.sum("n_spans").alias("spans_processed"), F.count(F.lit(1)).alias("sessions")
    )


def rate_by(
    df: DataFrame, ms: Column, label: Column, range_s: int = 60, step_s: int = 15
) -> DataFrame:
    """Rate per second over the last ``range_s`` seconds, every ``step_s``.

    Rows are counted per step first; only the counts are spread over the
    windows that contain the step.  ``range_s`` is a multiple of ``step_s``.
    """
    if step_s <= 0 or range_s % step_s:
        raise ValueError(f"{range_s} s is no multiple of steps of {step_s} s")
    step = F.lit(step_s * 1000).cast("bigint")
    slot = F.call_function("div", ms, step) * step
    counts = df.groupBy(label.alias("label"), slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    ends = F.sequence(F.lit(1), F.lit(range_s // step_s))
    windows = counts.withColumn("i", F.explode(ends)).withColumn(
        "window_end_ms", F.col("slot") + F.col("i") * step
    )
    return windows.groupBy("label", "window_end_ms").agg(
        (F.sum("n") / range_s).alias("per_second")
    )


def counter_rate(
    samples: DataFrame, ms: Column, value: Column, label: Column, range_s: int = 60, step_s: int = 15
) -> DataFrame:
    """``(label, window_end_ms, samples, increase, per_second)`` of a counter.

    Every ``step_s`` seconds, over the samples of the last ``range_s`` seconds
    (the end included, the start not).  A value below the one before it is a
    restart from 0, so it counts whole.  ``per_second`` is the increase carried
    on to the window's borders: up to the border where the nearest sample lies
    within 1.1 mean distances of it, else half a mean distance, and never back
    beyond the time at which the counter would have been 0.  Windows whose
    samples are not of two times at least have no row; samples without time or
    value are left out, those of one time are ordered by value.

    A step's samples become one summary per label, so only samples of one label
    and step are sorted together; a window merges the summaries of its steps.
    """
    if step_s <= 0 or range_s % step_s:
        raise ValueError(f"{range_s} s is no multiple of steps of {step_s} s")
    step, span = F.lit(step_s * 1000).cast("bigint"), range_s * 1000
    rows = samples.select(label.alias("label"), ms.cast("bigint").alias("ms"), value.cast("double").alias("value"))
    rows = rows.filter("ms is not null and value is not null").withColumn("slot", F.col("ms") + F.pmod(-F.col("ms"), step))
    grown = lambda now, before: F.when(now < before, now).otherwise(now - before)
    order = Window.partitionBy("label", "slot").orderBy("ms", "value")
    rows = rows.withColumn("more", F.coalesce(grown(F.col("value"), F.lag("value").over(order)), F.lit(0.0)))
    point = F.struct("ms", "value")
    slots = rows.groupBy("label", "slot").agg(
        F.min(point).alias("first"), F.max(point).alias("last"), F.count(F.lit(1)).alias("n"), F.sum("more").alias("more")
    )
    ends = F.sequence(F.lit(0), F.lit(range_s // step_s - 1))
    windows = slots.withColumn("i", F.explode(ends)).withColumn("window_end_ms", F.col("slot") + F.col("i") * step)
    parts = windows.groupBy("label", "window_end_ms").agg(
        F.array_sort(F.collect_list(F.struct("slot", "first", "last", "n", "more"))).alias("parts")  # one a step
    )

    def merged(acc, x):
        more = acc["more"] + x["more"] + grown(x["first"]["value"], acc["last"]["value"])
        return F.struct(
            acc["slot"].alias("slot"), acc["first"].alias("first"), x["last"].alias("last"), (acc["n"] + x["n"]).alias("n"), more.alias("more")
        )

    whole = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0], merged)
    found = parts.select("label", "window_end_ms", whole.alias("w")).select(
        "label", "window_end_ms", F.col("w.first.ms").alias("a"), F.col("w.last.ms").alias("b"),
        F.col("w.first.value").alias("begin"), F.col("w.n").alias("samples"), F.col("w.more").alias("increase"),
    ).filter("b > a")
    seconds = (F.col("b") - F.col("a")) / 1000
    mean = seconds / (F.col("samples") - 1)
    ahead = (F.col("a") - (F.col("window_end_ms") - span)) / 1000
    behind = (F.col("window_end_ms") - F.col("b")) / 1000
    positive = (F.col("increase") > 0) & (F.col("begin") >= 0)
    ahead = F.when(positive, F.least(ahead, seconds * (F.col("begin") / F.col("increase")))).otherwise(ahead)
    reach = lambda gap: F.when(gap >= mean * 1.1, mean / 2).otherwise(gap)
    rate = F.col("increase") * ((seconds + reach(ahead) + reach(behind)) / seconds) / range_s
    return found.select("label", "window_end_ms", "samples", "increase", rate.alias("per_second"))


def observed(df: DataFrame, name: str) -> DataFrame:
    """Count the rows that pass here while a batch or a stream runs."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))
