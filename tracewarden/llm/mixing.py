"""Mixing sources to target weights by weighted sampling without replacement.

A document's key is exponential with its quality weight as rate
(Efraimidis-Spirakis): ``-ln(u) / weight`` with ``u`` drawn from a hash of its
id (of its text where it has none), so that reruns agree.  Within a source, documents are taken in the order
of their keys until the prefix sum of sizes reaches the budget.  Budgets above
a source's size are complete epochs first; only the rest is sampled.

A source of any size is cut into key ranges of about ``RANGE`` documents by the
distribution of its keys, which follows from how many documents have which
weight; ranges are summed, prefix sums run over the sums, and only
within a range over documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.steps import tidy
from tracewarden.session import freeze

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
RANGE = 8192
#: Weights of good, unlabelled and poor documents.
GOOD, PLAIN, POOR = 2.0, 1.0, 0.5


#: Results beside the document's own columns.
RESULTS = ("size", "source_size", "target", "taken")


def uniform(key: Column) -> Column:
    """In (0, 1), from the first 52 bits of the key's MD5."""
    bits = F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("double")
    return (F.coalesce(bits, F.lit(0.0)) + 0.5) / float(2**52)


def quality_weights(labels: DataFrame) -> DataFrame:
    """``(doc_id, weight)``: 2 for good, 0.5 for poor documents; of repeated
    labels the best holds."""
    good = F.max("quality")
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.when(good > 0, GOOD).when(good <= 0, POOR).otherwise(PLAIN).alias("weight")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` of ``sizes(source, size)``.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    the sum of all sizes; a share stops at ``epochs`` times the source's size
    and the excess is shared anew by weight.  That ends at one water level:
    ``target = least(cap, level * weight)``.  One row per source is sorted.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = total.withColumn("w", F.get(listed, (F.row_number().over(by_name) - 1) % len(weights)))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(epochs))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = ranked.withColumns(
        {
            "all_size": F.sum(F.col("source_size").cast("double")).over(every),
            "all_w": F.sum("w").over(every),
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
            "place": F.row_number().over(by_level),
        }
    )
    # The level if all sources before this one are at their caps; the first
    # source whose own cap is not below it sets the level of all.
    ranked = ranked.withColumn("level", (F.col("all_size") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    uncapped = F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct("place", "level"))
    level = F.min(uncapped).over(every)
    return ranked.select("source", "source_size", F.least("cap", level["level"] * F.col("w")).alias("target"))


def mix(
    docs: DataFrame,
    labels: DataFrame | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = MOST_EPOCHS,
    range_size: int = RANGE,
    whole: bool = False,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each row of
    ``docs(doc_id, source, text)``.

    ``size`` counts words (null text: 0).  ``taken`` is the size times the
    number of times the mix takes the document: the complete epochs that its
    source's target holds, and one more where the document comes within the
    rest in key order; the document at the edge is taken if at least half of
    it fits, so a source ends within half a document of its target.  Empty
    documents take nothing.  Equal keys are ordered by id and size.  Rows
    without an id are drawn by their text; repeated ones of these have one key.
    ``labels(doc_id, quality)`` weigh the sampling; without them all weigh 1.
    With ``whole`` all columns of ``docs`` come along, those named like one of
    the other four results left out; without, no further columns are read.
    Runs jobs and writes tables to the shared folder while it is built.
    """
    tidy(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    by_text = F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit(""))))
    drawn = uniform(F.coalesce(F.col("doc_id").cast("string"), by_text))
    carried = [c for c in docs.columns if c not in RESULTS] if whole else []
    # Inside a struct the names of documents' columns clash with none.  Documents
    # are numbered where they are written, and only their numbers are sorted.
    along = [F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc")] if carried else []
    held = freeze(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size.alias("size"), drawn.alias("u"), *along))
    rows = held.drop("doc")
    targets = freeze(source_targets(rows, weights, epochs))
    if labels is not None:
        rows = rows.join(quality_weights(labels), "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(PLAIN))
    weight = F.coalesce("weight", F.lit(PLAIN))
    share = lambda w: F.avg((weight == w).cast("double"))
    counts = rows.groupBy(F.col("source").alias("s")).agg(
        F.ceil(F.count(F.lit(1)) / range_size).alias("ranges"), *[share(w).alias(f"share_{i}") for i, w in enumerate((GOOD, PLAIN, POOR))]
    )
    counts = freeze(counts)
    rows = rows.withColumn("key", -F.log("u") / weight)
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("s")))
    # The part of the source's keys that is expected below this one.
    below = sum(F.col(f"share_{i}") * (1 - F.exp(-w * F.col("key"))) for i, w in enumerate((GOOD, PLAIN, POOR)))
    rows = rows.withColumn("range", F.floor(below * F.col("ranges")))
    rows = rows.select("row", "doc_id", "source", "size", "key", "range")
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    over = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("range_size").over(over), F.lit(0)))
    sums = sums.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    sums = sums.select("s", F.col("range").alias("r"), "base", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - full * F.col("source_size")
    more = (F.col("base") + F.col("before") + F.col("size") / 2 <= rest).cast("long")
    taken = (F.col("size") * (full + more)).cast("long").alias("taken")
    if not whole:
        return rows.select("doc_id", "size", "source_size", "target", taken)
    rows = rows.select("row", "size", "source_size", "target", taken).join(held.select("row", "doc"), "row")
    return rows.select(*[F.col(f"doc.`{c}`").alias(c) for c in carried], "size", "source_size", "target", "taken")
