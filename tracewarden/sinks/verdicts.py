"""The table of verdict documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verdict_documents(verdicts: DataFrame, evaluated_at: Column | None = None) -> DataFrame:
    """Documents as they are stored; times are timestamps of ms precision."""
    now = F.current_timestamp() if evaluated_at is None else evaluated_at
    return verdicts.select(
        "key",
        F.timestamp_millis("session_start").alias("startDate"),
        F.date_trunc("millisecond", now).alias("evaluationDate"),
        "propertyName",
        "truthValue",
    )


def _laid_out(documents: DataFrame) -> DataFrame:
    """By property and day; large groups are split over files, small ones joined."""
    dated = documents.withColumn("day", F.to_date("startDate"))
    return dated.hint("rebalance", "propertyName", "day").sortWithinPartitions(
        "propertyName", "day", "startDate"
    )


def write_verdicts(documents: DataFrame, path: str) -> None:
    """Append documents; evaluating again adds further ones."""
    _laid_out(documents).write.mode("append").partitionBy("propertyName", "day").parquet(path)


def write_verdict_batch(documents: DataFrame, batch_id: int, path: str) -> None:
    """Write one batch of a stream; a repeated batch replaces itself."""
    _laid_out(documents).write.mode("overwrite").partitionBy("propertyName", "day").parquet(
        f"{path}/batch_id={batch_id}"
    )


def verdicts_in_range(documents: DataFrame, property_name: str, start: Column, end: Column) -> DataFrame:
    """Documents of a property started within the range, both ends included.

    A stored table has a ``day`` partition for each date; only those of the
    range are listed and read.
    """
    met = (F.col("propertyName") == property_name) & F.col("startDate").between(start, end)
    if "day" in documents.columns:
        met &= F.col("day").between(F.to_date(start), F.to_date(end))
    return documents.filter(met)


def latest_verdicts(documents: DataFrame) -> DataFrame:
    """The last evaluation of each key and property.

    A partial aggregate, so a key that was evaluated very often shrinks
    before the shuffle.
    """
    newest = Window.partitionBy("key", "propertyName").orderBy(
        F.desc("evaluationDate"), F.desc("startDate"), F.desc("truthValue")
    )
    return documents.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
