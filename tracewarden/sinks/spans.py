"""A stored table of spans that trace search can prune.

Spans lie in one folder per day of their start, sorted by trace id, with Parquet
Bloom filters on trace id and service, so that a search opens the folders of its
days and, of their row groups, those that may hold the id or service.  A second
table lists the days of each trace; it is dealt into folders by a hash of the
trace id, so looking one trace up reads one of these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators.trace_query import find_trace_ids, get_trace, service_name

#: Folders of the index of traces.
SHELVES = 64
#: Columns with Bloom filters, and the distinct values of a file these allow for.
BLOOM = {"trace_id": 1_000_000, "service": 10_000}
#: Columns that the store adds.
OWN = ("service", "day")


def _day(nanos: Column) -> Column:
    """The date (UTC) of a time in nanoseconds, floored also before 1970."""
    length = F.lit(86_400_000_000_000).cast("bigint")
    return F.date_from_unix_date(F.call_function("div", nanos - F.pmod(nanos, length), length).cast("int"))


def _shelf(trace_id: Column) -> Column:
    return F.pmod(F.xxhash64(trace_id), F.lit(SHELVES)).cast("int")


@dataclass(frozen=True)
class SpanStore:
    """Spans under ``path``; every method may run on any session that reads it."""

    path: str

    def append(self, spans: DataFrame, codec: str = "zstd") -> None:
        """Add spans.  Days are split over files where they are large and joined
        where they are small.  The index is written first: an append that fails
        in between leaves days listed that hold nothing, never spans that no
        search finds."""
        dated = spans.withColumns({"service": service_name(), "day": _day(F.col("start_time_unix_nano"))})
        days = dated.groupBy("trace_id", "day").count().drop("count")
        shelved = days.withColumn("shelf", _shelf(F.col("trace_id"))).hint("rebalance", "shelf")
        shelved.sortWithinPartitions("shelf", "trace_id").write.mode("append").partitionBy("shelf").parquet(f"{self.path}/traces")
        writer = dated.hint("rebalance", "day").sortWithinPartitions("day", "trace_id", "start_time_unix_nano").write
        for name, values in BLOOM.items():
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(
                f"parquet.bloom.filter.expected.ndv#{name}", str(values)
            )
        writer.mode("append").partitionBy("day").parquet(f"{self.path}/spans", compression=codec)

    def spans(self, spark: SparkSession) -> DataFrame:
        """All spans, with ``service`` and ``day``."""
        return spark.read.parquet(f"{self.path}/spans")

    def days_of(self, spark: SparkSession, trace_ids: DataFrame) -> DataFrame:
        """``(trace_id, day)`` of the given traces, each once."""
        index = spark.read.parquet(f"{self.path}/traces")
        wanted = trace_ids.select("trace_id", _shelf(F.col("trace_id")).alias("shelf")).distinct()
        return index.join(wanted, ["shelf", "trace_id"], "left_semi").select("trace_id", "day").distinct()

    def get_trace(self, spark: SparkSession, trace_id: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """Spans of one trace, optionally started in ``[start, end)`` nanoseconds.

        Its days (one row each) are looked up before the spans are read.
        """
        own = trace_id.lower()
        index = spark.read.parquet(f"{self.path}/traces")
        # A constant, so that the folder is chosen when the plan is made.
        shelf = spark.range(1).select(_shelf(F.lit(own))).first()[0]
        listed = index.filter((F.col("shelf") == shelf) & (F.col("trace_id") == own)).filter(_between(start, end))
        days = [r["day"] for r in listed.select("day").distinct().collect()]
        found = self.spans(spark).filter(F.col("day").isin(days) if days else F.lit(False))
        return get_trace(found, own, start, end).drop(*OWN)

    def find_traces(self, spark: SparkSession, limit: int | None = None, **conditions) -> DataFrame:
        """All spans of the traces that hold a matching span, as
        :func:`tracewarden.operators.trace_query.find_traces` finds them."""
        spans = self.spans(spark).filter(_between(conditions.get("start_min"), conditions.get("start_max")))
        if conditions.get("service") is not None:
            spans = spans.filter(F.col("service") == conditions["service"])
        ids = find_trace_ids(spans.drop(*OWN), limit, **conditions)
        listed = self.days_of(spark, ids)
        # One row for each day that has spans, however many traces are found.
        days = [r["day"] for r in listed.select("day").distinct().collect()]
        stored = self.spans(spark).filter(F.col("day").isin(days) if days else F.lit(False))
        return stored.join(listed, ["day", "trace_id"], "left_semi").drop(*OWN)


def _between(start: int | None, end: int | None) -> Column:
    """Days that may hold spans started in ``[start, end)`` nanoseconds."""
    met = F.lit(True)
    if start is not None:
        met &= F.col("day") >= _day(F.lit(start).cast("bigint"))
    if end is not None:
        met &= F.col("day") <= _day(F.lit(end - 1).cast("bigint"))
    return met
