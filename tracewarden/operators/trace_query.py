"""Search for traces, services and operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.spans import has_attribute, string_attribute


def service_name() -> Column:
    return string_attribute(F.col("resource.attributes"), "service.name")


def get_trace(
    spans: DataFrame, trace_id: str, start: int | None = None, end: int | None = None
) -> DataFrame:
    """Spans of one trace, optionally started in ``[start, end)`` (nanoseconds)."""
    found = spans.filter(F.col("trace_id") == trace_id.lower())
    if start is not None:
        found = found.filter(F.col("start_time_unix_nano") >= start)
    if end is not None:
        found = found.filter(F.col("start_time_unix_nano") < end)
    return found


def matching_spans(
    spans: DataFrame,
    service: str | None = None,
    operation: str | None = None,
    attributes: dict[str, str] | None = None,
    start_min: int | None = None,
    start_max: int | None = None,
    duration_min: int | None = None,
    duration_max: int | None = None,
) -> DataFrame:
    """Spans that meet every given condition by themselves."""
    start = F.col("start_time_unix_nano")
    length = F.col("end_time_unix_nano") - start
    tests = []
    if service is not None:
        tests.append(service_name() == service)
    if operation is not None:
        tests.append(F.col("name") == operation)
    for key, value in (attributes or {}).items():
        tests.append(
            has_attribute(F.col("attributes"), key, value)
            | has_attribute(F.col("resource.attributes"), key, value)
        )
    if start_min is not None:
        tests.append(start >= start_min)
    if start_max is not None:
        tests.append(start < start_max)
    if duration_min is not None:
        tests.append(length >= duration_min)
    if duration_max is not None:
        tests.append(length <= duration_max)
    return spans.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def find_trace_ids(spans: DataFrame, limit: int | None = None, **conditions) -> DataFrame:
    """Ids of traces with a matching span; with a limit, the smallest ids."""
    ids = matching_spans(spans, **conditions).select("trace_id").distinct()
    return ids if limit is None else ids.orderBy("trace_id").limit(limit)


def find_traces(spans: DataFrame, limit: int | None = None, **conditions) -> DataFrame:
    """All spans of the traces that hold a matching span."""
    return spans.join(find_trace_ids(spans, limit, **conditions), "trace_id", "left_semi")


def services(spans: DataFrame) -> DataFrame:
    return spans.select(service_name().alias("service")).dropna().distinct()


def operations(spans: DataFrame, service: str, kind: int | None = None) -> DataFrame:
    """Distinct span names and kinds of a service."""
    found = spans.filter(service_name() == service)
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    return found.select("name", "kind").distinct()
