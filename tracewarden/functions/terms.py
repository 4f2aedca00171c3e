"""Text form of spans and of their start and end messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.spans import any_value_to_string

# The labels and separators below are the text form that readers
# of span terms expect.


def attribute_terms(attributes: Column) -> Column:
    """Entries as ``["key", "value"]`` joined by a space; ``nil`` when empty."""
    entries = F.transform(
        attributes, lambda a: F.concat(F.lit('["'), a["key"], F.lit('", "'), any_value_to_string(a["value"]), F.lit('"]'))
    )
    return F.when(F.size(attributes) == 0, "nil").otherwise(F.array_join(entries, " "))


def span_term() -> Column:
    """Term of a row of the spans table."""
    own = F.concat("trace_id", F.lit("/"), "span_id")

    def event_term(e: Column, index: Column) -> Column:
        return F.concat(
            F.lit(' < event("'), own, F.lit("/"), index.cast("string"), F.lit('") : Event | timeUnixNano : '),
            e["time_unix_nano"].cast("string"), F.lit(', name : "'), e["name"],
            F.lit('", attributes : '), attribute_terms(e["attributes"]), F.lit(" > "),
        )

    events = F.when(F.size("events") == 0, "nil").otherwise(
        F.array_join(F.transform("events", event_term), ", ")
    )
    term = F.concat(
        F.lit(' < span("'), own, F.lit('") : Span | traceId : "'), "trace_id",
        F.lit('", spanId : "'), "span_id", F.lit('", parentSpanId : "'), "parent_span_id",
        F.lit('", name : "'), "name",
        F.lit('", startTimeUnixNano : '), F.col("start_time_unix_nano").cast("string"),
        F.lit(", endTimeUnixNano : "), F.col("end_time_unix_nano").cast("string"),
        F.lit(", attributes : "), attribute_terms(F.col("attributes")),
        F.lit(", events : "), events, F.lit(" > "),
    )
    return F.regexp_replace(term, "[\\r\\n]", "")


def render_terms(spans: DataFrame) -> DataFrame:
    """One line per span, in column ``value``."""
    return spans.select(span_term().alias("value"))


def message_terms(events: DataFrame, monitor_id: str) -> DataFrame:
    """One line per start or end event, addressed to a monitor."""
    word = F.when(F.col("is_end"), "spanEnd(").otherwise("spanStart(")
    return events.select(
        F.concat(word, F.lit(monitor_id), F.lit(", "), span_term(), F.lit(")")).alias("value")
    )
