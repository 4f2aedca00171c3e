"""Column functions on spans, their attributes and their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.payloads import escape_json, let, message_text, text_contains

NANOS_PER_MS = 1_000_000


def hex_id(raw: Column) -> Column:
    """Binary id as lower-case hex, two digits per byte."""
    return F.lower(F.hex(raw))


def is_root(parent_span_id: Column) -> Column:
    return F.coalesce(parent_span_id, F.lit("")) == ""


def nanos_to_ms(nanos: Column) -> Column:
    """Whole milliseconds of a nanosecond count, in integer arithmetic."""
    return F.call_function("div", nanos, F.lit(NANOS_PER_MS).cast("bigint"))


def ms_to_nanos(ms: Column) -> Column:
    return ms * F.lit(NANOS_PER_MS).cast("bigint")


def event_time(nanos: Column) -> Column:
    """Nanoseconds since the epoch as a timestamp of millisecond precision."""
    return F.timestamp_millis(nanos_to_ms(nanos))


def span_duration_nanos(start: Column, end: Column) -> Column:
    """Distance between start and end, never negative."""
    return F.abs(end - start)


def named(spans: DataFrame, name: str) -> DataFrame:
    return spans.filter(F.col("name") == name)


def span_label(name: Column, span_id: Column, trace_id: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", name, span_id, trace_id), F.lit(")"))


def event_label(
    is_start: Column, epoch: Column, name: Column, span_id: Column, trace_id: Column
) -> Column:
    """Short text of a start or end event."""
    word = F.when(is_start, "SpanStart(").otherwise("SpanEnd(")
    return F.concat(
        word, epoch.cast("string"), F.lit(", "), span_label(name, span_id, trace_id), F.lit(")")
    )


def any_value_to_string(value: Column) -> Column:
    """Text of an attribute value as it stands in terms: strings are escaped."""
    text = value["string_value"]
    return F.when(text.isNotNull(), escape_json(text)).otherwise(plain_value(value))


def plain_value(value: Column) -> Column:
    """Text of an attribute value; lists and nested lists give a fixed word."""
    return (
        F.when(value["string_value"].isNotNull(), value["string_value"])
        .when(value["bool_value"].isNotNull(), value["bool_value"].cast("string"))
        .when(value["int_value"].isNotNull(), value["int_value"].cast("string"))
        .when(value["double_value"].isNotNull(), value["double_value"].cast("string"))
        # The two words are fixed values of the text form.
        .when(value["array_value"].isNotNull(), F.lit("unsupportedArrayValue"))
        .when(value["kvlist_value"].isNotNull(), F.lit("unsupportedKvlistValue"))
        .when(value["bytes_value"].isNotNull(), hex_id(value["bytes_value"]))
        .otherwise(F.lit(""))
    )


def attribute(attributes: Column, key: str) -> Column:
    """Text of the first entry with the key; NULL when there is none."""
    texts = F.transform(
        F.filter(attributes, lambda a: a["key"] == key), lambda a: plain_value(a["value"])
    )
    return F.get(texts, F.lit(0))


def string_attribute(attributes: Column, key: str) -> Column:
    """First entry with the key that holds a string; NULL when there is none."""
    entry = F.get(
        F.filter(
            attributes, lambda a: (a["key"] == key) & a["value"]["string_value"].isNotNull()
        ),
        F.lit(0),
    )
    return entry["value"]["string_value"]


def has_attribute(attributes: Column, key: str, value: str) -> Column:
    """Whether some entry pairs the key with the value."""
    return F.coalesce(
        F.exists(
            attributes,
            lambda a: (a["key"] == key) & (plain_value(a["value"]) == value),
        ),
        F.lit(False),
    )


def matches_span(attributes: Column, wanted: dict[str, str]) -> Column:
    """Whether every wanted pair occurs among the attributes."""
    found = F.lit(True)
    for key, value in wanted.items():
        found = found & has_attribute(attributes, key, value)
    return found


# Attribute pairs of a span that generates an image (fixed values).
IMAGE_GENERATION = {
    "gen_ai.operation.name": "execute_tool",
    "gen_ai.tool.name": "generate_image",
}


def is_image_generation_span(attributes: Column) -> Column:
    return matches_span(attributes, IMAGE_GENERATION)


def event_by_name(events: Column, name: str) -> Column:
    """First event of the span with the name; NULL when there is none."""
    return F.get(F.filter(events, lambda e: e["name"] == name), F.lit(0))


def has_event(events: Column, name: str) -> Column:
    return F.coalesce(F.exists(events, lambda e: e["name"] == name), F.lit(False))


def event_name(event: Column) -> Column:
    return event["name"]


def span_events(span: Column) -> Column:
    return span["events"]


def event_attribute(event: Column, key: str) -> Column:
    return attribute(event["attributes"], key)


def count_down(n: Column) -> Column:
    """One less, but never below zero."""
    return F.greatest(n - 1, F.lit(0).cast("int"))


def bot_message(attributes: Column, events: Column) -> Column:
    """Text of the first choice event of a chat span."""
    text = message_text(event_attribute(event_by_name(events, "gen_ai.choice"), "message"))
    return F.when(attribute(attributes, "gen_ai.operation.name") == "chat", text)


# Instruction text that does not count as a mention (fixed value).
TOOL_INSTRUCTION = "You MUST use the tool 'say_something_nice' NOW"


def is_mention_text(text: Column, word: str) -> Column:
    def mentions(t: Column) -> Column:
        return text_contains(t, word, ignore_case=True) & ~text_contains(t, TOOL_INSTRUCTION)

    return let(text, mentions)


def is_mention_span(parent_span_id: Column, events: Column, word: str) -> Column:
    """Root span whose first user message mentions the word."""
    text = message_text(event_attribute(event_by_name(events, "gen_ai.user.message"), "content"))
    return F.coalesce(is_root(parent_span_id) & is_mention_text(text, word), F.lit(False))
