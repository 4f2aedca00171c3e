"""Schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One OTLP attribute value: at most one field is set.  Lists and nested
# key-value lists are held as JSON text because Spark structs cannot recurse.
ANY_VALUE = (
    "struct<string_value:string,bool_value:boolean,int_value:bigint,"
    "double_value:double,array_value:string,kvlist_value:string,"
    "bytes_value:binary>"
)
KEY_VALUES = f"array<struct<key:string,value:{ANY_VALUE}>>"
SPAN_EVENTS = (
    "array<struct<time_unix_nano:bigint,name:string,"
    f"attributes:{KEY_VALUES},dropped_attributes_count:int>>"
)
SPAN_LINKS = (
    "array<struct<trace_id:string,span_id:string,trace_state:string,"
    f"attributes:{KEY_VALUES},dropped_attributes_count:int,flags:int>>"
)
STATUS = "struct<message:string,code:int>"
SCOPE = (
    f"struct<name:string,version:string,attributes:{KEY_VALUES},"
    "dropped_attributes_count:int>"
)
RESOURCE = f"struct<attributes:{KEY_VALUES},dropped_attributes_count:int>"

# Column name -> type of the spans table, in column order.
SPAN_COLUMNS = {
    "trace_id": "string",
    "span_id": "string",
    "parent_span_id": "string",
    "trace_state": "string",
    "flags": "int",
    "name": "string",
    "kind": "int",
    "start_time_unix_nano": "bigint",
    "end_time_unix_nano": "bigint",
    "attributes": KEY_VALUES,
    "events": SPAN_EVENTS,
    "links": SPAN_LINKS,
    "dropped_attributes_count": "int",
    "dropped_events_count": "int",
    "dropped_links_count": "int",
    "status": STATUS,
    "scope": SCOPE,
    "scope_schema_url": "string",
    "resource": RESOURCE,
    "resource_schema_url": "string",
}
SPANS = ", ".join(f"{name} {kind}" for name, kind in SPAN_COLUMNS.items())

# Span kinds by code (fixed values of the trace format).
SPAN_KINDS = ["UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"]

VERDICTS = (
    "key string, session_start bigint, session_end bigint, "
    "propertyName string, truthValue string"
)

# Rows of a simulation file, as written in the file.
SIM_SPANS = (
    "spanId struct<traceId:string,spanId:string>, parentId string, "
    "spanName string, spanKind string, startTimeOffsetMs bigint, "
    "durationMs bigint, attributes map<string,string>"
)


def text_value(value: Column) -> Column:
    """An attribute value holding a string."""
    return F.struct(
        value.cast("string").alias("string_value"),
        F.lit(None).cast("boolean").alias("bool_value"),
        F.lit(None).cast("bigint").alias("int_value"),
        F.lit(None).cast("double").alias("double_value"),
        F.lit(None).cast("string").alias("array_value"),
        F.lit(None).cast("string").alias("kvlist_value"),
        F.lit(None).cast("binary").alias("bytes_value"),
    )


def number_value(value: Column) -> Column:
    """An attribute value holding a 64-bit integer."""
    return text_value(F.lit(None)).withField("int_value", value.cast("bigint"))


def double_value(value: Column) -> Column:
    """An attribute value holding a double."""
    return text_value(F.lit(None)).withField("double_value", value.cast("double"))


def bool_value(value: Column) -> Column:
    """An attribute value holding a boolean."""
    return text_value(F.lit(None)).withField("bool_value", value.cast("boolean"))


def attribute_entry(key: str, value: Column) -> Column:
    """One entry of an attribute list; plain columns become string values."""
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def text_entry(key: str, value: Column) -> Column:
    return attribute_entry(key, text_value(value))


def no_attributes() -> Column:
    return F.array().cast(KEY_VALUES)


def span_row(**columns: Column) -> list[Column]:
    """The full spans schema from the given columns; the rest is empty."""
    empty = {
        "trace_state": F.lit(""),
        "flags": F.lit(0),
        "kind": F.lit(1),
        "parent_span_id": F.lit(""),
        "attributes": no_attributes(),
        "events": F.array().cast(SPAN_EVENTS),
        "links": F.array().cast(SPAN_LINKS),
        "dropped_attributes_count": F.lit(0),
        "dropped_events_count": F.lit(0),
        "dropped_links_count": F.lit(0),
        "status": F.struct(F.lit("").alias("message"), F.lit(0).alias("code")),
        "scope_schema_url": F.lit(""),
        "resource_schema_url": F.lit(""),
    }
    out = []
    for name, kind in SPAN_COLUMNS.items():
        value = columns.get(name, empty.get(name, F.lit(None)))
        out.append(value.cast(kind).alias(name))
    return out
