"""Small span tables for tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.schema import KEY_VALUES, SPANS


def value(text=None, **other):
    names = ["string_value", "bool_value", "int_value", "double_value", "array_value", "kvlist_value", "bytes_value"]
    given = {"string_value": text, **other}
    return tuple(given.get(n) for n in names)


def entries(pairs):
    return [(k, value(v)) for k, v in (pairs or {}).items()]


def span(trace, own, parent="", name="s", start=0, end=0, attributes=None, events=()):
    """A row of the spans table; ``events`` are (name, attributes) pairs."""
    return (
        trace, own, parent, "", 0, name, 1, start, end, entries(attributes),
        [(start, n, entries(a), 0) for n, a in events], [], 0, 0, 0, ("", 0),
        ("scope", "1", [], 0), "", ([("service.name", value("svc"))], 0), "",
    )


def spans(spark, rows):
    return spark.createDataFrame(rows, SPANS)


def attributes_column(spark, pairs):
    return spark.createDataFrame([(entries(pairs),)], f"a {KEY_VALUES}").select(F.col("a"))
