"""Spans from plain tables: click events, conversations, and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.schema import (
    KEY_VALUES,
    SPAN_EVENTS,
    number_value,
    attribute_entry,
    no_attributes,
    span_row,
    text_entry,
)

SECOND = 1_000_000_000


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def utc_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since the epoch of a timestamp column, read as UTC."""
    kind = dict(df.dtypes)[column]
    if kind == "timestamp_ntz":
        moved = f"convert_timezone('UTC', current_timezone(), {column})"
        return F.expr(f"unix_micros(cast({moved} as timestamp))")
    return F.unix_micros(F.col(column).cast("timestamp"))


def hex_number(number: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(number.cast("bigint"))), width, "0")


def _service(name: Column) -> Column:
    return F.struct(
        F.array(text_entry("service.name", name)).cast(KEY_VALUES).alias("attributes"),
        F.lit(0).alias("dropped_attributes_count"),
    )


def _scope(name: str) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        F.lit("1").alias("version"),
        no_attributes().alias("attributes"),
        F.lit(0).alias("dropped_attributes_count"),
    )


def spans_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """One trace per user; the user's first event is the root of the rest.

    The first event per user is a partial aggregate of one row per user; the
    join back leaves a user with very many events to adaptive skew splitting.
    """
    rows = load(spark, folder, "events")
    rows = rows.select(
        "event_id",
        "user_id",
        "event_type",
        utc_micros(rows, "ts").alias("micros"),
        F.round(F.col("value") * 1_000_000).cast("bigint").alias("length"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    first = rows.groupBy("user_id").agg(
        F.min(F.struct("micros", "event_id"))["event_id"].alias("root_id")
    )
    start = F.col("micros") * 1000
    bucket = F.concat(F.lit("k"), (F.col("k") % 7).cast("string"))
    entries = F.filter(
        F.array(
            text_entry("event.type", F.col("event_type")),
            F.when(F.col("k") % 10 != 0, text_entry("bucket", bucket)),
            attribute_entry("k", number_value(F.col("k"))),
        ),
        lambda e: e.isNotNull(),
    )
    return rows.join(first, "user_id").select(
        *span_row(
            trace_id=hex_number(F.col("user_id"), 32),
            span_id=hex_number(F.col("event_id"), 16),
            parent_span_id=F.when(F.col("event_id") == F.col("root_id"), "").otherwise(
                hex_number(F.col("root_id"), 16)
            ),
            name=F.col("event_type"),
            start_time_unix_nano=start,
            end_time_unix_nano=start + F.col("length"),
            attributes=entries,
            resource=_service(F.concat(F.lit("svc"), (F.col("user_id") % 3).cast("string"))),
            scope=_scope("events"),
        )
    )


def spans_from_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """One trace per conversation: user turns are roots, others their children.

    Texts sit in ``gen_ai`` messages; the key attribute ``chat_id`` ends in
    the conversation's epoch second.
    """
    rows = load(spark, folder, "conversations")
    epoch = F.lit(1_700_000_000).cast("bigint") + F.col("conv_id") * 86400
    start = (epoch + F.col("turn") * 60) * SECOND
    payload = F.to_json(F.array(F.struct(F.col("text"))))

    def message(name: str, key: str) -> Column:
        return F.array(
            F.struct(
                start.alias("time_unix_nano"),
                F.lit(name).alias("name"),
                F.array(text_entry(key, payload)).alias("attributes"),
                F.lit(0).alias("dropped_attributes_count"),
            )
        ).cast(SPAN_EVENTS)

    is_user, is_bot = F.col("role") == "user", F.col("role") == "assistant"
    chat_id = F.concat_ws(
        "/", F.lit("conv"), F.col("conv_id").cast("string"), epoch.cast("string")
    )
    entries = F.filter(
        F.array(
            text_entry("chat_id", chat_id),
            F.when(is_bot, text_entry("gen_ai.operation.name", F.lit("chat"))),
        ),
        lambda e: e.isNotNull(),
    )
    trace = hex_number(F.col("conv_id"), 32)
    own = hex_number(F.col("conv_id") * 1_000_000 + F.col("turn"), 16)
    return rows.select(
        *span_row(
            trace_id=trace,
            span_id=own,
            parent_span_id=F.when(is_user, "").otherwise(
                hex_number(F.col("conv_id") * 1_000_000, 16)
            ),
            name=F.when(is_user, "ask").when(is_bot, "chat").otherwise("setup"),
            start_time_unix_nano=start,
            end_time_unix_nano=start + 30 * SECOND,
            attributes=entries,
            events=F.when(is_user, message("gen_ai.user.message", "content"))
            .when(is_bot, message("gen_ai.choice", "message"))
            .otherwise(F.array().cast(SPAN_EVENTS)),
            resource=_service(F.lit("conversations")),
            scope=_scope("conversations"),
        )
    )


def spans_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One trace per order: an ``order`` root and one ``ship`` child per line.

    A line's span id comes from order and line number, which repeat in the
    table, so the spans hold natural duplicates.
    """
    orders = load(spark, folder, "orders")
    ordered = orders.select(
        "o_orderkey", (utc_micros(orders, "o_orderdate") * 1000).alias("ordered")
    )
    roots = ordered.select(
        "o_orderkey",
        F.lit(0).alias("line"),
        "ordered",
        (F.col("ordered") + F.lit(3600 * SECOND)).alias("shipped"),
    )
    lines = load(spark, folder, "lineitem")
    shipped = lines.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_linenumber").alias("line"),
        (utc_micros(lines, "l_shipdate") * 1000).alias("shipped"),
    )
    children = shipped.join(ordered, "o_orderkey").select(
        "o_orderkey", "line", "ordered", "shipped"
    )
    own = hex_number(F.col("o_orderkey") * 16 + F.col("line"), 16)
    is_order = F.col("line") == 0
    return roots.unionByName(children).select(
        *span_row(
            trace_id=hex_number(F.col("o_orderkey"), 32),
            span_id=own,
            parent_span_id=F.when(is_order, "").otherwise(
                hex_number(F.col("o_orderkey") * 16, 16)
            ),
            name=F.when(is_order, "order").otherwise("ship"),
            start_time_unix_nano=F.col("ordered"),
            end_time_unix_nano=F.col("shipped"),
            resource=_service(F.lit("orders")),
            scope=_scope("orders"),
        )
    )


def sim_spans_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Planned spans from orders and lines, with ids that repeat nowhere.

    Line ``n`` of an order hangs below line ``n - 1`` where that exists, else
    below the order, so that trees have several levels.  The table repeats
    line numbers; further copies of a line hang below the order with ids of
    their own.  Every row of both tables is a span.
    """
    orders = load(spark, folder, "orders")
    lines = load(spark, folder, "lineitem")
    trace = F.concat(F.lit("order"), F.col("o_orderkey").cast("string"))
    roots = orders.select(
        trace.alias("trace_id"),
        F.lit("root").alias("span_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit("order").alias("span_name"),
        F.lit(0).cast("bigint").alias("start_offset_ms"),
        (F.col("o_custkey") % 5000).cast("bigint").alias("duration_ms"),
    )
    # Both windows lie on the same shuffle and sort of the lines, by order.
    detail = ["l_partkey", "l_quantity"]
    before = F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", *detail))
    copy = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*detail))
    numbered = lines.select("l_orderkey", "l_linenumber", *detail).withColumn("before", before).withColumn("copy", copy)
    # A first copy comes right behind the lines of the next smaller number.
    follows = F.col("l_orderkey").isNotNull() & (F.col("copy") == 1) & (F.col("before") == F.col("l_linenumber") - 1)
    placed = numbered.select(
        F.col("l_orderkey").alias("o_orderkey"),
        "l_linenumber",
        F.col("l_partkey").alias("part"),
        F.col("l_quantity").alias("quantity"),
        "copy",
        follows.alias("has_above"),
    )
    line = F.concat(F.lit("line"), F.col("l_linenumber").cast("string"))
    own = F.when(F.col("copy") > 1, F.concat(line, F.lit("-"), F.col("copy").cast("string")))
    children = placed.select(
        trace.alias("trace_id"),
        F.coalesce(own, line).alias("span_id"),
        F.when(
            F.col("has_above"),
            F.concat(F.lit("line"), (F.col("l_linenumber") - 1).cast("string")),
        ).otherwise("root").alias("parent_id"),
        F.lit("ship").alias("span_name"),
        (F.col("part") % 3000).cast("bigint").alias("start_offset_ms"),
        (F.col("quantity") * 100 - 300).cast("bigint").alias("duration_ms"),
    )
    return roots.unionByName(children).withColumns(
        {
            "span_kind": F.lit("INTERNAL"),
            "attributes": F.create_map(F.lit("line"), F.col("span_id")),
        }
    )
