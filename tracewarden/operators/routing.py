"""Attribute-filtered routing of messages to subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.ordered import numbered


def fan_out(messages: DataFrame, topic_subscriptions: DataFrame) -> DataFrame:
    """Each message of a topic once per subscription of the topic.

    Columns: messages (msg_id, topic, attributes as JSON text),
    topic_subscriptions (topic, subscription).
    """
    return messages.join(topic_subscriptions, "topic")


def _at_path(payload: Column, path: Column) -> Column:
    """Text at a dotted path that is given by a column."""
    quoted = F.concat(F.lit("$['"), F.replace(path, F.lit("."), F.lit("']['")), F.lit("']"))
    return F.call_function("get_json_object", payload, quoted)


def filter_holds(payload: Column, path: Column, value: Column) -> Column:
    """Whether a filter given by columns holds; a NULL path means no filter.

    Paths are dotted, as in ``payloads.json_field``.
    """
    return F.when(path.isNull(), True).otherwise(
        F.coalesce(_at_path(payload, path) == value, F.lit(False))
    )


def route(fanned: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Messages per subscriber whose filter holds on the message's attributes.

    ``subscribers`` has subscription, subscriber, filter_key, filter_value.
    Each message gives the values at the paths that some filter of the
    subscription names; path and value are then part of the join, so a message
    meets the subscribers that get it and no others.
    """
    out = ["subscriber", "subscription", "topic", "msg_id"]
    filtered = subscribers.filter("filter_key is not null")
    paths = filtered.select("subscription", "filter_key").distinct()
    values = fanned.join(paths, "subscription").withColumn(
        "filter_value", _at_path(F.col("attributes"), F.col("filter_key"))
    )
    met = values.join(filtered, ["subscription", "filter_key", "filter_value"]).select(*out)
    free = subscribers.filter("filter_key is null").select("subscription", "subscriber")
    return met.unionByName(fanned.join(free, "subscription").select(*out))


def received(routed: DataFrame, chunks: int | None = None) -> DataFrame:
    """What each subscriber got, numbered in message order.

    A subscriber may have got any number of messages, so the list is rows.
    """
    once = routed.select("subscriber", "msg_id").distinct()
    return numbered(once, ["subscriber"], ["msg_id"], "position", chunks)


def msg_received(routed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whether each wanted (subscriber, msg_id) was received."""
    got = routed.select("subscriber", "msg_id").distinct().withColumn("got", F.lit(True))
    return wanted.join(got, ["subscriber", "msg_id"], "left").withColumn(
        "received", F.coalesce("got", F.lit(False))
    ).drop("got")


def undelivered(routed: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (subscriber, msg_id) pairs that were not routed."""
    return expected.join(routed, ["subscriber", "msg_id"], "left_anti")


def delivery_check(routed: DataFrame, expected: DataFrame) -> DataFrame:
    """Per subscriber, how much was expected and whether all of it came."""
    seen = msg_received(routed, expected.select("subscriber", "msg_id").distinct())
    return seen.groupBy("subscriber").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if("received").alias("delivered"),
        F.bool_and("received").alias("holds"),
    )
