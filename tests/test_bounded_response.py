"""Bounded response against brute force, with one dominant key and any bound."""

import random

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import temporal
from tracewarden.session import freeze

SCHEMA = "key string, at long, tie int, p boolean, q boolean"


def brute(rows, within):
    found = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        placed = [r for r in mine if r[1] is not None]
        end = max((r[1] for r in placed), default=None)
        missed = [
            r[1] for i, r in enumerate(placed)
            if r[3] and not any(s[4] and s[1] - r[1] <= within for s in placed[i:])
        ]
        found[key] = (not missed, False if any(at + within < end for at in missed) else None)
    return found


def judged(df, within):
    got = temporal.bounded_response(df, ["key"], ["at", "tie"], "at", F.col("p"), F.col("q"), within, None)
    return {r.key: (r.closed, r.open) for r in got.collect()}


@pytest.mark.parametrize("within", [0, 1, 3, 17, 10_000])
def test_any_bound(spark, within):
    draw = random.Random(within)
    rows = [
        (
            "hot" if draw.random() < 0.4 else draw.choice([f"k{i}" for i in range(150)] + [None]),
            draw.choice([None, *range(-60, 60)]), i,
            draw.choice([True, False, None]), draw.choice([True, False, None]),
        )
        for i in range(1200)
    ]
    want = brute(rows, within)
    assert judged(freeze(spark.createDataFrame(rows, SCHEMA)), within) == want
    assert {v[0] for v in want.values()} == {True, False}


def test_hot_key_and_slot(spark):
    """One key with nearly all rows, all in one slot, and its last p open."""
    rows = spark.range(200_000).select(
        F.lit("hot").alias("key"), (F.col("id") % 1000).alias("at"), (F.col("id") / 1000).cast("int").alias("tie"),
        (F.col("id") % 7 == 0).alias("p"), (F.col("id") % 1000 == 990).alias("q"),
    )
    # Rows are ordered by (at, tie): p at 991 and later have no q after them.
    assert judged(rows, 5_000) == {"hot": (False, None)}
    assert judged(rows, 3) == {"hot": (False, False)}
    assert judged(rows.filter("at <= 990 and not (p and q)"), 990) == {"hot": (True, None)}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert judged(empty, 5) == {}
    with pytest.raises(ValueError):
        judged(empty.withColumn("at", F.col("at").cast("double")), 5)
    with pytest.raises(ValueError):
        judged(empty, -1)
