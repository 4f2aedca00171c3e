"""Ordered scans over chunks give what a plain pass over each key gives."""

import random

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import ordered
from tracewarden.operators.ordered import CHUNK, into_chunks, multiple, next_values, numbered, prefixes, running_sums


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    # One key holds most rows; many keys hold one or two.
    data = [("hot", i, rng.randrange(-5, 6), rng.random() < 0.02) for i in range(3000)]
    data += [(f"k{i % 400}", i, rng.randrange(9), rng.random() < 0.3) for i in range(900)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "key string, at int, v int, mark boolean")


@pytest.mark.parametrize("chunks", [None, 1, 5, 40])
def test_running_sums(rows, chunks):
    data, df = rows
    got = running_sums(df, ["key"], ["at"], {"total": F.col("v"), "n": F.lit(1)}, chunks)
    assert got.columns == ["key", "at", "v", "mark", "total", "n"]
    found = {(r.key, r.at): (r.total, r.n) for r in got.collect()}
    state = {}
    for key, at, v, _ in sorted(data):
        total, n = state.get(key, (0, 0))
        state[key] = (total + v, n + 1)
        assert found[(key, at)] == state[key]
    assert len(found) == len(data)


@pytest.mark.parametrize("chunks", [1, 7, 40])
def test_numbered_spans_chunks(rows, chunks):
    data, df = rows
    got = numbered(df, ["key"], ["at"], chunks=chunks)
    assert got.filter("key = 'hot'").agg(F.max("seq")).first()[0] == 3000
    assert got.filter("key = 'hot' and seq <> at + 1").count() == 0


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("chunks", [1, 6, 40])
def test_next_values(rows, strict, chunks):
    data, df = rows
    got = next_values(
        df, ["key"], ["at"], {"q": F.when(F.col("mark"), F.col("at")), "w": F.when(F.col("v") == 5, F.col("v"))},
        strict, chunks,
    )
    found = {(r.key, r.at): (r.q, r.w) for r in got.collect()}
    by_key = {}
    for row in sorted(data):
        by_key.setdefault(row[0], []).append(row)
    for key, mine in by_key.items():
        for i, (_, at, _, _) in enumerate(mine):
            rest = mine[i + 1 :] if strict else mine[i:]
            q = next((r[1] for r in rest if r[3]), None)
            w = next((r[2] for r in rest if r[2] == 5), None)
            assert found[(key, at)] == (q, w)


def test_chunks_are_bounded_in_one_partition(rows, monkeypatch):
    data, df = rows
    monkeypatch.setattr(ordered, "CHUNK_BITS", 5)
    placed = into_chunks(df, ["key"], ["at"], 2)
    assert placed.groupBy(CHUNK).count().agg(F.max("count")).first()[0] <= 32
    got = running_sums(df, ["key"], ["at"], {"total": F.col("v"), "n": F.lit(1)}, 2)
    want = {}
    for key, at, v, _ in sorted(data):
        total, n = want.get(key, (0, 0))
        want[key] = (total + v, n + 1)
    last = got.groupBy("key").agg(F.max_by(F.struct("total", "n"), "at").alias("s"))
    assert {r.key: tuple(r.s) for r in last.collect()} == want


@pytest.mark.parametrize("bits, slice_bits", [(3, 16), (6, 4), (18, 16)])
def test_chunks_from_counts(spark, monkeypatch, bits, slice_bits):
    """A key with half of all rows, bursts, nulls, negative and far times, and flags before them."""
    monkeypatch.setattr(ordered, "CHUNK_BITS", bits)
    monkeypatch.setattr(ordered, "SLICE_BITS", slice_bits)
    rng = random.Random(11)
    times = [None, -(2**62), 2**62, *[rng.randrange(-(10**12), 10**12) for _ in range(300)], *range(500, 900)]
    data = [("hot", rng.random() < 0.5, t, i) for i, t in enumerate(times)]
    data += [(rng.choice([None, "a", "b"]), None if rng.random() < 0.2 else True, rng.randrange(50), 10**6 + i) for i in range(300)]
    data += [("burst", False, 7, 2 * 10**6 + i) for i in range(60)]
    df = spark.createDataFrame(data, "key string, flag boolean, at long, id long").repartition(6)
    rows, split = ordered.placed(df, ["key"], ["flag", "at", "id"])
    counts = [r["count"] for r in rows.groupBy("key", CHUNK).count().collect()]
    assert max(counts) <= 2**bits or not split
    got = {r["id"]: r["seq"] for r in numbered(df, ["key"], ["flag", "at", "id"]).collect()}
    low = lambda v: (v is not None, v or 0)
    seen = {}
    for key, _, _, i in sorted(data, key=lambda r: (low(r[1]), low(r[2]), r[3])):
        seen[key] = seen.get(key, 0) + 1
        assert got[i] == seen[key]


def test_small_keys_take_one_exchange(spark, rows):
    _, df = rows
    plan = numbered(df, ["key"], ["at"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan


def test_a_large_key_covers_many_chunks_and_carries_stay_few(rows):
    _, df = rows
    placed = into_chunks(df, ["key"], ["at"], 40)
    sizes = [r["count"] for r in placed.groupBy(CHUNK).count().collect()]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)
    assert placed.filter("key = 'hot'").select(CHUNK).distinct().count() > 10
    assert {r.key for r in multiple(placed, ["key"]).collect()} >= {"hot"}


@pytest.mark.parametrize("bits", [1, 8])
def test_prefixes_over_sparse_and_negative_chunks(spark, monkeypatch, bits):
    monkeypatch.setattr(ordered, "FAN_BITS", bits)
    at = [-70_000, -3, 0, 1, 2, 255, 256, 1 << 20]
    rows = [(k, c, [i]) for k in ("a", None) for i, c in enumerate(at)] + [("b", 5, [9])]
    parts = spark.createDataFrame(rows, f"key string, {CHUNK} long, part array<int>")
    got = prefixes(parts, ["key"], F.array().cast("array<int>"), lambda x, y: F.concat(x, y))
    found = {(r["key"], r[CHUNK]): r["before"] for r in got.collect()}
    assert found == {(k, c): list(range(i)) for k in ("a", None) for i, c in enumerate(at)} | {("b", 5): []}


def test_jobs_grow_slower_than_chunks(spark, rows):
    _, df = rows

    def jobs(chunks):
        tracker, group = spark.sparkContext.statusTracker(), f"chunks-{chunks}"
        spark.sparkContext.setJobGroup(group, group)
        running_sums(df, ["key"], ["at"], {"n": F.lit(1)}, chunks).count()
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(64) <= jobs(4) + 8
