"""Searching stored spans finds what searching all spans finds, in fewer files."""

import random

import pytest
from pyspark.sql import functions as F

from samples import span, spans
from tracewarden.operators import trace_query
from tracewarden.sinks.spans import SpanStore

DAY = 86_400_000_000_000
WHERE = dict(service="svc", operation="pay", start_min=3 * DAY + 5, start_max=6 * DAY)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    rows = []
    for t in range(120):
        first = rng.randrange(-2, 18)
        for i in range(rng.randint(1, 5)):
            at = (first + i // 3) * DAY + rng.randrange(DAY)
            rows.append(span(f"{t:032x}", f"{t:08x}{i:08x}", "", rng.choice(["pay", "buy", "look"]), at, at + rng.randrange(10**9)))
    hot = [span("f" * 32, f"{i:016x}", "", "look", 4 * DAY + i, 4 * DAY + i) for i in range(150)]  # a third of all spans
    return spans(spark, rows + hot)


@pytest.fixture(scope="module")
def store(table, tmp_path_factory):
    found = SpanStore(str(tmp_path_factory.mktemp("store")))
    for part in (0, 1):  # two appends, traces in both
        found.append(table.filter(F.pmod(F.xxhash64("span_id"), F.lit(2)) == part))
    return found


def ids(df):
    return sorted((r["trace_id"], r["span_id"], r["name"], r["start_time_unix_nano"]) for r in df.collect())


def scanned(df, metric):
    """A metric of the scans of a query without shuffles, summed."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getName() else plan
    leaves, total = plan.collectLeaves(), 0
    for k in range(leaves.size()):
        found = leaves.apply(k).metrics().get(metric)
        total += found.get().value() if found.isDefined() else 0
    return total


def test_stored_spans_are_all_spans(spark, table, store):
    assert store.spans(spark).drop("service", "day").count() == table.count()
    assert ids(store.spans(spark)) == ids(table)


@pytest.mark.parametrize("bounds", [(None, None), (3 * DAY, None), (None, 6 * DAY), (4 * DAY + 10, 4 * DAY + 20)])
def test_one_trace(spark, table, store, bounds):
    for t in [*(f"{t:032x}" for t in (0, 7, 33)), "F" * 32, "e" * 32]:
        found = store.get_trace(spark, t, *bounds)
        assert ids(found) == ids(trace_query.get_trace(table, t, *bounds))
        assert set(found.columns) == set(table.columns)


@pytest.mark.parametrize("limit", [None, 2])
def test_search(spark, table, store, limit):
    for where in (WHERE, {"operation": "buy"}, {"service": "none"}, {"attributes": {"service.name": "svc"}, "duration_min": 5 * 10**8}):
        want = trace_query.find_traces(table, limit, **where)
        assert ids(store.find_traces(spark, limit, **where)) == ids(want)


def test_one_trace_reads_the_folders_of_its_days(spark, store):
    every = scanned(store.spans(spark), "numFiles")
    one = scanned(store.get_trace(spark, f"{7:032x}"), "numFiles")
    assert every >= 20 and 1 <= one <= 4
    few = store.find_traces(spark, **WHERE)
    days = {r["day"] for r in store.days_of(spark, few).select("day").distinct().collect()}
    assert 0 < len(days) < 20


def test_row_groups_without_the_id_are_not_read(spark, tmp_path):
    at = [span(f"{2 * i:032x}", f"{i:016x}", "", "s", i, i) for i in range(2000)]
    store = SpanStore(str(tmp_path))
    store.append(spans(spark, at))
    absent = store.spans(spark).filter(F.col("trace_id") == f"{1001:032x}")  # between the least and the largest
    assert scanned(absent, "numOutputRows") == 0
    assert scanned(store.spans(spark).filter(F.col("trace_id") == f"{1000:032x}"), "numOutputRows") > 0


def test_an_empty_append(spark, table, tmp_path):
    store = SpanStore(str(tmp_path))
    store.append(table)
    store.append(table.limit(0))
    assert store.spans(spark).count() == table.count()
