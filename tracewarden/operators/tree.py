"""Span trees: depth and path of each span, faults, and the planned timeline.

Trees are climbed by pointer doubling: after round ``k`` each span points to
its ancestor ``2^k`` levels up and knows what lies in between, so a tree of
depth ``d`` takes ``log2 d`` rounds.

A trace of at most ``SMALL`` spans is one row, and its rounds are made inside
that row, so that all such traces together cost one shuffle.  Other traces, and
those in which an id is missing or repeats, are joined round by round; each
round joins and writes only the spans that have not reached their root, and
nothing is gathered per trace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.ordered import next_values
from tracewarden.schema import KEY_VALUES, span_row, text_value
from tracewarden.session import freeze

PAD_MS = 1000
LATENESS_MS = 500
# Spans of a trace that is worked on as one row.
SMALL = 64


def duplicate_span_ids(spans: DataFrame) -> DataFrame:
    return (
        spans.groupBy("trace_id", "span_id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def _climb(nodes: DataFrame, paths: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """Spans at their roots, and the spans still below theirs in each round.

    ``nodes`` has trace_id, span_id, up (parent or NULL) and own (a number).
    Spans below a missing parent drop out; spans on a cycle, or below one,
    never get to a root.  Runs a few jobs per round while it is built.
    """
    level = freeze(
        nodes.select(
            "trace_id", "span_id", "up", "own",
            F.lit(None).cast("bigint").alias("above"),
            F.lit(0).alias("depth"),
            (F.col("span_id") if paths else F.lit(None).cast("string")).alias("path"),
            F.when(F.col("up").isNull(), F.col("span_id")).alias("top"),
        )
    )
    done, rounds, waiting = level.filter("up is null"), [], None
    pending = level.filter("up is not null")
    while True:
        # Every round some span reaches its root, unless all that wait are on
        # a cycle or below one.
        left = pending.count()
        if left == 0 or left == waiting:
            return done, rounds
        waiting = left
        rounds.append(pending)
        higher = done.unionByName(pending).select(
            "trace_id",
            F.col("span_id").alias("up"),
            F.col("up").alias("next_up"),
            F.greatest("own", "above").alias("more_above"),
            F.col("depth").alias("more_depth"),
            F.col("path").alias("more_path"),
            F.col("top").alias("next_top"),
        )
        moved = pending.join(higher, ["trace_id", "up"]).select(
            "trace_id",
            "span_id",
            F.col("next_up").alias("up"),
            "own",
            F.greatest("above", "more_above").alias("above"),
            (F.col("depth") + F.col("more_depth") + 1).alias("depth"),
            (F.concat_ws("/", "more_path", "path") if paths else F.col("path")).alias("path"),
            F.col("next_top").alias("top"),
        )
        level = freeze(moved)
        done, pending = done.unionByName(level.filter("up is null")), level.filter("up is not null")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, not again per array item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _paths(up: Column) -> Column:
    """For each item of a trace the places of the items from its root to itself.

    ``up`` holds the place of each item's parent, from 1: 0 if it is missing,
    NULL at a root.  Items below no root get NULL.
    """
    begun = F.transform(up, lambda u, i: F.struct(u.cast("int").alias("to"), F.array(i).alias("path")))

    def joined(items: Column, item: Column) -> Column:
        above = F.get(items, item["to"] - 1)
        higher = F.struct(above["to"].alias("to"), F.concat(above["path"], item["path"]).alias("path"))
        return F.when(item["to"] > 0, higher).otherwise(item)

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(up) + 1)).cast("int"))
    ended = F.aggregate(rounds, begun, lambda items, _: F.transform(items, lambda item: joined(items, item)))
    return F.transform(ended, lambda item: F.when(item["to"].isNull(), item["path"]))


def _by_size(spans: DataFrame, parent: Column, ordered: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Small traces as rows ``(trace_id, items, paths)``, and the spans of the others.

    ``items`` holds the spans' other columns, and is in the order of the ids if
    ``ordered``; ``paths`` is that of :func:`_paths`.  Spans without a trace are left
    out.  Runs jobs.
    """
    rows = freeze(spans.filter("trace_id is not null"))
    large = rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL)
    large = freeze(large.select("trace_id"))
    none_large = large.isEmpty()
    few = rows if none_large else rows.join(large, "trace_id", "left_anti")
    columns = ["span_id", *[c for c in rows.columns if c not in ("trace_id", "span_id")]]
    items = F.collect_list(F.struct(*columns, parent.alias("_up")))
    traces = few.groupBy("trace_id").agg((F.array_sort(items) if ordered else items).alias("items"))
    ids = F.col("items")["span_id"]
    up = _bound(ids, lambda known: F.transform("items", lambda x: F.array_position(known, x["_up"])))
    own = F.size(F.array_distinct(F.array_compact(ids)))
    traces = freeze(
        traces.select("trace_id", "items", (own < F.size("items")).alias("odd"), _bound(up, _paths).alias("paths"))
    )
    odd = traces.filter("odd").select("trace_id", F.inline("items")).drop("_up")
    others = [] if none_large else [rows.join(large, "trace_id", "left_semi")]
    others += [] if odd.isEmpty() else [odd.select(*rows.columns)]
    rest = others[0].unionByName(others[-1]) if len(others) == 2 else others[0] if others else None
    return traces.filter("not odd").drop("odd"), rest


def _through(items: Column, path: Column, of: Callable[[Column], Column]) -> Column:
    """The items whose path (``of`` an item) leads through the end of ``path``."""
    return F.filter(items, lambda item: F.get(of(item), F.size(path) - 1) == F.element_at(path, -1))


def _parent() -> Column:
    return F.when(F.col("parent_id") != "", F.col("parent_id"))


def _in_first_tree(paths: Column, items: Column) -> Column:
    """The paths from the root with the smallest id."""
    roots = F.filter(paths, lambda p: F.size(p) == 1)
    place = lambda p: F.get(p, F.lit(0))
    first = F.array_min(F.transform(roots, lambda p: F.struct(F.get(items, place(p))["span_id"], place(p).alias("at"))))
    return _bound(first["at"], lambda top: F.filter(paths, lambda p: place(p) == top))


def _nodes(spans: DataFrame, own: str | None = None) -> DataFrame:
    number = F.col(own).cast("bigint") if own else F.lit(0).cast("bigint")
    return spans.select("trace_id", "span_id", _parent().alias("up"), number.alias("own"))


def _first_roots(spans: DataFrame) -> DataFrame:
    root = F.coalesce(F.col("parent_id"), F.lit("")) == ""
    return spans.filter(root).groupBy("trace_id").agg(F.min("span_id").alias("top"))


def _reached(spans: DataFrame, paths: bool) -> DataFrame:
    """``(trace_id, span_id, depth)`` of what can be reached from the first root, and its ``path``."""
    out = ["trace_id", "span_id", "depth", *(["path"] if paths else [])]
    traces, rest = _by_size(spans.select("trace_id", "span_id", "parent_id"), _parent())
    span_id = lambda at: F.get("items", at)["span_id"]
    columns = lambda p: [
        span_id(F.element_at(p, -1)).alias("span_id"),
        (F.size(p) - 1).alias("depth"),
        *([F.array_join(F.transform(p, span_id), "/").alias("path")] if paths else []),
    ]
    listed = F.transform(_in_first_tree(F.col("paths"), F.col("items")), lambda p: F.struct(*columns(p)))
    found = traces.select("trace_id", F.inline(listed)).select(*out)
    if rest is None:
        return found
    done, _ = _climb(_nodes(rest), paths)
    return found.unionByName(done.join(_first_roots(rest), ["trace_id", "top"], "left_semi").select(*out))


def span_tree(spans: DataFrame) -> DataFrame:
    """Spans reachable from the root of their trace, with depth and path.

    ``spans`` has trace_id, span_id and parent_id, ids unique per trace.  Of
    several roots the one with the smallest id counts.
    """
    return _reached(spans, True).select("trace_id", "span_id", "depth", "path")


def tree_errors(spans: DataFrame) -> DataFrame:
    """Traces whose spans are not one tree, with the reason."""
    copies = duplicate_span_ids(spans).select("trace_id").distinct().withColumn("doubled", F.lit(1))
    totals = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"))
    unique = spans.dropDuplicates(["trace_id", "span_id"])
    reached = _reached(unique, False).groupBy("trace_id").agg(F.count(F.lit(1)).alias("reached"))
    roots = _first_roots(spans).withColumn("rooted", F.lit(1)).drop("top")
    joined = (
        totals.join(reached, "trace_id", "left")
        .join(roots, "trace_id", "left")
        .join(copies, "trace_id", "left")
    )
    error = (
        F.when(F.col("doubled") == 1, "duplicate span id")
        .when(F.col("rooted").isNull(), "no root span")
        .when(F.coalesce("reached", F.lit(0)) != F.col("spans"), "not a tree")
    )
    return joined.select("trace_id", "spans", error.alias("error")).filter("error is not null")


def preorder(spans: DataFrame) -> DataFrame:
    """``(trace_id, span_id, depth, position, size)`` of the spans that can be
    reached from the root of their trace.

    ``position`` counts from 0, a parent before its children and these by id;
    ``size`` counts the spans below and including one, so what lies below a
    span are the ``size`` positions from its own on.  Ids are unique per trace;
    of several roots the smallest counts; spans on a cycle or below a missing
    parent are left out, as are those without a trace or an id.

    A walk around the tree enters and leaves each span once.  Each of these
    steps knows the next one: into the first child, else out; then into the
    next sibling, else out of the parent.  Steps are ranked by pointer doubling
    along this list, each adding up what lies up to the step it points to, so a
    tree of ``n`` spans takes ``log2(2 n)`` joins, however deep or wide it is.
    In a small trace paths are sorted instead.
    """
    named = spans.filter("trace_id is not null and span_id is not null").select("trace_id", "span_id", "parent_id")
    traces, rest = _by_size(named, _parent(), ordered=True)
    # Items lie in the order of their ids, so paths of places sort as paths of ids.
    walk = F.array_sort(_in_first_tree(F.col("paths"), F.col("items")))
    listed = _bound(walk, lambda paths: F.transform(paths, lambda p, i: F.struct(
        F.get("items", F.element_at(p, -1))["span_id"].alias("span_id"),
        (F.size(p) - 1).alias("depth"),
        i.cast("bigint").alias("position"),
        F.size(_through(paths, p, lambda q: q)).cast("bigint").alias("size"),
    )))
    found = traces.select("trace_id", F.inline(listed))
    return found if rest is None else found.unionByName(_preorder_by_steps(rest))


def _preorder_by_steps(spans: DataFrame) -> DataFrame:
    nodes = freeze(spans.select("trace_id", "span_id", _parent().alias("parent")))
    below = nodes.filter("parent is not null")
    siblings = next_values(below, ["trace_id", "parent"], ["span_id"], {"sibling": F.col("span_id")}, strict=True)
    firsts = below.groupBy("trace_id", F.col("parent").alias("span_id")).agg(F.min("span_id").alias("child"))
    linked = nodes.filter("parent is null").withColumn("sibling", F.lit(None).cast("string")).unionByName(siblings)
    linked = linked.join(firsts, ["trace_id", "span_id"], "left")
    child, sibling = F.col("child"), F.col("sibling")
    enter = F.struct(
        F.lit(False).alias("out"), F.coalesce(child, "span_id").alias("next"), child.isNull().alias("next_out"),
        F.lit(1).cast("bigint").alias("entered"), F.lit(1).cast("bigint").alias("level"),
    )
    leave = F.struct(
        F.lit(True).alias("out"), F.coalesce(sibling, "parent").alias("next"), sibling.isNull().alias("next_out"),
        F.lit(0).cast("bigint").alias("entered"), F.lit(-1).cast("bigint").alias("level"),
    )
    steps = linked.select("trace_id", "span_id", F.explode(F.array(enter, leave)).alias("s")).select("trace_id", "span_id", "s.*")
    level = freeze(steps.withColumn("top", F.when(F.col("next").isNull(), F.col("span_id"))))
    done, pending, waiting = level.filter("next is null"), level.filter("next is not null"), None
    while True:
        left = pending.count()
        if left == 0 or left == waiting:
            break
        waiting = left
        ahead = done.unionByName(pending).select(
            "trace_id", F.col("span_id").alias("next"), F.col("out").alias("next_out"), F.col("next").alias("after"),
            F.col("next_out").alias("after_out"), F.col("entered").alias("more_entered"),
            F.col("level").alias("more_level"), F.col("top").alias("end_top"),
        )
        moved = pending.join(ahead, ["trace_id", "next", "next_out"]).select(
            "trace_id", "span_id", "out", F.col("after").alias("next"), F.col("after_out").alias("next_out"),
            (F.col("entered") + F.col("more_entered")).alias("entered"),
            (F.col("level") + F.col("more_level")).alias("level"), F.col("end_top").alias("top"),
        )
        level = freeze(moved)
        done, pending = done.unionByName(level.filter("next is null")), level.filter("next is not null")
    walked = done.join(_first_roots(spans), ["trace_id", "top"], "left_semi")
    # What remains from a step on: spans still to enter, and the way back up.
    per_span = walked.groupBy("trace_id", "span_id", "top").agg(
        F.max(F.when(~F.col("out"), F.col("entered"))).alias("from_in"),
        F.max(F.when(F.col("out"), F.col("entered"))).alias("from_out"),
        F.max(F.when(~F.col("out"), -F.col("level"))).alias("depth"),
    )
    totals = walked.filter("span_id = top and not out").select("trace_id", F.col("entered").alias("total"))
    return per_span.join(totals, "trace_id").select(
        "trace_id", "span_id", F.col("depth").cast("int").alias("depth"),
        (F.col("total") - F.col("from_in")).alias("position"), (F.col("from_in") - F.col("from_out")).alias("size"),
    )


def descendants(spans: DataFrame) -> DataFrame:
    """Every trace's spans in pre-order: a parent, then its children by id, each
    followed by what is below it."""
    return preorder(spans).orderBy("trace_id", "position")


def effective_timeline(sim_spans: DataFrame, pad_ms: int = PAD_MS) -> DataFrame:
    """Planned start and end of each span, in ms from the start of the replay.

    A span starts at its offset but not before its parent; it ends after its
    duration but not before its children.
    """
    spans = sim_spans.withColumn("offset", F.col("start_offset_ms") + pad_ms)
    traces, rest = _by_size(spans, _parent())
    items, paths = F.col("items"), F.col("paths")
    offset = lambda at: F.get(items, at)["offset"].cast("bigint")
    reached = F.filter(paths, lambda p: p.isNotNull())
    start = lambda p: F.array_max(F.transform(p, offset))
    begun = F.transform(reached, lambda p: F.struct(
        p.alias("path"),
        start(F.slice(p, 1, F.size(p) - 1)).alias("parent_start_ms"),
        start(p).alias("start_ms"),
        (start(p) + F.get(items, F.element_at(p, -1))["duration_ms"]).alias("end_ms"),
    ))
    columns = ["span_id", *[c for c in spans.columns if c not in ("trace_id", "span_id")]]
    listed = _bound(begun, lambda all_: F.transform(all_, lambda b: F.struct(
        *[F.get(items, F.element_at(b["path"], -1))[c].alias(c) for c in columns],
        (F.size(b["path"]) - 1).alias("depth"),
        b["parent_start_ms"].alias("parent_start_ms"),
        b["start_ms"].alias("start_ms"),
        F.array_max(F.transform(_through(all_, b["path"], lambda e: e["path"]), lambda e: e["end_ms"])).alias("end_ms"),
    )))
    found = traces.select("trace_id", F.inline(listed))
    return found if rest is None else found.unionByName(_timeline_by_rounds(rest))


def _timeline_by_rounds(sim_spans: DataFrame) -> DataFrame:
    spans = freeze(sim_spans)
    done, rounds = _climb(_nodes(spans, "offset"))
    starts = done.select(
        "trace_id",
        "span_id",
        "depth",
        F.col("above").alias("parent_start_ms"),
        F.greatest("own", "above").alias("start_ms"),
    )
    planned = freeze(spans.join(starts, ["trace_id", "span_id"]))
    # Ends only grow: each round adds rows for the spans above others, and the
    # largest end of a span counts.
    ends = planned.select(
        "trace_id", "span_id", (F.col("start_ms") + F.col("duration_ms")).alias("end_ms")
    )
    for pending in rounds:
        below = (
            pending.select("trace_id", "span_id", "up")
            .join(ends, ["trace_id", "span_id"])
            .groupBy("trace_id", F.col("up").alias("span_id"))
            .agg(F.max("end_ms").alias("end_ms"))
        )
        ends = ends.unionByName(freeze(below))
    ends = ends.groupBy("trace_id", "span_id").agg(F.max("end_ms").alias("end_ms"))
    return planned.join(ends, ["trace_id", "span_id"])


def late_spans(timeline: DataFrame, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """Spans planned before their parent starts: errors, or started at once."""
    behind = F.col("parent_start_ms") - F.col("offset")
    return timeline.withColumn("behind_ms", behind).filter("behind_ms > 0").withColumn(
        "outcome", F.when(F.col("behind_ms") > lateness_ms, "error").otherwise("started at once")
    )


def no_time_spans(sim_spans: DataFrame) -> DataFrame:
    """Spans without any time to run in."""
    return sim_spans.filter("duration_ms <= 0")


def sim_to_spans(timeline: DataFrame, base_ms: int) -> DataFrame:
    """Planned spans as real spans that begin at ``base_ms``."""
    entries = F.transform(
        F.map_entries("attributes"),
        lambda e: F.struct(e["key"].alias("key"), text_value(e["value"]).alias("value")),
    ).cast(KEY_VALUES)
    # Kind codes are fixed values of the trace format.
    kinds = F.create_map(
        *[F.lit(x) for pair in {
            "INTERNAL": 1, "SERVER": 2, "CLIENT": 3, "PRODUCER": 4, "CONSUMER": 5,
        }.items() for x in pair]
    )
    return timeline.select(
        *span_row(
            trace_id=F.col("trace_id"),
            span_id=F.col("span_id"),
            parent_span_id=F.coalesce("parent_id", F.lit("")),
            name=F.col("span_name"),
            kind=F.coalesce(kinds[F.col("span_kind")], F.lit(0)),
            start_time_unix_nano=(F.col("start_ms") + base_ms) * 1_000_000,
            end_time_unix_nano=(F.col("end_ms") + base_ms) * 1_000_000,
            attributes=entries,
        )
    )
