"""Monitors: state per key, moved by each event, judged at each session end.

Three kinds share one interface (``init``, ``step``, ``verdict`` as Columns):

* ``SumMonitor`` - the state is a running total.  Totals are partial
  aggregates per session; events are neither ordered nor gathered.
* ``StateMonitor`` - finitely many states, moved by rules that look at the
  event only.  A stretch of events is then a small map from state to state.
* ``Monitor`` - any state, with a summary of a stretch of events that can be
  merged with the summary of the next one (``lift``, ``merge``, ``enter``).

Stretches of a key are folded in parallel; their maps or summaries are merged
as a tree, so a key of any length costs a logarithm of jobs.  A step without a
summary can only fold ready-made arrays (``fold_sequences``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.operators import ordered
from tracewarden.operators.ordered import CHUNK
from tracewarden.operators.sessions import (
    BLOCK_BITS,
    EVENT_ORDER,
    dedupe_spans,
    ignore_windows,
    key_spans,
    no_large_key,
    session_counters,
    session_slices,
    sessionize,
    sessionize_small,
    sessions,
    to_events,
)
from tracewarden.session import freeze

# Length of the arrays in which the states after every event are written down.
BLOCK = 256

# Order of the rows of a key: events of a session, then the mark at its end.
FOLD_ORDER = ["session_start", "mark", *EVENT_ORDER]


def truth(value: Column) -> Column:
    """Three-valued verdict of a nullable boolean."""
    return F.when(value, "True").when(~value, "False").otherwise("Undecided")


@dataclass(frozen=True)
class Monitor:
    """A property of the event sequence of each key.

    ``features`` are columns computed per event before any shuffle; ``step``
    sees the state and a struct with the features, ``is_end`` and
    ``epoch_unix_nano``.  ``lift`` gives the summary of one event, ``neutral``
    that of none, ``merge`` that of two stretches, and ``enter`` the state after
    a stretch from the state before it.  ``rules`` name the conditions under which the step
    does something, for auditing.

    ``ignore_session`` is a condition on a session's counters and on
    ``ignore_features``: named aggregates of span Columns over the session's
    events in order, each ``("any" | "all" | "first" | "last", column)``.
    """

    name: str
    init: Column
    step: Callable[[Column, Column], Column]
    verdict: Callable[[Column], Column]
    neutral: Column | None = None
    lift: Callable[[Column], Column] | None = None
    merge: Callable[[Column, Column], Column] | None = None
    enter: Callable[[Column, Column], Column] | None = None
    features: dict[str, Column] = field(default_factory=dict)
    rules: dict[str, Column] = field(default_factory=dict)
    prepare: Callable[[DataFrame], DataFrame] | None = None
    key_attribute: str | None = None
    gap_ms: int = 10_000
    lateness_ms: int = 0
    ttl_ms: int | None = None
    ignore_key: Callable[[Column], Column] | None = None
    ignore_session: Column | None = None
    ignore_features: dict[str, tuple[str, Column]] = field(default_factory=dict)
    across_sessions: bool = True

    def fold_keys(self) -> list[str]:
        """What a state belongs to: the key since its last restart, or a session."""
        return ["key", "generation"] if self.across_sessions else ["key", "session_start"]

    def carries(self, parts, keys, starts):
        """State at the start of each chunk of the keys that lie in several.

        ``parts`` are the arrays of these keys.
        """
        if self.merge is None:
            raise ValueError(f"{self.name}: a step is folded over chunks by lift, merge and enter")
        stretch = F.aggregate("items", self.neutral, lambda acc, e: self.merge(acc, self.lift(e)))
        parts = parts.select(*keys, CHUNK, stretch.alias("part"))
        before = ordered.prefixes(parts, keys, self.neutral, self.merge)
        if before is None:
            return None
        entered = _with_starts(before, keys, starts, self.init)
        return entered.select(*keys, CHUNK, self.enter(F.col("_start"), F.col("before")).alias("_carried"))


def constants(values, kind: str) -> Column:
    """An array of literals, folded to one constant by the optimizer."""
    text = ",".join("" if v is None else str(v).lower() for v in values)
    # A lambda over the parts would not be folded, but worked out anew for each event.
    return F.split(F.lit(text), ",").try_cast(f"array<{kind}>")


@dataclass(frozen=True)
class SumMonitor(Monitor):
    """State is the total of ``amount`` over the events so far."""

    @staticmethod
    def of(name: str, amount: Column, verdict: Callable[[Column], Column], **settings):
        return SumMonitor(
            name=name,
            init=F.lit(0).cast("bigint"),
            step=lambda s, e: s + e["amount"],
            verdict=verdict,
            features={"amount": F.coalesce(amount.cast("bigint"), F.lit(0).cast("bigint"))},
            **settings,
        )


@dataclass(frozen=True)
class Rule:
    """When ``when`` holds for an event, states move as ``moves`` says."""

    name: str
    when: Column
    moves: dict


@dataclass(frozen=True)
class StateMonitor(Monitor):
    """State is a number into ``states``; the first rule that holds moves it."""

    states: tuple = ()
    table: tuple = ()

    @staticmethod
    def of(name, states, start, rules: list[Rule], verdicts: dict, **settings):
        number = {s: i for i, s in enumerate(states)}
        # Letter 0 changes nothing; letter i is rule i.
        rows = [{}] + [r.moves for r in rules]
        moves = [tuple(number[row.get(s, s)] for s in states) for row in rows]
        moving = [i for i, r in enumerate(rules, 1) if any(a != b for a, b in r.moves.items())]
        letter = F.lit(0)
        for i, rule in reversed(list(enumerate(rules, 1))):
            letter = F.when(rule.when, i if i in moving else 0).otherwise(letter)
        return StateMonitor.of_table(
            name, states, number[start], moves, letter, [verdicts.get(s) for s in states],
            rules={r.name: r.when for r in rules}, **settings,
        )

    @staticmethod
    def of_table(name, states, start: int, moves: list[tuple], letter: Column, verdicts: list, **settings):
        """From where each state goes by each letter; letter 0 moves nothing."""
        size = len(states)
        table = tuple(t for row in moves for t in row)
        numbers, every = constants(table, "int"), constants(range(size), "int")
        # A stretch is the list of the states that it leads to from each state.
        moved = lambda e: F.slice(numbers, e["letter"] * size + 1, size)
        judged = constants(verdicts, "boolean")
        return StateMonitor(
            name=name,
            init=F.lit(start),
            step=lambda s, e: F.get(numbers, e["letter"] * size + s),
            verdict=lambda s: F.get(judged, s),
            neutral=every,
            lift=moved,
            merge=lambda m, n: F.transform(m, lambda s: F.get(n, s)),
            enter=lambda s, m: F.get(m, s),
            features={"letter": letter},
            states=tuple(states),
            table=table,
            **settings,
        )


def _with_starts(df: DataFrame, keys: list[str], starts: DataFrame | None, init: Column):
    """Add ``_start``: the stored state of the key, or the initial one."""
    if starts is None:
        return df.withColumn("_start", init)
    stored = starts.select("key", F.col("state").alias("_stored"))
    first = F.col("_stored").isNotNull()
    if "generation" in keys:
        first = first & (F.col("generation") == 0)
    return (
        df.join(stored, "key", "left")
        .withColumn("_start", F.when(first, F.col("_stored")).otherwise(init))
        .drop("_stored")
    )


def _traced(
    arrays: DataFrame, keys: list[str], step, keep: str | None = None, before: bool = False
) -> DataFrame:
    """Rows of the arrays again, each with the state after (or before) it.

    Arrays are taken in blocks so that writing the states down stays linear.
    With ``keep`` only rows flagged by that field come out.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("items") - 1) / BLOCK).cast("int")),
        lambda i: F.slice("items", i * BLOCK + 1, BLOCK),
    )
    cut = arrays.select(*keys, "_start", blocks.alias("blocks"))
    starts = ordered.running(
        F.col("blocks"), F.col("_start"), lambda s, b: F.aggregate(b, s, step), before=True
    )
    starts = F.when(F.size("blocks") == 1, F.array("_start")).otherwise(starts)
    per_block = cut.select(
        *keys, F.explode(F.arrays_zip("blocks", starts.alias("starts"))).alias("b")
    )
    block, start = F.col("b.blocks"), F.col("b.starts")
    if keep is not None and not before:
        return _kept(per_block, keys, step, keep)
    rows = F.arrays_zip(block.alias("item"), ordered.running(block, start, step, before).alias("state"))
    if keep is not None:
        rows = F.filter(rows, lambda r: r["item"][keep])
    return per_block.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.item.*", "r.state")


def _kept(per_block: DataFrame, keys: list[str], step, keep: str) -> DataFrame:
    """The flagged items of the blocks with the state after each; only these are written down."""
    state = lambda acc, e: step(acc["s"], e)
    row = lambda e, s: F.struct(e.alias("item"), s.alias("state"))
    begin = F.col("b.starts")
    none = F.array_repeat(row(F.get("b.blocks", F.lit(0)), begin), 0)

    def moved(acc: Column, e: Column) -> Column:
        after = state(acc, e)
        return F.when(e[keep], F.struct(after.alias("s"), F.array_append(acc["out"], row(e, after)).alias("out"))).otherwise(
            F.struct(after.alias("s"), acc["out"].alias("out"))
        )

    rows = F.aggregate("b.blocks", F.struct(begin.alias("s"), none.alias("out")), moved, lambda acc: acc["out"])
    return per_block.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.item.*", "r.state")


def fold(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    payload: list[str],
    monitor: Monitor,
    starts: DataFrame | None = None,
    chunks: int | None = None,
    keep: str | None = None,
) -> DataFrame:
    """State after each row (or each kept row), folding each key's rows in order.

    Each task holds one chunk of a key at a time.  Only keys that run over a
    chunk border need a carried state, at most one per chunk.  Runs jobs while
    it is built and writes tables to the shared folder.
    """
    placed, split = ordered.placed(rows, keys, order, chunks)
    arrays = ordered.arrays_per_chunk(placed, keys, order, payload)
    carry = None
    if split:
        several = ordered.same_keys(placed, ordered.multiple(placed, keys), keys, "left_semi")
        parts = ordered.arrays_per_chunk(several, keys, order, payload)
        if not several.isEmpty():
            carry = monitor.carries(parts, keys, starts)
    started = _with_starts(arrays, keys, starts, monitor.init)
    if carry is not None:
        started = ordered.same_keys(started, carry, [*keys, CHUNK], "left")
        started = started.withColumn("_start", F.coalesce("_carried", "_start")).drop("_carried")
    return _traced(started, keys, monitor.step, keep)


def _narrow(spans: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Spans with the features of their two events instead of wide columns.

    Attributes, messages and texts are looked at here, in the scan stage; only
    ids, times and features go through the shuffles that follow.
    """
    for is_end, time in ((False, "start_time_unix_nano"), (True, "end_time_unix_nano")):
        spans = spans.withColumns({"is_end": F.lit(is_end), "epoch_unix_nano": F.col(time)})
        spans = spans.withColumns({f"{n}_{int(is_end)}": c for n, c in features.items()})
    return spans.select(
        "key", "trace_id", "span_id", "parent_span_id",
        "start_time_unix_nano", "end_time_unix_nano",
        *[f"{n}_{i}" for n in features for i in (0, 1)],
    )


def narrowed(
    spans: DataFrame, monitor: Monitor, features: dict[str, Column] | None = None
) -> DataFrame:
    """Keyed spans with features, without the keys the monitor ignores."""
    keyed = key_spans(spans, monitor.key_attribute)
    if monitor.ignore_key is not None:
        keyed = keyed.filter(~F.coalesce(monitor.ignore_key(F.col("key")), F.lit(False)))
    if monitor.prepare is not None:
        keyed = monitor.prepare(keyed)
    looked_at = {f"_ignore_{n}": c for n, (_, c) in monitor.ignore_features.items()}
    return _narrow(keyed, (monitor.features if features is None else features) | looked_at)


def ignored_sessions(placed: DataFrame, monitor: Monitor) -> DataFrame | None:
    if monitor.ignore_session is None:
        return None
    return session_counters(placed, monitor.ignore_features).filter(monitor.ignore_session)


def monitored(narrow: DataFrame, monitor: Monitor, borders: DataFrame | None = None) -> DataFrame:
    """Spans of the sessions the monitor looks at, with their session."""
    placed = sessionize(narrow, monitor.gap_ms, monitor.ttl_ms, borders)
    ignored = ignored_sessions(placed, monitor)
    return placed if ignored is None else ignore_windows(placed, ignored)


def session_ends(narrow: DataFrame, monitor: Monitor, borders: DataFrame | None = None) -> DataFrame:
    """The sessions themselves, from the small table of time slices."""
    ends = sessions(narrow, monitor.gap_ms, monitor.ttl_ms, borders)
    if monitor.ignore_session is None:
        return ends
    placed = sessionize(narrow, monitor.gap_ms, monitor.ttl_ms, borders)
    return ignore_windows(ends, ignored_sessions(placed, monitor))


def monitor_events(placed: DataFrame, features) -> DataFrame:
    """Events of deduplicated spans with only the columns the monitor needs."""
    events = to_events(dedupe_spans(placed))
    return events.select(
        "key", "generation", "session_start", "session_end", *EVENT_ORDER,
        *[
            F.when(F.col("is_end"), F.col(f"{n}_1")).otherwise(F.col(f"{n}_0")).alias(n)
            for n in features
        ],
    )


def evaluate(
    spans: DataFrame,
    monitor: Monitor,
    starts: DataFrame | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """State and verdict at the end of each session of each key.

    ``starts`` holds states to begin from, columns ``key`` and ``state``.
    """
    narrow = narrowed(spans, monitor)
    if not isinstance(monitor, SumMonitor):
        # The wide spans are read once; the passes below see narrow rows only.
        narrow = freeze(narrow)
    return evaluate_narrow(narrow, monitor, starts, chunks)


def evaluate_narrow(
    narrow: DataFrame,
    monitor: Monitor,
    starts: DataFrame | None = None,
    chunks: int | None = None,
    borders: DataFrame | None = None,
) -> DataFrame:
    """``evaluate`` for spans that ``narrowed`` has prepared.

    ``borders`` are the ``session_slices`` of the spans, if they are known.
    """
    if isinstance(monitor, SumMonitor):
        states = _session_totals(narrow, monitor, starts, borders)
    else:
        states = _session_states(narrow, monitor, starts, chunks, borders)
    return states.select(
        "key", "generation", "session_start", "session_end", "state",
        monitor.verdict(F.col("state")).alias("verdict"),
    )


def _session_totals(narrow: DataFrame, monitor: Monitor, starts, borders) -> DataFrame:
    events = monitor_events(monitored(narrow, monitor, borders), monitor.features)
    per_session = events.groupBy("key", "generation", "session_start", "session_end").agg(
        F.sum("amount").alias("state")
    )
    if not monitor.across_sessions:
        return per_session
    per_session = freeze(per_session)
    # One row per session here; starts are a gap apart, which bounds a block.
    block = F.shiftright(F.floor(F.col("session_start") / monitor.gap_ms), BLOCK_BITS)
    totals = ordered.running_sum_in_blocks(
        per_session, ["key", "generation"], "session_start", block, "state"
    )
    if starts is None:
        return totals
    started = _with_starts(totals, monitor.fold_keys(), starts, F.lit(0).cast("bigint"))
    return started.withColumn("state", F.col("state") + F.col("_start"))


def _session_states(narrow, monitor, starts, chunks, borders) -> DataFrame:
    payload = list(monitor.features)
    keys = monitor.fold_keys()
    plain = borders is None and chunks is None and monitor.ignore_session is None and monitor.gap_ms > 0
    # Sessions without a key or a start are sessions too, but have no events.
    if plain and no_large_key(narrow, whole=True):
        return _small_session_states(narrow, monitor, starts)
    if borders is None:
        borders = freeze(session_slices(narrow, monitor.gap_ms, monitor.ttl_ms))
    events = monitor_events(monitored(narrow, monitor, borders), monitor.features)
    rows = events.withColumn("mark", F.lit(False))
    # A mark stands for the end of a session; it moves nothing.
    ends = session_ends(narrow, monitor, borders)
    blank = {c: F.lit(None).cast(t) for c, t in events.dtypes if c not in ends.columns}
    marks = ends.withColumns(blank).withColumn("mark", F.lit(True))
    folding = monitor
    if isinstance(monitor, StateMonitor):
        # Events that move nothing are dropped before they are shuffled.
        rows = rows.filter("letter > 0")
        marks = marks.withColumn("letter", F.lit(0))
    else:
        folding = _past_marks(monitor)
    order = [c for c in FOLD_ORDER if c not in keys]
    carried = [c for c in ("session_end", "generation") if c not in keys]
    return fold(
        rows.unionByName(marks), keys, order, [*carried, *payload], folding, starts, chunks, "mark"
    )


def _small_session_states(narrow, monitor, starts) -> DataFrame:
    """``_session_states`` where every key fits one task: one shuffle by key."""
    payload, keys = list(monitor.features), monitor.fold_keys()
    spans = dedupe_spans(sessionize_small(narrow, monitor.gap_ms, monitor.ttl_ms))
    first = F.row_number().over(Window.partitionBy("key", "session_start").orderBy("span_id")) == 1
    # A row per event that counts, and one more per session, the mark at its end.
    fixed = [c for c in EVENT_ORDER if c != "is_end"]
    event = lambda is_end, time: F.struct(
        F.lit(False).alias("mark"), F.col(time).alias("epoch_unix_nano"), "trace_id", "span_id",
        F.lit(is_end).alias("is_end"), *[F.col(f"{n}_{int(is_end)}").alias(n) for n in payload],
    )
    both = [event(False, "start_time_unix_nano"), event(True, "end_time_unix_nano")]
    folding = monitor
    if isinstance(monitor, StateMonitor):
        both = [F.when(F.col(f"letter_{i}") > 0, e) for i, e in enumerate(both)]
    else:
        folding = _past_marks(monitor)
    order = [c for c in FOLD_ORDER if c not in keys]
    carried = [c for c in ("session_end", "generation") if c not in keys]
    kinds = {n: spans.schema[f"{n}_0"].dataType for n in payload}
    marked = F.struct(
        F.lit(True).alias("mark"), *[F.lit(None).cast("bigint" if c == "epoch_unix_nano" else "string").alias(c) for c in fixed],
        F.lit(None).cast("boolean").alias("is_end"),
        *[(F.lit(0) if isinstance(monitor, StateMonitor) else F.lit(None)).cast(kinds[n]).alias(n) for n in payload],
    )
    rows = spans.withColumn("_first", first).select(
        "key", "generation", "session_start", "session_end",
        F.inline(F.array_compact(F.array(*both, F.when(F.col("_first"), marked)))),
    )
    arrays = ordered.arrays_per_chunk(rows.withColumn(CHUNK, F.lit(0).cast("bigint")), keys, order, [*carried, *payload])
    return _traced(_with_starts(arrays, keys, starts, monitor.init), keys, folding.step, "mark")


def _past_marks(monitor: Monitor) -> Monitor:
    """The monitor for rows among which marks move nothing."""
    step, lift, neutral = monitor.step, monitor.lift, monitor.neutral
    moved = replace(monitor, step=lambda s, e: F.when(e["mark"], s).otherwise(step(s, e)))
    if lift is None:
        return moved
    return replace(moved, lift=lambda e: F.when(e["mark"], neutral).otherwise(lift(e)))


def evaluate_steps(
    spans: DataFrame, monitor: Monitor, chunks: int | None = None
) -> DataFrame:
    """State and verdict after every event."""
    placed = monitored(narrowed(spans, monitor), monitor)
    events = monitor_events(placed, monitor.features)
    keys = monitor.fold_keys()
    order = [c for c in ["session_start", *EVENT_ORDER] if c not in keys]
    if isinstance(monitor, SumMonitor):
        states = ordered.running_sums(
            events, keys, order, {"state": F.col("amount")}, chunks
        )
    else:
        states = fold(
            events, keys, order, ["session_end", *monitor.features], monitor, None, chunks
        )
    return states.withColumn("verdict", monitor.verdict(F.col("state")))


def fold_sequences(sequences: DataFrame, monitor: Monitor, column: str = "items") -> DataFrame:
    """States after each item of ready-made short event arrays, from ``init``."""
    started = sequences.withColumn("_start", monitor.init).withColumnRenamed(column, "items")
    keys = [c for c in started.columns if c not in ("items", "_start")]
    steps = _traced(started, keys, monitor.step)
    return steps.withColumn("truthValue", truth(monitor.verdict(F.col("state"))))


def verdicts(evaluated: DataFrame, monitor: Monitor) -> DataFrame:
    """One row per evaluated session."""
    return evaluated.select(
        "key",
        "session_start",
        "session_end",
        F.lit(monitor.name).alias("propertyName"),
        truth(F.col("verdict")).alias("truthValue"),
    )


def run_monitor(
    spans: DataFrame, monitor: Monitor, sink: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """The whole path for one property, optionally ending in a sink."""
    out = verdicts(evaluate(spans, monitor), monitor)
    if sink is not None:
        sink(out)
    return out


def unmatched_events(spans: DataFrame, monitor: Monitor) -> DataFrame:
    """Events none of the monitor's rules accepts, with their session."""
    accepted = reduce(
        lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in monitor.rules.values()]
    )
    audit = {"accepted": accepted}
    return monitor_events(monitored(narrowed(spans, monitor, audit), monitor), audit).filter(~F.col("accepted"))


def run_monitors(spans: DataFrame, monitors: list[Monitor]) -> DataFrame:
    """Verdicts of several properties over the same spans.

    Monitors with the same key, gap and TTL that ignore and prepare nothing
    read the spans once, for the features of all of them, and share the
    sessions; others run by themselves.
    """
    groups: dict[tuple, list[Monitor]] = {}
    for place, m in enumerate(monitors):
        alone = m.prepare is not None or m.ignore_key is not None or m.ignore_session is not None
        by = (m.key_attribute, m.gap_ms, m.ttl_ms, place if alone else -1)
        groups.setdefault(by, []).append(m)
    found = []
    for (key_attribute, gap_ms, ttl_ms, _), group in groups.items():
        if len(group) == 1:
            found.append(run_monitor(spans, group[0]))
            continue
        features = {f"m{i}_{n}": c for i, m in enumerate(group) for n, c in m.features.items()}
        narrow = freeze(_narrow(key_spans(spans, key_attribute), features))
        borders = freeze(session_slices(narrow, gap_ms, ttl_ms))
        for i, m in enumerate(group):
            own = {f"m{i}_{n}_{e}": f"{n}_{e}" for n in m.features for e in (0, 1)}
            others = [c for c in narrow.columns if c not in own and c.startswith("m") and c[1:2].isdigit()]
            mine = narrow.drop(*others).withColumnsRenamed(own)
            found.append(verdicts(evaluate_narrow(mine, m, borders=borders), m))
    return reduce(DataFrame.unionByName, found)


def verdict_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("propertyName", "truthValue").agg(F.count(F.lit(1)).alias("n"))
