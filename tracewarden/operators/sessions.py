"""Keys, event-time sessions, start and end events, and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.spans import is_root, nanos_to_ms, string_attribute
from tracewarden.operators.ordered import CHUNK, CHUNK_BITS, multiple, next_values, numbered, prefixes, same_keys, suffixes
from tracewarden.session import freeze

# Order of the events of a session; ends follow starts at the same instant.
EVENT_ORDER = ["epoch_unix_nano", "trace_id", "span_id", "is_end"]
# Slices of a key that one window sees.
BLOCK_BITS = 12
SPAN_IDENTITY = ["start_time_unix_nano", "end_time_unix_nano", "trace_id"]


def key_by_trace(spans: DataFrame) -> DataFrame:
    return spans.withColumn("key", F.col("trace_id"))


def key_by_attribute(spans: DataFrame, attribute: str) -> DataFrame:
    """Key by a string attribute; spans without it keep their trace id."""
    return spans.withColumn(
        "key", F.coalesce(string_attribute(F.col("attributes"), attribute), F.col("trace_id"))
    )


def key_spans(spans: DataFrame, attribute: str | None) -> DataFrame:
    return key_by_attribute(spans, attribute) if attribute else key_by_trace(spans)


def _start_ms() -> Column:
    return nanos_to_ms(F.col("start_time_unix_nano"))


def _slice(gap_ms: int) -> Column:
    width = F.lit(gap_ms).cast("bigint")
    return F.call_function("div", F.col("start_ms") - F.pmod("start_ms", width), width)


def _joined_stretch(earlier: Column, later: Column, gap_ms: int, ttl_ms: int | None) -> Column:
    """Two stretches of slices in time order as one.

    ``low`` and ``high`` are the first and last start; ``start`` is where the
    last session begins and ``end`` where the first one stops, if the stretch
    holds a border; ``expired`` counts restarts inside.
    """
    pause = later["low"] - earlier["high"]
    border = pause > gap_ms
    expired = (pause > gap_ms + ttl_ms).cast("int") if ttl_ms is not None else F.lit(0)
    joined = F.struct(
        earlier["low"].alias("low"),
        later["high"].alias("high"),
        F.coalesce(later["start"], F.when(border, later["low"]), earlier["start"]).alias("start"),
        F.coalesce(earlier["end"], F.when(border, earlier["high"]), later["end"]).alias("end"),
        (earlier["expired"] + later["expired"] + expired).alias("expired"),
    )
    return F.when(earlier["low"].isNull(), later).when(later["low"].isNull(), earlier).otherwise(joined)


def session_slices(
    spans: DataFrame, gap_ms: int, ttl_ms: int | None = None, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Session borders per key and time slice.

    Two starts within one slice as wide as the gap are closer than the gap,
    so a slice never holds a session border.  The slices are partial
    aggregates of the spans.  Windows run over blocks of at most
    ``2 ** block_bits`` slices; what lies before and after a block is summed up
    as a tree over the blocks of a key, so that no task sees a whole key.

    ``generation`` counts the state restarts of the key: a session that starts
    more than ``ttl_ms`` after the session before it was closed begins a new
    one.  Touching sessions merge.  Runs jobs while it is built.
    """
    slices = freeze(
        spans.withColumn("start_ms", _start_ms())
        .groupBy("key", _slice(gap_ms).alias("slice"))
        .agg(F.min("start_ms").alias("low"), F.max("start_ms").alias("high"))
        .withColumn(CHUNK, F.shiftright("slice", block_bits))
    )
    by_time = Window.partitionBy("key", CHUNK).orderBy("slice")
    up_to_here = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_the_end = (
        Window.partitionBy("key", CHUNK)
        .orderBy(F.desc("slice"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    wide = F.lit(None).cast("bigint")
    nothing = F.struct(
        *[wide.alias(c) for c in ("low", "high", "start", "end")], F.lit(0).alias("expired")
    )
    inner = slices.withColumns({"pause": F.col("low") - F.lag("high").over(by_time), "was": F.lag("high").over(by_time)})
    border = F.col("pause") > gap_ms
    restart = F.count_if(F.col("pause") > gap_ms + ttl_ms).cast("int") if ttl_ms is not None else F.lit(0)
    stretch = F.struct(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.max(F.when(border, F.col("low"))).alias("start"),
        F.min(F.when(border, F.col("was"))).alias("end"),
        restart.alias("expired"),
    )
    joined = lambda x, y: _joined_stretch(x, y, gap_ms, ttl_ms)
    several, before, after = multiple(slices, ["key"]), None, None
    if not several.isEmpty():
        parts = inner.groupBy("key", CHUNK).agg(stretch.alias("part"))
        parts = freeze(same_keys(parts, several, ["key"], "left_semi"))
        before = prefixes(parts, ["key"], nothing, joined)
        after = suffixes(parts, ["key"], nothing, lambda x, y: joined(y, x))
    for name, carry in (("earlier", before), ("later", after)):
        if carry is None:
            slices = slices.withColumn(name, nothing)
        else:
            slices = same_keys(slices, carry.withColumnRenamed("before", name), ["key", CHUNK], "left")
            slices = slices.withColumn(name, F.coalesce(name, nothing))
    earlier, later = F.col("earlier"), F.col("later")
    pause = F.col("low") - F.coalesce(F.lag("high").over(by_time), earlier["high"])
    ending = F.coalesce(F.lead("low").over(by_time), later["low"]) - F.col("high")
    expired = F.lit(0)
    if ttl_ms is not None:
        expired = F.when(F.col("pause") > gap_ms + ttl_ms, 1).otherwise(0)
    begun = F.last(
        F.when(F.col("pause").isNull() | (F.col("pause") > gap_ms), F.col("low")), ignorenulls=True
    ).over(up_to_here)
    stopped = F.last(
        F.when(F.col("ending").isNull() | (F.col("ending") > gap_ms), F.col("high")), ignorenulls=True
    ).over(from_the_end)
    return (
        slices.withColumns({"pause": pause, "ending": ending})
        .withColumns(
            {
                "session_start": F.coalesce(begun, earlier["start"], earlier["low"]),
                "session_end": F.coalesce(stopped, later["end"], later["high"]) + gap_ms,
                "generation": (F.sum(expired).over(up_to_here) + earlier["expired"]).cast("int"),
            }
        )
        .select("key", "slice", "session_start", "session_end", "generation")
    )


def sessionize(
    spans: DataFrame, gap_ms: int, ttl_ms: int | None = None, borders: DataFrame | None = None
) -> DataFrame:
    """Spans with the start and end (ms) of their session.

    The join is on (key, slice), so a large key is spread over its slices and
    adaptive skew splitting takes care of a large slice.
    """
    borders = session_slices(spans, gap_ms, ttl_ms) if borders is None else borders
    placed = spans.withColumn("start_ms", _start_ms()).withColumn("slice", _slice(gap_ms))
    return placed.join(borders, ["key", "slice"]).drop("slice", "start_ms")


def no_large_key(spans: DataFrame, whole: bool = False) -> bool:
    """Does each key fit one task, with two events per span?  Runs a job.

    With ``whole`` no span may be without a key or a start either.
    """
    bare = F.count_if(F.col("start_time_unix_nano").isNull() | F.col("key").isNull()) if whole else F.lit(0)
    sizes = spans if whole else spans.filter("key is not null")
    sizes = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), bare.alias("bare"))
    return sizes.filter((F.col("n") > 2 ** (CHUNK_BITS - 1)) | (F.col("bare") > 0)).isEmpty()


def sessionize_small(spans: DataFrame, gap_ms: int, ttl_ms: int | None = None) -> DataFrame:
    """``sessionize`` where :func:`no_large_key` holds.

    The spans of a key are shuffled once, by the key; what is done next per key
    or session, dedupe and order too, stays where they are.
    """
    others = [c for c in spans.columns if c != "key"]
    by_time = Window.partitionBy("key").orderBy("start_ms")
    up_to_here = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = spans.withColumn("start_ms", _start_ms()).filter("key is not null and start_ms is not null")
    pause = known.withColumn("pause", F.col("start_ms") - F.lag("start_ms").over(by_time))
    border = F.when(F.col("pause").isNull() | (F.col("pause") > gap_ms), F.col("start_ms"))
    expired = F.lit(0) if ttl_ms is None else F.when(F.col("pause") > gap_ms + ttl_ms, 1).otherwise(0)
    generation = F.lit(0) if ttl_ms is None else F.sum(expired).over(up_to_here).cast("int")
    begun = pause.withColumns({
        "session_start": F.last(border, ignorenulls=True).over(up_to_here), "generation": generation,
    })
    last = F.max("start_ms").over(Window.partitionBy("key", "session_start"))
    return begun.withColumn("session_end", last + gap_ms).select("key", *others, "session_start", "session_end", "generation")


def sessions(
    spans: DataFrame, gap_ms: int, ttl_ms: int | None = None, borders: DataFrame | None = None
) -> DataFrame:
    """One row per key and session, without touching the spans twice."""
    borders = session_slices(spans, gap_ms, ttl_ms) if borders is None else borders
    return (
        borders
        .select("key", "session_start", "session_end", "generation")
        .distinct()
    )


def dedupe_spans(placed: DataFrame, within: tuple[str, ...] = ("key", "session_start")) -> DataFrame:
    """Keep one row per span id within a session: the smallest by time and trace.

    The row limit of the window is applied before the shuffle too, so many
    copies of a span shrink to one per task first.
    """
    others = [c for c in placed.columns if c not in SPAN_IDENTITY]
    rank = F.row_number().over(
        Window.partitionBy(*within, "span_id").orderBy(*SPAN_IDENTITY, F.xxhash64(*others))
    )
    return placed.withColumn("_copy", rank).filter("_copy = 1").drop("_copy")


def to_events(spans: DataFrame) -> DataFrame:
    """Two rows per span: its start and its end."""
    return spans.withColumn("is_end", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "epoch_unix_nano",
        F.when(F.col("is_end"), F.col("end_time_unix_nano")).otherwise(
            F.col("start_time_unix_nano")
        ),
    )


def order_events(
    events: DataFrame, keys: tuple[str, ...] = ("key", "session_start"), chunks: int | None = None
) -> DataFrame:
    """Number the events of each session, from 1."""
    return numbered(events, list(keys), EVENT_ORDER, "seq", chunks)


def session_events(spans: DataFrame, gap_ms: int, ttl_ms: int | None = None) -> DataFrame:
    """Events of deduplicated spans with their session, in no particular order."""
    return to_events(dedupe_spans(sessionize(spans, gap_ms, ttl_ms)))


def session_sequence(spans: DataFrame, gap_ms: int, chunks: int | None = None) -> DataFrame:
    """What a monitor sees: the events of each (key, session), numbered in order."""
    if chunks is None and gap_ms > 0 and no_large_key(spans):
        events = to_events(dedupe_spans(sessionize_small(spans, gap_ms)))
        place = F.row_number().over(Window.partitionBy("key", "session_start").orderBy(*EVENT_ORDER))
        return events.withColumn("seq", place.cast("bigint"))
    return order_events(session_events(spans, gap_ms), chunks=chunks)


def _seen(name: str, kind: str) -> Column:
    """An aggregate of a feature over a session's start and end events."""
    start, end = F.col(f"_ignore_{name}_0"), F.col(f"_ignore_{name}_1")
    if kind == "any":
        return F.coalesce(F.bool_or(F.coalesce(start, F.lit(False)) | F.coalesce(end, F.lit(False))), F.lit(False))
    if kind == "all":
        return F.coalesce(F.bool_and(F.coalesce(start & end, F.lit(False))), F.lit(True))
    at = lambda time, is_end: F.struct(F.col(time).alias("at"), "trace_id", "span_id", F.lit(is_end).alias("is_end"))
    begin, stop = at("start_time_unix_nano", False), at("end_time_unix_nano", True)
    if kind == "first":
        early = F.when(begin <= stop, start).otherwise(end)
        return F.min_by(early, F.least(begin, stop))
    if kind == "last":
        late = F.when(begin > stop, start).otherwise(end)
        return F.max_by(late, F.greatest(begin, stop))
    raise ValueError(f"any, all, first or last, not {kind}")


def session_counters(
    placed: DataFrame, features: dict[str, tuple[str, Column]] | None = None
) -> DataFrame:
    """Spans in, distinct spans, roots, duplicates and key fallbacks per session.

    ``features`` adds aggregates over the events of the deduplicated spans; the
    spans hold the features of both events (``_ignore_<name>_0`` and ``_1``).
    """
    counted = _counters(placed)
    if not features:
        return counted
    by = ["key", "session_start"]
    seen = dedupe_spans(placed).groupBy(*by).agg(*[_seen(n, kind).alias(n) for n, (kind, _) in features.items()])
    return counted.join(seen, by)


def _counters(placed: DataFrame) -> DataFrame:
    root = is_root(F.col("parent_span_id"))
    per_id = placed.groupBy("key", "session_start", "session_end", "span_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.max(root.cast("int")).alias("root"),
        F.count_if(F.col("key") == F.col("trace_id")).alias("fallbacks"),
    )
    return per_id.groupBy("key", "session_start", "session_end").agg(
        F.sum("copies").alias("n_spans"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("root").cast("bigint").alias("n_roots"),
        (F.sum("copies") - F.count(F.lit(1))).alias("n_duplicates"),
        F.sum("fallbacks").alias("n_trace_keyed"),
    )


def ignore_windows(placed: DataFrame, ignored: DataFrame) -> DataFrame:
    """Drop the sessions listed in ``ignored`` (columns key, session_start)."""
    return placed.join(ignored.select("key", "session_start"), ["key", "session_start"], "left_anti")


def older_than(key: Column, as_of: Column, age_seconds: int = 86400) -> Column:
    """Whether the epoch second after the last ``/`` of the key is too old.

    A key without such a number is never too old.
    """
    epoch = F.element_at(F.split(key, "/"), -1).try_cast("bigint")
    return F.coalesce(epoch < as_of - age_seconds, F.lit(False))


def root_times(spans: DataFrame) -> DataFrame:
    """Start and end of the first root span of each key, one row per key."""
    root = is_root(F.col("parent_span_id"))
    first = F.min(
        F.struct("start_time_unix_nano", "span_id", "end_time_unix_nano")
    )
    return (
        spans.filter(root)
        .groupBy("key")
        .agg(first.alias("r"))
        .select(
            "key",
            F.col("r.start_time_unix_nano").alias("root_start"),
            F.col("r.end_time_unix_nano").alias("root_end"),
            F.col("r.span_id").alias("root_span_id"),
        )
    )


def root_aligned_events(spans: DataFrame, chunks: int | None = None) -> DataFrame:
    """Events from the root start on: the root start is first, its end last.

    Events before the root start are left out, as are keys without a root.
    """
    events = to_events(spans).join(root_times(spans), "key")
    own = F.col("span_id") == F.col("root_span_id")
    place = F.when(own & ~F.col("is_end"), 0).when(own, 2).otherwise(1)
    kept = events.filter(F.col("epoch_unix_nano") >= F.col("root_start")).withColumn("place", place)
    return numbered(kept, ["key"], ["place", *EVENT_ORDER], "seq", chunks).drop("place")


def multiple_root_errors(spans: DataFrame, by: str = "key") -> DataFrame:
    """Every root of a group beyond its first one, as an error row."""
    roots = spans.filter(is_root(F.col("parent_span_id")))
    first = roots.groupBy(by).agg(
        F.min(F.struct("start_time_unix_nano", "span_id")).alias("_first")
    )
    own = F.struct("start_time_unix_nano", "span_id")
    return (
        roots.join(first, by)
        .filter(own != F.col("_first"))
        .withColumn("error", F.lit("more than one root span"))
        .drop("_first")
    )


def lettered_events(spans: DataFrame, tick_ms: int) -> DataFrame:
    """Events with the number of the tick they fall in, counted from the root start.

    Events before the root start carry a negative letter: they are errors.
    """
    tick = F.lit(tick_ms * 1_000_000).cast("bigint")
    ahead = F.col("epoch_unix_nano") - F.col("root_start")
    letter = F.call_function("div", ahead - F.pmod(ahead, tick), tick)
    return to_events(spans).join(root_times(spans), "key").withColumn("letter", letter)


def tumbling_letters(
    spans: DataFrame, tick_ms: int, tests: dict[str, Column], chunks: int | None = None
) -> DataFrame:
    """One row per key and letter, empty letters included.

    A letter holds how many events fell into its tick and, per named test,
    whether some event of the tick passed.  Letters are partial aggregates, so
    the events of a tick are never gathered.
    """
    events = lettered_events(spans, tick_ms).filter("letter >= 0")
    filled = events.groupBy("key", "letter").agg(
        F.count(F.lit(1)).alias("n_events"),
        *[F.coalesce(F.bool_or(t), F.lit(False)).alias(n) for n, t in tests.items()],
    )
    # An empty letter is told from the gap to the next filled one; long gaps
    # are spread in two steps so that no array grows with their length.
    runs = next_values(
        filled, ["key"], ["letter"], {"_next": F.col("letter")}, strict=True, chunks=chunks
    ).withColumn("_last", F.coalesce(F.col("_next") - 1, F.col("letter")))
    step = F.lit(4096).cast("bigint")
    spread = runs.withColumn("_base", F.explode(F.sequence("letter", "_last", step))).withColumn(
        "_letter", F.explode(F.sequence("_base", F.least(F.col("_base") + step - 1, "_last")))
    )
    own = F.col("_letter") == F.col("letter")
    return spread.select(
        "key",
        F.col("_letter").alias("letter"),
        F.when(own, F.col("n_events")).otherwise(0).alias("n_events"),
        *[F.when(own, F.col(n)).otherwise(False).alias(n) for n in tests],
    )


def early_events(spans: DataFrame, tick_ms: int) -> DataFrame:
    """Events before the root start, which no letter can hold."""
    return lettered_events(spans, tick_ms).filter("letter < 0")
