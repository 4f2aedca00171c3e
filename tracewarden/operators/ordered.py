"""Ordered work inside groups of any size.

A window partitioned by key puts every row of a key into one task, which a key
with a large share of all rows cannot afford.  Here the rows of each key are cut
along the order into "chunks" of at most ``2 ** CHUNK_BITS`` rows, by counts of
narrow slices, so that a large key covers many chunks.  Each chunk is worked on by
itself, and what crosses a chunk border goes into a *carry* table of at most
one row per key and chunk.  What the chunks before a chunk add up to is worked
out as a tree over the chunks (:func:`prefixes`), so no task sees all chunks of
a key, and carries are joined on (key, chunk), which no key can dominate.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.session import freeze

CHUNK = "_chunk"
CHUNK_BITS = 18
FAN_BITS = 8
SLICE_BITS = 16


def into_chunks(
    df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None
) -> DataFrame:
    """Rows with the number of their chunk, written out once.

    Chunks of a key are numbered in ``order`` and hold at most
    ``2 ** CHUNK_BITS`` rows.  With ``chunks`` rows are dealt to so many ranges.
    """
    return placed(df, keys, order, chunks)[0]


def placed(
    df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None
) -> tuple[DataFrame, bool]:
    """``into_chunks``, and whether some key may have several chunks.

    Where the order begins with a number, chunks come from counts: rows are
    counted per key, and those of the larger keys per slice of the number, so
    that no row is sampled or moved to find its chunk.  Slices are narrowed
    until each holds at most half a chunk; where one number has more rows than
    that, or the order begins with something else, rows are ranged.
    """
    if chunks is not None:
        return _ranged(df, keys, order, chunks), True
    lead = _leading(df, order)
    if lead is None:
        return _ranged(df, keys, order, None), True
    rows, half = freeze(df), 2**CHUNK_BITS // 2
    flags, number = lead
    large = freeze(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 2 * half).drop("_n"))
    if large.isEmpty():
        return rows.withColumn(CHUNK, F.lit(0).cast("bigint")), False
    at = F.coalesce(F.col(number).cast("bigint"), F.lit(-(2**63)))
    many = same_keys(rows.select(*keys, *flags, at.alias("_at")), large, keys, "left_semi")
    low, high = many.agg(F.min("_at"), F.max("_at")).first()
    bits = max(0, (high - low).bit_length() - SLICE_BITS)
    while True:
        by = [*keys, *flags]
        slices = many.groupBy(*by, F.shiftright("_at", bits).alias("_slice")).agg(F.count(F.lit(1)).alias("_own"))
        slices = freeze(slices)
        if slices.agg(F.max("_own")).first()[0] <= half:
            break
        if bits == 0:
            return _ranged(rows, keys, order, None), True
        bits = max(0, bits - SLICE_BITS // 2)
    summed = running_sum_in_blocks(
        slices.withColumn("_sum", F.col("_own")), by, "_slice", F.shiftright("_slice", SLICE_BITS // 2), "_sum"
    )
    # Flags come before the number in the order, and so in the chunk's number.
    flagged = sum((F.coalesce(F.col(f).cast("bigint") + 1, F.lit(0)) * 3**i for i, f in enumerate(flags[::-1])), F.lit(0))
    chunk = F.shiftleft(flagged.cast("bigint"), 40) + F.floor((F.col("_sum") - F.col("_own")) / half)
    index = summed.select(*by, "_slice", chunk.alias("_chunk_of"))
    found = same_keys(rows.withColumn("_slice", F.shiftright(at, bits)), index, [*by, "_slice"], "left")
    return freeze(found.withColumn(CHUNK, F.coalesce("_chunk_of", F.lit(0))).drop("_slice", "_chunk_of")), True


def _leading(df: DataFrame, order: list[str]) -> tuple[list[str], str] | None:
    """The flags that an order begins with, and the whole number after them."""
    kinds, flags = dict(df.dtypes), []
    for name in order:
        if kinds[name] == "boolean":
            flags.append(name)
        else:
            return (flags, name) if kinds[name] in ("bigint", "int", "smallint", "tinyint") else None
    return None


def _ranged(df: DataFrame, keys: list[str], order: list[str], chunks: int | None) -> DataFrame:
    """Range borders come from a sample and differ between runs of a plan, so
    the numbered rows are frozen before they are used twice."""
    by = [*keys, *order]
    ranged = df.repartitionByRange(chunks, *by) if chunks else df.repartitionByRange(*by)
    # The id counts the sorted rows of a partition up from the partition's own
    # base, so its upper bits number runs of rows in (key, order).
    place = F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)
    return freeze(ranged.sortWithinPartitions(*by).withColumn(CHUNK, place))


def multiple(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that lie in several chunks."""
    ends = rows.groupBy(*keys).agg(F.min(CHUNK).alias("_low"), F.max(CHUNK).alias("_high"))
    return ends.filter("_low < _high").select(*keys)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which some may be NULL; both have only these in common."""
    names = {k: f"_r_{k}" for k in keys}
    other = right.withColumnsRenamed(names)
    met = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(other, met, how).drop(*names.values())


def running(items: Column, start: Column, combine: Callable[[Column, Column], Column], before: bool) -> Column:
    """What precedes (or ends with) each item of a short array, combined."""
    after = lambda acc: F.concat(F.slice(acc["out"], 2, F.size(acc["out"])), F.array(acc["s"]))
    return F.aggregate(
        items,
        F.struct(start.alias("s"), F.array_repeat(start, 0).alias("out")),
        lambda acc, e: F.struct(
            combine(acc["s"], e).alias("s"), F.array_append(acc["out"], acc["s"]).alias("out")
        ),
        (lambda acc: acc["out"]) if before else after,
    )


def prefixes(
    parts: DataFrame,
    keys: list[str],
    neutral: Column,
    combine: Callable[[Column, Column], Column],
) -> DataFrame | None:
    """``(keys, chunk, before)``: what the parts of all earlier chunks combine to.

    ``parts`` holds keys, chunk and ``part``.  Groups of neighbouring chunks
    are combined to one part each, level by level, until one is left; on the
    way back each group hands every member what lies before it.  A group has
    at most ``2 ** FAN_BITS`` members, and levels grow with the logarithm of the chunks.
    """
    level = freeze(parts.select(*keys, F.col(CHUNK).cast("bigint").alias("_at"), "part"))
    low, top = level.agg(F.min("_at"), F.max("_at")).first()
    if low is None:
        return None
    level, top = level.withColumn("_at", F.col("_at") - low), top - low
    groups = []
    while True:
        members = F.array_sort(F.collect_list(F.struct("_at", "part"))).alias("items")
        level = level.withColumn("_up", F.shiftright("_at", FAN_BITS))
        groups.append(freeze(level.groupBy(*keys, F.col("_up").alias("_at")).agg(members)))
        top >>= FAN_BITS
        if top == 0:
            break
        joined = F.aggregate("items", neutral, lambda acc, m: combine(acc, m["part"]))
        level = groups[-1].select(*keys, "_at", joined.alias("part"))
    before = groups[-1].select(*keys, "_at", neutral.alias("before"))
    for group in reversed(groups):
        handed = running(F.col("items"), F.col("before"), lambda acc, m: combine(acc, m["part"]), True)
        rows = same_keys(group, before, [*keys, "_at"], "inner")
        each = F.explode(F.arrays_zip("items", handed.alias("handed"))).alias("e")
        before = rows.select(*keys, each).select(
            *keys, F.col("e.items._at").alias("_at"), F.col("e.handed").alias("before")
        )
    return before.select(*keys, (F.col("_at") + low).alias(CHUNK), "before")


def suffixes(
    parts: DataFrame, keys: list[str], neutral: Column, combine: Callable[[Column, Column], Column]
) -> DataFrame | None:
    """As ``prefixes``, of the later chunks: ``combine(what follows, a part)``."""
    found = prefixes(parts.withColumn(CHUNK, -F.col(CHUNK)), keys, neutral, combine)
    return None if found is None else found.withColumn(CHUNK, -F.col(CHUNK))


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    chunks: int | None = None,
) -> DataFrame:
    """Add running sums over the rows up to and including each row.

    ``order`` must tell rows of one key apart.  All sums are 64-bit integers.
    """
    staged = {f"_v{i}": F.coalesce(v.cast("bigint"), F.lit(0)) for i, v in enumerate(sums.values())}
    rows, several = placed(df.withColumns(staged), keys, order, chunks)
    return _running_sums(rows, keys, order, dict(zip(sums, staged)), several)


def _running_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], split: bool):
    inside = (
        Window.partitionBy(CHUNK, *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.withColumns({out: F.sum(v).over(inside) for out, v in sums.items()})
    if not split:
        return local.drop(CHUNK, *sums.values())
    total = F.struct(*[F.sum(v).alias(v) for v in sums.values()])
    per_chunk = rows.groupBy(*keys, CHUNK).agg(total.alias("part"))
    several = multiple(rows, keys)
    zero = F.struct(*[F.lit(0).cast("bigint").alias(v) for v in sums.values()])
    add = lambda x, y: F.struct(*[(x[v] + y[v]).alias(v) for v in sums.values()])
    if not several.isEmpty():
        carry = prefixes(same_keys(per_chunk, several, keys, "left_semi"), keys, zero, add)
        local = same_keys(local, carry, [*keys, CHUNK], "left")
        local = local.withColumns(
            {out: F.col(out) + F.coalesce(F.col("before")[v], F.lit(0)) for out, v in sums.items()}
        ).drop("before")
    return local.drop(CHUNK, *sums.values())


def running_sum_in_blocks(
    df: DataFrame, keys: list[str], order: str, block: Column, value: str
) -> DataFrame:
    """``value`` summed up to each row, for rows that bear their block.

    Blocks follow the order and hold few rows each; only they are windowed.
    """
    rows = df.withColumn(CHUNK, block)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = df.schema[value].dataType
    sums = rows.groupBy(*keys, CHUNK).agg(F.sum(value).cast(kind).alias("part"))
    several = multiple(sums, keys)
    local = rows.withColumn(value, F.sum(value).over(inside).cast(kind))
    if not several.isEmpty():
        add = lambda x, y: (x + F.coalesce(y, F.lit(0))).cast(kind)
        carry = prefixes(same_keys(sums, several, keys, "left_semi"), keys, F.lit(0).cast(kind), add)
        local = same_keys(local, carry, [*keys, CHUNK], "left")
        local = local.withColumn(value, F.col(value) + F.coalesce("before", F.lit(0).cast(kind))).drop("before")
    return local.drop(CHUNK)


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: str = "seq",
    chunks: int | None = None,
) -> DataFrame:
    """Add the position of each row within its key, from 1."""
    return running_sums(df, keys, order, {out: F.lit(1)}, chunks)


def next_values(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Column],
    strict: bool = False,
    chunks: int | None = None,
) -> DataFrame:
    """Add, per value, the first non-null one at or after each row.

    With ``strict`` the row itself is not looked at.
    """
    names = list(values)
    rows, split = placed(df.withColumns(values), keys, order, chunks)
    # Looking back in reverse order: one pass, where a frame that reaches to the
    # end of the group would be worked out anew for each row.
    backwards = (
        Window.partitionBy(CHUNK, *keys)
        .orderBy(*[F.desc(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -int(strict))
    )
    local = rows.withColumns({n: F.last(n, ignorenulls=True).over(backwards) for n in names})
    if not split:
        return local.drop(CHUNK)
    position = F.struct(*order)
    first = [F.min_by(n, F.when(F.col(n).isNotNull(), position)).alias(n) for n in names]
    per_chunk = rows.groupBy(*keys, CHUNK).agg(F.struct(*first).alias("part"))
    several = multiple(rows, keys)
    # From the end: of the parts seen the nearest one counts.
    nearest = lambda x, y: F.struct(*[F.coalesce(y[n], x[n]).alias(n) for n in names])
    nothing = F.struct(*[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in names])
    if not several.isEmpty():
        carry = suffixes(same_keys(per_chunk, several, keys, "left_semi"), keys, nothing, nearest)
        local = same_keys(local, carry, [*keys, CHUNK], "left")
        local = local.withColumns({n: F.coalesce(n, F.col("before")[n]) for n in names}).drop("before")
    return local.drop(CHUNK)


def arrays_per_chunk(
    rows: DataFrame, keys: list[str], order: list[str], payload: list[str], out: str = "items"
) -> DataFrame:
    """One ordered array per key and chunk; never longer than a chunk."""
    item = F.struct(*order, *[p for p in payload if p not in order])
    return rows.groupBy(CHUNK, *keys).agg(F.array_sort(F.collect_list(item)).alias(out))
