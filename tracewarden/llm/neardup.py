"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each document's distinct word shingles are hashed once; the ``k`` smallest
   hashes are its sketch.  Documents of equal sets form a class, of which only
   the smallest ``doc_id`` goes on, so groups of copies cost one row each.
2. Inverted lists of the retained values name the classes that share them.
   Every class is first held against the head (smallest id) of its lists: one
   pair per class and head, however long the list.
3. Classes of short lists that are still apart are paired, with their overlap
   counted over the lists.  Classes whose sketch lies mostly in long lists
   can be alike through these alone: they are held against each other in
   blocks of bounded size, in which the exact intersections are matrix
   products; blocks that are already one component are skipped.
4. Pairs of the lists must pass the estimate of the union's sketch, and all
   links are confirmed on the full sets.

The estimate is taken at half the threshold.  A pair at exactly 0.75 misses
that with a probability below 1e-7 at ``k`` = 48; sets smaller than the sketch
are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.steps import components, tidy
from tracewarden.llm.words import NON_SPACE, mixed, pieces, plain_strings, shingles, split_words
from tracewarden.session import freeze

LONG_LIST = 64
BLOCK = 512
_COLUMNS = 8192


def _document_sets(batches, width, make, schema):
    """One row for each document: ``make`` gets its id and its set."""
    for batch in batches:
        texts, ids = plain_strings(batch, "text"), batch.column(0)
        for low, high in pieces(texts):
            found = split_words(texts[low:high], NON_SPACE, fold=True)
            rows = [
                make(key, shingles(found.hashes[found.of(i)], width))
                for i, key in enumerate(ids[low:high].to_pylist())
            ]
            yield pa.RecordBatch.from_pylist(rows, schema)


def _print_of(values: np.ndarray, seed: int) -> int:
    with np.errstate(over="ignore"):
        return int(mixed(values + np.uint64(seed)).sum(dtype=np.uint64).view(np.int64))


def sketches(docs: DataFrame, k: int = 48, width: int = 5) -> DataFrame:
    """``(doc_id, n, f1, f2, sketch)``: set size, a 128-bit print of the set
    that does not depend on its order, and its ``k`` smallest hashes."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sketch", pa.list_(pa.int64()))]
    )

    def make(key, values):
        return {
            "doc_id": key,
            "n": len(values),
            "f1": _print_of(values, 1),
            "f2": _print_of(values, 0x5851F42D4C957F2D),
            "sketch": values[:k].astype(np.int64),
        }

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda batches: _document_sets(batches, width, make, schema),
        "doc_id long, n long, f1 long, f2 long, sketch array<long>",
    )


def full_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(id, n, whole)``: the full set, as the bytes of sorted 64-bit hashes."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("whole", pa.binary())])

    def make(key, values):
        return {"id": key, "n": len(values), "whole": values.tobytes()}

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda batches: _document_sets(batches, width, make, schema), "id long, n long, whole binary"
    )


def _alike(inter, n_a, n_b, percent):
    return 100 * inter >= percent * (n_a + n_b - inter)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets are alike."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("whole").alias(f"whole_{c}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def verify(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("whole_a"), batch.column("whole_b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(_alike(inter, len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "whole_a", "whole_b").mapInArrow(verify, "a long, b long")


def _estimated(pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose union's sketch leaves them possible."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return joined.filter(sizes & (200 * shared >= percent * F.size(union))).select("a", "b")


def _forest(links: list[tuple[int, int]], comps: dict[int, int]) -> list[tuple[int, int]]:
    """Of the links, those that join two parts of what they connect."""
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in links:
        x, y = root(comps[a]), root(comps[b])
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _block_links(percent: int):
    """Links between the two blocks of a tile, or within its single block."""

    def compare(table: pa.Table) -> pa.Table:
        tile = table.to_pydict()
        ids, comp = np.array(tile["rep"]), np.array(tile["comp"])
        first = np.array(tile["block"]) == np.array(tile["bi"])
        values = [np.frombuffer(b, np.uint64) for b in tile["whole"]]
        sizes = np.array([len(v) for v in values])
        rows = np.repeat(np.arange(len(ids)), sizes)
        flat = np.concatenate(values)
        codes, places, often = np.unique(flat, return_inverse=True, return_counts=True)
        left = np.flatnonzero(first)
        right = left if tile["bi"][0] == tile["bj"][0] else np.flatnonzero(~first)
        slot = np.empty(len(ids), np.int64)
        slot[left], slot[right] = np.arange(len(left)), np.arange(len(right))
        inter = np.zeros((len(left), len(right)), np.float32)
        useful = np.flatnonzero(often > 1)  # a value of one row meets nothing
        number = np.full(len(codes), -1, np.int64)
        number[useful] = np.arange(len(useful))
        column = number[places]
        order = np.argsort(column, kind="stable")
        ordered = column[order]
        for low in range(0, len(useful), _COLUMNS):
            part = order[np.searchsorted(ordered, low) : np.searchsorted(ordered, low + _COLUMNS)]
            dense = np.zeros((len(ids), min(_COLUMNS, len(useful) - low)), np.float32)
            dense[rows[part], column[part] - low] = 1
            inter += dense[left] @ dense[right].T
        ok = _alike(inter, sizes[left][:, None], sizes[right][None, :], percent)
        ok &= comp[left][:, None] != comp[right][None, :]
        x, y = np.nonzero(ok)
        links = list(zip(ids[left][x].tolist(), ids[right][y].tolist(), strict=True))
        kept = _forest(links, dict(zip(ids.tolist(), comp.tolist(), strict=True)))
        return pa.table({"a": pa.array([a for a, _ in kept], pa.int64()), "b": pa.array([b for _, b in kept], pa.int64())})

    return compare


def _links_of_long_lists(members: DataFrame, sets: DataFrame, labels: DataFrame, k: int, percent: int, long_list: int, block: int) -> DataFrame:
    """Links of classes that may be alike through long lists alone."""
    held = members.filter(F.col("c") > long_list)
    enough = (
        held.groupBy("rep").agg(F.countDistinct("value").alias("hot"), F.max("n").alias("n"))
        .filter(F.col("hot") * 200 >= percent * F.least(F.col("n"), F.lit(k)))
        .select("rep")
    )
    held = freeze(held.select("value", "rep").join(enough, "rep"))
    heads = held.groupBy("value").agg(F.min("rep").alias("head"))
    met = components(held.join(heads, "value").select(F.col("rep").alias("a"), F.col("head").alias("b")))
    nodes = met.select(F.col("node").alias("rep"), F.col("component").alias("met"))
    nodes = nodes.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    # Rows of a large component get blocks of their own.
    cohorts = nodes.groupBy("met", "comp").count()
    nodes = nodes.join(cohorts, ["met", "comp"]).withColumn(
        "cohort", F.when(F.col("count") >= block, F.col("comp"))
    )
    total = nodes.groupBy("met", "cohort").agg(F.count("*").alias("rows"))
    nodes = nodes.drop("count").join(
        total.withColumnRenamed("cohort", "c2").withColumnRenamed("met", "m2"),
        (F.col("met") == F.col("m2")) & F.col("cohort").eqNullSafe(F.col("c2")),
    )
    share = F.ceil(F.col("rows") / block)
    nodes = freeze(
        nodes.withColumn("block", F.hash(F.col("cohort"), F.pmod(F.xxhash64("rep"), share)).cast("long"))
        .select("met", "rep", "comp", "cohort", "block")
    )
    blocks = nodes.select("met", "block", "cohort").distinct()
    right = blocks.select("met", F.col("block").alias("bj"), F.col("cohort").alias("cj"))
    # One row for each two blocks that do not lie in one component.
    tiles = (
        blocks.withColumnRenamed("block", "bi").join(right, "met")
        .filter("bi <= bj and not (cohort <=> cj and cohort is not null)")
        .select("met", "bi", "bj")
    )
    rows = tiles.withColumn("block", F.explode(F.array_distinct(F.array("bi", "bj")))).join(nodes, ["met", "block"])
    rows = rows.join(sets.select(F.col("id").alias("rep"), "whole"), "rep")
    return (
        rows.select("met", "bi", "bj", "block", "rep", "comp", "whole")
        .groupBy("met", "bi", "bj")
        .applyInArrow(_block_links(percent), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame,
    percent: int = 75,
    width: int = 5,
    k: int = 48,
    long_list: int = LONG_LIST,
    block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of
    ``docs(doc_id, text)``.

    Words run to ASCII white space, with A-Z in lower case; documents of fewer
    than ``width`` words are one shingle.  Two documents are linked where 100
    times the intersection is at least ``percent`` times the union.  Documents
    without words are linked with nothing, as are rows without a ``doc_id``
    (``component_id`` null, kept).  Rows of one ``doc_id`` are one document:
    all are returned and links of any of them count.  Other columns are not
    read.  Runs jobs and writes tables to the shared folder while it is built.
    """
    tidy(docs.sparkSession)
    made = freeze(sketches(docs, k, width))
    whole = made.filter("n > 0 and doc_id is not null")
    classes = freeze(whole.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")))
    reps = freeze(
        whole.join(classes.select("f1", "f2", F.col("rep").alias("doc_id")), ["f1", "f2", "doc_id"])
        .select(F.col("doc_id").alias("rep"), "n", "sketch")
    )
    postings = reps.select("rep", "n", F.explode("sketch").alias("value"))
    lists = freeze(
        postings.groupBy("value").agg(F.count("*").alias("c"), F.min("rep").alias("head")).filter("c > 1")
    )
    members = freeze(postings.join(lists, "value"))
    need = F.ceil(F.lit(percent / 200) * F.least(F.col("n"), F.lit(k)))
    pool = (
        members.groupBy("rep").agg(
            F.count("*").alias("held"), F.sum((F.col("c") > long_list).cast("long")).alias("hot"), F.max(need).alias("need")
        )
        .filter("held >= need")
    )
    pool = freeze(pool)
    sets = freeze(full_sets(docs.join(pool.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), width))
    reps = freeze(reps.join(pool.select("rep"), "rep", "left_semi"))

    # Each class against the heads of its lists.
    stars = (
        members.filter("rep <> head").groupBy(F.col("head").alias("a"), F.col("rep").alias("b"))
        .agg(F.count("*").alias("o"), F.max(need).alias("need"))
        .filter("o >= need")
    )
    first = freeze(_confirmed(_estimated(stars, reps, k, percent), sets, percent))
    labels = freeze(components(first).select(F.col("node").alias("rep"), F.col("component").alias("comp")))

    # Classes of short lists that are still apart.
    short = members.filter(F.col("c") <= long_list).join(pool.select("rep", "hot", "need"), "rep")
    short = short.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    short = freeze(short.select("value", "rep", "comp", "hot", "need"))
    apart = short.groupBy("value").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y")
    short = short.join(apart.select("value"), "value")
    other = short.select("value", *[F.col(c).alias(f"{c}_b") for c in ("rep", "comp", "hot", "need")])
    paired = (
        short.join(other, "value").filter("rep < rep_b and comp <> comp_b")
        .groupBy(F.col("rep").alias("a"), F.col("rep_b").alias("b"))
        .agg(F.count("*").alias("o"), F.max(F.least("hot", "hot_b")).alias("hot"), F.max(F.greatest("need", "need_b")).alias("need"))
        .filter("o + hot >= need")
    )
    second = freeze(_confirmed(_estimated(paired, reps, k, percent), sets, percent))
    third = freeze(_links_of_long_lists(members, sets, labels, k, percent, long_list, block))

    linked = components(first.unionByName(second).unionByName(third))
    named = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select(
        "f1", "f2", "n", F.coalesce("component", "rep").alias("component_id")
    )
    both = whole.join(named, ["f1", "f2", "n"])
    alone = made.filter("n = 0 or doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    rows = both.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
    # A repeated doc_id may stand for several sets, and so for several classes.
    twice = made.groupBy("doc_id").count().filter("count > 1 and doc_id is not null")
    if not twice.isEmpty():
        rows = _joined_copies(freeze(rows))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _joined_copies(rows: DataFrame) -> DataFrame:
    """Rows of one ``doc_id`` in different components join these."""
    merged = components(rows.filter("doc_id is not null").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    merged = merged.select(F.col("node").alias("doc_id"), "component")
    return rows.join(merged, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id")
    )

