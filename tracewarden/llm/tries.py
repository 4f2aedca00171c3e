"""Tries of conversations that begin alike, as burst tries.

A node is a distinct sequence of first turns.  It is named by its *key*: the
sums of four 31-bit hashes of (depth, turn), so what comes before a stretch of
turns only has to be added to it.  Conversations are cut into storeys of
``STOREY`` turns; a storey's piece of a conversation is a *suffix* under a trie
head, the key of what comes before.  Equal suffixes under one head are one row
from there on, however many conversations share them.

Suffixes of one head are a container.  A container of more than ``CELLS`` turns
bursts: its suffixes go to containers by their next turn, until all are small.
Shards then hold whole containers, sorted, and sweep over them: a suffix opens
a node wherever it differs from its neighbour.  Nodes above the containers are
sums over the burst suffixes.

Sums over a subtree need no climbing.  Each node is *owned* by its smallest
member.  What a conversation owns lies at the end of its path, so the value
below a node is what all its members own, less what its own owner has above.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.steps import tidy
from tracewarden.operators.ordered import numbered, running_sums
from tracewarden.session import freeze

WORD = r"[^\x20\x09-\x0D]+"
STOREY, CELLS, SHARED, STRIDE = 256, 1 << 12, 3, 4
_HASHES = [f"h{i}" for i in range(4)]
#: Key of the root.
ROOT = bytes(32)
#: Conversations whose ids are joined to one text before these are hashed.
_BLOCK_BITS = 12


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, i, id, words)``: turns numbered from 1 in order of ``turn``
    (null first), each with a digest of role and text, and its words.

    Null role or text is empty.  Equal ``turn`` values follow their digests.
    Rows without ``conv_id`` belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"),
        F.col("turn").isNotNull().alias("placed"),
        F.unhex(F.substring(F.sha2(named, 256), 1, 32)).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return freeze(numbered(rows, ["conv_id"], ["placed", "turn", "id", "row"], "i").select("conv_id", "i", "id", "words"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(all ids, turns)`` of conversations that begin like the first of their
    block of twenty: the first ``h`` turns of ``conv_id - conv_id % 20``, then
    the own ones after the first ``h``, with ``h`` the CRC-32 of the id modulo 4.
    """
    given = turns(conversations)
    sizes = given.groupBy("conv_id").agg(F.max("i").alias("size"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (SHARED + 1)).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % 20).alias("base")
    ids = sizes.select("conv_id", h, base)
    heads = sizes.select(F.col("conv_id").alias("base"), F.least("size", F.lit(SHARED)).alias("first"))
    ids = ids.join(heads, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("first", F.lit(0))).alias("taken"))
    ids = freeze(ids)
    first = given.filter(F.col("i") <= SHARED).select(F.col("conv_id").alias("base"), "i", "id", "words")
    shared = ids.join(first, "base").filter("i <= taken").select("conv_id", F.col("i").alias("depth"), "id", "words")
    own = given.join(ids, "conv_id").filter("i > h")
    own = own.select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("depth"), "id", "words")
    return ids.select("conv_id"), shared.unionByName(own)


def _keyed(cells: DataFrame, storey: int) -> DataFrame:
    """``(conv_id, storey, depth, path, words)``: each storey of a conversation
    with the keys of its nodes and the words of their last turns; ``depth`` is
    that before the first of them.
    """
    hashes = [F.xxhash64(F.lit(seed), "depth", "id") for seed in (1, 2)]
    low = [h.bitwiseAND(F.lit(0x7FFFFFFF)) for h in hashes]
    high = [F.shiftrightunsigned(h, 33) for h in hashes]
    values = dict(zip(_HASHES, [*low, *high]))
    cells = cells.withColumns(values | {"storey": F.floor((F.col("depth") - 1) / storey)})
    cell = F.struct("depth", *_HASHES, "words")
    each = cells.groupBy("conv_id", "storey").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    # Only conversations of several storeys have something before one.
    long = cells.filter("storey > 0").select("conv_id").distinct()
    sums = cells.join(long, "conv_id", "left_semi").groupBy("conv_id", "storey")
    sums = freeze(sums.agg(*[F.sum(h).alias(h) for h in _HASHES]))
    before = [F.struct(*[F.lit(0).cast("long").alias(h) for h in _HASHES]).alias("before")]
    if not sums.isEmpty():
        upto = running_sums(sums, ["conv_id"], ["storey"], {f"s{h}": F.col(h) for h in _HASHES})
        less = F.struct(*[(F.col(f"s{h}") - F.col(h)).alias(h) for h in _HASHES])
        upto = upto.select("conv_id", "storey", less.alias("prior"))
        each = each.join(upto, ["conv_id", "storey"], "left")
        before = [F.coalesce("prior", before[0]).alias("before")]
    rows = each.select("conv_id", "storey", "cells", *before)

    def task(batches):
        for batch in batches:
            cells, heads = batch.column(2), batch.column(3)
            sizes = cells.value_lengths().to_numpy()
            stops = np.cumsum(sizes)
            flat = cells.flatten()
            keys = []
            for h in range(4):
                run = np.cumsum(flat.field(h + 1).to_numpy())
                earlier = np.concatenate([[0], run])[stops - sizes]
                keys.append(run + np.repeat(heads.field(h).to_numpy() - earlier, sizes))
            offsets = pa.array(np.concatenate([[0], stops]), pa.int32())
            first = flat.field(0).to_numpy()[stops - sizes] - 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(first, pa.int64()),
                    pa.ListArray.from_arrays(offsets, _binary(np.stack(keys, axis=1))),
                    pa.ListArray.from_arrays(offsets, flat.field(5)),
                    _binary(np.stack([heads.field(h).to_numpy() for h in range(4)], axis=1)),
                ],
                names=["conv_id", "storey", "depth", "path", "words", "head"],
            )

    kinds = "conv_id long, storey long, depth long, path array<binary>, words array<long>, head binary"
    return freeze(rows.mapInArrow(task, kinds))


def _binary(keys: np.ndarray) -> pa.Array:
    """Keys of four numbers as 32 bytes each."""
    packed = pa.py_buffer(np.ascontiguousarray(keys, ">i8").tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(keys), [None, packed]).cast(pa.binary())


def _words(keys: pa.Array) -> np.ndarray:
    """The four numbers of each key."""
    fixed = keys.cast(pa.binary(32))
    flat = np.frombuffer(fixed.buffers()[1], ">i8").reshape(-1, 4)
    return flat[fixed.offset : fixed.offset + len(fixed)]


def burst(suffixes: DataFrame, cells: int = CELLS) -> DataFrame:
    """``suffixes(key, head, path)`` with ``burst``, the turns that heads hold
    of each, and ``container``, the key of the head it ends below.

    Containers larger than ``cells`` turns burst by the next turn; ``STRIDE``
    levels at a time are measured, by sums made before the shuffle.
    """
    size = F.size("path")
    state = suffixes.withColumns({"burst": F.lit(0), "open": F.lit(True)})
    at = lambda level: F.when(level == 0, F.col("head")).otherwise(F.get("path", level - 1))
    done = None
    while True:
        levels = F.sequence(F.col("burst"), F.least(F.col("burst") + STRIDE - 1, size))
        seen = state.select("key", "path", "head", F.explode(levels).alias("level"))
        seen = seen.select("key", "level", at(F.col("level")).alias("node"), (F.size("path") - F.col("level")).alias("turns"))
        large = seen.groupBy("node").agg(F.sum("turns").alias("turns"), F.count(F.lit(1)).alias("n"))
        large = freeze(large.filter((F.col("turns") > cells) & (F.col("n") > 1)).select("node"))
        if large.isEmpty():
            closed = state
            state = None
        else:
            deeper = seen.join(large, "node", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("more"))
            moved = state.join(deeper, "key", "left").withColumn("more", F.coalesce("more", F.lit(0)))
            moved = freeze(moved.withColumn("burst", F.least(F.col("burst") + F.col("more"), size)))
            open_ = (F.col("more") == STRIDE) & (F.col("burst") < size)
            closed, state = moved.filter(~open_).drop("more"), moved.filter(open_).drop("more")
        done = closed if done is None else done.unionByName(closed)
        if state is None or state.isEmpty():
            break
    # All turns of a suffix are in heads: it has reached the bottom of one.
    return done.drop("open").withColumn("container", at(F.col("burst").cast("int")))


def _sweep(sums: list[str], least: str):
    """Task over sorted suffixes: a row for each node they have below heads."""

    def nodes(table: pa.Table) -> pa.RecordBatch:
        path = table["path"].combine_chunks()
        sizes, skip = path.value_lengths().to_numpy().astype(np.int64), table["burst"].to_numpy().astype(np.int64)
        begins, left = np.cumsum(sizes) - sizes, sizes - skip
        keys, heads = _words(path.flatten()), _words(table["head"].combine_chunks())
        row = np.repeat(np.arange(len(sizes)), left)
        level = np.arange(len(row)) - np.repeat(np.cumsum(left) - left, left) + skip[row]
        cell = begins[row] + level
        own = table["container"].to_pylist()
        joined = np.array([k > 0 and own[k] == own[k - 1] for k in range(len(own))], bool)
        above = joined[row] & (level < sizes[row - 1])
        other = np.where(above, begins[row - 1] + level, cell)
        opens = ~above | (keys[other] != keys[cell]).any(axis=1)
        order = np.lexsort((row, level))
        starts = np.flatnonzero(opens[order])
        rows, cells, levels = row[order], cell[order][starts], level[order][starts]
        at = rows[starts]
        words = table["words"].combine_chunks().flatten().to_numpy()
        parents = np.where((levels > 0)[:, None], keys[np.maximum(cells - 1, 0)], heads[at])
        out = {
            "key": _binary(keys[cells]),
            "parent": _binary(parents),
            "depth": pa.array(table["depth"].to_numpy()[at] + levels + 1, pa.int64()),
            "words": pa.array(words[cells], pa.int64()),
        }
        for name, over in [(least, np.minimum), *[(s, np.add) for s in sums]]:
            values = table[name].to_numpy()[rows]
            out[name] = pa.array(over.reduceat(values, starts) if len(starts) else values, pa.int64())
        return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    def task(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = held["container"][-1].as_py()
            if held["container"][0].as_py() == last:
                continue
            whole = len(held) - 1
            while held["container"][whole].as_py() == last:
                whole -= 1
            yield nodes(held.slice(0, whole + 1).combine_chunks())
            held = held.slice(whole + 1)
        if held is not None and len(held):
            yield nodes(held.combine_chunks())

    return task


def _nodes(suffixes: DataFrame, sums: list[str]) -> DataFrame:
    """``(key, parent, depth, words, conv_id, <sums>)`` of all nodes but the root."""
    shards = suffixes.repartition("container").sortWithinPartitions("container", "path")
    kinds = "key binary, parent binary, depth long, words long, conv_id long" + "".join(f", {s} long" for s in sums)
    columns = ["path", "words", "burst", "container", "head", "depth", "conv_id", *sums]
    below = shards.select(*columns).mapInArrow(_sweep(sums, "conv_id"), kinds)
    levels = suffixes.filter("burst > 0").select(*columns, F.explode(F.sequence(F.lit(1), "burst")).alias("level"))
    above = levels.select(
        F.get("path", F.col("level") - 1).alias("key"),
        F.when(F.col("level") > 1, F.get("path", F.col("level") - 2)).otherwise(F.col("head")).alias("parent"),
        (F.col("depth") + F.col("level")).alias("depth"),
        F.get("words", F.col("level") - 1).alias("words"),
        "conv_id",
        *sums,
    )
    above = above.groupBy("key", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), *[F.sum(s).alias(s) for s in sums])
    return below.unionByName(above)


def _digests(ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of ``ends(key, conv_id)``.

    Ids are first joined in blocks of close ones, sorted by Spark; the hash
    then runs over a node's blocks as they stream by, holding one of them.
    """
    block = F.shiftright("conv_id", _BLOCK_BITS).alias("block")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("key", block).agg(ids.alias("ids"))

    def task(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for k, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if k != key:
                    if digest is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _pairs(done)
        if digest is not None:
            yield _pairs([(key, digest.hexdigest())])

    shards = blocks.repartition("key").sortWithinPartitions("key", "block")
    return shards.mapInArrow(task, "key binary, ends_sha256 string")


def _pairs(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], names=["key", "ends_sha256"]
    )


def prefix_trie(ids: DataFrame, cells: DataFrame, storey: int = STOREY, size: int = CELLS) -> DataFrame:
    """One row for each node of the trie of ``cells(conv_id, depth, id, words)``.

    ``ids(conv_id)`` names all conversations, those without turns as well, each
    once; ``depth`` counts the turns of one from 1 without gaps.  Returns
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's
    ``conv_id``; root: null), ``n_convs``, ``n_children``, ``n_leaves``
    (childless nodes below and including it), ``saved_tokens`` (members less
    one, times the words of the last turn, over the nodes below and including
    it) and ``ends_sha256`` (SHA-256 of the ids of members that end here, in
    decimal, ascending, joined by commas).  Without conversations there is no
    node.  Runs jobs while it is built.
    """
    tidy(ids.sparkSession)
    keyed = _keyed(cells, storey)
    one = [F.first(c).alias(c) for c in ("head", "depth", "path", "words")]
    last = F.element_at("path", -1)
    suffixes = keyed.groupBy(last.alias("key")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *one)
    placed = freeze(burst(freeze(suffixes), size))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("words"), "conv_id", "n_convs",
    )
    nodes = freeze(_nodes(placed, ["n_convs"]).unionByName(root))
    children = freeze(nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children")))

    # What each node adds, and what its owner has above it.
    value = (F.col("n_convs") - 1) * F.col("words")
    owned = nodes.join(children, "key", "left").select("key", "conv_id", "depth", value.alias("value"), F.isnull("n_children").cast("long").alias("leaf"))
    owned = running_sums(owned, ["conv_id"], ["depth"], {"upto": F.col("value")})
    owned = freeze(owned.select("key", "conv_id", (F.col("upto") - F.col("value")).alias("above"), "value", "leaf"))
    shares = owned.groupBy("conv_id").agg(F.sum("value").alias("saved"), F.sum("leaf").alias("leaves"))
    shares = freeze(shares.filter("saved <> 0 or leaves <> 0"))
    whole = shares.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))

    ends = keyed.select("conv_id", last.alias("key"))
    weights = ends.join(shares, "conv_id").groupBy("key").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    weighed = placed.join(weights, "key", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("saved", "leaves")})
    below = _nodes(weighed, ["saved", "leaves"]).select("key", "saved", "leaves")
    below = below.unionByName(whole.filter("saved is not null").select(F.lit(ROOT).alias("key"), "saved", "leaves"))

    top = keyed.groupBy("conv_id").agg(F.max_by(last, "storey").alias("key"))
    ended = ids.join(top, "conv_id", "left").select("conv_id", F.coalesce("key", F.lit(ROOT)).alias("key"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(children, "key", "left").join(below, "key").join(owned.select("key", "above"), "key")
    found = found.join(_digests(ended), "key", "left").join(parents, "parent", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
