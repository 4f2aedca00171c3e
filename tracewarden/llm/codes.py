"""Vector codes: each part of a vector becomes the number of its nearest entry.

Distances are exact integers.  Parts and entries are padded with zeros to a
power of two ``p`` and brought into the Walsh-Hadamard basis, where squared
differences add up to ``p`` times the squared distance.  Most of it lies in the
coefficients of few sign changes, so they are summed in that order, and an
entry goes as soon as its sum passes the whole distance of a likely entry.

Every task takes any rows; codebooks are the only thing all tasks share, and
hold ``entries`` vectors.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.steps import tidy
from tracewarden.session import freeze

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a batch that are compared at once.
STRIP = 4096


def sequency_order(size: int) -> np.ndarray:
    """Natural numbers of the Hadamard rows by their sign changes."""
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    bits = size.bit_length() - 1
    return sum(((gray >> k) & 1) << (bits - 1 - k) for k in range(bits)) + np.zeros(size, np.int64)


def walsh(values: np.ndarray) -> np.ndarray:
    """The transform of the last axis, padded with zeros, by sign changes."""
    size = 1 << max(0, values.shape[-1] - 1).bit_length()
    out = np.zeros((*values.shape[:-1], size), values.dtype)
    out[..., : values.shape[-1]] = values
    step = 1
    while step < size:
        pairs = out.reshape(*out.shape[:-1], size // (2 * step), 2, step)
        low, high = pairs[..., 0, :], pairs[..., 1, :]
        out = np.stack([low + high, low - high], axis=-2).reshape(out.shape)
        step *= 2
    return out[..., sequency_order(size)]


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` of finite doubles: 64-bit integers where the squares
    of all later sums fit in these, else Python's own of any size."""
    if np.abs(vectors).max(initial=0) * SCALE < 2**25:
        return np.floor(vectors * SCALE).astype(np.int64)
    exact = [int(x) * SCALE if abs(x) >= 2**53 else int(np.floor(x * SCALE)) for x in vectors.ravel().tolist()]
    return np.array(exact, object).reshape(vectors.shape)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of, and squared distance to, the nearest entry of each part;
    equal distances go to the lower number."""
    if parts.shape[-1] == 0:
        return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    a, e = walsh(parts), walsh(entries)
    size = a.shape[-1]
    sums = (a[:, :1] - e[None, :, 0]) ** 2
    likely = e[np.argmin(sums, axis=1)]
    bound = ((a - likely) ** 2).sum(axis=1)
    rows, cols = np.nonzero(sums <= bound[:, None])
    sums = sums[rows, cols]
    for k in range(1, size):
        sums = sums + (a[rows, k] - e[cols, k]) ** 2
        left = sums <= bound[rows]
        rows, cols, sums = rows[left], cols[left], sums[left]
    # Pairs go by row, then entry; every row has the likely one at least.
    firsts = np.searchsorted(rows, np.arange(len(parts)))
    least = np.minimum.reduceat(sums, firsts)
    best = np.flatnonzero(sums == least[rows])
    best = best[np.unique(rows[best], return_index=True)[1]]
    return cols[best], least // size


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _strips(batch: pa.RecordBatch, name: str):
    column = batch.column(batch.schema.get_field_index(name))
    for low in range(0, len(column), STRIP):
        part = column.slice(low, STRIP)
        yield low, whole_numbers(_matrix(part))


def _wide(book: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in Python's integers if one of them is."""
    if book.dtype == values.dtype:
        return book, values
    return book.astype(object), values.astype(object)


def _assigned(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    books, values = _wide(books, values)
    parts = values.reshape(len(values), len(books), values.shape[1] // len(books))
    found = [nearest(parts[:, m], books[m]) for m in range(len(books))]
    return np.stack([c for c, _ in found], axis=1), reduce(lambda x, y: x + y, [d for _, d in found])


def _smaller(books: np.ndarray) -> np.ndarray:
    """64-bit integers again, where they are small enough for exact squares."""
    return books.astype(np.int64) if not books.size or max(abs(int(x)) for x in books.ravel()) < 2**25 else books


def usable(vectors: Column) -> Column:
    """Arrays that are there, with every component there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vectors, lambda x: bad(x.cast("double"))), F.lit(False))


def limbs(x: int) -> list[int]:
    """A whole number of any size in 32-bit steps that can be summed apart; the
    last one has the sign."""
    out = []
    while not -(2**32) < x < 2**32:
        out.append(x & 0xFFFFFFFF)
        x >>= 32
    return [*out, x]


def _sums(books: np.ndarray):
    def task(batches):
        m, k, width = books.shape
        total, count = np.zeros((m, k, width), object), np.zeros((m, k), np.int64)
        for batch in batches:
            for _, values in _strips(batch, "vector"):
                codes, _ = _assigned(values, books)
                parts = values.reshape(len(values), m, width)
                for p in range(m):
                    order = np.argsort(codes[:, p], kind="stable")
                    used, starts = np.unique(codes[order, p], return_index=True)
                    total[p, used] += np.add.reduceat(parts[order, p], starts, axis=0)
                    count[p, used] += np.diff([*starts, len(order)])
        rows = [
            (p, e, place, limb, int(count[p, e]), value)
            for p, e in zip(*np.nonzero(count))
            for place, x in enumerate(total[p, e].tolist())
            for limb, value in enumerate(limbs(int(x)))
        ]
        kinds = [pa.int32()] * 4 + [pa.int64()] * 2
        names = ["part", "entry", "place", "limb", "n", "value"]
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return task


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the mean of its parts, rounded down; unused ones stay."""
    kinds = "part int, entry int, place int, limb int, n long, value long"
    found = rows.mapInArrow(_sums(books), kinds).groupBy("part", "entry", "place", "limb")
    # As many rows as the codebooks have numbers, times the limbs of these.
    sums, sizes = {}, {}
    for r in found.agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect():
        at = r["part"], r["entry"], r["place"]
        sums[at] = sums.get(at, 0) + (r["value"] << (32 * r["limb"]))
        sizes[at] = max(sizes.get(at, 0), r["n"])
    out = books.astype(object)
    for at, total in sums.items():
        out[at] = total // sizes[at]
    return _smaller(out)


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """``(parts, entries, width)`` whole numbers learned from ``rows(vec_id, vector)``."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = rows.orderBy(*order).limit(entries).collect()
    sizes = {r["n"] for r in rows.select(F.size("vector").alias("n")).distinct().limit(2).collect()}
    if len(sizes) > 1 or any(n % parts for n in sizes):
        raise ValueError(f"vectors must have one length, a multiple of {parts}; found {sorted(sizes)}")
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    start = whole_numbers(np.array([r["vector"] for r in first], np.float64))
    books = _smaller(start.reshape(len(first), parts, start.shape[1] // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers by part, entry and place, in decimal."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """``(vec_id, label, code, error, label_error, codebooks_sha256)`` for each
    usable row of ``vectors(vec_id, label, <column>)``.

    Components are taken as ``floor(256 * x)``.  ``code`` holds two hexadecimal
    digits for each part, ``error`` the squared distances summed over the parts,
    ``label_error`` that of all rows with the label, nulls together.  Rows with
    a null vector, or a null or non-finite component, are left out.  Null ids
    come last where the first entries are chosen, equal ids by their vectors;
    repeated rows each have their row.  With fewer usable rows than entries the
    codebooks are as short.  An error beyond 64 bits is null.  Vectors of
    different lengths, or of one that is no multiple of ``parts``, raise
    ``ValueError``.  Other columns are ignored.  At most 256 entries.  Runs jobs
    while it is built.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hexadecimal digits name at most 256 entries")
    tidy(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", F.col(column).cast("array<double>").alias("vector"))
    rows = freeze(rows.filter(usable(F.col("vector"))))
    books = codebooks(rows, parts, entries, rounds)

    def task(batches):
        for batch in batches:
            for low, values in _strips(batch, "vector"):
                codes, errors = _assigned(values, books)
                text = codes.astype(np.uint8).tobytes().hex()
                size = 2 * codes.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, len(values)),
                        batch.column(1).slice(low, len(values)),
                        pa.array([text[k * size : (k + 1) * size] for k in range(len(values))], pa.string()),
                        pa.array([int(x) if int(x) < 2**63 else None for x in errors], pa.int64()),
                    ],
                    names=["vec_id", "label", "code", "error"],
                )

    label = rows.schema["label"].dataType.simpleString()
    ids = rows.schema["vec_id"].dataType.simpleString()
    coded = freeze(rows.mapInArrow(task, f"vec_id {ids}, label {label}, code string, error long"))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.when(F.count("error") == F.count(F.lit(1)), total).try_cast("long")
    totals = coded.groupBy(F.col("label").alias("of")).agg(whole.alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return joined.withColumn("codebooks_sha256", F.lit(books_digest(books)))
