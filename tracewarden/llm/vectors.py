"""Near-duplicate vectors: int8 tile products with error bounds.

Vectors are brought to length 1 and written as ``s * q + e`` with ``q`` in
int8.  For two of them ``|v.w - s*t*(q.r)| <= |sq||f| + |e||tr| + |e||f|``, so
the product of codes plus that bound is never below the true cosine.  Tiles of
codes are multiplied as matrices (exact: sums stay below 2**24), and only pairs
whose upper bound reaches the threshold are computed again in double precision.

Equal vectors form a class of one row.  Classes are dealt into blocks of a
fixed number of rows by hash, and each two blocks meet in one task.  A task
returns link counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.steps import components, tidy
from tracewarden.session import freeze

BLOCK = 2048
#: Rows of a tile's product that are held at once.
_STRIP = 256
#: Above the rounding of the bound's own double arithmetic.
_SLACK = 1e-9


def _usable(batches):
    """``(vec_id, code, n)`` of vectors that can link: the bytes of their doubles."""
    schema = pa.schema([("vec_id", pa.int64()), ("code", pa.binary())])
    for batch in batches:
        rows = []
        for key, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            code = None
            if values.is_valid:
                inner = values.values
                vector = inner.cast(pa.float64()).to_numpy(zero_copy_only=False)
                if inner.null_count == 0 and len(vector) and np.isfinite(vector).all():
                    most = np.abs(vector).max()
                    if most > 0:
                        code = (vector + 0.0).tobytes()
            rows.append({"vec_id": key, "code": code})
        yield pa.RecordBatch.from_pylist(rows, schema)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, lengths of what the codes stand for, lengths of the rest."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def upper_bounds(left, right) -> np.ndarray:
    """Of all products of two sets of quantised vectors."""
    (q, s, near_l, rest_l), (r, t, near_r, rest_r) = left, right
    products = (q.astype(np.float32) @ r.astype(np.float32).T).astype(np.float64)
    products *= s[:, None]
    products *= t[None, :]
    products += np.outer(near_l, rest_r)
    products += np.outer(rest_l, near_r + rest_r)
    return products


def _tile(threshold: float):
    kinds = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        ids, counts = table["rep"].to_numpy(), table["n"].to_numpy()
        vectors = np.frombuffer(b"".join(table["code"].to_pylist()), np.float64).reshape(len(ids), -1)
        # Scaled first, as squares of large or small numbers leave the doubles.
        scaled = vectors / np.abs(vectors).max(axis=1)[:, None]
        unit = scaled / np.linalg.norm(scaled, axis=1)[:, None]
        first = table["block"].to_numpy() == table["bi"].to_numpy()
        left = np.flatnonzero(first)
        same = table["bi"][0] == table["bj"][0]
        right = left if same else np.flatnonzero(~first)
        coded = quantised(unit)
        side = lambda at: tuple(x[at] for x in coded)
        links, up, forest = np.zeros(len(ids), np.int64), np.arange(len(ids)), []

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for low in range(0, len(left), _STRIP):
            rows = left[low : low + _STRIP]
            maybe = np.argwhere(upper_bounds(side(rows), side(right)) >= threshold - _SLACK)
            a, b = rows[maybe[:, 0]], right[maybe[:, 1]]
            if same:
                a, b = a[a < b], b[a < b]
            for part in range(0, len(a), 65536):
                x, y = a[part : part + 65536], b[part : part + 65536]
                exact = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                x, y = x[exact], y[exact]
                np.add.at(links, x, counts[y])
                np.add.at(links, y, counts[x])
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    p, q = root(i), root(j)
                    if p != q:
                        up[max(p, q)] = min(p, q)
                        forest.append((ids[i], ids[j]))
        some = np.flatnonzero(links)
        return pa.table(
            {
                "id": pa.array([*ids[some].tolist(), *[int(i) for i, _ in forest]], pa.int64()),
                "links": pa.array([*links[some].tolist(), *[0] * len(forest)], pa.int64()),
                "to": pa.array([*[None] * len(some), *[int(j) for _, j in forest]], pa.int64()),
            },
            kinds,
        )

    return compare


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of
    ``vectors(vec_id, embedding)``.

    Two rows are linked where their cosine in double precision is at least
    ``threshold``; rows of equal vectors are.  Null, empty and zero vectors and
    those with null or non-finite components link with nothing, nor do vectors
    of different lengths with each other.  Rows of one ``vec_id`` share a
    component, but each counts as a link of the others that it is linked with;
    a row without ``vec_id`` links with nothing (``component_id`` null, kept).
    Other columns are not read.  Runs jobs and writes tables to the shared
    folder while it is built.
    """
    tidy(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_usable, "vec_id long, code binary")
    rows = freeze(rows.withColumn("code", F.when(F.col("vec_id").isNotNull(), F.col("code"))))
    classes = rows.filter("code is not null").groupBy("code").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = freeze(classes)
    size = F.octet_length("code")
    blocks = classes.groupBy(size.alias("size")).agg(F.count("*").alias("rows")).collect()
    # Vectors of one length are a set of blocks; there are few lengths.
    share = F.coalesce(*[F.when(size == r["size"], F.lit(math.ceil(r["rows"] / block))) for r in blocks], F.lit(1))
    placed = classes.select("rep", "n", "code", size.alias("size"), share.alias("share"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("code"), F.col("share")))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("share") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    found = freeze(
        dealt.select("size", low.alias("bi"), high.alias("bj"), "block", "rep", "n", "code")
        .groupBy("size", "bi", "bj")
        .applyInArrow(_tile(threshold), "id long, links long, to long")
    )
    linked = components(found.filter("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    counts = found.filter("to is null").groupBy("id").agg(F.sum("links").alias("others"))
    named = (
        classes.join(counts.withColumnRenamed("id", "rep"), "rep", "left")
        .join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "code",
            (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    out = rows.join(named, "code", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
