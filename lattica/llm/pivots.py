"""Near-duplicate vectors by a pivot-permutation index (operator 7).

Each vector is described by its nearest pivots, in order.  Inverted lists
hold, for each pair of pivots, the vectors that have both among their
nearest; vectors that share two pivots or more meet in such a list and are
verified by their cosine in double precision.  A pair that meets in several
lists counts in the first only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, sample_rows
from lattica.llm.linking import bucket_cells, components, forest, map_cells

#: A pair of pivots as one key; a vector's length goes in front, so that lists hold vectors of one length.
_PIVOTS = 1 << 13


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest pivots of each row, nearest first; of equal ones the first.

    Rows are taken in chunks, so that memory does not grow with rows times pivots."""
    unit, out = _unit(pivots).T, []
    for at in range(0, len(x), 512):
        far = -(_unit(x[at : at + 512]) @ unit)
        if k < far.shape[1]:
            bound = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
            # Ties on the bound go to the first pivots: the others are put behind.
            tied = far == bound
            far[tied & (np.cumsum(tied, axis=1) > k - (far < bound).sum(axis=1, keepdims=True))] = 2.0
            best = np.sort(np.argpartition(far, k - 1, axis=1)[:, :k], axis=1)
        else:
            best = np.broadcast_to(np.arange(far.shape[1]), far.shape)
        order = np.argsort(np.take_along_axis(far, best, axis=1), axis=1, kind="stable")
        out.append(np.take_along_axis(best, order, axis=1))
    return np.concatenate(out or [np.zeros((0, min(k, len(pivots))), int)]).astype(np.int32)


def n_pivots(n: int, most: int = 4096) -> int:
    """Pivots for n vectors: as the root of n, so that lists stay about as long."""
    return int(min(most, max(8, math.ceil(1.2 * math.sqrt(n)))))


def spread(x: np.ndarray, most: int, least: float) -> np.ndarray:
    """Places of the first ``most`` rows of which no two have a cosine of ``least`` or more, so that a dense group has one pivot, not its share."""
    unit, picked = _unit(x), []
    free = np.ones(len(x), bool)
    for at in range(len(x)):
        if free[at]:
            picked.append(at)
            if len(picked) == most:
                break
            free[at + 1 :] &= unit[at + 1 :] @ unit[at] < least
    return np.array(picked, int)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, k: int = 8, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row.

    Pivots are a bounded sample: 1.2 times the root of the number of
    different vectors of a length, 4,096 at most: those that hash lowest of
    four times as many, without any that another pivot links with, so that a
    dense group can't take many.  All vectors are indexed.  Vectors that are null, zero or hold null or
    non-finite components link with nothing, and so do vectors of different
    lengths.  Equal vectors go through the index once and count with their
    number.  Rows that repeat count as vectors of their own; null ids form
    components that have an id if any member has one."""
    vector = F.col(vector_col) if dict(df.dtypes)[vector_col] == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("x"))  # floats travel as such, cosines are in doubles
    fine = F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = cut(rows.select("vec_id", F.when(fine, F.col("x")).alias("x")).withColumn("node", F.when(fine, F.xxhash64("x"))), "vectors")
    vectors = cut(rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.first("x").alias("x")).withColumn("dim", F.size("x")), "distinct")

    counts = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}  # one row per length of vector
    chosen = sample_rows(vectors.select("node", "x", "dim"), "dim", 4 * n_pivots(max(counts.values(), default=0))).collect()
    sampled = {d: np.array([r["x"] for r in sorted((r for r in chosen if r["dim"] == d), key=lambda r: r["node"])][: 4 * n_pivots(counts[d])]) for d in counts}
    pivots = {d: x[spread(x, n_pivots(counts[d]), least)] for d, x in sampled.items()}
    shared = df.sparkSession.sparkContext.broadcast(pivots)  # 4,096 vectors of each length at most

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                x = part.column("x").flatten().to_numpy().reshape(-1, d)
                near = np.sort(nearest(x, shared.value[d], min(k, len(shared.value[d]))), axis=1)
                if near.shape[1] < 2:
                    near = np.column_stack([near, near + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel(), pa.int16()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "n", "x", "dim")), lists], names=["node", "n", "x", "dim", "near"])

    def compare(c: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
        unit, near = _unit(c["x"]), c["near"]
        cosine = unit[left] @ unit[right].T
        linked = cosine >= least
        if left is right:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked)
        if not len(i):
            return None
        # The pair counts here only if this list is the one of its two smallest shared pivots.
        a, b = left[i], right[j]
        first = np.zeros(len(a), bool)
        low, high = c["key"][0] // _PIVOTS % _PIVOTS, c["key"][0] % _PIVOTS
        for at in range(0, len(a), 100_000):
            pa_, pb = near[a[at : at + 100_000]], near[b[at : at + 100_000]]
            below = ((pa_[:, :, None] == pb[:, None, :]).any(axis=2) & (pa_ < high)).sum(axis=1)
            first[at : at + 100_000] = below == 1  # only ``low`` is shared below ``high``
        a, b = a[first], b[first]
        if not len(a):
            return None
        size = len(c["node"])
        counts = np.bincount(a, c["n"][b], size) + (0 if left is right else np.bincount(b, c["n"][a], size))
        full = np.zeros((size, size), bool)
        full[a, b] = full[b, a] = True
        at = np.flatnonzero(full.any(axis=1))
        return pa.RecordBatch.from_pydict({"node": pa.array(c["node"][at]), "links": pa.array(counts[at].astype(np.int64)), "root": pa.array(c["node"][forest(full)[at]])})

    kind = vectors.schema["x"].dataType.simpleString()
    described = cut(vectors.select("node", "n", "x", "dim").mapInArrow(describe, f"node long, n long, x {kind}, dim int, near array<smallint>"), "described")
    # Lists are dealt to cells without the vectors, which join them once the cells are known.
    pair = f"(dim * {_PIVOTS}L + near[i]) * {_PIVOTS}L + z"
    keys = F.expr(f"flatten(transform(sequence(0, size(near) - 2), i -> transform(slice(near, i + 2, size(near)), z -> {pair})))")
    cells = bucket_cells(cut(described.select("node", F.explode(keys).alias("key")), "lists"), "key", "node", block)
    found = cut(map_cells(cells.join(described.drop("dim"), "node"), "key", compare, "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = vectors.select("node", "n", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = members.groupBy("root").agg(F.min("first").alias("component"))
    known = members.join(smallest, "root").join(links, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
    out = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
