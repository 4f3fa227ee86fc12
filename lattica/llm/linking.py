"""Links inside buckets without all pairs, and connected components.

``bucket_cells`` splits a bucket of any size into cells: its rows are dealt to
blocks, and each pair of blocks is one cell of bounded size.  ``map_cells``
compares rows inside a cell in one vectorised step and emits what grows with
the rows, not with the pairs.  Components come from edges by alternating
large-star and small-star steps over written tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import column, cut, in_arrow, names_of, new_path, partitions, remove

#: Keys with this share of all rows or more are joined by broadcast, so there are 10,000 of them at most.
_HEAVY = 10_000


def hot_join(rows: DataFrame, table: DataFrame, key: str, size: str, few: bool = False) -> DataFrame:
    """``rows`` joined with ``table``, a written table of one row for each key
    with column ``size``, the number of rows that have it.

    Heavy keys are joined by broadcast (there are ``_HEAVY`` at most), so
    their rows stay where they are; all others are dealt by the key.  ``few``
    says that there are too few rows for any key to be heavy."""
    if few:
        return rows.join(table, key)
    total, most = table.agg(F.sum(size), F.max(size)).first()
    least = max(1000, (total or 0) // _HEAVY + 1)
    if (most or 0) < least:
        return rows.join(table, key)
    heavy = F.broadcast(table.where(F.col(size) >= least))
    rest = rows.join(heavy.select(key), key, "left_anti").join(table.where(F.col(size) < least), key)
    return rows.join(heavy, key).unionByName(rest)


def bucket_cells(rows: DataFrame, key: str, spread: str, block: int, sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` with columns lo, hi and side: the cells that a row takes part in.

    Rows alone in their bucket are left out, and so are buckets that are not
    in ``sizes`` (key, n) where that is given.  A bucket of n rows has
    ceil(n / block) blocks; row blocks follow the hash of column ``spread``.
    A large bucket is never dealt to one task: see ``hot_join``."""
    if sizes is None:
        sizes = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_bucket")).where("n_bucket > 1"), "sizes")
    blocks = F.ceil(F.col("n_bucket") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(spread), F.lit("block")), blocks.cast("long")).cast("int")
    dealt = hot_join(rows, sizes, key, "n_bucket").withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")}).drop("n_bucket", "other")


def map_cells(cells: DataFrame, key: str, compare: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``compare(columns, left, right)`` for each cell: the numpy columns of its
    rows and the places of the rows to compare (the same twice in a cell of one block)."""
    n = partitions(cells.sparkSession)
    dealt = cells.repartition(n, key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")
    names = dealt.columns
    lists = {f.name for f in dealt.schema.fields if f.dataType.typeName() == "array"}

    def columns(batch: pa.Table) -> dict[str, np.ndarray]:
        batch = batch.combine_chunks()
        out = {}
        for c in names:
            array = batch.column(c).combine_chunks()
            out[c] = array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1) if c in lists else array.to_numpy(zero_copy_only=False)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done(table: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
            """Compares the cells that have ended; what may go on is held."""
            cell = [table.column(c).to_numpy() for c in (key, "lo", "hi")]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cell])) + 1
            bounds = [0, *new.tolist(), *([table.num_rows] if last else [])]
            out = []
            if len(bounds) > 1:
                data = None if lists else columns(table.slice(0, bounds[-1]))
                for a, b in zip(bounds, bounds[1:]):
                    if b - a < 2:
                        continue
                    # Lists have one length in a cell only, so those are turned to arrays cell by cell.
                    part = columns(table.slice(a, b - a)) if lists else {c: v[a:b] for c, v in data.items()}
                    all_, one = np.arange(b - a), part["lo"][0] == part["hi"][0]
                    left = all_ if one else all_[part["side"] == part["lo"]]
                    made = compare(part, left, left if one else all_[part["side"] == part["hi"]])
                    if made is not None:
                        out.append(made)
            return out, table.slice(bounds[-1])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None or not held.num_rows else pa.concat_tables([held, table])
            if held.num_rows:
                made, held = done(held, False)
                yield from made
        if held is not None and held.num_rows:
            yield from done(held, True)[0]

    return in_arrow(dealt, run, schema)


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row of its component."""
    n = len(linked)
    root = np.full(n, -1)
    for seed in np.flatnonzero(linked.any(axis=1)):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        front = np.array([seed])
        while len(front):
            reached = linked[front].any(axis=0) & (root < 0)
            root[reached] = seed
            front = np.flatnonzero(reached)
    return np.where(root < 0, np.arange(n), root)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of each node in edges (a, b).

    Self links and null ends are ignored; no edges give no rows.  Each step
    writes its edges to the shared folder, so a lost executor costs one step;
    steps that nothing reads any more are removed.  The edges of a node with
    very many are not dealt to one task."""
    spark, paths = edges.sparkSession, []

    def step(df: DataFrame) -> DataFrame:
        paths.append(new_path(spark, "edges"))
        return cut(df, path=paths[-1])

    def least(df: DataFrame) -> DataFrame:
        found = df.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        return found if few else step(found)

    edges = edges.where("a is not null and b is not null and a != b")
    stars = step(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or not now[0]:
            break
        state, few = now, now[0] < 10_000
        # Large star: every larger neighbour of a node, to the smallest of the node and its neighbours.
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = step(hot_join(both, least(both), "a", "n", few).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        # Small star: every smaller neighbour, and the node itself, to the smallest of them.
        lowest = least(large)
        down = hot_join(large, lowest, "a", "n", few).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = step(down.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        for path in paths[:-1]:
            remove(spark, path)
        paths = paths[-1:]
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


#: Rows that may be broadcast where a table was counted first: some dozen MB.
SMALL = 300_000


def sized(df: DataFrame) -> DataFrame:
    """``df``, a written table, to be broadcast if it has at most ``SMALL`` rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def row_hash(df: DataFrame) -> "F.Column":
    return F.xxhash64(*names_of(df))


def keep_rows(df: DataFrame, members: DataFrame, id_col: str) -> DataFrame:
    """``df`` with one row of each class, of the smallest id.

    ``members`` has doc_id, row (see ``row_hash``), root and component_id of
    each row.  Of rows of one class that share its smallest id, that of the
    lowest hash stays; equal rows are one; classes that share an id keep a row
    each.  Rows without an id can't stand for a class and all stay.  Choices
    are made on ids and hashes; of whole rows only those that go, or that
    repeat, are looked up."""
    counted = members.where("doc_id is not null").groupBy("root", "component_id", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    counted = cut(counted, "counted")
    stay = counted.where("doc_id = component_id").groupBy("root").agg(F.min("row").alias("lowest"))
    verdict = counted.join(stay, "root", "left").withColumn("stays", (F.col("doc_id") == F.col("component_id")) & (F.col("row") == F.col("lowest")))
    away = cut(verdict.where("not stays or n > 1").select(F.col("doc_id").alias("away_id"), F.col("row").alias("away_row"), "stays"), "away")
    rows = df.select(F.struct(*names_of(df)).alias("row"), column(id_col).cast("long").alias("row_id"), row_hash(df).alias("hash"))
    same = (F.col("row_id") == F.col("away_id")) & (F.col("hash") == F.col("away_row"))
    single = rows.join(sized(away), same, "left_anti").select("row.*")
    repeated = rows.join(sized(cut(away.where("stays"), "repeated")), same, "left_semi").groupBy("row_id", "hash").agg(F.first("row").alias("row")).select("row.*")
    return single.unionAll(repeated)
