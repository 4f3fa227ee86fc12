"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.sources.shared import cut, new_path, remove, shared_dir  # noqa: F401

#: ASCII white space that separates words: exactly what ``bytes.split()`` splits at.
SPACES = b" \t\n\x0b\x0c\r"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary_list(column: pa.Array) -> list[bytes | None]:
    """The values of an Arrow string column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: What this worker process keeps from task to task: the owner's key and the value.
_KEPT: list = [None, None]


def kept(key: Hashable, make: Callable):
    """The value of ``make()``, kept in this worker process until another key is asked for."""
    if _KEPT[0] != key:
        _let_go()
        _KEPT[:] = [key, make()]
    return _KEPT[1]


def _let_go() -> None:
    if _KEPT[0] is not None:
        _KEPT[:] = [None, None]
    give_back()


def give_back() -> None:
    """Returns freed memory to the machine, since worker processes live on after their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: Hashable | None = None) -> DataFrame:
    """``mapInArrow`` that bounds what a worker process holds: at its start a
    task lets go of what another operator has ``kept``, and at its end returns
    freed memory.  ``keeps`` is the key of what ``run`` itself keeps."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _KEPT[0] is not None and _KEPT[0] != keeps:
            _let_go()
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def names_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def as_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets one of ours; ``row.*`` gives them back."""
    return F.struct(*names_of(df)).alias("row")


def with_results(df: DataFrame, text_col: str, results: Callable[[list], list[tuple]], fields: str) -> DataFrame:
    """``row`` (see ``as_row``) and the columns ``fields`` that ``results`` makes of a batch's texts."""
    kinds = T.StructType.fromDDL(fields)
    rows = df.select(as_row(df), column(text_col).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in kinds.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(zip(*results(batch.column(1).to_pylist()))) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(made, arrow))], names=["row", *kinds.names])

    return in_arrow(rows, run, T.StructType([rows.schema.fields[0], *kinds.fields]))


def learnable(id_col) -> Column:
    """Rows whose labels may be learned from: crc32(id as text) mod 4 is not 2.

    A null id counts as crc32 0, so such rows may be learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0)) % 4 != 2


def held_out(id_col) -> Column:
    return ~learnable(id_col)


def sample_rows(df: DataFrame, strata: str, per_stratum: int) -> DataFrame:
    """min(n, ``per_stratum``) rows of each value of ``strata`` (null a value
    like any other): those whose columns hash lowest, so reruns agree whatever
    the partitioning, and null or repeated ids do no harm.

    Rows are first thinned by a hash threshold from the strata's exact counts,
    so that only about twice the wanted rows are dealt and ranked; a stratum
    that this leaves short, since its rows repeat, is thinned less in a
    further pass.  Equal rows are counted, not dealt, before the ranking."""
    spark, names = df.sparkSession, df.columns
    hashed = df.select(as_row(df), column(strata).alias("stratum"), F.xxhash64(F.lit("sample"), *names_of(df)).alias("rank"))
    counts = hashed.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    few = counts.limit(10_001).collect()
    thin = hashed
    if len(few) <= 10_000:
        at = F.col("rank").cast("double") / F.lit(2.0**64) + F.lit(0.5)
        share = {r["stratum"]: min(1.0, (2.0 * per_stratum + 64) / r["n"]) for r in few}
        schema = T.StructType([T.StructField("s", counts.schema["stratum"].dataType), T.StructField("share", T.DoubleType())])
        while True:
            limits = F.broadcast(spark.createDataFrame(list(share.items()), schema))  # 10,000 rows at most
            thin = hashed.join(limits, F.col("stratum").eqNullSafe(F.col("s"))).where(at <= F.col("share")).drop("s", "share")
            if all(s >= 1.0 for s in share.values()):
                break
            have = {r["stratum"]: r["n"] for r in thin.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
            short = [r["stratum"] for r in few if have.get(r["stratum"], 0) < min(r["n"], per_stratum)]
            if not short:
                break
            share.update({s: min(1.0, 16 * share[s]) for s in short})
    different = thin.groupBy("stratum", "rank").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"))
    order = Window.partitionBy("stratum").orderBy("rank")
    before = different.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    taken = before.where(F.col("before") < per_stratum).withColumn("times", F.least("n", F.lit(per_stratum) - F.col("before")).cast("int"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
