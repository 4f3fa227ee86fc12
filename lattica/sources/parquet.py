"""Plain Parquet tables as tables of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.plans.types import BOOL, FLOAT, INT, TEXT, Table, TableColumn


def adapted(field: T.StructField) -> tuple[str, Column] | None:
    """A column's kind and its conversion; None for types without one.

    Times count as milliseconds since 1970 in UTC."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT, c.cast("bigint")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return FLOAT, c.cast("double")
    if isinstance(kind, T.StringType):
        return TEXT, c
    if isinstance(kind, T.BooleanType):
        return BOOL, c
    if isinstance(kind, T.TimestampNTZType):
        return INT, F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    if isinstance(kind, T.TimestampType):
        return INT, F.unix_millis(c)
    return None


class ParquetTables:
    """The Parquet files of a folder, each looked at when first used.

    ``keys`` names primary keys; a table without one is a bag."""

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, tuple[str, ...]] | None = None):
        self.spark, self.folder, self.keys = spark, folder, keys or {}
        self.known: dict[str, tuple[Table, DataFrame]] = {}

    def _load(self, name: str) -> tuple[Table, DataFrame]:
        if name not in self.known:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            made = [(f.name, a) for f in df.schema.fields if (a := adapted(f))]
            key = self.keys.get(name, ())
            table = Table(name, tuple(TableColumn(n, kind, n not in key) for n, (kind, _) in made), key)
            self.known[name] = (table, df.select(*(c.alias(n) for n, (_, c) in made)))
        return self.known[name]

    def get(self, name: str) -> Table | None:
        try:
            return self._load(name)[0]
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def frame(self, name: str) -> DataFrame:
        return self._load(name)[1]


class FrameTables:
    """DataFrames by name, with declared tables."""

    def __init__(self, tables: dict[str, tuple[Table, DataFrame]]):
        self.tables = tables

    def get(self, name: str) -> Table | None:
        found = self.tables.get(name)
        return found and found[0]

    def frame(self, name: str) -> DataFrame:
        return self.tables[name][1]
