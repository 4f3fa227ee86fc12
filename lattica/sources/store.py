"""A versioned store of Parquet tables.

Each table version is a folder of Parquet files that never changes.  A
manifest names the catalog and the current version of every table; a new
manifest is published by a rename that fails if its number is taken, so a
reader sees all of a program's writes or none, and of two writers that started
from the same manifest one gets ``serializable_conflict``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import CONFLICT, EngineError
from lattica.plans.types import SPARK, Table
from lattica.sources import catalog as C


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "catalog": C.empty(), "data": {}, "history": []}
        lines = self.spark.read.option("wholetext", True).text(f"{self.folder}/manifests/{version}.json").first()
        return json.loads(lines[0])

    def publish(self, before: dict, catalog: dict, data: dict[str, str], transitions: list[dict] = ()) -> dict:
        """The next manifest, if no other has taken its place; ``transitions`` are the records that it adds."""
        changed = C.canonical(catalog) != C.canonical(before["catalog"])
        catalog = catalog | {"revision": before["catalog"]["revision"] + changed}
        history = before["history"] + ([{"revision": catalog["revision"], "hash": C.digest(catalog)}] if changed else [])
        made = {"version": before["version"] + 1, "catalog": catalog, "data": data, "history": history, "transitions": [*before.get("transitions", []), *(t | {"revision": catalog["revision"]} for t in transitions)]}
        final = self._path(f"{self.folder}/manifests/{made['version']}.json")
        staged = self._path(f"{self.folder}/manifests/.staged-{uuid.uuid4().hex}")
        out = self._fs.create(staged, True)
        out.write(json.dumps(made).encode())
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(self._fs.makeQualified(staged), self._fs.makeQualified(final), options)
        except Exception as error:
            self._fs.delete(staged, False)
            raise EngineError(CONFLICT, "serializable_conflict", str(made["version"])) from error
        return made

    def write(self, df: DataFrame, t: dict) -> str:
        """A new version of a table, its columns stored by id."""
        path = f"{self.folder}/data/{t['id']}-{uuid.uuid4().hex}"
        df.select(*(F.col(f"`{c['name']}`").cast(SPARK[c["type"]]).alias(f"c{c['id']}") for c in t["columns"])).write.parquet(path)
        return path

    def read(self, t: dict, path: str | None) -> DataFrame:
        """A version's rows; a column that came later reads its missing value."""
        schema = ", ".join(f"`{c['name']}` {SPARK[c['type']]}" for c in t["columns"])
        if path is None:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.parquet(path)
        have = set(df.columns)
        return df.select(*((F.col(f"c{c['id']}") if f"c{c['id']}" in have else F.lit(c["missing"]).cast(SPARK[c["type"]])).alias(c["name"]) for c in t["columns"]))


class Snapshot:
    """The tables of one catalog and one set of versions, for the engine."""

    def __init__(self, store: Store, catalog: dict, data: dict[str, str]):
        self.store, self.catalog, self.data = store, catalog, data

    def get(self, name: str) -> Table | None:
        found = [t for t in self.catalog["tables"] if t["name"] == name]
        return C.described(found[0]) if found else None

    def frame(self, name: str) -> DataFrame:
        t = C.table(self.catalog, name)
        return self.store.read(t, self.data.get(str(t["id"])))
