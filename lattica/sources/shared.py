"""The folder that driver and executors share, and lineage cuts in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one.

    A session of one machine (a test, say) may do without and gets a temporary
    folder; on a cluster executors would not see each other's files there, so
    a missing setting is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lattica-')}")
        found = context.getCheckpointDir()
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in this application's own part of the shared folder, which goes when the application ends."""
    own = f"{shared_dir(spark)}/lattica/{spark.sparkContext.applicationId}"
    where, files = _file_system(spark, own)
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that
    survives the loss of any executor and lets later reads prune columns."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written step that nothing reads any more."""
    where, files = _file_system(spark, path)
    files.delete(where, True)
