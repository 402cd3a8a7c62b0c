"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written and not yet deleted, by the scopes that are open.
_SCOPES: list[dict[str, DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that a cluster names in ``spark.checkpoint.dir``. Only where that
    is unset and all tasks run in this very process (tests, a notebook) it is a
    temporary folder of this machine."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("quillspark.scratch.dir", None)
    if not named:
        master = conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("quillspark.scratch.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and the rows (with any partition-dependent ids) can't change afterwards."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    if _SCOPES:
        _SCOPES[-1][path] = out
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*written: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote; nothing may read them any more."""
    for df in written:
        delete(df.sparkSession, df.scratch)
        for scope in _SCOPES:
            scope.pop(df.scratch, None)
    if written:
        release_shuffles(written[0].sparkSession)


def release_shuffles(spark: SparkSession) -> None:
    """Spark drops a shuffle's files once the driver's JVM has collected the plan
    behind it; behind written tables nobody needs them, and they are a corpus long."""
    spark._jvm.System.gc()


@contextlib.contextmanager
def scope():
    """Deletes at its end all tables written inside, but for those handed to the
    function that it yields."""
    tables: dict[str, DataFrame] = {}
    _SCOPES.append(tables)
    try:
        yield lambda df: tables.pop(df.scratch) and df
    finally:
        _SCOPES.remove(tables)
        discard(*tables.values())
