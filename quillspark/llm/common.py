"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import delete, discard, materialise, release_shuffles, scope, scratch_path, shared_dir
from ..shipping import ship

__all__ = ["delete", "discard", "materialise", "release_shuffles", "scope", "scratch_path", "session", "shared_dir", "shuffle_partitions", "table"]


def session(df: DataFrame) -> SparkSession:
    """The session of ``df``, whose Python workers can import this package."""
    ship(df.sparkSession)
    return df.sparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
