"""Clustered Parquet layouts: range-partitioned and sorted by a key, so row-group
statistics skip what a range or equality can't match; Bloom filters for texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_clustered(df: DataFrame, path: str, key: str, partitions: int | None = None, bloom: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` by ``key`` and returns it as read from there (the same bag)."""
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    writer = ranged.sortWithinPartitions(key).write.mode("overwrite")
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a written table's files (their contents aren't read)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()["bytes"]
