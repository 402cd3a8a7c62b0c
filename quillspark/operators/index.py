"""Dense row numbers, index permutations and row lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise

_LOCAL_BITS = 33


def with_dense_ids(df: DataFrame, name: str, first: int = 0, store: str | None = None) -> DataFrame:
    """``df`` with consecutive numbers in partition order.

    The partition-local ids are written down first (to ``store``, or a scratch
    table), so numbering can't change; then the small table of partition counts
    gives each partition its offset. That table is the side to broadcast, by name:
    Spark reckons sizes by columns, and where only the new number is read it takes
    the rows themselves for the smaller side.
    """
    spark = df.sparkSession
    numbered = df.withColumn("__m", F.monotonically_increasing_id())
    if store:
        numbered.write.mode("overwrite").parquet(store)
        numbered = spark.read.schema(numbered.schema).parquet(store)
    else:
        numbered = materialise(numbered, "numbered")
    part = F.shiftright("__m", _LOCAL_BITS)
    counts = numbered.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p")) - F.col("__n") + first  # one row per partition
    offsets = counts.select("__p", before.alias("__before"))
    row = F.col("__before") + F.col("__m").bitwiseAND((1 << _LOCAL_BITS) - 1)
    return numbered.join(F.broadcast(offsets), part == F.col("__p")).withColumn(name, row).drop("__m", "__p", "__before")


def index_permutation(df: DataFrame, key: str, row_id: str = "row_id") -> DataFrame:
    """(position, row_id) in order of ``key``, ties by ``row_id``: a range exchange
    and local sorts, not one global window."""
    ranged = df.select(key, row_id).repartitionByRange(key, row_id).sortWithinPartitions(key, row_id)
    return with_dense_ids(ranged, "position").select("position", row_id)


def row_lookup(df: DataFrame, index: int, row_id: str = "row_id") -> DataFrame:
    return df.where(F.col(row_id) == index)
