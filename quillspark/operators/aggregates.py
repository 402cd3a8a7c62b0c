"""Grouped counts and reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the extremes of no rows at all are.
EMPTY_MIN, EMPTY_MAX = 2**32 - 1, 0


def count_by_precinct(df: DataFrame, max_key: int | None = 200, column: str = "violation_precinct") -> DataFrame:
    """(key, count) for precincts below ``max_key`` (None: all)."""
    if max_key is not None:
        df = df.where(F.col(column) < max_key)
    return df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("count"))


def count_by_fiscal_year(df: DataFrame, bounded: bool = False, column: str = "fiscal_year") -> DataFrame:
    """(key, count) for all years, or for 2000..2049 only."""
    if bounded:
        df = df.where((F.col(column) >= 2000) & (F.col(column) < 2050))
    return df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("count"))


def first_n_groups(groups: DataFrame, n: int = 5) -> DataFrame:
    """The n smallest keys."""
    return groups.orderBy("key").limit(n)


def top_groups(groups: DataFrame, n: int = 5) -> DataFrame:
    """The n largest counts."""
    return groups.orderBy(F.desc("count"), "key").limit(n)


def count_in_date_range(df: DataFrame, start: int, end: int, column: str = "issue_date") -> DataFrame:
    return df.where(F.col(column).between(start, end)).agg(F.count(F.lit(1)).alias("count"))


def date_extremes(df: DataFrame, ignore_null_dates: bool = False, column: str = "issue_date") -> DataFrame:
    """(min_date, max_date) over all rows, missing dates (0) included unless told otherwise."""
    if ignore_null_dates:
        df = df.where(F.col(column) != 0)
    low = F.coalesce(F.min(column).cast("long"), F.lit(EMPTY_MIN).cast("long"))
    high = F.coalesce(F.max(column).cast("long"), F.lit(EMPTY_MAX).cast("long"))
    return df.agg(low.alias("min_date"), high.alias("max_date"))


def record_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


filter_count = record_count


def text_pool_size(df: DataFrame) -> DataFrame:
    """Bytes of all text columns, also in MiB and GiB."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    size = F.coalesce(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0)).cast("long")), F.lit(0))
    out = df.agg(size.cast("long").alias("size"))
    return out.select("size", (F.col("size") / 2**20).alias("size_mb"), (F.col("size") / 2**30).alias("size_gb"))
