"""Structured Streaming over a folder that CSV files are dropped into.

The row-wise parsing is the same as in batch. A stream has no place for row ids,
and its files carry no header unless ``header`` names the line to leave out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records_csv import parse_lines


def record_stream(spark: SparkSession, folder: str, header: str | None = None, **options: str) -> DataFrame:
    lines = spark.readStream.option("lineSep", "\n").options(**options).text(folder)
    if header is not None:
        lines = lines.where(F.regexp_replace("value", r"\r+\z", "") != header)
    return parse_lines(lines)
