"""Ingest of record CSV files: text lines, tokenizer expression, typed columns."""

from __future__ import annotations

import sys

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import csv_tokens, enum_code, parse_date, to_u16, to_u32, to_u64
from ..operators.index import with_dense_ids
from ..schema import COLUMNS, LEAST_FIELDS, RAW_SUFFIX, record_type

_NUMBERS = {"u64": to_u64, "u32": to_u32, "u16": to_u16, "date": parse_date}


def typed_columns(tokens: Column) -> list[Column]:
    out = []
    for place, (name, kind) in enumerate(COLUMNS.items()):
        text = F.coalesce(F.get(tokens, F.lit(place)), F.lit(""))
        if kind.startswith("code:"):
            out += [enum_code(text, kind[5:]).alias(name), text.alias(name + RAW_SUFFIX)]
        else:
            out.append((text if kind == "text" else _NUMBERS[kind](text)).alias(name))
    return out


def parse_lines(lines: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    """Typed records of text lines: trailing carriage returns go, then empty lines
    and those with too few fields. ``keep`` names columns that stay."""
    lines = lines.withColumn("__line", F.rtrim(value, F.lit("\r")))
    # a filter on the tokens would be moved below them and evaluate them twice; a generator stays
    wide = F.filter(F.array(csv_tokens(F.col("__line"))), lambda t: F.size(t) >= LEAST_FIELDS)
    lines = lines.select(*keep, F.explode(wide).alias("__tokens"))
    return lines.select(*keep, *typed_columns(F.col("__tokens")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file without its first, whatever that says. A line ends at \\n only.

    The first line is the first row of the file's first split; that row number is
    taken before anything is filtered.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    text = text.select("value", F.col("_metadata.file_block_start").alias("__at"), local.alias("__local"))
    return text.where("not (__at = 0 and __local = 0)").select("value")


def load_csv(spark: SparkSession, *paths: str, store: str) -> DataFrame:
    """Records of the files, appended in call order, with dense ``row_id``s.

    Each file's rows are written below ``store`` once and read from there. A
    missing file gives a message and no rows.
    """
    out, first = None, 0
    for i, path in enumerate(paths):
        try:
            records = with_dense_ids(parse_lines(_lines(spark, path)), "row_id", first, f"{store}/part={i}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            print(f"cannot open {path}", file=sys.stderr)
            continue
        records = records.select(*record_type().names)
        first += records.count()
        out = records if out is None else out.unionByName(records)
    return spark.createDataFrame([], record_type()) if out is None else out


def load_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(lines, parsed, skipped): lines that aren't empty, below the first."""
    lines = _lines(spark, path).select(F.rtrim("value", F.lit("\r")).alias("line")).where("line <> ''")
    fine = F.size(csv_tokens(F.col("line"))) >= LEAST_FIELDS
    out = lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(fine).alias("parsed"))
    return out.withColumn("skipped", F.col("lines") - F.col("parsed"))


def records_from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A store from values in memory; what a row doesn't name is zero or empty."""
    schema = record_type()
    zero = {f.name: "" if f.dataType.typeName() == "string" else 0 for f in schema.fields}
    from decimal import Decimal

    full = []
    for i, row in enumerate(rows):
        values = zero | {"row_id": i} | row
        values["summons_number"] = Decimal(values["summons_number"])
        full.append(tuple(values[f.name] for f in schema.fields))
    return spark.createDataFrame(full, schema)
