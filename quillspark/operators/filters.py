"""Predicates. Each is one plain comparison, so a Parquet scan gets it pushed down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unsigned(value: int, bits: int, what: str) -> int:
    if not 0 <= value < 2**bits:
        raise ValueError(f"{what} must be in 0..{2**bits - 1}")
    return value


def by_date_range(df: DataFrame, start: int, end: int, column: str = "issue_date") -> DataFrame:
    """start <= date <= end; dates of 0 are missing ones. An inverted range is empty."""
    return df.where(F.col(column).between(_unsigned(start, 32, "start"), _unsigned(end, 32, "end")))


def by_code(df: DataFrame, code: int, column: str = "violation_code") -> DataFrame:
    return df.where(F.col(column) == _unsigned(code, 16, "code"))


def by_plate(df: DataFrame, plate: str, column: str = "plate_id") -> DataFrame:
    """The exact text, byte for byte."""
    return df.where(F.col(column) == plate)


def by_state(df: DataFrame, code: int, column: str = "registration_state") -> DataFrame:
    """0 finds the unknown ones."""
    return df.where(F.col(column) == _unsigned(code, 8, "code"))


def by_county(df: DataFrame, code: int, column: str = "violation_county") -> DataFrame:
    return df.where(F.col(column) == _unsigned(code, 8, "code"))
