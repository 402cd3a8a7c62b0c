"""Text to value, with the record's rules: malformed and missing are zero, and
numbers wrap modulo their width. All are built-in expressions (ANSI-safe)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..schema import DICTIONARIES, NULL_DATES, TEXT_NAMES

_CHUNK = 16


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def to_unsigned(c: Column, bits: int) -> Column:
    """Digits only, of any length, modulo 2**bits (decimal(20,0)); else 0.

    10**k is a multiple of 2**k, so the last ``bits`` digits decide; they are
    taken sixteen at a time, which keeps every step within 38 digits.
    """
    c = _text(c)
    # numbers of up to 18 digits, which are nearly all, fit into a long
    short = F.pmod(c.try_cast("decimal(18,0)") if bits == 64 else c.try_cast("long"), F.lit(Decimal(2**bits)) if bits == 64 else F.lit(2**bits))
    digits = F.lpad(F.right(c, F.lit(bits)), bits, "0")
    value = F.lit(0).cast("decimal(38,0)")
    modulus, shift = F.lit(Decimal(2**bits)), F.lit(Decimal(10**_CHUNK))
    for at in range(0, bits, _CHUNK):
        chunk = F.substring(digits, at + 1, _CHUNK).try_cast("decimal(16,0)")
        value = F.pmod((value.cast("decimal(20,0)") * shift + chunk).cast("decimal(38,0)"), modulus)
    full = F.when(c.rlike(r"\A[0-9]+\z"), value).otherwise(F.lit(0)).cast("decimal(20,0)")
    return F.when(c.rlike(r"\A[0-9]{1,18}\z"), short.cast("decimal(20,0)")).otherwise(full)


def to_u64(c: Column) -> Column:
    return to_unsigned(c, 64)


def to_u32(c: Column) -> Column:
    return to_unsigned(c, 32).cast("long")


def to_u16(c: Column) -> Column:
    return to_unsigned(c, 16).cast("int")


def to_char_field(c: Column, size: int) -> Column:
    """At most size - 1 bytes of the text's UTF-8; a size of zero or less leaves
    nothing, and a letter that doesn't fit whole goes entirely."""
    raw, most = _text(c).cast("binary"), max(size - 1, 0)
    return F.coalesce(*(F.try_validate_utf8(F.substring(raw, 1, max(most - k, 0)).cast("string")) for k in range(4)))


def is_null_date(c: Column) -> Column:
    return _text(c).isin(*NULL_DATES)


def parse_date(c: Column) -> Column:
    """YYYYMMDD as a number, not checked against a calendar."""
    return F.when(is_null_date(c), F.lit(0).cast("long")).otherwise(to_u32(c))


def enum_code(c: Column, dictionary: str) -> Column:
    """The code's number, exact and case-sensitive; 0 where it is unknown."""
    codes = DICTIONARIES[dictionary].split()
    place = F.array_position(F.array(*map(F.lit, codes)), _text(c))
    return place.cast("short")


def text_field_name(index: Column) -> Column:
    names = F.array(*map(F.lit, TEXT_NAMES))
    known = (index >= 0) & (index < len(TEXT_NAMES))
    return F.when(known, F.get(names, index.cast("int"))).otherwise(F.lit("Unknown"))


#: Name to (argument types, expression of its arguments).
FUNCTIONS = {
    "to_u64": ("s string", to_u64), "to_u32": ("s string", to_u32), "to_u16": ("s string", to_u16), "is_null_date": ("s string", is_null_date),
    "parse_date": ("s string", parse_date), "text_field_name": ("i int", text_field_name),
} | {f"{d}_to_enum": ("s string", lambda c, d=d: enum_code(c, d)) for d in DICTIONARIES}


def register(spark: SparkSession) -> None:
    """Temporary SQL functions of the same names: the expressions themselves as
    their bodies, so no Python runs in a query."""
    for name, (argument, function) in FUNCTIONS.items():
        plan = spark.createDataFrame([], argument).select(function(F.col(argument.split()[0])).alias("out"))
        body = plan._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument}) RETURN {body}")
