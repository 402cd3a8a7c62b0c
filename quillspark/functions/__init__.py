"""Scalar functions as Column expressions; ``register`` makes them SQL functions."""

from .codecs import (
    FUNCTIONS,
    enum_code,
    is_null_date,
    parse_date,
    register,
    text_field_name,
    to_char_field,
    to_u16,
    to_u32,
    to_u64,
    to_unsigned,
)
from .csv_tokens import csv_tokens

__all__ = [
    "FUNCTIONS", "csv_tokens", "enum_code", "is_null_date", "parse_date", "register", "text_field_name", "to_char_field",
    "to_u16", "to_u32", "to_u64", "to_unsigned",
]
