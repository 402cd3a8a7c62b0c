"""Reading CSV and Parquet stores, and writing clustered layouts."""

from .layout import stored_bytes, write_clustered
from .records_csv import load_csv, load_statistics, parse_lines, records_from_rows

__all__ = ["load_csv", "load_statistics", "parse_lines", "records_from_rows", "stored_bytes", "write_clustered"]
