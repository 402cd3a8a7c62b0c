"""Filters, aggregates, lookups and indexes over a record DataFrame."""

from .aggregates import (
    count_by_fiscal_year,
    count_by_precinct,
    count_in_date_range,
    date_extremes,
    filter_count,
    first_n_groups,
    record_count,
    text_pool_size,
    top_groups,
)
from .filters import by_code, by_county, by_date_range, by_plate, by_state
from .index import index_permutation, row_lookup, with_dense_ids

__all__ = [
    "by_code", "by_county", "by_date_range", "by_plate", "by_state", "count_by_fiscal_year", "count_by_precinct",
    "count_in_date_range", "date_extremes", "filter_count", "first_n_groups", "index_permutation", "record_count", "row_lookup",
    "text_pool_size", "top_groups", "with_dense_ids",
]
