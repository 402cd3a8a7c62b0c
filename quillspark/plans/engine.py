"""One store of records behind the whole query surface."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .. import operators as ops
from ..scratch import scratch_path
from ..sources import load_csv, stored_bytes, write_clustered


@dataclass
class QueryResult:
    """A lazy result, and what running it showed."""

    df: DataFrame
    total_scanned: int
    elapsed_ms: float = field(default=0.0)

    def count(self) -> int:
        start = time.perf_counter()
        n = self.df.count()
        self.elapsed_ms = 1000 * (time.perf_counter() - start)
        return n

    def rows(self) -> list:
        """Collected, by row id or key: for results of a size that the caller knows."""
        start = time.perf_counter()
        keys = [c for c in ("row_id", "key") if c in self.df.columns]
        out = (self.df.orderBy(*keys) if keys else self.df).collect()
        self.elapsed_ms = 1000 * (time.perf_counter() - start)
        return out


class Engine:
    """``indexed`` keeps one clustered copy per searched column (date, code, state,
    county) and sends each filter to its own; results are the same."""

    INDEXED = {"date": "issue_date", "code": "violation_code", "state": "registration_state", "county": "violation_county"}

    def __init__(self, spark: SparkSession, indexed: bool = False, bounded_years: bool = False, max_precinct: int | None = 200):
        self.spark, self.indexed, self.bounded_years, self.max_precinct = spark, indexed, bounded_years, max_precinct
        self.store: DataFrame | None = None
        self.layouts: dict[str, DataFrame] = {}
        self.layout_paths: list[str] = []
        self.build_time_ms = 0.0
        self._size: int | None = None

    @property
    def engine_name(self) -> str:
        return "clustered" if self.indexed else "scan"

    def load(self, *paths: str) -> int:
        """Appends the records of CSV files; returns how many these were."""
        before = self.record_count() if self.store is not None else 0
        records = load_csv(self.spark, *paths, store=scratch_path(self.spark, "store"))
        if before:
            records = records.withColumn("row_id", records["row_id"] + before)
        self.add(records)
        return self.record_count() - before

    def add(self, records: DataFrame) -> None:
        self.store = records if self.store is None else self.store.unionByName(records)
        self._size = None
        if self.indexed:
            self._index(records)

    def build(self) -> None:
        """Writes all clustered copies anew, each as one sorted whole."""
        self.layouts, self.layout_paths, self.build_time_ms = {}, [], 0.0
        if self.store is not None:
            self._index(self.store)

    def _index(self, records: DataFrame) -> None:
        """Clustered copies of new records stand beside the older ones; these stay as they are."""
        start = time.perf_counter()
        for name, column in self.INDEXED.items():
            path = scratch_path(self.spark, f"by-{name}")
            layout = write_clustered(records, path, column, bloom=("plate_id",))
            self.layouts[name] = self.layouts[name].unionByName(layout) if name in self.layouts else layout
            self.layout_paths.append(path)
        self.build_time_ms += 1000 * (time.perf_counter() - start)

    def index_bytes(self) -> int:
        """What the clustered copies take on disk."""
        return sum(stored_bytes(self.spark, path) for path in self.layout_paths)

    def record_count(self) -> int:
        if self._size is None:
            self._size = 0 if self.store is None else self.store.count()
        return self._size

    def _result(self, df: DataFrame) -> QueryResult:
        return QueryResult(df, self.record_count())

    def _for(self, name: str) -> DataFrame:
        return self.layouts.get(name, self.store)

    def find_by_date_range(self, start: int, end: int) -> QueryResult:
        return self._result(ops.by_date_range(self._for("date"), start, end))

    def find_by_violation_code(self, code: int) -> QueryResult:
        return self._result(ops.by_code(self._for("code"), code))

    def find_by_plate(self, plate: str) -> QueryResult:
        return self._result(ops.by_plate(self._for("date"), plate))  # clustered copies have Bloom filters for plates

    def find_by_state(self, code: int) -> QueryResult:
        return self._result(ops.by_state(self._for("state"), code))

    def find_by_county(self, code: int) -> QueryResult:
        return self._result(ops.by_county(self._for("county"), code))

    def count_by_precinct(self) -> QueryResult:
        return self._result(ops.count_by_precinct(self.store, self.max_precinct))

    def count_by_fiscal_year(self) -> QueryResult:
        return self._result(ops.count_by_fiscal_year(self.store, self.bounded_years))

    def count_in_date_range(self, start: int, end: int) -> QueryResult:
        return self._result(ops.count_in_date_range(self._for("date"), start, end))

    def find_date_extremes(self) -> QueryResult:
        return self._result(ops.date_extremes(self.store))

    def record(self, index: int):
        return ops.row_lookup(self.store, index).first()
