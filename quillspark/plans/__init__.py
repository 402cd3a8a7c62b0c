"""The query facade and the measuring harness."""

from .engine import Engine, QueryResult
from .harness import BenchmarkEntry, run_benchmark, stats_summary, peak_memory_mb, print_stats, print_stats_csv

__all__ = ["peak_memory_mb", "print_stats", "print_stats_csv", "BenchmarkEntry", "Engine", "QueryResult", "run_benchmark", "stats_summary"]
