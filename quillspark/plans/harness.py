"""Statistics of measured values, and timing of queries into the noop sink."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stats_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, min, max, mean, median and sample deviation (0 of one value); zeros of none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), zero(F.min(value).cast("double")).alias("min"), zero(F.max(value).cast("double")).alias("max"),
        zero(F.avg(value)).alias("mean"), zero(F.median(value)).alias("median"), zero(F.stddev_samp(value)).alias("stddev"),
    )


@dataclass
class BenchmarkEntry:
    name: str
    engine: str
    mean: float
    stddev: float
    min: float
    max: float
    median: float
    runs: int
    scanned: int
    matched: int

    @property
    def throughput(self) -> float:
        """Records scanned a second, by the mean."""
        return self.scanned / (self.mean / 1000) if self.mean else 0.0

    def csv_row(self) -> str:
        return ",".join(map(str, [*asdict(self).values(), self.throughput]))

    @staticmethod
    def csv_header() -> str:
        return ",".join([*BenchmarkEntry.__dataclass_fields__, "throughput"])


def print_stats(entries: list[BenchmarkEntry], file: TextIO | None = None) -> None:
    """A line for each entry, aligned, under a header."""
    out = file or sys.stdout
    print(f"{'name':<28}{'engine':<12}{'mean ms':>12}{'stddev':>12}{'min':>12}{'max':>12}{'median':>12}{'runs':>6}{'scanned':>12}{'matched':>12}{'rows/s':>16}", file=out)
    for e in entries:
        numbers = "".join(f"{x:>12.3f}" for x in (e.mean, e.stddev, e.min, e.max, e.median))
        print(f"{e.name:<28}{e.engine:<12}{numbers}{e.runs:>6}{e.scanned:>12}{e.matched:>12}{e.throughput:>16.0f}", file=out)


def print_stats_csv(entries: list[BenchmarkEntry], file: TextIO | None = None) -> None:
    for line in (BenchmarkEntry.csv_header(), *(e.csv_row() for e in entries)):
        print(line, file=file or sys.stdout)


def peak_memory_mb(spark: SparkSession) -> dict[str, float]:
    """Peak memory of each JVM so far, by executor id: heap and beyond, as the
    executors last reported; for the driver, which also runs the tasks of a local
    session, the sum of its own memory pools' peaks."""
    jvm, out = spark._jvm, {}
    pools = jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    out["driver"] = sum(p.getPeakUsage().getUsed() for p in pools) / 1e6
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    for i in range(executors.size()):
        e = executors.apply(i)
        if e.id() != "driver" and e.peakMemoryMetrics().isDefined():
            m = e.peakMemoryMetrics().get()
            out[e.id()] = sum(m.getMetricValue(x) for x in ("JVMHeapMemory", "JVMOffHeapMemory")) / 1e6
    return out


def run_benchmark(run: Callable[[], DataFrame], iterations: int, warmup: int = 1) -> list[float]:
    """Milliseconds of each run after the warm-up."""
    out = []
    for i in range(warmup + iterations):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        if i >= warmup:
            out.append(1000 * (time.perf_counter() - start))
    return out


def entry_of(spark: SparkSession, name: str, engine: str, times: list[float], scanned: int, matched: int) -> BenchmarkEntry:
    row = stats_summary(spark.createDataFrame([(t,) for t in times], "t double"), "t").first()
    return BenchmarkEntry(name, engine, row["mean"], row["stddev"], row["min"], row["max"], row["median"], len(times), scanned, matched)
