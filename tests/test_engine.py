import pytest
from pyspark.sql import functions as F

from quillspark import operators as ops
from quillspark.plans import Engine, run_benchmark, stats_summary
from quillspark.plans.harness import entry_of
from quillspark.sources import records_from_rows


def hundred(spark):
    return records_from_rows(spark, [
        {
            "row_id": i, "summons_number": 9000000000 + i, "issue_date": 20240101 + i % 28, "violation_code": 46 if i % 10 == 0 else 21,
            "registration_state": 1 if i < 70 else 2, "violation_county": i % 5 + 1, "violation_precinct": i % 3 + 1,
            "fiscal_year": 2024 if i < 50 else 2025, "plate_id": "TEST001" if i < 5 else f"PLT{i:05d}",
        } for i in range(100)
    ])


@pytest.fixture(scope="module", params=[False, True])
def engine(request, spark):
    e = Engine(spark, indexed=request.param)
    e.add(hundred(spark).cache())
    return e


def ids(result):
    return [r.row_id for r in result.rows()]


def test_filters(engine):
    rows = range(100)
    assert ids(engine.find_by_date_range(20240101, 20240107)) == [i for i in rows if i % 28 < 7]
    assert engine.find_by_date_range(20240101, 20240107).count() == 28
    assert engine.find_by_date_range(20240101, 20240114).count() == 56
    assert [engine.find_by_violation_code(c).count() for c in (46, 21, 99)] == [10, 90, 0]
    assert ids(engine.find_by_plate("TEST001")) == [0, 1, 2, 3, 4] and ids(engine.find_by_plate("test001")) == []
    assert [engine.find_by_state(c).count() for c in (1, 2, 0)] == [70, 30, 0]
    assert ids(engine.find_by_county(2)) == [i for i in rows if i % 5 == 1]
    assert engine.find_by_date_range(20240107, 20240101).count() == 0
    assert engine.find_by_plate("x").total_scanned == 100


def test_aggregates(engine):
    assert [tuple(r) for r in engine.count_by_precinct().rows()] == [(1, 34), (2, 33), (3, 33)]
    assert [tuple(r) for r in engine.count_by_fiscal_year().rows()] == [(2024, 50), (2025, 50)]
    assert engine.count_in_date_range(20240101, 20240107).rows()[0][0] == 28
    assert tuple(engine.find_date_extremes().rows()[0]) == (20240101, 20240128)
    assert engine.record(7).plate_id == "PLT00007" and engine.record_count() == 100


def test_arguments(spark, engine):
    for call in (lambda: engine.find_by_state(256), lambda: engine.find_by_violation_code(-1), lambda: engine.find_by_date_range(0, 2**32)):
        with pytest.raises(ValueError):
            call()


def test_bounds_and_nulls(spark):
    df = records_from_rows(spark, [{"violation_precinct": p, "fiscal_year": y, "issue_date": d} for p, y, d in ((0, 0, 0), (199, 1999, 5), (200, 2000, 9), (65535, 2050, 7))])
    assert sorted(tuple(r) for r in ops.count_by_precinct(df).collect()) == [(0, 1), (199, 1)]
    assert ops.count_by_precinct(df, max_key=None).count() == 4
    assert sorted(tuple(r) for r in ops.count_by_fiscal_year(df, bounded=True).collect()) == [(2000, 1)]
    assert ops.count_by_fiscal_year(df).count() == 4
    assert tuple(ops.date_extremes(df).first()) == (0, 9) and tuple(ops.date_extremes(df, ignore_null_dates=True).first()) == (5, 9)
    assert tuple(ops.date_extremes(df.limit(0)).first()) == (4294967295, 0)
    assert ops.by_date_range(df, 0, 5).count() == 2 and ops.by_state(df, 0).count() == 4
    groups = ops.count_by_precinct(df.unionByName(df.where("violation_precinct = 199")))
    assert [r.key for r in ops.first_n_groups(groups, 1).collect()] == [0] and [r.key for r in ops.top_groups(groups, 1).collect()] == [199]


def test_index_permutation(spark):
    df = hundred(spark).repartition(5)
    got = [r.row_id for r in ops.index_permutation(df, "issue_date").orderBy("position").collect()]
    assert got == sorted(range(100), key=lambda i: (i % 28, i))


def test_numbering_broadcasts_offsets_alone(spark):
    """Not the rows, however narrow the part of them that is read: they are as many as the records."""
    ids = ops.with_dense_ids(hundred(spark).repartition(3), "n").agg(F.count_distinct("n"), F.max("n"))
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert tuple(ids.first()) == (100, 99)


def test_append(spark):
    e = Engine(spark)
    e.add(hundred(spark))
    e.add(hundred(spark).withColumn("row_id", F.col("row_id") + 100))
    assert e.record_count() == 200 and e.find_by_plate("TEST001").count() == 10


def test_pushdown(spark, tmp_path):
    hundred(spark).write.parquet(str(tmp_path / "p"))
    plan = ops.by_date_range(spark.read.parquet(str(tmp_path / "p")), 1, 2).select("row_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(issue_date" in plan and "ReadSchema: struct<row_id:bigint,issue_date:bigint>" in plan


@pytest.mark.parametrize("xs, want", [([], (0, 0, 0, 0, 0, 0)), ([5.0], (1, 5, 5, 5, 5, 0)), ([1.0, 2.0, 3.0, 4.0], (4, 1, 4, 2.5, 2.5, 1.290994))])
def test_stats(spark, xs, want):
    row = stats_summary(spark.createDataFrame([(x,) for x in xs], "v double"), "v").first()
    assert tuple(round(x, 6) for x in row) == want


def test_benchmark(spark):
    times = run_benchmark(lambda: spark.range(10), 2)
    e = entry_of(spark, "range", "scan", times, 10, 10)
    assert e.runs == 2 and e.throughput > 0 and e.csv_row().count(",") == e.csv_header().count(",")
