"""Driver-facing queries of the record engine, over its stand-in tables.

There is no record file among the test tables, so each operator runs over columns
that stand for the record's: lineitem's ship date for the issue date, its line
number for the code, its supplier for the precinct, customer names for plates,
and so on (see README).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from . import operators as ops
from .plans.engine import Engine
from .plans.harness import stats_summary
from .schema import COLUMNS, DICTIONARIES
from .scratch import scratch_path
from .sources import load_csv, load_statistics, parse_lines, records_from_rows, write_clustered

JANUARY = (19950101, 19950131)
STATES = "A N"  # return flags that the stand-in dictionary knows; R is unknown
COUNTIES = "MACHINERY BUILDING AUTOMOBILE"
_LAYOUTS: dict[tuple[str, str, str], DataFrame] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _date_key(c: str) -> Column:
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def _code(c: str, codes: str) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, codes.split())), F.col(c)), F.lit(0)).cast("int")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", _date_key("l_shipdate").alias("issue_date"), F.col("l_linenumber").alias("violation_code"),
        F.col("l_suppkey").alias("violation_precinct"), F.year("l_shipdate").alias("fiscal_year"), _code("l_returnflag", STATES).alias("registration_state"),
    )


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("plate_id"), _code("c_mktsegment", COUNTIES).alias("violation_county")
    )


def _in_january(df: DataFrame) -> DataFrame:
    """The date key is computed here, so the stored column's own bounds are added:
    these reach the scan (a real store keeps the key itself)."""
    stored = F.col("l_shipdate")
    bounds = (stored >= F.lit("1995-01-01").cast("timestamp_ntz")) & (stored < F.lit("1995-02-01").cast("timestamp_ntz"))
    return ops.by_date_range(df.where(bounds), *JANUARY)


def _clustered(spark: SparkSession, sf_dir: str, name: str, df: DataFrame, key: str) -> DataFrame:
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _LAYOUTS:
        _LAYOUTS[at] = write_clustered(df, scratch_path(spark, f"by-{name}"), key)
    return _LAYOUTS[at]


def record_count(spark, sf_dir):
    return ops.record_count(_lineitem(spark, sf_dir))


def filter_date_range(spark, sf_dir):
    return _in_january(_lineitem(spark, sf_dir)).select("l_orderkey", "l_linenumber", "issue_date")


def filter_violation_code(spark, sf_dir):
    return ops.by_code(_lineitem(spark, sf_dir), 3).select("l_orderkey", "l_linenumber")


def filter_plate(spark, sf_dir):
    return ops.by_plate(_customer(spark, sf_dir), "Customer#000000042").select("c_custkey", "plate_id")


def filter_state(spark, sf_dir):
    return ops.by_state(_lineitem(spark, sf_dir), 1).select("l_orderkey", "l_linenumber", "registration_state")


def filter_county(spark, sf_dir):
    return ops.by_county(_customer(spark, sf_dir), 2).select("c_custkey", "violation_county")


def filter_unknown_county(spark, sf_dir):
    return ops.by_county(_customer(spark, sf_dir), 0).select("c_custkey", "violation_county")


def filter_inverted_range(spark, sf_dir):
    return ops.by_date_range(_lineitem(spark, sf_dir), 19950131, 19950101).select("l_orderkey", "issue_date")


def filter_count(spark, sf_dir):
    return ops.filter_count(ops.by_code(_lineitem(spark, sf_dir), 3))


def agg_count_by_precinct(spark, sf_dir):
    return ops.count_by_precinct(_lineitem(spark, sf_dir))


def agg_count_by_precinct_all(spark, sf_dir):
    return ops.count_by_precinct(_lineitem(spark, sf_dir), max_key=None)


def agg_count_by_fiscal_year(spark, sf_dir):
    return ops.count_by_fiscal_year(_lineitem(spark, sf_dir))


def agg_count_by_fiscal_year_bounded(spark, sf_dir):
    return ops.count_by_fiscal_year(_lineitem(spark, sf_dir), bounded=True)


def count_in_date_range(spark, sf_dir):
    return ops.count_in_date_range(_in_january(_lineitem(spark, sf_dir)), *JANUARY)


def date_extremes(spark, sf_dir):
    return ops.date_extremes(_lineitem(spark, sf_dir))


def date_extremes_empty(spark, sf_dir):
    return ops.date_extremes(_lineitem(spark, sf_dir).where(F.lit(False)))


def first_n_groups(spark, sf_dir):
    return ops.first_n_groups(ops.count_by_precinct(_lineitem(spark, sf_dir)))


def top_groups(spark, sf_dir):
    return ops.top_groups(ops.count_by_precinct(_lineitem(spark, sf_dir)))


def row_lookup(spark, sf_dir):
    return ops.row_lookup(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), 77, "event_id")


def append_load(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return orders.unionByName(orders)


def indexed_filter_date(spark, sf_dir):
    store = _clustered(spark, sf_dir, "date", _lineitem(spark, sf_dir), "issue_date")
    return ops.by_date_range(store, *JANUARY).select("l_orderkey", "l_linenumber", "issue_date")


def indexed_filter_code(spark, sf_dir):
    store = _clustered(spark, sf_dir, "code", _lineitem(spark, sf_dir), "violation_code")
    return ops.by_code(store, 3).select("l_orderkey", "l_linenumber")


def indexed_filter_state(spark, sf_dir):
    store = _clustered(spark, sf_dir, "state", _lineitem(spark, sf_dir), "registration_state")
    return ops.by_state(store, 1).select("l_orderkey", "l_linenumber", "registration_state")


def indexed_filter_county(spark, sf_dir):
    store = _clustered(spark, sf_dir, "county", _customer(spark, sf_dir), "violation_county")
    return ops.by_county(store, 2).select("c_custkey", "violation_county")


def index_build(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(_date_key("o_orderdate").alias("issue_date"), F.col("o_orderkey").alias("row_id"))
    return ops.index_permutation(orders, "issue_date")


def text_pool_size(spark, sf_dir):
    return ops.text_pool_size(_table(spark, sf_dir, "customer")).select("size")


def stats_of_events(spark, sf_dir):
    out = stats_summary(_table(spark, sf_dir, "events"), "value", "event_type")
    return out.select("event_type", "n", "min", "max", "median", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


# --- scalar functions, over texts made from keys ---


def _keys(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"))


def _number_text(k: Column) -> Column:
    """Some plain, some far too long, some malformed, some empty."""
    key = k.cast("long")
    return (
        F.when(key % 7 == 0, F.concat(F.lit("184467440737095516"), k))
        .when(key % 7 == 1, F.concat(F.lit("-"), k))
        .when(key % 7 == 2, F.lit(""))
        .when(key % 7 == 3, F.concat(F.lit("00"), k))
        .otherwise(k)
    )


def to_u64(spark, sf_dir):
    return _keys(spark, sf_dir).select("o_orderkey", fn.to_u64(_number_text(F.col("k"))).cast("string").alias("value"))


def to_u32(spark, sf_dir):
    return _keys(spark, sf_dir).select("o_orderkey", fn.to_u32(_number_text(F.col("k"))).alias("value"))


def to_u16(spark, sf_dir):
    return _keys(spark, sf_dir).select("o_orderkey", fn.to_u16(_number_text(F.col("k"))).alias("value"))


def to_char_field(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", fn.to_char_field(F.col("c_name"), 12).alias("value"))


def _date_text() -> Column:
    key = F.col("o_orderkey")
    return (
        F.when(key % 5 == 0, F.lit("0")).when(key % 5 == 1, F.lit("88888888")).when(key % 5 == 2, F.lit("")).when(key % 5 == 3, F.lit("12/31/2024"))
        .otherwise(F.lpad(F.col("k"), 8, "2"))
    )


def is_null_date(spark, sf_dir):
    return _keys(spark, sf_dir).select("o_orderkey", fn.is_null_date(_date_text()).alias("value"))


def parse_date(spark, sf_dir):
    return _keys(spark, sf_dir).select("o_orderkey", fn.parse_date(_date_text()).alias("value"))


def _enum(dictionary: str):
    def query(spark, sf_dir):
        codes = DICTIONARIES[dictionary].split()
        texts = F.array(*map(F.lit, [*codes, "", "zz", codes[0].lower() + " "]))
        text = F.get(texts, (F.col("o_orderkey") % (len(codes) + 3)).cast("int"))
        return _keys(spark, sf_dir).select("o_orderkey", fn.enum_code(text, dictionary).cast("int").alias("code"))

    return query


def text_field_name(spark, sf_dir):
    return _keys(spark, sf_dir).select("o_orderkey", fn.text_field_name((F.col("o_orderkey") % 24 - 1).cast("int")).alias("name"))


# --- the CSV dialect ---


def csv_tokenize(spark, sf_dir):
    """Names and numbers joined into lines of this dialect, taken apart again."""
    c = _table(spark, sf_dir, "customer")
    line = F.concat(F.lit('"'), "c_name", F.lit('",'), F.col("c_custkey").cast("string"), F.lit(',,"a,""b"'), "c_mktsegment", F.lit(","))
    t = fn.csv_tokens(line)
    return c.select(
        "c_custkey", F.size(t).alias("n"), t[0].alias("f0"), t[1].alias("f1"), t[2].alias("f2"), t[3].alias("f3"), t[4].alias("f4"), t[5].alias("f5")
    )


def _record_lines(spark, sf_dir, fields: int = 44) -> DataFrame:
    """Orders as lines of the record's CSV form."""
    made = {
        "summons_number": F.col("o_orderkey").cast("string"), "plate_id": F.col("o_orderpriority"), "issue_date": _date_key("o_orderdate").cast("string"),
        "violation_code": (F.col("o_orderkey") % 99).cast("string"), "violation_precinct": (F.col("o_custkey") + 65536).cast("string"),
        "registration_state": F.lit("NJ"), "violation_county": F.when(F.col("o_orderkey") % 2 == 0, "BK").otherwise("??"),
        "street_name": F.lit("5, Main"), "fiscal_year": F.year("o_orderdate").cast("string"),
    }
    cells = [F.concat(F.lit('"'), made.get(c, F.lit("")), F.lit('"')) for c in COLUMNS][:fields]
    orders = _table(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism)  # as a text file of that size would be split
    return orders.select("o_orderkey", F.concat_ws(",", *cells).alias("value"))


_SHOWN = ("summons_number", "plate_id", "issue_date", "violation_code", "violation_precinct", "registration_state", "violation_county", "street_name", "fiscal_year")


def _shown(df: DataFrame) -> DataFrame:
    casts = {"summons_number": "long", "registration_state": "int", "violation_county": "int"}
    return df.select(*(F.col(c).cast(casts[c]).alias(c) if c in casts else c for c in _SHOWN))


def csv_roundtrip(spark, sf_dir):
    return _shown(parse_lines(_record_lines(spark, sf_dir)))


def csv_reject_short_rows(spark, sf_dir):
    """42 fields go, 43 stay with a fiscal year of zero, 46 stay."""
    lines = _record_lines(spark, sf_dir)
    kind = F.col("o_orderkey") % 3
    short = lambda n: F.array_join(F.slice(F.split("value", ",(?=\")"), 1, n), ",")
    value = F.when(kind == 0, short(42)).when(kind == 1, short(43)).otherwise(F.concat("value", F.lit(',"x","y"')))
    return _shown(parse_lines(lines.withColumn("value", value)))


def csv_file_load(spark, sf_dir):
    """The lines written as CRLF files with a header, loaded from two of them."""
    path = _line_file(spark, sf_dir)
    records = load_csv(spark, path, path, store=scratch_path(spark, "store"))
    return _shown(records.where("row_id >= 0"))


def _line_file(spark, sf_dir, broken: bool = False) -> str:
    """The lines as a CRLF file with a header; with ``broken``, each third one is short."""
    path = scratch_path(spark, "csv")
    value = F.when(F.lit(broken) & (F.col("o_orderkey") % 3 == 0), F.concat(F.lit("short,"), F.col("o_orderkey").cast("string"))).otherwise(F.col("value"))
    lines = _record_lines(spark, sf_dir).select(F.concat(value, F.lit("\r")).alias("value"))
    header = spark.createDataFrame([("header\r",)], "value string")
    header.coalesce(1).unionByName(lines.coalesce(1)).coalesce(1).write.text(path)
    return path


def load_statistics_of_file(spark, sf_dir):
    return load_statistics(spark, _line_file(spark, sf_dir, broken=True))


def engine_append_load(spark, sf_dir):
    """The public load, twice: the second one appends and row ids go on."""
    path, engine = _line_file(spark, sf_dir), Engine(spark)
    loaded = [engine.load(path), engine.load(path)]
    ids = engine.store.agg(F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"), F.count_distinct("row_id").alias("ids"))
    return ids.select(*(F.lit(n).cast("long").alias(c) for c, n in zip(("first_load", "second_load"), loaded)), *ids.columns)


def missing_file_load(spark, sf_dir):
    engine = Engine(spark)
    n = engine.load(scratch_path(spark, "no-such-file"))
    return spark.range(1).select(F.lit(n).cast("long").alias("loaded"), F.lit(engine.record_count()).cast("long").alias("records"))


def insert_rows(spark, sf_dir):
    """A store from values in memory; what a row doesn't name is zero or empty."""
    rows = [{"summons_number": 2**63 + 1, "plate_id": "ABC"}, {"summons_number": 2, "issue_date": 20240229, "violation_code": 21}]
    records = records_from_rows(spark, rows)
    return records.select("row_id", F.col("summons_number").cast("string").alias("summons_number"), "plate_id", "issue_date", "violation_code")


def engine_selection(spark, sf_dir):
    """The same searches by either engine; the clustered one has copies that take room."""
    path, out = _line_file(spark, sf_dir), []
    for indexed in (False, True):
        engine = Engine(spark, indexed=indexed)
        engine.load(path)
        found = [engine.find_by_violation_code(3).count(), engine.find_by_county(2).count(), engine.find_by_plate("1-URGENT").count()]
        out.append((engine.engine_name, *found, engine.index_bytes() > 0))
    return spark.createDataFrame(out, "engine string, code long, county long, plate long, has_copies boolean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        record_count, filter_date_range, filter_violation_code, filter_plate, filter_state, filter_county, filter_unknown_county,
        filter_inverted_range, filter_count, agg_count_by_precinct, agg_count_by_precinct_all, agg_count_by_fiscal_year,
        agg_count_by_fiscal_year_bounded, count_in_date_range, date_extremes, date_extremes_empty, first_n_groups, top_groups, row_lookup,
        append_load, indexed_filter_date, indexed_filter_code, indexed_filter_state, indexed_filter_county, index_build, text_pool_size,
        to_u64, to_u32, to_u16, to_char_field, is_null_date, parse_date, text_field_name, csv_tokenize, csv_roundtrip,
        csv_reject_short_rows, csv_file_load, engine_append_load, missing_file_load, insert_rows, engine_selection,
    )
} | {"stats_summary": stats_of_events, "load_statistics": load_statistics_of_file} | {f"enum_{d}": _enum(d) for d in DICTIONARIES}
