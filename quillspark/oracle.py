"""DuckDB SQL for the queries of the record engine."""

from __future__ import annotations

from .schema import DICTIONARIES, TEXT_NAMES

_K = "cast(strftime({0}, '%Y%m%d') as integer)"
_SHIP = _K.format("l_shipdate")
_STATE = "case l_returnflag when 'A' then 1 when 'N' then 2 else 0 end"
_COUNTY = "case c_mktsegment when 'MACHINERY' then 1 when 'BUILDING' then 2 when 'AUTOMOBILE' then 3 else 0 end"
_NUMBER = """case o_orderkey % 7 when 0 then '184467440737095516' || o_orderkey when 1 then '-' || o_orderkey when 2 then ''
    when 3 then '00' || o_orderkey else cast(o_orderkey as varchar) end"""
_DATE = """case o_orderkey % 5 when 0 then '0' when 1 then '88888888' when 2 then '' when 3 then '12/31/2024'
    else left(lpad(cast(o_orderkey as varchar), 8, '2'), 8) end"""


def _unsigned(bits: int) -> str:
    return f"select o_orderkey, case when t ~ '^[0-9]+$' then cast(cast(t as hugeint) % {2**bits} as {{0}}) else cast(0 as {{0}}) end as value from (select o_orderkey, {_NUMBER} as t from orders)"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _enum(dictionary: str) -> str:
    codes = DICTIONARIES[dictionary].split()
    texts = _list([*codes, "", "zz", codes[0].lower() + " "])
    return f"""select o_orderkey, cast(coalesce(list_position({_list(codes)}, {texts}[o_orderkey % {len(codes) + 3} + 1]), 0) as integer) as code
        from orders"""


_DIRECT = f"""select o_orderkey as summons_number, o_orderpriority as plate_id, cast({_K.format("o_orderdate")} as bigint) as issue_date,
    cast(o_orderkey % 99 as integer) as violation_code, cast(o_custkey % 65536 as integer) as violation_precinct,
    2 as registration_state, case when o_orderkey % 2 = 0 then 2 else 0 end as violation_county, '5, Main' as street_name,
    cast(year(o_orderdate) as integer) as fiscal_year from orders"""

_JANUARY = f"select l_orderkey, l_linenumber, {_SHIP} as issue_date from lineitem where {_SHIP} between 19950101 and 19950131"
_CODE = "select l_orderkey, l_linenumber from lineitem where l_linenumber = 3"
_IN_STATE = "select l_orderkey, l_linenumber, 1 as registration_state from lineitem where l_returnflag = 'A'"
_IN_COUNTY = "select c_custkey, 2 as violation_county from customer where c_mktsegment = 'BUILDING'"
_BY_PRECINCT = "select l_suppkey as key, count(*) as count from lineitem where l_suppkey < 200 group by 1"
_BY_YEAR = "select cast(year(l_shipdate) as integer) as key, count(*) as count from lineitem {0} group by 1"

ORACLE = {
    "record_count": "select count(*) as count from lineitem",
    "filter_date_range": _JANUARY,
    "filter_violation_code": _CODE,
    "filter_plate": "select c_custkey, c_name as plate_id from customer where c_name = 'Customer#000000042'",
    "filter_state": _IN_STATE,
    "filter_county": _IN_COUNTY,
    "filter_unknown_county": f"select c_custkey, 0 as violation_county from customer where {_COUNTY} = 0",
    "filter_inverted_range": f"select l_orderkey, {_SHIP} as issue_date from lineitem where false",
    "filter_count": "select count(*) as count from lineitem where l_linenumber = 3",
    "agg_count_by_precinct": _BY_PRECINCT,
    "agg_count_by_precinct_all": "select l_suppkey as key, count(*) as count from lineitem group by 1",
    "agg_count_by_fiscal_year": _BY_YEAR.format(""),
    "agg_count_by_fiscal_year_bounded": _BY_YEAR.format("where year(l_shipdate) >= 2000 and year(l_shipdate) < 2050"),
    "count_in_date_range": f"select count(*) filter (where {_SHIP} between 19950101 and 19950131) as count from lineitem",
    "date_extremes": f"select cast(min({_SHIP}) as bigint) as min_date, cast(max({_SHIP}) as bigint) as max_date from lineitem",
    "date_extremes_empty": "select cast(4294967295 as bigint) as min_date, cast(0 as bigint) as max_date",
    "first_n_groups": f"{_BY_PRECINCT} order by key limit 5",
    "top_groups": f"{_BY_PRECINCT} order by count desc, key limit 5",
    "row_lookup": "select event_id, user_id, event_type from events where event_id = 77",
    "append_load": "select o_orderkey, o_orderstatus from orders union all select o_orderkey, o_orderstatus from orders",
    "indexed_filter_date": _JANUARY,
    "indexed_filter_code": _CODE,
    "indexed_filter_state": _IN_STATE,
    "indexed_filter_county": _IN_COUNTY,
    "index_build": f"""select row_number() over (order by {_K.format("o_orderdate")}, o_orderkey) - 1 as position, o_orderkey as row_id from orders""",
    "text_pool_size": "select cast(sum(strlen(c_name) + strlen(c_mktsegment)) as bigint) as size from customer",
    "stats_summary": """select event_type, count(value) as n, min(value) as min, max(value) as max, median(value) as median,
        round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as stddev from events group by 1""",
    "to_u64": _unsigned(64).format("varchar"),
    "to_u32": _unsigned(32).format("bigint"),
    "to_u16": _unsigned(16).format("integer"),
    "to_char_field": "select c_custkey, left(c_name, 11) as value from customer",
    "is_null_date": f"select o_orderkey, {_DATE} in ('', '0', '00000000', '88888888') as value from orders",
    "parse_date": f"""select o_orderkey, case when t in ('', '0', '00000000', '88888888', '12/31/2024') then 0
        else cast(t as bigint) end as value from (select o_orderkey, {_DATE} as t from orders)""",
    "text_field_name": f"""select o_orderkey, coalesce({_list(TEXT_NAMES)}[case when o_orderkey % 24 between 1 and 21
        then o_orderkey % 24 end], 'Unknown') as name from orders""",
    "csv_tokenize": """select c_custkey, 6 as n, c_name as f0, cast(c_custkey as varchar) as f1, '' as f2, 'a,""b' as f3,
        c_mktsegment as f4, '' as f5 from customer""",
    "csv_roundtrip": _DIRECT,
    "csv_reject_short_rows": f"""select * replace (case when summons_number % 3 = 1 then 0 else fiscal_year end as fiscal_year)
        from ({_DIRECT}) where summons_number % 3 <> 0""",
    "load_statistics": """select count(*) as lines, count(*) filter (where o_orderkey % 3 <> 0) as parsed,
        count(*) filter (where o_orderkey % 3 = 0) as skipped from orders""",
    "engine_append_load": """select count(*) as first_load, count(*) as second_load, cast(0 as bigint) as first_id,
        2 * count(*) - 1 as last_id, 2 * count(*) as ids from orders""",
    "missing_file_load": "select cast(0 as bigint) as loaded, cast(0 as bigint) as records",
    "insert_rows": """select * from (values (cast(0 as bigint), '9223372036854775809', 'ABC', cast(0 as bigint), cast(0 as integer)),
        (1, '2', '', 20240229, 21)) t(row_id, summons_number, plate_id, issue_date, violation_code)""",
    "engine_selection": """select engine, count(*) filter (where o_orderkey % 99 = 3) as code, count(*) filter (where o_orderkey % 2 = 0) as county,
        count(*) filter (where o_orderpriority = '1-URGENT') as plate, engine = 'clustered' as has_copies
        from orders, (values ('scan'), ('clustered')) t(engine) group by engine""",
    "csv_file_load": f"{_DIRECT} union all {_DIRECT}",
} | {f"enum_{d}": _enum(d) for d in DICTIONARIES}
