import random

from pyspark.sql import functions as F

from quillspark.functions import csv_tokens
from quillspark.schema import COLUMNS
from quillspark.sources import load_csv, load_statistics, parse_lines

FULL = (
    '"9139716661","LKS7820","NY","PAS","20240702","38","SUBN","TOYOT","T","26790","28590","12810","20260312","0005","005","005",'
    '"363518","T105","J","0209P","","MN","F","42A","Mott St","","","408","H1","","YYYYYY","0730A","1000P","WH","","2024","100038",'
    '"0","071","38-Failure to Dsplay Meter Rec","","","","2025"'
)


def model(line):
    """The dialect's rules, one letter at a time."""
    out, i, n = [], 0, len(line)
    ended_by_comma = False
    while i < n and len(out) < 48:
        ended_by_comma = False
        if line[i] == '"':
            i += 1
            start = i
            while i < n:
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        i += 2
                        continue
                    break
                i += 1
            out.append(line[start:min(i, n)])
            if i < n:
                i += 1
                if i < n and line[i] == ",":
                    i += 1
                    ended_by_comma = True
        else:
            end = line.find(",", i)
            out.append(line[i:] if end < 0 else line[i:end])
            i, ended_by_comma = (n, False) if end < 0 else (end + 1, True)
    return (out + [""] if ended_by_comma and i >= n else out)[:48]


def tokens(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, s string")
    return [r[1] for r in df.select("i", csv_tokens(F.col("s"))).orderBy("i").collect()]


def test_edges(spark):
    cases = {
        "": [], "a,": ["a", ""], ",": ["", ""], '"a",': ["a", ""], '"a"b,c': ["a", "b", "c"], '"a""b",c': ['a""b', "c"],
        '"open,x': ["open,x"], '"open,': ["open,"], 'a"b,c': ['a"b', "c"], ' "a",b': [' "a"', "b"], "," * 60: [""] * 48,
        '"A",,,"D"': ["A", "", "", "D"], '123,ABC,"hello, world",456': ["123", "ABC", "hello, world", "456"],
    }
    assert tokens(spark, list(cases)) == list(cases.values())


def test_random_lines(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice('ab ,,""') for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for line, got in zip(lines, tokens(spark, lines)):
        assert got == model(line), line


def test_typed_row(spark):
    r = parse_lines(spark.createDataFrame([(FULL,)], "value string")).first()
    assert (int(r.summons_number), r.plate_id, r.registration_state, r.plate_type, r.issue_date) == (9139716661, "LKS7820", 1, 1, 20240702)
    assert (r.issuing_agency, r.violation_county, r.violation_front_opposite, r.issuer_squad, r.street_name) == (2, 1, 1, 10, "Mott St")
    assert (r.violation_precinct, r.issuer_code, r.law_section, r.violation_legal_code, r.unregistered_vehicle) == (5, 363518, 408, 0, 0)
    assert (r.date_first_observed, r.violation_location, r.vehicle_year, r.fiscal_year) == (0, "0005", 2024, 2025)
    assert r.violation_description == "38-Failure to Dsplay Meter Rec" and r.violation_county_raw == "MN"


def line(n, fields=44):
    cells = [str(n), f"P{n}"] + [""] * (len(COLUMNS) - 3) + ["2024"]
    return ",".join((cells + ["x"] * 9)[:fields])


def test_files(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_bytes(("header\r\n" + line(1) + "\r\n\r\n\n" + line(2, 42) + "\n" + line(3, 43) + "\r\r\n" + line(4, 46) + "\n" + "x\ry").encode())
    b.write_bytes((line(9) + "\n" + line(5)).encode())  # its first line goes, whatever it says
    df = load_csv(spark, str(a), str(tmp_path / "none.csv"), str(b), store=str(tmp_path / "store"))
    got = [(r.row_id, int(r.summons_number), r.plate_id, r.fiscal_year) for r in df.orderBy("row_id").collect()]
    assert got == [(0, 1, "P1", 2024), (1, 3, "P3", 0), (2, 4, "P4", 2024), (3, 5, "P5", 2024)]
    assert tuple(load_statistics(spark, str(a)).first()) == (5, 3, 2)


def test_many_splits_keep_order(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("h\n" + "".join(line(i) + "\n" * (1 + i % 2) for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = load_csv(spark, str(path), store=str(tmp_path / "s")).select("row_id", "summons_number")
        assert all(r[0] == int(r[1]) for r in df.collect()) and df.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_files(spark, tmp_path):
    for name, text in (("empty", ""), ("header", "h\n")):
        (tmp_path / name).write_text(text)
        assert load_csv(spark, str(tmp_path / name), store=str(tmp_path / f"{name}-s")).count() == 0
    assert load_csv(spark, str(tmp_path / "none"), store=str(tmp_path / "none-s")).count() == 0


def test_stream(spark, tmp_path):
    from quillspark.streaming import record_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("h\n" + line(1) + "\n" + line(2, 10) + "\n")
    stream = record_stream(spark, str(tmp_path / "in"), header="h").select("plate_id", "fiscal_year")
    query = stream.writeStream.format("memory").queryName("records").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("records").collect()] == [("P1", 2024)]
