import random

import pytest
from pyspark.sql import functions as F

from quillspark import functions as fn
from quillspark.schema import COLUMNS, DICTIONARIES, TEXT_NAMES, code_of


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def model(text, bits):
    return int(text) % 2**bits if text and text.isascii() and text.isdigit() else 0


def test_unsigned_numbers(spark):
    rng = random.Random(1)
    texts = ["", "0", "38", "70000", "-5", " 5", "005", "38.0", "18446744073709551617", "9139716661", "20240702", None, "7\n", "٣", "1" * 90]
    texts += ["".join(rng.choice("0123456789") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    got = values(spark, texts, fn.to_u64(F.col("s")), fn.to_u32(F.col("s")), fn.to_u16(F.col("s")))
    for text, (a, b, c) in zip(texts, got):
        assert (int(a), b, c) == tuple(model(text, n) for n in (64, 32, 16)), text


def test_dates(spark):
    got = values(spark, ["", "0", "00000000", "88888888", "20240702", "123", "12/31/2024", None], fn.is_null_date(F.col("s")), fn.parse_date(F.col("s")))
    assert got == [(True, 0), (True, 0), (True, 0), (True, 0), (False, 20240702), (False, 123), (False, 0), (True, 0)]


@pytest.mark.parametrize("dictionary", DICTIONARIES)
def test_codes(spark, dictionary):
    codes = DICTIONARIES[dictionary].split()
    assert len(set(codes)) == len(codes)
    texts = [*codes, "", "XXXX", codes[0] + " ", None]
    got = [r[0] for r in values(spark, texts, fn.enum_code(F.col("s"), dictionary))]
    assert got == [*range(1, len(codes) + 1), 0, 0, 0, 0]


def test_known_codes():
    assert [code_of("state", s) for s in ("NY", "NJ", "PA", "99", "QC", "XX")] == [1, 2, 3, 18, 65, 0]
    assert [code_of("squad", s) for s in ("J", "0000", "AA", "A2")] == [10, 26, 27, 41]
    assert [code_of("plate_type", s) for s in ("PAS", "COM", "AGC")] == [1, 2, 65]
    assert len(COLUMNS) == 44 and len(TEXT_NAMES) == sum(k == "text" for k in COLUMNS.values()) == 21


def test_char_field_and_names(spark):
    assert values(spark, ["aé中\U0001f600"], *(fn.to_char_field(F.col("s"), n) for n in (1, 2, 3, 4, 6, 7, 10, 11, 12))) == [
        ("", "a", "a", "aé", "aé", "aé中", "aé中", "aé中\U0001f600", "aé中\U0001f600")
    ]
    assert values(spark, ["TOYOT", "ABCDEF", ""], fn.to_char_field(F.col("s"), 6), fn.to_char_field(F.col("s"), 4), fn.to_char_field(F.col("s"), 0)) == [
        ("TOYOT", "TOY", ""), ("ABCDE", "ABC", ""), ("", "", "")]
    df = spark.createDataFrame([(i,) for i in (-1, 0, 20, 21)], "i int")
    assert [r[0] for r in df.select(fn.text_field_name(F.col("i"))).collect()] == ["Unknown", "Plate ID", "Double Parking Violation", "Unknown"]


def test_sql_functions(spark):
    fn.register(spark)
    row = spark.sql("select to_u16('70000') a, county_to_enum('QN') b, parse_date('0') c, to_u64('7') d").first()
    assert tuple(map(int, row)) == (4464, 3, 0, 7)
