import datetime as dt

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statweave.functions import parse, text
from statweave.functions.periods import range_predicate
from statweave.operators import normalize
from statweave.sources import files


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.x for r in df.select("i", expression(F.col("s")).alias("x")).orderBy("i").collect()]


DATES = [
    "2020-01-01", "2020", "2020-02", "20200201", "2020-2-1", "2020/02/01", "2020-01-01T23:30:00-05:00",
    "2020-01-01T23:30:00-0500", "2020-01-01 10:15", "2020-02-30", "2020-13-01", "9999-01-01", "", "abc",
    "2020-01-01T00:00:00Z", "2020-01-01T23:30:00+05:00", "20200201T101112", "2020-02-01T23:30-05", "2020/2", "2020 2", "20200201T1011",
    "20200201 101112", "20200201T101112-0500", "20200201T101112.25+05", "2020-02-01T10:11Z", "2020-02-01T10:11 +05:00", "2020-W05", "202002",
    "2020-02-01T24:00", "2020-02-01T10:11+5",
]


def test_dates_follow_pandas(spark):
    expected = pd.to_datetime(pd.Series(DATES), errors="coerce", format="ISO8601", utc=True)
    got = column(spark, DATES, parse.iso_date)
    assert got == [None if pd.isna(x) else x.date() for x in expected]


def test_now_is_not_a_date(spark):
    assert column(spark, ["now", "today", "2020-01-01x"], parse.iso_date) == [None] * 3


NUMBERS = ["1", "-1.5", "+2", ".5", "5.", "1e3", "1E-3", "1d", "0x1p3", "inf", "nan", "", "bad", "1 2", "1_000", "1e400", "NA"]


def test_numbers(spark):
    expected = pd.to_numeric(pd.Series(NUMBERS), errors="coerce")
    wanted = [None if pd.isna(x) or abs(x) == float("inf") else float(x) for x in expected]
    assert column(spark, NUMBERS, parse.finite_number) == wanted


def test_strip_removes_what_python_removes(spark):
    cells = ["  a b\t", "\x1fa\x1c", "　x ", "\xa0\xa0", "plain", "a\nb\n", "", "abc\n", "abc\r\n", "d\n", "\nd", "a\nb"]
    assert column(spark, cells, parse.strip) == [c.strip() for c in cells]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n abcé\x1d", max_size=8), min_size=1, max_size=40))
def test_strip_random(spark, cells):
    assert column(spark, cells, parse.strip) == [c.strip() for c in cells]


def test_title_case_follows_python(spark):
    names = ["UPPER-DIR D.I. KHAN", "o'neil", "lower dir", "ABC2def", ""]
    assert column(spark, names, text.title_case) == [n.title() for n in names]


def test_dataset_and_titles(spark):
    names = ["raw/table_1_national.xlsx", "table_1_kp_districts.xlsx", "table_1_punjab_districts.xlsx", "table_1_islamabad.xlsx"]
    assert column(spark, names, text.census_dataset) == [
        "pbs_census_2023_national", "pbs_census_2023_kp", "pbs_census_2023_punjab_districts",
        "pbs_census_2023_islamabad_districts",
    ]
    assert column(spark, ["current_usd", "persons_per_sq_km"], text.unit_label) == ["Current US dollars", "persons per sq km"]
    assert column(spark, ["raw/a.b.csv", ".hidden", "x"], text.file_stem) == ["a.b", ".hidden", "x"]


def test_csv_line_quotes(spark):
    row = spark.range(1).select(text.csv_line(F.lit('A,"B'), F.lit(2), F.lit(None).cast("string")).alias("x")).first()
    assert row.x == '"A,""B","2",""'


PERIODS = [dt.date(2019, 12, 31), dt.date(2020, 1, 1), dt.date(2020, 2, 29), dt.date(2020, 12, 31), dt.date(2021, 1, 1)]


@pytest.mark.parametrize("start,end", [
    ("2020", "2020"), ("2020-02", "2020-02"), ("2020-13", None), (None, "2020-00"), (None, "2020-02-31"),
    ("2020-02-30", "2021"), ("2020-01-01", "2020-12-31"), (None, "2020-02-00"), ("2020-00", None),
])
def test_partial_bounds_match_text_comparison(spark, start, end):
    df = spark.createDataFrame([(p,) for p in PERIODS], "period date")
    got = {r.period for r in df.filter(range_predicate(F.col("period"), start, end)).collect()}
    high = end and {4: end + "-12-31", 7: end + "-31"}.get(len(end), end)
    wanted = {p for p in PERIODS if (not start or p.isoformat() >= start) and (not high or p.isoformat() <= high)}
    assert got == wanted


def test_range_shape_is_checked():
    with pytest.raises(ValueError):
        range_predicate(F.col, "2020'; DROP", None)


def test_unit_and_geography_normalisation(spark):
    df = spark.createDataFrame([(" KPK ", "2", "thousand persons")], "geography string, value string, unit string")
    aliases = spark.createDataFrame([("KPK", "Khyber Pakhtunkhwa")], "alias string, name string")
    row = normalize.normalized(df, aliases, {"thousand persons": ("persons", 1000)}).first()
    assert (row.geography, row.value, row.unit) == ("Khyber Pakhtunkhwa", 2000.0, "persons")


def test_unit_factors_are_checked_and_chain():
    with pytest.raises(ValueError):
        normalize.fold_units({"a": ("b", 0)})
    assert normalize.fold_units({"a": ("b", 10.0), "b": ("c", 2.0)}) == {"a": ("c", 20.0), "b": ("c", 2.0)}


def test_official_urls(spark):
    urls = [
        "https://pbs.gov.pk/a", "https://www.pbs.gov.pk", "https://pbs.gov.pk:443/x", "https://example.com/pbs.csv",
        "https://pbs.gov.pk.evil.example/source.csv", "http://pbs.gov.pk/", "https://u:p@pbs.gov.pk/", "https://pbs.gov.pk:8443/",
        "https://notpbs.gov.pk/", "HTTPS://PBS.GOV.PK/", None,
    ]
    got = column(spark, urls, lambda c: files.official_url(c, files.OFFICIAL_HOSTS["pbs"]))
    assert got == [True, True, True, False, False, False, False, False, False, True, False]
