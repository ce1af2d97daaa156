import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.functions import scalars as S


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).cast("string").alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


AMOUNTS = {
    "1180.00": 1180.0, "1,180.00": 1180.0, "$ 1180.00": 1180.0, "₹1,000.50": 1000.5, "12,20": 12.2, "€ 12,20": 12.2,
    "-99.99": -99.99, "0": 0.0, "": None, None: None, "N/A": None, "abc": None, ".": None, "-": None, "1.2.3": None,
    "1.234,56": 1234.56, "$ 1 180.00": 1180.0,
}


def test_amounts(spark):
    rows = spark.createDataFrame([(k,) for k in AMOUNTS], "v string").select(S.parse_amount("v").alias("x"))
    assert [r.x for r in rows.collect()] == list(AMOUNTS.values())


@pytest.mark.parametrize(
    ("text", "iso"),
    [(x, "2026-01-15") for x in ("2026-01-15", "15/01/2026", "15-01-2026", "15 Jan 2026", "15  January 2026")]
    + [(x, None) for x in ("", None, "garbage", "not-a-date", "32/01/2026", "2026/01/15")],
)
def test_index_dates(spark, text, iso):
    assert one(spark, S.index_date("v"), v=text) == iso


@pytest.mark.parametrize(
    ("text", "day"),
    [("15.03.2026", (2026, 3, 15)), ("2026/03/15", (2026, 3, 15)), ("15/03/26", (2026, 3, 15)), ("1/2/99", (1999, 2, 1)), ("31/02/2026", None), ("15 Mar 2026", None)],
)
def test_validation_dates(spark, text, day):
    assert one(spark, S.parse_date("v"), v=text) == (day and datetime.date(*day))


def test_texts(spark):
    assert one(spark, S.normalize_text("v"), v="  ACME   TRADERS  ") == "acme traders"
    assert one(spark, S.normalize_text("v"), v=None) == ""
    assert one(spark, S.title_case("v"), v="PART-B form 2ND") == "Part-B Form 2Nd"


@pytest.mark.parametrize(("a", "b", "rate"), [("test", "best", 0.25), ("", "test", 4.0), ("", "", 0.0), ("é", "e", 1.0)])
def test_cer(spark, a, b, rate):
    assert one(spark, S.cer("a", "b"), a=a, b=b) == rate


@pytest.mark.parametrize(("a", "b", "rate"), [("the quick brown fox", "the quick brown dog", 0.25), ("", "one two", 2.0), ("a b", " a  b ", 0.0)])
def test_wer(spark, a, b, rate):
    assert one(spark, S.wer("a", "b"), a=a, b=b) == rate


@pytest.mark.parametrize(
    ("name", "a", "b", "same"),
    [("total", "1,180.00", "$ 1180", True), ("date", "15/01/2026", "2026-01-15", True), ("vendor", "ACME  Traders", "acme traders", True), ("total", "n/a", "N/A ", True), ("total", "1", None, False), ("x", None, None, True)],
)
def test_fields_match(spark, name, a, b, same):
    assert one(spark, S.fields_match(F.lit(name), "a", "b"), a=a, b=b) == same
