"""Coercion, keys and the calendar."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from shelfmart.functions import coerce, keys
from shelfmart.functions.calendar import calendar, month_bounds
from tests.conftest import rows


def test_website_money_counts_missing_as_zero(spark):
    df = spark.createDataFrame([(None,), ("0",), ("12.345",), ("abc",)], "v string")
    found = [r[0] for r in df.select(coerce.website_money(F.col("v"))).collect()]
    assert found == [Decimal("0.0000"), Decimal("0.0000"), Decimal("12.3450"), None]


def test_marketplace_money_turns_zero_into_missing(spark):
    df = spark.createDataFrame([(None,), ("0",), ("0.00",), ("12.345",), ("abc",)], "v string")
    found = [r[0] for r in df.select(coerce.marketplace_money(F.col("v"))).collect()]
    assert found == [None, None, None, Decimal("12.35"), None]


def test_base_amount_rounds_half_up(spark):
    df = spark.sql("SELECT cast('0.0001' AS decimal(15,4)) AS a, cast('-0.0001' AS decimal(15,4)) AS b, "
                   "cast('0.5' AS decimal(15,8)) AS r")
    found = df.select(coerce.base_amount(F.col("a"), F.col("r")), coerce.base_amount(F.col("b"), F.col("r"))).first()
    assert tuple(found) == (Decimal("0.0001"), Decimal("-0.0001"))


def test_zero_date_and_activity(spark):
    df = spark.createDataFrame([("0000-00-00", 1), ("2020-02-29", 0), (None, None)], "d string, s int")
    found = df.select(coerce.source_date(F.col("d")), coerce.activity_label(F.col("s"))).collect()
    assert [tuple(r) for r in found] == [(None, "active"), (dt.date(2020, 2, 29), "inactive"), (None, "inactive")]


def test_date_key_and_back(spark):
    df = spark.sql("SELECT timestamp_ntz'2004-02-29 23:59:59' AS t")
    df = df.select(keys.date_key(F.col("t")).alias("k"))
    found = df.select("k", keys.date_from_key(F.col("k")), keys.month_of_date_key(F.col("k"))).first()
    assert tuple(found) == (20040229, dt.date(2004, 2, 29), 200402)


def test_surrogates_of_channels_do_not_meet(spark):
    df = spark.createDataFrame([(0,), (2**56 - 1,)], "id long")
    found = df.select(keys.surrogate("website", F.col("id")), keys.surrogate("marketplace", F.col("id"))).collect()
    assert len({v for r in found for v in r}) == 4


def test_payload_keeps_nulls(spark):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS string) AS b")
    assert df.select(coerce.json_payload("a", "b")).first()[0] == '{"a":1,"b":null}'


def test_sanitise_and_headers(spark):
    df = spark.sql("SELECT 1.50BD AS unit_price, date'2020-01-02' AS day, timestamp_ntz'2020-01-02 03:04:05' AS t, 'x' AS s")
    assert tuple(coerce.sanitise(df).first()) == (1.5, "2020-01-02", "2020-01-02T03:04:05", "x")
    assert coerce.with_headers(df).columns == ["Unit Price", "Day", "T", "S"]


def test_printable_blanks_missing_and_zero(spark):
    df = spark.sql("SELECT 0 AS a, CAST(NULL AS int) AS b, 2 AS c, false AS d, true AS e, '' AS f")
    assert tuple(coerce.printable(df).first()) == ("", "", "2", "", "true", "")


def test_default_calendar(spark):
    days = calendar(spark)
    assert days.count() == 7670
    day = days.where("date_id = 20150101").first().asDict()
    assert day == {
        "date_id": 20150101, "full_date": dt.date(2015, 1, 1), "day_of_month": 1, "day_name": "Thursday ",
        "day_of_week": 4, "week_of_year": 1, "month": 1, "month_name": "January  ", "quarter": 1, "year": 2015,
        "is_weekend": False, "season": "Winter",
    }
    assert days.where("full_date = '2021-01-03'").first()["week_of_year"] == 53
    assert rows(days.where("year = 2016").groupBy("season").count()) == [
        ("Autumn", 91), ("Spring", 92), ("Summer", 92), ("Winter", 91),
    ]


def test_month_bounds():
    assert month_bounds(dt.date(2020, 12, 31)) == (dt.date(2020, 12, 1), dt.date(2021, 1, 1))
    assert month_bounds(dt.date(2020, 2, 29)) == (dt.date(2020, 2, 1), dt.date(2020, 3, 1))
