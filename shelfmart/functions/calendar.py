"""The date dimension and month arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmart.functions.keys import date_key

# Default span of the calendar, months of each season, width of the blank-padded names.
CALENDAR_FIRST_DAY = dt.date(2015, 1, 1)
CALENDAR_LAST_DAY = dt.date(2035, 12, 31)
SEASON_MONTHS = {"Spring": (3, 4, 5), "Summer": (6, 7, 8), "Autumn": (9, 10, 11)}
OTHER_SEASON = "Winter"
NAME_WIDTH = 9


def season(month: Column) -> Column:
    branch = F
    for name, months in SEASON_MONTHS.items():
        branch = branch.when(month.isin(*months), name)
    return branch.otherwise(OTHER_SEASON)


def calendar_between(bounds: DataFrame) -> DataFrame:
    """One row per day for a one-row frame of `first_day`, `last_day`."""
    day = F.col("full_date")
    weekday = F.weekday(day) + 1
    return bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("full_date")).select(
        date_key(day).alias("date_id"),
        day,
        F.dayofmonth(day).alias("day_of_month"),
        F.rpad(F.date_format(day, "EEEE"), NAME_WIDTH, " ").alias("day_name"),
        weekday.alias("day_of_week"),
        F.weekofyear(day).alias("week_of_year"),
        F.month(day).alias("month"),
        F.rpad(F.date_format(day, "MMMM"), NAME_WIDTH, " ").alias("month_name"),
        F.quarter(day).alias("quarter"),
        F.year(day).alias("year"),
        (weekday >= 6).alias("is_weekend"),
        season(F.month(day)).alias("season"),
    )


def calendar(
    spark: SparkSession, first_day: dt.date = CALENDAR_FIRST_DAY, last_day: dt.date = CALENDAR_LAST_DAY
) -> DataFrame:
    return calendar_between(spark.range(1).select(F.lit(first_day).alias("first_day"), F.lit(last_day).alias("last_day")))


def at(moment: dt.datetime | dt.date) -> Column:
    """A clock time as a zone-less timestamp constant."""
    return F.lit(moment.isoformat()).cast("timestamp_ntz")


def month_bounds(day: dt.date) -> tuple[dt.date, dt.date]:
    """First day of the month and of the next one."""
    first = dt.date(day.year, day.month, 1)
    return first, dt.date(day.year + day.month // 12, day.month % 12 + 1, 1)
