"""Row checks that name the first broken rule instead of failing the load."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

VIOLATION = "violation"


def missing(name: str) -> Column:
    return F.col(name).isNull()


def too_long(name: str, width: int) -> Column:
    return F.length(name) > width


def flag(df: DataFrame, broken: Mapping[str, Column]) -> DataFrame:
    """Add `violation`: the code of the first rule a row breaks, NULL when it breaks none."""
    return df.withColumn(VIOLATION, F.coalesce(*[F.when(test, code) for code, test in broken.items()]))


def flag_unknown_day(df: DataFrame, dim_date: DataFrame, broken: Mapping[str, Column]) -> DataFrame:
    """`flag`, plus the check that `date_id` is a day of the calendar."""
    days = dim_date.select("date_id", F.lit(True).alias("_known_day"))
    tests = {"date_null": missing("date_id"), "date_unknown": F.col("_known_day").isNull(), **broken}
    return flag(df.join(days, "date_id", "left"), tests).drop("_known_day")


def accepted(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col(VIOLATION).isNull()).drop(VIOLATION)


def rejected(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col(VIOLATION).isNotNull())


def outcome_counts(flagged: DataFrame) -> DataFrame:
    """Loaded and failed rows, the two figures of a sync record."""
    failed = F.col(VIOLATION).isNotNull()
    return flagged.agg(
        F.count_if(~failed).alias("records_ingested"),
        F.count_if(failed).alias("records_failed"),
    )
