"""Typed coercion between source, staging and consumers. Bad text becomes NULL and is caught by the quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, NumericType, TimestampNTZType, TimestampType

# Storage types of amounts and rates.
MONEY = "decimal(15,4)"
RATE = "decimal(15,8)"
MARKETPLACE_MONEY = "decimal(12,2)"


def website_money(value: Column, to: str = MONEY) -> Column:
    """A missing website amount counts as zero; text that is no number stays NULL for the quarantine."""
    return F.when(value.isNull(), F.lit(0).cast(to)).otherwise(value.try_cast(to))


def marketplace_money(value: Column, to: str = MARKETPLACE_MONEY) -> Column:
    """A missing marketplace amount stays NULL, and so does a zero."""
    return F.nullif(value.try_cast(to), F.lit(0).cast(to))


def or_default(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def source_date(value: Column) -> Column:
    """Text date of the shop database; its zero date has no calendar day and becomes NULL."""
    return value.try_cast("date")


def base_amount(amount: Column, rate: Column) -> Column:
    """Amount in the base currency, rounded half-up to storage scale; NULL where it does not fit."""
    return (amount * rate).try_cast(MONEY)


def activity_label(flag: Column) -> Column:
    return F.when(flag == 1, "active").otherwise("inactive")


def json_payload(*columns: str | Column) -> Column:
    """The row as JSON text, NULL fields included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def iso_text(column: Column, data_type) -> Column:
    if isinstance(data_type, DateType):
        return F.date_format(column, "yyyy-MM-dd")
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")


def sanitise(df: DataFrame) -> DataFrame:
    """Consumer typing: decimals as doubles, dates and timestamps as ISO text."""

    def plain(field):
        if isinstance(field.dataType, DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, (DateType, TimestampType, TimestampNTZType)):
            return iso_text(F.col(field.name), field.dataType).alias(field.name)
        return F.col(field.name)

    return df.select(*[plain(field) for field in df.schema])


def header(name: str) -> str:
    return name.replace("_", " ").title()


def with_headers(df: DataFrame) -> DataFrame:
    """Spreadsheet form: headed columns, raw values."""
    return df.toDF(*[header(c) for c in df.columns])


def printable(df: DataFrame) -> DataFrame:
    """Page form: headed columns of text, blank where the value is missing, zero or false."""

    def cell(field):
        column = F.col(field.name)
        if isinstance(field.dataType, NumericType):
            blank = column == 0
        elif isinstance(field.dataType, BooleanType):
            blank = ~column
        else:
            blank = F.lit(False)
        return F.when(column.isNull() | blank, "").otherwise(column.cast("string")).alias(header(field.name))

    return df.select(*[cell(field) for field in df.schema])
