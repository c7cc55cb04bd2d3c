"""Identifiers: surrogate keys, date keys, title keys."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

WEBSITE = "website"
MARKETPLACE = "marketplace"
CHANNEL_ID = {WEBSITE: 1, MARKETPLACE: 2}

# A surrogate is the channel number in the high bits and the source id in the low 56: stable across runs,
# one-to-one, and computed per row without a shuffle or a sequence.
KEY_SPAN = 1 << 56


def surrogate(channel: str, source_id: Column) -> Column:
    return F.lit(CHANNEL_ID[channel] * KEY_SPAN) + source_id.cast("long")


def date_key(day: Column) -> Column:
    """Timestamp or date to YYYYMMDD."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def date_from_key(key: Column) -> Column:
    return F.make_date((key / 10000).cast("int"), (key / 100).cast("int") % 100, key % 100)


def month_of_date_key(key: Column) -> Column:
    """YYYYMMDD to YYYYMM, the partition column of the fact tables."""
    return (key / 100).cast("int")


def date_key_of(day: dt.date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


def title_key(title: Column) -> Column:
    """The form in which marketplace item names are compared with product titles."""
    return F.lower(F.trim(title))
