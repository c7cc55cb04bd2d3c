"""Sort columns with NULLs after values when ascending and before them when descending."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ascending(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def descending(name: str) -> Column:
    return F.col(name).desc_nulls_first()
