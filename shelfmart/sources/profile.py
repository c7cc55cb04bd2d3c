"""Source checks before a load: which tables are there, how many rows they hold, how recent the orders are."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, functions as F

from shelfmart import schemas

EXPECTED_TABLES = sorted(schemas.SHOP)


def missing_tables(present: Collection[str]) -> list[str]:
    return [name for name in EXPECTED_TABLES if name not in present]


def profile(tables: Mapping[str, DataFrame], newest: Mapping[str, str]) -> DataFrame:
    """One row per table: its row count and, where `newest` names a date column, the latest value. An expected table
    that is not there has a row without a count."""
    parts = [
        df.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("row_count"),
            (F.max(newest[name]) if name in newest else F.lit(None).cast("timestamp_ntz")).alias("newest"),
        )
        for name, df in tables.items()
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    absent = missing_tables(tables)
    if absent:
        rows = [(name, None, None) for name in absent]
        report = report.unionByName(
            report.sparkSession.createDataFrame(rows, "table_name string, row_count long, newest timestamp_ntz")
        )
    return report
