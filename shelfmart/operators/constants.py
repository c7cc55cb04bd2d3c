"""Small fixed tables as plan constants."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def fixed_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows known in code. The optimizer knows the size of an inlined array, which it does not of an RDD."""
    fields = StructType.fromDDL(schema).fields

    def constant(value, field):
        plain = value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value
        return F.lit(plain).cast(field.dataType).alias(field.name)

    records = [F.struct(*[constant(value, field) for value, field in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*records)))
