"""The tables reports and alerts read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Mart:
    dim_date: DataFrame
    dim_sales_channel: DataFrame
    dim_category: DataFrame
    dim_publisher: DataFrame
    dim_product: DataFrame
    dim_customer: DataFrame
    dim_order_status: DataFrame
    fact_orders: DataFrame
    fact_order_lines: DataFrame
    order_months: DataFrame
