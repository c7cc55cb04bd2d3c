"""Incremental and full reads of the shop database tables.

Every read takes `read`, a function from a table name to its DataFrame, so that Parquet exports and JDBC share one
set of plans; filters and projections stay next to the scan and are pushed into either.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmart import schemas
from shelfmart.functions.calendar import at
from shelfmart.functions.coerce import or_default, source_date, website_money

Reader = Callable[[str], DataFrame]

# Language of the labels, flag of the leading category.
LABEL_LANGUAGE = 1
MAIN_CATEGORY = 1

ORDER_COLUMNS = [
    "order_id", "store_id", "customer_id", "customer_group_id", "payment_city", "payment_country",
    "shipping_city", "shipping_method", "payment_method", "total", "order_status_id",
    "currency_code", "currency_value", "date_added", "date_modified",
]


def parquet_reader(spark: SparkSession, folder: str) -> Reader:
    return lambda name: spark.read.schema(schemas.SHOP[name]).parquet(f"{folder}/{name}")


@dataclass(frozen=True)
class JdbcReader:
    """Tables behind a JDBC url, called with a table name. `partition_bounds` gives (column, low, high, partitions) for
    the large ones, so that a first load is read by many tasks. Lines of changed orders are selected in the database."""

    spark: SparkSession
    url: str
    table_names: Mapping[str, str]
    partition_bounds: Mapping[str, tuple[str, int, int, int]] = field(default_factory=dict)
    options: Mapping[str, str] = field(default_factory=dict)
    rows_a_partition: int = 1_000_000

    def __call__(self, name: str) -> DataFrame:
        return self._load(self.table_options(name))

    def table_options(self, name: str) -> dict[str, str]:
        return {"dbtable": self.table_names[name], **_bounds(*self.partition_bounds.get(name, ()))}

    def _load(self, options: Mapping[str, str]) -> DataFrame:
        return self.spark.read.format("jdbc").option("url", self.url).options(**self.options).options(**options).load()

    def changed_lines_query(self, since: dt.datetime, until: dt.datetime | None) -> str:
        """Lines of the orders changed in the window, as a sub-select: no other line leaves the database."""
        window = f"o.date_modified >= '{_sql_time(since)}'"
        if until is not None:
            window += f" AND o.date_modified <= '{_sql_time(until)}'"
        lines, orders = self.table_names["order_products"], self.table_names["orders"]
        return f"SELECT p.* FROM {lines} p WHERE p.order_id IN (SELECT o.order_id FROM {orders} o WHERE {window})"

    def bounds_options(self, query: str) -> dict[str, str]:
        """The least and greatest line of the window, and how many there are: one row."""
        inner = "MIN(q.order_product_id) AS low, MAX(q.order_product_id) AS high, COUNT(*) AS lines"
        return {"dbtable": f"(SELECT {inner} FROM ({query}) q) AS bounds"}

    def changed_lines_options(self, query: str, low: int | None, high: int | None, lines: int) -> dict[str, str]:
        """The sub-select as the table to read, cut by line id into partitions of about equal numbers of lines."""
        parts = -(-lines // self.rows_a_partition)
        cut = _bounds("order_product_id", low, high + 1, parts) if parts > 1 else {}
        return {"dbtable": f"({query}) AS changed_lines", **cut}

    def changed_lines(self, since: dt.datetime, until: dt.datetime | None = None) -> DataFrame:
        query = self.changed_lines_query(since, until)
        found = self._load(self.bounds_options(query)).first()
        return self._load(self.changed_lines_options(query, found["low"], found["high"], found["lines"]))


def _bounds(column=None, low=None, high=None, parts=None) -> dict[str, str]:
    if column is None:
        return {}
    return {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}


def _sql_time(moment: dt.datetime) -> str:
    return moment.isoformat(sep=" ")


def _labels(read: Reader, name: str, *columns: str) -> DataFrame:
    return read(name).where(F.col("language_id") == LABEL_LANGUAGE).select(*columns)


def _changed(df: DataFrame, column: str, since: dt.datetime, until: dt.datetime | None) -> DataFrame:
    changed = df.where(F.col(column) >= at(since))
    return changed if until is None else changed.where(F.col(column) <= at(until))


def orders(read: Reader, since: dt.datetime, until: dt.datetime | None = None) -> DataFrame:
    return _changed(read("orders"), "date_modified", since, until).select(*ORDER_COLUMNS)


def lines_since(
    read: Reader, changed_orders: DataFrame, since: dt.datetime, until: dt.datetime | None = None
) -> DataFrame:
    """Lines of the orders changed in a window: selected by the database if there is one, else by a join."""
    if isinstance(read, JdbcReader):
        return read.changed_lines(since, until)
    return order_lines(read, changed_orders)


def order_lines(read: Reader, changed_orders: DataFrame) -> DataFrame:
    """Lines of the changed orders; no id list passes through the driver."""
    return read("order_products").join(changed_orders.select("order_id"), "order_id", "left_semi")


def products(read: Reader, since: dt.datetime, until: dt.datetime | None = None) -> DataFrame:
    labels = _labels(read, "product_descriptions", "product_id", "name", "description")
    main = (
        read("product_to_category")
        .where(F.col("main_category") == MAIN_CATEGORY)
        .select("product_id", F.col("category_id").alias("main_category_id"))
    )
    return (
        _changed(read("products"), "date_modified", since, until)
        .withColumnRenamed("pereplet", "binding_type")
        .withColumn("date_available", source_date(F.col("date_available")))
        .join(labels, "product_id", "left")
        .join(main, "product_id", "left")
    )


def categories(read: Reader) -> DataFrame:
    labels = _labels(read, "category_descriptions", "category_id", "name", "description")
    return read("categories").join(labels, "category_id", "left")


def publishers(read: Reader) -> DataFrame:
    labels = _labels(read, "manufacturer_descriptions", "manufacturer_id", "description")
    return read("manufacturers").join(labels, "manufacturer_id", "left")


def customers(read: Reader, since: dt.datetime, until: dt.datetime | None = None) -> DataFrame:
    """Customers registered since; no personal column is selected."""
    groups = _labels(
        read, "customer_group_descriptions", "customer_group_id", F.col("name").alias("customer_group_name")
    )
    return (
        _changed(read("customers"), "date_added", since, until)
        .select(
            "customer_id", "customer_group_id", "store_id", F.col("newsletter").alias("is_newsletter"), "date_added"
        )
        .join(groups, "customer_group_id", "left")
    )


def coerce_orders(rows: DataFrame) -> DataFrame:
    """Column defaults and amounts of website orders."""
    return rows.withColumns(
        {
            "store_id": or_default(F.col("store_id"), 0),
            "customer_id": or_default(F.col("customer_id"), 0),
            "customer_group_id": or_default(F.col("customer_group_id"), 0),
            "order_status_id": or_default(F.col("order_status_id"), 0),
            "currency_code": or_default(F.col("currency_code"), "UAH"),
            "total": website_money(F.col("total")),
            "currency_value": website_money(F.col("currency_value"), "decimal(15,8)"),
        }
    )


def coerce_order_lines(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: website_money(F.col(c)) for c in ("price", "total", "tax")})


def coerce_products(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "price": website_money(F.col("price")),
            **{c: or_default(F.col(c), 0) for c in ("quantity", "stock_status_id", "manufacturer_id", "status")},
        }
    )


def coerce_categories(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "parent_id": or_default(F.col("parent_id"), 0),
            "status": or_default(F.col("status"), 1),
            "sort_order": or_default(F.col("sort_order"), 0),
        }
    )


def coerce_customers(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "customer_group_id": or_default(F.col("customer_group_id"), 0),
            "store_id": or_default(F.col("store_id"), 0),
            "is_newsletter": or_default(F.col("is_newsletter"), False),
        }
    )
