"""Staging tables: natural key, columns an update may change, and the merge of a batch."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfmart.functions.calendar import at
from shelfmart.operators.merge import collapse, merge_batch


@dataclass(frozen=True)
class StagingTable:
    name: str
    keys: tuple[str, ...]
    updated: tuple[str, ...]
    version: tuple[str, ...] = ()
    keeps_payload: bool = False
    block: int | None = None


# Large staging tables are stored in blocks of this many ids. Ids grow with time, so that a batch touches the last
# blocks and few others, and a block holds no more rows than ids.
BLOCK = "id_block"
ORDER_BLOCK = 50_000_000
LINE_BLOCK = 500_000_000


# Which columns a repeated key overwrites; all others stay as first inserted.
WEBSITE_ORDERS = StagingTable(
    "stg_website_orders",
    ("order_id",),
    ("total", "order_status_id", "date_modified", "raw_json", "ingested_at"),
    ("date_modified",),
    True,
    ORDER_BLOCK,
)
WEBSITE_ORDER_LINES = StagingTable(
    "stg_website_order_lines",
    ("order_product_id",),
    ("quantity", "price", "total", "raw_json", "ingested_at"),
    keeps_payload=True,
    block=LINE_BLOCK,
)
WEBSITE_PRODUCTS = StagingTable(
    "stg_website_products",
    ("product_id",),
    ("quantity", "price", "status", "date_modified", "name", "raw_json", "ingested_at"),
    ("date_modified",),
    True,
)
WEBSITE_CATEGORIES = StagingTable(
    "stg_website_categories", ("category_id",), ("parent_id", "status", "name", "ingested_at")
)
WEBSITE_MANUFACTURERS = StagingTable(
    "stg_website_manufacturers", ("manufacturer_id",), ("name", "description", "ingested_at")
)
WEBSITE_CUSTOMERS = StagingTable(
    "stg_website_customers", ("customer_id",), ("customer_group_id", "customer_group_name", "ingested_at")
)
MARKETPLACE_ORDERS = StagingTable(
    "stg_marketplace_orders",
    ("marketplace_order_id",),
    ("changed", "status", "status_group", "cost_with_discount", "raw_json", "ingested_at"),
    ("changed",),
    True,
    ORDER_BLOCK,
)
MARKETPLACE_ORDER_LINES = StagingTable(
    "stg_marketplace_order_lines",
    ("purchase_id",),
    ("quantity", "cost_with_discount", "raw_json", "ingested_at"),
    ("changed",),
    True,
    LINE_BLOCK,
)


def stored_version(table: StagingTable) -> tuple[str, ...]:
    """The version columns a stored row can be compared by."""
    return tuple(c for c in table.version if c in table.updated)


def collapsed(batch: DataFrame, table: StagingTable, run_at: dt.datetime) -> DataFrame:
    """The rows a batch brings, one per key; a key repeated within it is applied version by version.

    A version column the batch does not carry is ignored; one that is not itself an updatable column is used for
    the order only and not stored.
    """
    version = [c for c in table.version if c in batch.columns]
    stored = [c for c in batch.columns if c not in version or c in table.updated]
    payload = stored if table.keeps_payload else []
    return collapse(batch.withColumn("ingested_at", at(run_at)), table.keys, table.updated, version, payload)


def stage(existing: DataFrame | None, batch: DataFrame, table: StagingTable, run_at: dt.datetime) -> DataFrame:
    """The staging table after one batch; no existing table means a first load."""
    rows = collapsed(batch, table, run_at)
    return rows if existing is None else merge_batch(existing, rows, table.keys, table.updated, stored_version(table))
