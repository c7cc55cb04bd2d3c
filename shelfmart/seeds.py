"""Seed rows: sales channels, order statuses with their groups, default alert rules."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmart import schemas
from shelfmart.functions.keys import CHANNEL_ID, KEY_SPAN, MARKETPLACE, WEBSITE
from shelfmart.operators.constants import fixed_table

PROCESSING, COMPLETED, CANCELLED = 1, 2, 3

# Website statuses (id, label, group).
WEBSITE_STATUSES = [
    (1, "Pending", 1),
    (2, "Processing", 1),
    (3, "Shipped", 1),
    (5, "Complete", 2),
    (7, "Cancelled", 3),
    (8, "Denied", 3),
    (9, "Cancelled Reversal", 3),
    (10, "Failed", 3),
    (11, "Refunded", 3),
    (12, "Reversed", 3),
    (13, "Chargeback", 3),
    (14, "Expired", 3),
    (15, "Processed", 2),
    (16, "Voided", 3),
]

# Marketplace statuses (id, label, group).
MARKETPLACE_STATUSES = [
    (1, "New order", 1),
    (2, "Confirmed — wait for shipment", 1),
    (3, "Transferred to delivery service", 1),
    (4, "Delivering", 1),
    (5, "Stored in local pickup station", 1),
    (6, "Parcel received", 2),
    (7, "Was not processed by seller", 3),
    (10, "Dispatch is delayed", 1),
    (11, "Parcel was not picked up", 3),
    (12, "Product was rejected", 3),
    (13, "Cancelled by Administrator", 3),
    (15, "Incorrect waybill", 3),
    (16, "Out of stock / defective", 3),
    (17, "Cancellation — payment unacceptable", 3),
    (18, "Cancellation — fail to contact buyer", 3),
    (19, "Return", 3),
    (20, "Cancellation — product unacceptable", 3),
    (26, "Processing", 1),
    (40, "Cancellation — customer changed mind", 3),
    (42, "Out of stock", 3),
    (45, "Cancelled by buyer", 3),
    (50, "Cancellation — order not paid", 3),
]

# Groups of website statuses that have no seed row; any other id is still processing.
FALLBACK_COMPLETED = (5,)
FALLBACK_CANCELLED = (7, 13, 16, 17)

# Default alert rules (type, name, threshold, cooldown hours).
DEFAULT_RULES = [
    ("low_stock", "Low Stock Warning (≤5 copies)", "5", 24),
    ("low_stock", "Critical Stock (last copy)", "1", 12),
    ("no_orders", "No Orders in 48 Hours", "48", 48),
]


def sales_channels(spark: SparkSession, website_url: str | None = None, marketplace_url: str | None = None) -> DataFrame:
    rows = [
        (CHANNEL_ID[WEBSITE], "Website", website_url, True),
        (CHANNEL_ID[MARKETPLACE], "Marketplace", marketplace_url, True),
    ]
    return fixed_table(spark, rows, schemas.SALES_CHANNEL)


def order_statuses(spark: SparkSession) -> DataFrame:
    rows = [
        (CHANNEL_ID[channel] * KEY_SPAN + source_id, source_id, channel, label, group)
        for channel, seeds in ((WEBSITE, WEBSITE_STATUSES), (MARKETPLACE, MARKETPLACE_STATUSES))
        for source_id, label, group in seeds
    ]
    return fixed_table(spark, rows, schemas.ORDER_STATUS)


def alert_rules(spark: SparkSession, created_at: dt.datetime) -> DataFrame:
    rows = [
        (number, kind, name, Decimal(threshold), None, None, True, cooldown, None, created_at)
        for number, (kind, name, threshold, cooldown) in enumerate(DEFAULT_RULES, start=1)
    ]
    return fixed_table(spark, rows, schemas.ALERT_RULE)


def with_missing_rules(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """Seed rules not yet present by (type, name), so that seeding twice changes nothing."""
    names = rules.select("rule_type", "rule_name")
    fresh = wanted.join(names, ["rule_type", "rule_name"], "left_anti").select(*rules.columns)
    last_id = F.coalesce(rules.agg(F.max("rule_id")).scalar(), F.lit(0))
    return rules.unionByName(fresh.withColumn("rule_id", (F.col("rule_id") + last_id).cast("int")))
