"""Dimensions of the star schema, type 1: a repeated source key overwrites the listed columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from shelfmart.functions.calendar import at
from shelfmart.functions.coerce import activity_label
from shelfmart.functions.keys import MARKETPLACE, WEBSITE, surrogate
from shelfmart.operators.merge import insert_if_absent, merge_full
from shelfmart.operators.quarantine import VIOLATION, accepted, flag, missing, rejected, too_long
from shelfmart.seeds import CANCELLED, COMPLETED, FALLBACK_CANCELLED, FALLBACK_COMPLETED, PROCESSING
from shelfmart.sources.shop import LABEL_LANGUAGE

# Columns a repeated source key overwrites, per dimension.
PUBLISHER_UPDATES = ["name", "description"]
CATEGORY_UPDATES = ["name", "parent_id", "parent_name", "is_age_group", "sort_order"]
PRODUCT_UPDATES = ["title", "price", "quantity_in_stock", "stock_status", "status", "last_updated"]
CUSTOMER_UPDATES = ["customer_group"]

CHANNEL_KEY = ["source_channel"]
PUBLISHER_KEYS = ["publisher_id", "source_manufacturer_id"]
CATEGORY_KEYS = ["category_id", "source_category_id", *CHANNEL_KEY]
PRODUCT_KEYS = ["product_id", "source_product_id", *CHANNEL_KEY]
CUSTOMER_KEYS = ["customer_id", "source_customer_id", *CHANNEL_KEY]


ROW_HASH = "row_hash"

# Dimensions are stored in blocks of this many source ids.
DIM_BLOCK = "id_block"
BLOCK_IDS = 1_000_000


def stored_form(incoming: DataFrame, source_id: str, updates: list[str]) -> DataFrame:
    """A dimension as stored: with its block of ids, and a hash of the columns a change would show in. The time of the
    last update is not one of them."""
    tracked = [F.col(c) for c in updates if c != "last_updated"]
    # a hash passes over nulls, so which columns are null is hashed as well
    row_hash = F.xxhash64(*tracked, *[c.isNull() for c in tracked])
    return incoming.withColumns({DIM_BLOCK: F.expr(f"{source_id} div {BLOCK_IDS}"), ROW_HASH: row_hash})


def changed_rows(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `incoming` that are new or differ from what is stored; only keys and hashes of the table are read."""
    known = stored.select(*keys, F.col(ROW_HASH).alias("_known"))
    found = incoming.join(known, keys, "left")
    return found.where(F.col("_known").isNull() | (F.col("_known") != F.col(ROW_HASH))).drop("_known")


def public(stored: DataFrame) -> DataFrame:
    return stored.drop(DIM_BLOCK, ROW_HASH)


def _merged(existing: DataFrame | None, incoming: DataFrame, keys: list[str], updates: list[str]) -> DataFrame:
    return incoming if existing is None else merge_full(existing, incoming, keys, updates)


def flag_publishers(manufacturers: DataFrame) -> DataFrame:
    return flag(manufacturers, {"name_null": missing("name"), "name_length": too_long("name", 64)})


def publishers(manufacturers: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    incoming = accepted(flag_publishers(manufacturers)).select(
        surrogate(WEBSITE, F.col("manufacturer_id")).alias("publisher_id"),
        F.col("manufacturer_id").alias("source_manufacturer_id"),
        "name",
        "description",
    )
    return _merged(existing, incoming, PUBLISHER_KEYS, PUBLISHER_UPDATES)


def flag_categories(categories: DataFrame) -> DataFrame:
    return flag(categories, {"name_null": missing("name"), "name_length": too_long("name", 255)})


# Down from the roots, level by level, until one adds nothing; chains that run in a circle are never reached.
_TREE = """
    WITH RECURSIVE tree(category_id, name, parent_id, parent_name, sort_order) MAX RECURSION LEVEL 2147483647 AS (
        SELECT category_id, name, CAST(NULL AS BIGINT), CAST(NULL AS STRING), sort_order
        FROM {named} WHERE parent_id = 0
        UNION ALL
        SELECT c.category_id, c.name, CAST(c.parent_id AS BIGINT), t.name, c.sort_order
        FROM {named} c JOIN tree t ON c.parent_id = t.category_id
    )
    SELECT * FROM tree"""


def _rooted(named: DataFrame) -> DataFrame:
    """Categories whose chain of parents reaches a root, with the parent's name."""
    rows = named.select(F.col("category_id").cast("long").alias("category_id"), "name", "parent_id", "sort_order")
    return named.sparkSession.sql(_TREE, named=rows)


def unrooted_categories(staged: DataFrame) -> DataFrame:
    """Categories left out for want of a root: a parent that is missing or rejected, or parents in a circle."""
    named = accepted(flag_categories(staged))
    lost = named.join(_rooted(named).select("category_id"), "category_id", "left_anti")
    return lost.withColumn(VIOLATION, F.lit("no_root"))


def rejected_categories(staged: DataFrame) -> DataFrame:
    """All categories that are left out, with the reason."""
    flagged = flag_categories(staged)
    return rejected(flagged).unionByName(unrooted_categories(staged))


def categories(staged: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Roots are age groups; a child takes its parent's key and name. Those of `unrooted_categories` are left out."""
    found = _rooted(accepted(flag_categories(staged))).select(
        "category_id", "name", surrogate(WEBSITE, F.col("parent_id")).alias("parent_id"), "parent_name",
        F.col("parent_id").isNull().alias("is_age_group"), "sort_order",
    )
    incoming = found.select(
        surrogate(WEBSITE, F.col("category_id")).alias("category_id"),
        F.col("category_id").alias("source_category_id"),
        F.lit(WEBSITE).alias("source_channel"),
        *["name", "parent_id", "parent_name", "is_age_group", "sort_order"],
    )
    return _merged(existing, incoming, CATEGORY_KEYS, CATEGORY_UPDATES)


def flag_products(products: DataFrame) -> DataFrame:
    return flag(products, {"title_null": missing("name"), "title_length": too_long("name", 255)})


def products(
    staged: DataFrame,
    dim_publisher: DataFrame,
    dim_category: DataFrame,
    stock_statuses: DataFrame,
    run_at: dt.datetime,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Products with publisher, category and stock label; labels are taken in one language, one row per id."""
    publisher = dim_publisher.select(F.col("source_manufacturer_id").alias("manufacturer_id"), "publisher_id")
    category = dim_category.where(F.col("source_channel") == WEBSITE).select(
        F.col("source_category_id").alias("main_category_id"), "category_id"
    )
    label = stock_statuses.where(F.col("language_id") == LABEL_LANGUAGE).select(
        "stock_status_id", F.col("name").alias("stock_status")
    )
    incoming = (
        accepted(flag_products(staged))
        .withColumnRenamed("name", "title")
        .join(publisher, "manufacturer_id", "left")
        .join(category, "main_category_id", "left")
        .join(label, "stock_status_id", "left")
        .select(
            surrogate(WEBSITE, F.col("product_id")).alias("product_id"),
            F.col("product_id").alias("source_product_id"),
            F.lit(WEBSITE).alias("source_channel"),
            *["title", "author", "isbn", "publisher_id", "publishing_year", "pages_number", "binding_type"],
            *["category_id", "price", F.col("quantity").alias("quantity_in_stock"), "stock_status"],
            activity_label(F.col("status")).alias("status"),
            *["date_available", "date_added", at(run_at).alias("last_updated")],
        )
    )
    return _merged(existing, incoming, PRODUCT_KEYS, PRODUCT_UPDATES)


def customers(staged: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    incoming = staged.select(
        surrogate(WEBSITE, F.col("customer_id")).alias("customer_id"),
        F.col("customer_id").alias("source_customer_id"),
        F.lit(WEBSITE).alias("source_channel"),
        F.col("customer_group_name").alias("customer_group"),
        F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("string").alias("country"),
        F.col("date_added").cast("date").alias("date_registered"),
        "is_newsletter",
    )
    return _merged(existing, incoming, CUSTOMER_KEYS, CUSTOMER_UPDATES)


def website_statuses(orders: DataFrame) -> DataFrame:
    """Status rows for the ids seen in website orders, with a placeholder name and a default group."""
    source_id = F.col("source_id")
    return (
        orders.select(F.col("order_status_id").cast("int").alias("source_id"))
        .where(source_id.isNotNull())
        .distinct()
        .select(
            surrogate(WEBSITE, source_id).alias("status_id"),
            source_id,
            F.lit(WEBSITE).alias("source_channel"),
            F.concat(F.lit("Status "), source_id.cast("string")).alias("name_en"),
            F.when(source_id.isin(*FALLBACK_COMPLETED), COMPLETED)
            .when(source_id.isin(*FALLBACK_CANCELLED), CANCELLED)
            .otherwise(PROCESSING)
            .alias("status_group"),
        )
    )


def marketplace_statuses(orders: DataFrame) -> DataFrame:
    """Status rows for the ids seen in marketplace orders; of two groups for one id the lower is kept."""
    source_id = F.col("source_id")
    return (
        orders.where(F.col("status").isNotNull())
        .groupBy(F.col("status").alias("source_id"))
        .agg(F.min("status_group").alias("status_group"))
        .select(
            surrogate(MARKETPLACE, source_id).alias("status_id"),
            source_id,
            F.lit(MARKETPLACE).alias("source_channel"),
            F.concat(F.lit("Marketplace status "), source_id.cast("string")).alias("name_en"),
            "status_group",
        )
    )


def add_statuses(existing: DataFrame, seen: DataFrame) -> DataFrame:
    return insert_if_absent(existing, seen, ["source_id", "source_channel"])
