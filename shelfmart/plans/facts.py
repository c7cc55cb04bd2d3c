"""Order and line facts of both channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmart.functions.coerce import MONEY, RATE, base_amount
from shelfmart.functions.keys import CHANNEL_ID, MARKETPLACE, WEBSITE, date_key, month_of_date_key, surrogate, title_key
from shelfmart.operators.merge import merge_full
from shelfmart.operators.quarantine import accepted, flag, flag_unknown_day, missing, too_long

# Columns a repeated source key overwrites; date, rate, product and tax stay as first loaded.
ORDER_UPDATES = ["status_id", "total_amount", "total_amount_uah", "date_modified"]
LINE_UPDATES = ["quantity_sold", "unit_price", "line_total", "line_total_uah"]

ORDER_KEYS = ["order_id", "source_order_id", "channel_id"]
LINE_KEYS = ["line_id", "source_line_id", "channel_id"]
MONTH = "order_month"

ORDER_MISSING = "order_missing"


def _statuses(dim_status: DataFrame, channel: str, source_name: str) -> DataFrame:
    return dim_status.where(F.col("source_channel") == channel).select(F.col("source_id").alias(source_name), "status_id")


def flag_website_orders(staged: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Checks come before the look-ups, so that splitting off bad rows repeats no join but the calendar's."""
    return flag_unknown_day(
        staged.withColumn("date_id", date_key(F.col("date_added"))),
        dim_date,
        {
            "key_null": missing("order_id"),
            "total_null": missing("total"),
            "amount_range": base_amount(F.col("total"), F.col("currency_value")).isNull(),
            "currency_length": too_long("currency_code", 3),
            "city_length": too_long("shipping_city", 128),
            "shipping_length": too_long("shipping_method", 128),
            "payment_length": too_long("payment_method", 128),
        },
    )


def flag_marketplace_orders(staged: DataFrame, dim_date: DataFrame) -> DataFrame:
    return flag_unknown_day(
        staged.withColumn("date_id", date_key(F.col("created"))),
        dim_date,
        {"key_null": missing("marketplace_order_id"), "city_length": too_long("delivery_city", 128)},
    )


def flag_lines(staged: DataFrame) -> DataFrame:
    """The first of its own rules a line breaks."""
    return flag(staged, _line_rules(staged))


def _line_rules(staged: DataFrame) -> dict[str, Column]:
    return {
        "quantity_null": missing("quantity"),
        "quantity_range": F.col("quantity") < 0,
        **({"total_null": missing("total")} if "total" in staged.columns else {}),
    }


def _with_order(lines: DataFrame, key: str, fact_orders: DataFrame, channel: str, *more: str) -> DataFrame:
    """Lines beside the key, the day and `more` of their order, NULL where it is not loaded."""
    order = fact_orders.where(F.col("channel_id") == CHANNEL_ID[channel]).select(
        F.col("source_order_id").alias(key), F.col("order_id").alias("_order"), "date_id", *more
    )
    return lines.join(order, key, "left")


def flag_website_lines(lines: DataFrame, fact_orders: DataFrame) -> DataFrame:
    """Lines with their order and the first rule each breaks: one of its own, no loaded order to take the day and the
    rate from, or an amount that does not fit at that rate."""
    placed = _with_order(lines, "order_id", fact_orders, WEBSITE, "currency_value")
    too_large = base_amount(F.col("total"), F.col("currency_value")).isNull()
    return flag(placed, {**_line_rules(lines), ORDER_MISSING: missing("_order"), "amount_range": too_large})


def flag_marketplace_lines(lines: DataFrame, fact_orders: DataFrame) -> DataFrame:
    placed = _with_order(lines, "marketplace_order_id", fact_orders, MARKETPLACE)
    return flag(placed, {**_line_rules(lines), ORDER_MISSING: missing("_order")})


def website_orders(checked: DataFrame, dim_customer: DataFrame, dim_status: DataFrame) -> DataFrame:
    customer = dim_customer.where(F.col("source_channel") == WEBSITE).select(
        F.col("source_customer_id").alias("_customer"), F.col("customer_id")
    )
    return (
        checked.withColumnRenamed("customer_id", "_customer")
        .join(_statuses(dim_status, WEBSITE, "order_status_id"), "order_status_id", "left")
        .join(customer, "_customer", "left")
        .select(
            surrogate(WEBSITE, F.col("order_id")).alias("order_id"),
            F.col("order_id").cast("long").alias("source_order_id"),
            F.lit(CHANNEL_ID[WEBSITE]).alias("channel_id"),
            *["date_id", "customer_id", "status_id"],
            F.col("total").cast(MONEY).alias("total_amount"),
            base_amount(F.col("total"), F.col("currency_value")).alias("total_amount_uah"),
            *["currency_code", F.col("currency_value").cast(RATE).alias("currency_value")],
            *["shipping_city", "shipping_method", "payment_method", "date_added", "date_modified"],
        )
    )


def marketplace_orders(checked: DataFrame, dim_status: DataFrame) -> DataFrame:
    """Marketplace amounts are already in the base currency, and buyers are not kept."""
    no_text = F.lit(None).cast("string")
    amount = F.col("cost_with_discount").cast(MONEY)
    return checked.join(_statuses(dim_status, MARKETPLACE, "status"), "status", "left").select(
        surrogate(MARKETPLACE, F.col("marketplace_order_id")).alias("order_id"),
        F.col("marketplace_order_id").alias("source_order_id"),
        F.lit(CHANNEL_ID[MARKETPLACE]).alias("channel_id"),
        "date_id",
        F.lit(None).cast("long").alias("customer_id"),
        "status_id",
        amount.alias("total_amount"),
        amount.alias("total_amount_uah"),
        F.lit("UAH").alias("currency_code"),
        F.lit(1).cast(RATE).alias("currency_value"),
        F.col("delivery_city").alias("shipping_city"),
        no_text.alias("shipping_method"),
        no_text.alias("payment_method"),
        F.col("created").alias("date_added"),
        F.col("changed").alias("date_modified"),
    )


def merge_orders(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    return incoming if existing is None else merge_full(existing, incoming, ORDER_KEYS, ORDER_UPDATES)


def merge_lines(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    return incoming if existing is None else merge_full(existing, incoming, LINE_KEYS, LINE_UPDATES)


def website_lines(lines: DataFrame, fact_orders: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Lines of loaded orders that break no rule, at the rate their order was first loaded with."""
    return placed_website_lines(accepted(flag_website_lines(lines, fact_orders)), dim_product)


# What of a checked line its fact is made of
WEBSITE_PLACED = ["order_product_id", "_order", "product_id", "date_id", "quantity", "price", "total", "currency_value", "tax"]
MARKETPLACE_PLACED = ["purchase_id", "_order", "item_name", "date_id", "quantity", "price", "cost_with_discount"]


def placed_website_lines(placed: DataFrame, dim_product: DataFrame) -> DataFrame:
    product = dim_product.where(F.col("source_channel") == WEBSITE).select(
        F.col("source_product_id").alias("_product"), F.col("product_id").alias("_key"), "category_id"
    )
    return placed.withColumnRenamed("product_id", "_product").join(product, "_product", "left").select(
        surrogate(WEBSITE, F.col("order_product_id")).alias("line_id"),
        F.col("order_product_id").cast("long").alias("source_line_id"),
        *[F.col("_order").alias("order_id"), F.col("_key").alias("product_id"), "category_id"],
        *[F.lit(CHANNEL_ID[WEBSITE]).alias("channel_id"), "date_id"],
        F.col("quantity").alias("quantity_sold"),
        F.col("price").cast(MONEY).alias("unit_price"),
        F.col("total").cast(MONEY).alias("line_total"),
        base_amount(F.col("total"), F.col("currency_value")).alias("line_total_uah"),
        F.col("tax").cast(MONEY).alias("tax"),
    )


def products_by_title(dim_product: DataFrame) -> DataFrame:
    """One product per normalised title, the lowest id, so that a title shared by several cannot multiply lines."""
    return (
        dim_product.groupBy(title_key(F.col("title")).alias("_title"))
        .agg(F.min(F.struct("product_id", "category_id")).alias("_pick"))
        .select("_title", "_pick.product_id", "_pick.category_id")
    )


def marketplace_lines(lines: DataFrame, fact_orders: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Lines of loaded orders that break no rule, matched to a product by title as far as possible; an unmatched line
    keeps no product."""
    return placed_marketplace_lines(accepted(flag_marketplace_lines(lines, fact_orders)), dim_product)


def placed_marketplace_lines(placed: DataFrame, dim_product: DataFrame) -> DataFrame:
    amount = F.col("cost_with_discount").cast(MONEY)
    titled = placed.withColumn("_title", title_key(F.col("item_name")))
    return titled.join(products_by_title(dim_product), "_title", "left").select(
        surrogate(MARKETPLACE, F.col("purchase_id")).alias("line_id"),
        F.col("purchase_id").alias("source_line_id"),
        *[F.col("_order").alias("order_id"), "product_id", "category_id"],
        *[F.lit(CHANNEL_ID[MARKETPLACE]).alias("channel_id"), "date_id"],
        F.col("quantity").alias("quantity_sold"),
        F.col("price").cast(MONEY).alias("unit_price"),
        amount.alias("line_total"),
        amount.alias("line_total_uah"),
        F.lit(0).cast(MONEY).alias("tax"),
    )


def both_channels(website: DataFrame, marketplace: DataFrame) -> DataFrame:
    return website.unionByName(marketplace)


def with_month(fact: DataFrame) -> DataFrame:
    """Add the column the stored fact tables are partitioned by."""
    return fact.withColumn(MONTH, month_of_date_key(F.col("date_id")))


# Revenue and orders by channel, month and status, kept beside the facts
TOTALS = "order_months"


def month_totals(fact_orders: DataFrame) -> DataFrame:
    return fact_orders.groupBy("channel_id", MONTH, "status_id").agg(
        F.sum("total_amount_uah").alias("revenue"), F.count("*").alias("orders")
    )
