"""Parameterised reports. Time is always an argument; an optional filter left at None keeps everything."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from shelfmart.functions.calendar import at, month_bounds
from shelfmart.functions.keys import MARKETPLACE, WEBSITE, date_key_of, surrogate
from shelfmart.operators.ordering import ascending, descending
from shelfmart.operators.threshold import count_matches, match_thresholds
from shelfmart.plans.facts import MONTH
from shelfmart.plans.mart import Mart
from shelfmart.seeds import COMPLETED
from shelfmart.storage import kept


def _between_days(fact: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Rows of the given days, both included; the month bound prunes partitions of a stored fact."""
    low, high = date_key_of(first), date_key_of(last)
    if MONTH in fact.columns:
        fact = fact.where(F.col(MONTH).between(low // 100, high // 100))
    return fact.where(F.col("date_id").between(low, high))


def _of_channel(fact: DataFrame, channel_id: int | None) -> DataFrame:
    return fact if channel_id is None else fact.where(F.col("channel_id") == channel_id)


def completed(mart: Mart, orders: DataFrame) -> DataFrame:
    """Orders, or sums of orders by status, whose status counts as completed."""
    done = mart.dim_order_status.where(F.col("status_group") == COMPLETED).select("status_id")
    return orders.join(done, "status_id", "left_semi")


def _completed_between(mart: Mart, first: dt.date, last: dt.date, channel_id: int | None) -> DataFrame:
    """Completed orders placed from midnight of the first day to midnight of the last: the time of day counts, so
    of the last day only an order at exactly midnight is in."""
    orders = _of_channel(_between_days(mart.fact_orders, first, last), channel_id)
    return completed(mart, orders.where(F.col("date_added").between(at(first), at(last))))


def _lines_of_completed(mart: Mart, first: dt.date, last: dt.date, channel_id: int | None) -> DataFrame:
    """Lines carry the day and channel of their order, so both sides are cut down before the join."""
    lines = _of_channel(_between_days(mart.fact_order_lines, first, last), channel_id)
    orders = _completed_between(mart, first, last, channel_id)
    return lines.join(orders.select("order_id"), "order_id", "left_semi")


def _completed_sums(mart: Mart, orders: DataFrame, *keys: str) -> DataFrame:
    """Revenue and number of completed orders by `keys`, added up by status first, so that the look-up of the status
    group and everything after it sees a few rows per key."""
    sums = orders.groupBy(*keys, "status_id").agg(
        F.sum("total_amount_uah").alias("revenue"), F.count("order_id").alias("orders")
    )
    return completed(mart, sums)


def _whole_months(first: dt.date, last: dt.date) -> bool:
    return first.day == 1 and (last + dt.timedelta(days=1)).day == 1


def _monthly_sums(mart: Mart, first: dt.date, last: dt.date, channel_id: int | None = None) -> DataFrame:
    """Completed revenue and orders by year, month and channel: from the kept totals where the period is made of whole
    months, else from the orders of its days."""
    if _whole_months(first, last):
        month = F.col(MONTH)
        low, high = date_key_of(first) // 100, date_key_of(last) // 100
        totals = _of_channel(mart.order_months.where(month.between(low, high)), channel_id)
        sums = completed(mart, totals)
        return sums.select(F.floor(month / 100).cast("int").alias("year"), (month % 100).cast("int").alias("month"), "channel_id", "revenue", "orders")
    days = mart.dim_date.where(F.col("full_date").between(F.lit(first), F.lit(last)))
    orders = _of_channel(_between_days(mart.fact_orders, first, last), channel_id)
    sums = _completed_sums(mart, orders, "date_id", "channel_id").join(days.select("date_id", "year", "month"), "date_id")
    return sums.select("year", "month", "channel_id", "revenue", "orders")


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


# Month to date


def kpi_mtd(mart: Mart, as_of: dt.datetime) -> DataFrame:
    """From the kept totals of the month."""
    first, following = month_bounds(as_of.date())
    return _monthly_sums(mart, first, following - dt.timedelta(days=1)).agg(
        _zero(F.sum("revenue")).alias("total_revenue_mtd"), _zero(F.sum("orders")).alias("orders_mtd")
    )


def kpi_top_book(mart: Mart, as_of: dt.datetime) -> DataFrame:
    """Best-selling title of the month over orders of any status; units are added per product before the join."""
    first, following = month_bounds(as_of.date())
    lines = _between_days(mart.fact_order_lines, first, following - dt.timedelta(days=1))
    return _best_title(mart, lines.groupBy("product_id").agg(F.sum("quantity_sold").alias("units")))


def _best_title(mart: Mart, sold: DataFrame) -> DataFrame:
    return (
        sold.join(mart.dim_product.select("product_id", "title"), "product_id")
        .groupBy("title")
        .agg(F.sum("units").alias("units"))
        .orderBy(descending("units"), ascending("title"))
        .limit(1)
        .select(F.col("title").alias("top_book_title"), F.col("units").alias("top_book_units"))
    )


def _active_products(mart: Mart) -> DataFrame:
    return mart.dim_product.where(F.col("status") == "active")


def _stock_rules(rules: DataFrame) -> DataFrame:
    return rules.where((F.col("rule_type") == "low_stock") & F.col("is_active"))


def low_stock_pairs(mart: Mart, rules: DataFrame) -> DataFrame:
    """Active products with every active stock rule they fall under."""
    return match_thresholds(
        _active_products(mart).select("product_id", "title", "author", "quantity_in_stock"),
        "quantity_in_stock",
        _stock_rules(rules),
        "threshold",
        ["rule_id", "threshold", "cooldown_hours", "notify_email"],
    )


def kpi_low_stock(mart: Mart, rules: DataFrame) -> DataFrame:
    """Product and rule pairs, so that a product under two rules counts twice, and the products themselves."""
    counted = count_matches(_active_products(mart), "quantity_in_stock", _stock_rules(rules), "threshold")
    return counted.select(F.col("pairs").alias("low_stock_count"), F.col("items").alias("low_stock_products"))


def kpi_last_sync(sync_log: DataFrame) -> DataFrame:
    def newest(channel):
        return F.max(F.when(F.col("channel") == channel, F.col("completed_at"))).alias(f"last_sync_{channel}")

    return sync_log.where(F.col("status") == "success").agg(newest(WEBSITE), newest(MARKETPLACE))


def kpi_summary(
    mart: Mart, rules: DataFrame, sync_log: DataFrame, as_of: dt.datetime, top_book: DataFrame | None = None
) -> DataFrame:
    """The four blocks in one row; without a best seller its columns are NULL. A best seller worked out before may be
    handed in."""
    blocks = {
        "mtd": (kpi_mtd(mart, as_of), ["total_revenue_mtd", "orders_mtd"]),
        "top_book": (top_book or kpi_top_book(mart, as_of), ["top_book_title", "top_book_units"]),
        "low_stock": (kpi_low_stock(mart, rules), ["low_stock_count"]),
        "last_sync": (kpi_last_sync(sync_log), ["last_sync_website", "last_sync_marketplace"]),
    }
    row = mart.dim_date.sparkSession.range(1).select(
        *[block.select(F.struct(*names)).scalar().alias(key) for key, (block, names) in blocks.items()]
    )
    return row.select(*[F.col(f"{key}.{name}") for key, (_, names) in blocks.items() for name in names])


# Trends


def revenue_by_channel(mart: Mart, first: dt.date, last: dt.date) -> DataFrame:
    """Monthly completed revenue and orders per channel; a month without orders has a row of zeros.

    Each channel row explodes into the months of the period, and the calendar drops the months it does not hold.
    """
    days = mart.dim_date.where(F.col("full_date").between(F.lit(first), F.lit(last)))
    months = days.select("year", "month", "month_name").distinct()
    sold = (
        _monthly_sums(mart, first, last)
        .groupBy("year", "month", "channel_id")
        .agg(F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders"))
    )
    start = F.explode(
        F.sequence(F.lit(first.replace(day=1)), F.lit(last.replace(day=1)), F.expr("interval 1 month"))
    )
    spine = (
        mart.dim_sales_channel.select("channel_id", "channel_name", start.alias("start"))
        .select("channel_id", "channel_name", F.year("start").alias("year"), F.month("start").alias("month"))
        .join(months, ["year", "month"])
    )
    return (
        spine.join(sold, ["year", "month", "channel_id"], "left")
        .groupBy("year", "month", "month_name", "channel_name")
        .agg(
            _zero(F.sum("revenue")).alias("total_revenue_uah"),
            _zero(F.sum("orders")).alias("order_count"),
        )
        .orderBy("year", "month", "channel_name")
    )


def seasonal_trend(mart: Mart, first: dt.date, last: dt.date, channel_id: int | None = None) -> DataFrame:
    days = mart.dim_date.where(F.col("full_date").between(F.lit(first), F.lit(last)))
    sold = (
        _monthly_sums(mart, first, last, channel_id)
        .groupBy("year", "month")
        .agg(F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders"))
    )
    return (
        days.select("year", "month", "month_name", "season")
        .distinct()
        .join(sold, ["year", "month"], "left")
        .select(
            *["year", "month", "month_name", "season"],
            _zero(F.col("revenue")).alias("total_revenue_uah"),
            _zero(F.col("orders")).alias("order_count"),
        )
        .orderBy("year", "month")
    )


# Products and categories


def top_books(mart: Mart, first: dt.date, last: dt.date, channel_id: int | None = None, limit: int = 10) -> DataFrame:
    sold = (
        _lines_of_completed(mart, first, last, channel_id)
        .groupBy("product_id")
        .agg(F.sum("quantity_sold").alias("units"), F.sum("line_total_uah").alias("revenue"))
    )
    return _best_books(mart, sold, limit)


def _best_books(mart: Mart, sold: DataFrame, limit: int) -> DataFrame:
    return (
        sold.join(mart.dim_product.select("product_id", "title", "author"), "product_id")
        .select("product_id", "title", "author", F.col("units").alias("units_sold"), F.col("revenue").alias("revenue_uah"))
        .orderBy(descending("units_sold"), ascending("product_id"))
        .limit(limit)
    )


def sales_by_category(mart: Mart, first: dt.date, last: dt.date, channel_id: int | None = None) -> DataFrame:
    """Units and revenue per category with its share of all revenue, lines without a category included in the
    total, which is a sub-query over the same sums."""
    sold = (
        _lines_of_completed(mart, first, last, channel_id)
        .groupBy("category_id")
        .agg(F.sum("quantity_sold").alias("units"), F.sum("line_total_uah").alias("revenue"))
    )
    return _shares(mart, sold)


def _shares(mart: Mart, sold: DataFrame) -> DataFrame:
    total = sold.agg(F.sum("revenue").cast("decimal(38,4)")).scalar()
    category = mart.dim_category.select("category_id", F.col("name").alias("category_name"), "parent_name")
    share = F.col("revenue_uah") * 100 / F.nullif(total, F.lit(0).cast("decimal(38,4)"))
    return (
        sold.join(category, "category_id")
        .groupBy("category_name", "parent_name")
        .agg(F.sum("units").alias("units_sold"), F.sum("revenue").alias("revenue_uah"))
        .select("category_name", "parent_name", "units_sold", "revenue_uah", F.round(share, 2).alias("pct_of_total"))
        .orderBy(descending("revenue_uah"), ascending("category_name"), ascending("parent_name"))
    )


def inventory_status(mart: Mart, status: str | None = None, category_id: int | None = None) -> DataFrame:
    """Products by stock; `category_id` is the shop's number of a category."""
    stock = mart.dim_product
    if status is not None:
        stock = stock.where(F.col("status") == status)
    if category_id is not None:
        stock = stock.where(F.col("category_id") == surrogate(WEBSITE, F.lit(category_id)))
    category = mart.dim_category.select(
        "category_id", F.col("name").alias("category_name"), F.col("parent_name").alias("age_group")
    )
    return (
        stock.join(category, "category_id", "left")
        .select(
            *["product_id", "title", "author", "isbn", "quantity_in_stock", "price", "stock_status", "status"],
            *["category_name", "age_group"],
        )
        .orderBy(ascending("quantity_in_stock"), ascending("title"), ascending("product_id"))
    )


# Week


def _last_week(mart: Mart, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Completed orders of the seven days before `as_of` (and later), and the line figures of each order."""
    since = as_of - dt.timedelta(days=7)
    first_day = date_key_of(since.date())

    def recent(fact):
        if MONTH in fact.columns:
            fact = fact.where(F.col(MONTH) >= first_day // 100)
        return fact.where(F.col("date_id") >= first_day)

    orders = completed(mart, recent(mart.fact_orders).where(F.col("date_added") >= at(since)))
    lines = recent(mart.fact_order_lines).groupBy("order_id").agg(
        F.count("*").alias("lines"), F.sum("quantity_sold").alias("units")
    )
    return orders.select("order_id", "channel_id", "total_amount_uah"), lines


def _weekly(mart: Mart, orders: DataFrame, weight: Column) -> DataFrame:
    """Channel totals with each order counted `weight` times."""
    priced = F.when(F.col("total_amount_uah").isNotNull(), weight)
    totals = orders.groupBy("channel_id").agg(
        F.sum(weight).alias("order_count"),
        F.sum((F.col("total_amount_uah") * weight).cast("decimal(28,4)")).alias("revenue_uah"),
        F.sum("units").alias("units_sold"),
        F.sum(priced).alias("_priced"),
    )
    return (
        mart.dim_sales_channel.select("channel_id", "channel_name")
        .join(totals, "channel_id")
        .groupBy("channel_name")
        .agg(*[F.sum(c).alias(c) for c in ("order_count", "revenue_uah", "units_sold", "_priced")])
        .select(
            *["channel_name", "order_count", "revenue_uah", "units_sold"],
            (F.col("revenue_uah").cast("double") / F.nullif(F.col("_priced"), F.lit(0)))
            .alias("avg_order_value_uah"),
        )
        .orderBy(descending("revenue_uah"), ascending("channel_name"))
    )


def weekly_sales(mart: Mart, as_of: dt.datetime) -> DataFrame:
    """Figures per order line: an order with three lines counts three times in orders, revenue and average.

    Lines are reduced to one row per order before the join, and the order is then weighted by its line count.
    """
    orders, lines = _last_week(mart, as_of)
    return _weekly(mart, orders.join(lines, "order_id"), F.col("lines"))


def weekly_sales_order_grain(mart: Mart, as_of: dt.datetime) -> DataFrame:
    """The same week with every order counted once; orders without lines are included."""
    orders, lines = _last_week(mart, as_of)
    return _weekly(mart, orders.join(lines, "order_id", "left"), F.lit(1).cast("long"))


# Dispatch

# Fixed value: length of the best-seller list in a dispatched report.
REPORT_TOP_BOOKS = 50

Report = Callable[..., DataFrame]

REPORTS: dict[str, Report] = {
    "weekly_sales": lambda mart, as_of, **_: weekly_sales(mart, as_of),
    "monthly_revenue": lambda mart, first, last, **_: revenue_by_channel(mart, first, last),
    "top_books": lambda mart, first, last, channel_id, **_: top_books(mart, first, last, channel_id, REPORT_TOP_BOOKS),
    "sales_by_category": lambda mart, first, last, channel_id, **_: sales_by_category(mart, first, last, channel_id),
    "seasonal_trend": lambda mart, first, last, channel_id, **_: seasonal_trend(mart, first, last, channel_id),
    "inventory": lambda mart, category_id, **_: inventory_status(mart, "active", category_id),
}


def report(
    name: str,
    mart: Mart,
    first: dt.date,
    last: dt.date,
    as_of: dt.datetime,
    channel_id: int | None = None,
    category_id: int | None = None,
) -> DataFrame:
    if name not in REPORTS:
        raise ValueError(f"Unknown report type: {name}")
    return REPORTS[name](mart, first=first, last=last, as_of=as_of, channel_id=channel_id, category_id=category_id)


# Period of the dashboard's revenue chart, open end of its yearly lists, length of its best-seller list.
DASHBOARD_FROM = dt.date(2015, 1, 1)
DASHBOARD_TO = dt.date(2099, 12, 31)
DASHBOARD_TOP_BOOKS = 10


def dashboard_sums(mart: Mart, as_of: dt.datetime, until: dt.date = DASHBOARD_TO) -> DataFrame:
    """The lines since the start of the year added up by product and by category in one pass: `units`, `revenue` and
    `sold` (lines) of completed orders, `month_units` and `month_lines` of all orders of the month."""
    year = dt.date(as_of.year, 1, 1)
    first, following = month_bounds(as_of.date())
    done = _completed_between(mart, year, until, None).select("order_id", F.lit(True).alias("done"))
    lines = _between_days(mart.fact_order_lines, year, until).join(done, "order_id", "left")
    in_month = F.col("date_id").between(date_key_of(first), date_key_of(following - dt.timedelta(days=1)))
    units, revenue = F.col("quantity_sold"), F.col("line_total_uah")
    return lines.groupingSets([["product_id"], ["category_id"]], "product_id", "category_id").agg(
        F.grouping("product_id").alias("by_category"),
        F.sum(F.when(F.col("done"), units)).alias("units"),
        F.sum(F.when(F.col("done"), revenue)).alias("revenue"),
        F.count_if(F.col("done")).alias("sold"),
        F.sum(F.when(in_month, units)).alias("month_units"),
        F.count_if(in_month).alias("month_lines"),
    )


def dashboard(
    mart: Mart,
    rules: DataFrame,
    sync_log: DataFrame,
    as_of: dt.datetime,
    revenue_from: dt.date = DASHBOARD_FROM,
    until: dt.date = DASHBOARD_TO,
) -> dict[str, DataFrame]:
    """All blocks from one pass over the year's orders and lines, whose sums are written once, and the kept totals."""
    sums = kept(dashboard_sums(mart, as_of, until), "dashboard")
    books, categories = sums.where("by_category = 0"), sums.where("by_category = 1 AND sold > 0")
    month = books.where("month_lines > 0").select("product_id", F.col("month_units").alias("units"))
    return {
        "kpi": kpi_summary(mart, rules, sync_log, as_of, _best_title(mart, month)),
        "revenue_by_channel": revenue_by_channel(mart, revenue_from, until),
        "top_books": _best_books(mart, books.where("sold > 0"), DASHBOARD_TOP_BOOKS),
        "sales_by_category": _shares(mart, categories),
    }
