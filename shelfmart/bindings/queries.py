"""Registered queries: every operator over the sample tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmart import schemas, seeds
from shelfmart.bindings import tables as T
from shelfmart.functions.calendar import calendar, calendar_between
from shelfmart.functions.coerce import (
    base_amount, json_payload, marketplace_money, printable, sanitise, website_money, with_headers,
)
from shelfmart.functions.keys import CHANNEL_ID, MARKETPLACE, WEBSITE, date_from_key, date_key
from shelfmart.operators.constants import fixed_table
from shelfmart.operators.merge import insert_if_absent
from shelfmart.operators.quarantine import accepted, outcome_counts, rejected
from shelfmart.plans import alerts, dimensions, export, facts, history, refresh, reports, staging
from shelfmart.plans.staging import stage
from shelfmart.session import configure
from shelfmart.sources import marketplace, profile, shop, watermark
from shelfmart.streaming.landing import ingest_available

FROM, TO = dt.date(1995, 1, 1), dt.date(2001, 7, 31)
NO_ORDERS_AT = dt.datetime(2001, 8, 2, 12)
SINCE = dt.datetime(2000, 6, 1)
QUARANTINE_FROM, QUARANTINE_TO = dt.date(1996, 1, 1), dt.date(2000, 12, 31)
PAGE_FROM, PAGE_TO = dt.date(1996, 1, 1), dt.date(2000, 12, 31)
DEFAULT_RECIPIENT = "alerts@example.org"


# Sources


def src_orders_incremental(spark, sf_dir):
    return shop.orders(T.shop_reader(spark, sf_dir), SINCE)


def src_order_lines_semi(spark, sf_dir):
    read = T.shop_reader(spark, sf_dir)
    return shop.order_lines(read, shop.orders(read, SINCE))


def src_products_enriched(spark, sf_dir):
    return shop.products(T.shop_reader(spark, sf_dir), SINCE).drop("publisher", "isbn")


def src_categories_full(spark, sf_dir):
    return shop.categories(T.shop_reader(spark, sf_dir))


def src_publishers_full(spark, sf_dir):
    return shop.publishers(T.shop_reader(spark, sf_dir))


def src_customers_incremental(spark, sf_dir):
    return shop.customers(T.shop_reader(spark, sf_dir), dt.datetime(1997, 1, 1))


def _pages(spark, sf_dir):
    return marketplace.pages(spark, T.landing_folder(spark, sf_dir))


def src_marketplace_orders(spark, sf_dir):
    orders = marketplace.orders(_pages(spark, sf_dir), PAGE_FROM, PAGE_TO)
    return stage(None, orders, staging.MARKETPLACE_ORDERS, T.RUN_AT).drop("raw_json", "ingested_at")


def src_marketplace_lines(spark, sf_dir):
    return marketplace.order_lines(_pages(spark, sf_dir)).drop("raw_json", "changed")


def stream_marketplace_ingest(spark, sf_dir):
    """All landed files taken by the stream: the orders, each with the figures of its lines."""
    store = T.new_store(spark, sf_dir, "stream")
    ingest_available(store, T.landing_folder(spark, sf_dir), T.RUN_AT)
    lines = store.read(staging.MARKETPLACE_ORDER_LINES.name).groupBy("marketplace_order_id").agg(
        F.count("*").alias("line_count"),
        F.sum("quantity").alias("line_quantity"),
        F.sum("cost_with_discount").alias("line_cost_with_discount"),
    )
    orders = store.read(staging.MARKETPLACE_ORDERS.name).drop("raw_json", staging.BLOCK)
    return orders.join(lines, "marketplace_order_id", "left")


def cycle_incremental(spark, sf_dir):
    """Facts by channel and month after two scheduled runs, which are those of one full load."""
    store = T.cycled_store(spark, sf_dir)
    keys = ["channel_id", "order_month"]
    orders = store.read("fact_orders").groupBy(*keys).agg(
        F.count("*").alias("orders"), F.sum("total_amount_uah").alias("revenue_uah")
    )
    lines = store.read("fact_order_lines").groupBy(*keys).agg(
        F.count("*").alias("lines"), F.count("product_id").alias("matched"),
        F.sum("quantity_sold").alias("units"), F.sum("line_total_uah").alias("line_total_uah"),
    )
    return orders.join(lines, keys, "full_outer")


def src_marketplace_defaults(spark, sf_dir):
    """Purchases without a quantity count as one."""
    return marketplace.order_lines(T.sparse_pages(spark, sf_dir)).select("purchase_id", "quantity")


def sync_watermark(spark, sf_dir):
    channels = fixed_table(spark, [(WEBSITE,), (MARKETPLACE,), ("phone",)], "channel string")
    return watermark.watermarks(T.sync_log(spark, sf_dir), channels)


def dim_date(spark, sf_dir):
    """The calendar of the years the orders fall in."""
    day = F.col("o_orderdate").cast("date")
    span = T.raw(spark, sf_dir, "orders").agg(
        F.trunc(F.min(day), "year").alias("first_day"),
        F.date_sub(F.add_months(F.trunc(F.max(day), "year"), 12), 1).alias("last_day"),
    )
    return calendar_between(span)


def seed_order_status(spark, sf_dir):
    """Seeding after a load: statuses already seen in orders keep their row."""
    seen = dimensions.website_statuses(T.website_orders(spark, sf_dir)).unionByName(
        dimensions.marketplace_statuses(T.marketplace_orders(spark, sf_dir))
    )
    return insert_if_absent(seen, seeds.order_statuses(spark), ["source_id", "source_channel"])


def source_profile(spark, sf_dir):
    """Rows of every table of the shop; the sample has no stock statuses."""
    read = T.shop_reader(spark, sf_dir)
    present = [name for name in profile.EXPECTED_TABLES if name not in T.ABSENT]
    return profile.profile({name: read(name) for name in present}, {"orders": "date_added"})


# Coercion


def coerce_website_money(spark, sf_dir):
    """Discounts as text, zero ones missing: they come back as zero."""
    text = F.nullif(F.abs(F.col("l_discount").cast("decimal(4,2)")), F.lit(0).cast("decimal(4,2)")).cast("string")
    lines = T.raw(spark, sf_dir, "lineitem").select("l_linenumber", website_money(text).alias("amount"))
    return _money_report(lines)


def coerce_marketplace_money(spark, sf_dir):
    """Taxes as text: zero ones come back missing."""
    text = F.abs(F.col("l_tax").cast("decimal(12,2)")).cast("string")
    lines = T.raw(spark, sf_dir, "lineitem").select("l_linenumber", marketplace_money(text).alias("amount"))
    return _money_report(lines)


def _money_report(lines):
    return lines.groupBy("l_linenumber").agg(
        F.sum("amount").alias("amount"),
        F.count_if(F.col("amount").isNull()).alias("missing"),
        F.count_if(F.col("amount") == 0).alias("zero"),
    )


def raw_json_payload(spark, sf_dir):
    website = T.website_orders(spark, sf_dir).select(
        "order_id", json_payload("order_id", "customer_id", "total", "order_status_id", "currency_code").alias("payload")
    )
    other = T.marketplace_orders(spark, sf_dir).select(
        F.col("marketplace_order_id").alias("order_id"),
        json_payload("marketplace_order_id", "cost_with_discount", "status", "delivery_city").alias("payload"),
    )
    return website.unionByName(other)


def date_key_roundtrip(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    keyed = T.raw(spark, sf_dir, "orders").groupBy(date_key(day).alias("date_id")).agg(F.count("*").alias("orders"))
    return keyed.select("date_id", date_from_key(F.col("date_id")).alias("day"), "orders")


def currency_convert(spark, sf_dir):
    """Both channels; the marketplace's rate is 1."""
    other = T.marketplace_orders(spark, sf_dir).select(
        F.col("marketplace_order_id").alias("order_id"),
        F.col("cost_with_discount").cast("decimal(15,4)").alias("total"),
        F.lit(1).cast("decimal(15,8)").alias("currency_value"),
    )
    orders = T.website_orders(spark, sf_dir).select("order_id", "total", "currency_value").unionByName(other)
    return orders.withColumn("total_uah", base_amount(F.col("total"), F.col("currency_value")))


def report_sanitise(spark, sf_dir):
    website = T.website_orders(spark, sf_dir).select(
        "order_id", "total", "date_added", F.col("date_modified").cast("date").alias("day"), "payment_method"
    )
    other = T.marketplace_orders(spark, sf_dir).select(
        F.col("marketplace_order_id").alias("order_id"),
        F.col("cost_with_discount").cast("decimal(15,4)").alias("total"),
        F.col("created").alias("date_added"),
        F.col("changed").cast("date").alias("day"),
        F.lit(None).cast("string").alias("payment_method"),
    )
    return sanitise(website.unionByName(other))


# Staging


def _upserted(table, first, second, with_payload=False):
    loaded = stage(None, first, table, T.RUN_AT)
    merged = stage(loaded, second, table, T.SECOND_RUN_AT)
    return merged if with_payload else merged.drop("raw_json")


def upsert_orders(spark, sf_dir):
    merged = _upserted(staging.WEBSITE_ORDERS, T.orders_first(spark, sf_dir), T.orders_second(spark, sf_dir))
    return merged.drop("store_id", "customer_group_id", "payment_city", "payment_country", "shipping_method")


def upsert_order_lines(spark, sf_dir):
    lines = T.raw(spark, sf_dir, "lineitem")
    return _upserted(
        staging.WEBSITE_ORDER_LINES,
        T.order_products(spark, sf_dir, T.lines_first(spark, sf_dir, lines)),
        T.order_products(spark, sf_dir, T.lines_second(spark, sf_dir, lines)),
        with_payload=True,
    )


def upsert_products(spark, sf_dir):
    read = T.shop_reader(spark, sf_dir)
    rows = shop.coerce_products(shop.products(read, T.EVERYTHING)).select(
        "product_id", "author", "quantity", "price", "status", "date_modified", "name", "main_category_id"
    )
    small = F.col("quantity") <= 40
    again = rows.where(small & (F.col("status") == 1)).withColumns(
        {
            "author": F.lit("changed"),
            "quantity": F.col("quantity") + 1,
            "price": (F.col("price") + 1).cast("decimal(15,4)"),
            "status": F.lit(0).cast("int"),
            "date_modified": F.col("date_modified") + F.expr("interval 1 day"),
            "name": F.upper("name"),
            "main_category_id": F.lit(1),
        }
    )
    return _upserted(staging.WEBSITE_PRODUCTS, rows.where(small), rows.where(~small).unionByName(again))


def upsert_categories(spark, sf_dir):
    rows = shop.categories(T.shop_reader(spark, sf_dir)).drop("description")
    again = rows.withColumns(
        {
            "parent_id": F.when(F.col("parent_id") == 0, 0).otherwise(F.col("parent_id") % 5 + 1),
            "status": F.lit(0).cast("short"),
            "sort_order": F.col("sort_order") + 100,
            "name": F.lower("name"),
        }
    )
    return _upserted(staging.WEBSITE_CATEGORIES, rows.where(F.col("parent_id") != 3), again)


def upsert_publishers(spark, sf_dir):
    rows = shop.publishers(T.shop_reader(spark, sf_dir))
    again = rows.withColumns({"name": F.upper("name"), "description": F.lit(None).cast("string")})
    return _upserted(staging.WEBSITE_MANUFACTURERS, rows.where(F.col("description") < "nation 2"), again)


def upsert_customers(spark, sf_dir):
    rows = shop.customers(T.shop_reader(spark, sf_dir), T.EVERYTHING)
    again = rows.withColumns(
        {
            "customer_group_id": F.lit(99),
            "customer_group_name": F.lower("customer_group_name"),
            "is_newsletter": ~F.col("is_newsletter"),
        }
    )
    return _upserted(staging.WEBSITE_CUSTOMERS, rows.where("customer_group_name <> 'BUILDING'"), again)


def upsert_mkt_orders(spark, sf_dir):
    orders = T.marketplace_orders(spark, sf_dir).drop("total_quantity", "cost", "ttn")
    early = orders.where(F.col("changed") < F.lit(T.CUT.isoformat()).cast("timestamp_ntz"))
    late = orders.where(F.col("changed") >= F.lit(T.CUT.isoformat()).cast("timestamp_ntz"))
    again = early.where(F.col("status") == 1).withColumns(
        {
            "changed": F.col("changed") + F.expr("interval 2 days"),
            "status": F.lit(6),
            "status_group": F.lit(2),
            "cost_with_discount": (F.col("cost_with_discount") + 1).cast("decimal(12,2)"),
            "amount": F.lit(0).cast("decimal(12,2)"),
            "delivery_city": F.lit("moved"),
        }
    )
    return _upserted(staging.MARKETPLACE_ORDERS, early, late.unionByName(again))


def upsert_mkt_lines(spark, sf_dir):
    lines = T.raw(spark, sf_dir, "lineitem")
    return _upserted(
        staging.MARKETPLACE_ORDER_LINES,
        T.purchases(spark, sf_dir, T.lines_first(spark, sf_dir, lines)),
        T.purchases(spark, sf_dir, T.lines_second(spark, sf_dir, lines)),
        with_payload=True,
    )


def quarantine_counts(spark, sf_dir):
    return outcome_counts(marketplace.flag_orders(T.marketplace_orders(spark, sf_dir)))


def insert_absent(spark, sf_dir):
    """Customers in credit are known already; the others are added."""
    rows = T.raw(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    known = rows.where(F.col("c_acctbal") >= 0).drop("c_acctbal")
    arriving = rows.drop("c_acctbal").withColumn("c_name", F.upper("c_name"))
    return insert_if_absent(known, arriving, ["c_custkey"])


def sync_log_append(spark, sf_dir):
    store = T.new_store(spark, sf_dir, "sync")
    counts = outcome_counts(marketplace.flag_orders(T.marketplace_orders(spark, sf_dir)))
    store.append("sync_log", watermark.sync_record(counts, 1, MARKETPLACE, T.AS_OF, T.RUN_AT, sync_type="manual"))
    return store.log("sync_log", schemas.SYNC_LOG)


# Dimensions and facts


def dim_publisher(spark, sf_dir):
    return dimensions.publishers(T.staged(spark, sf_dir, "manufacturers"))


def dim_category(spark, sf_dir):
    return dimensions.categories(T.staged(spark, sf_dir, "categories"))


def dim_category_deep(spark, sf_dir):
    """A category tree of more levels than the shop's."""
    found = dimensions.categories(T.deep_categories(spark, sf_dir))
    return found.select("source_category_id", "name", "parent_name", "is_age_group")


def category_quarantine(spark, sf_dir):
    """Categories whose parents lead to no root."""
    lost = dimensions.unrooted_categories(T.deep_categories(spark, sf_dir))
    return lost.select("category_id", "parent_id", "violation")


def dim_product(spark, sf_dir):
    return dimensions.products(
        T.staged(spark, sf_dir, "products"), dim_publisher(spark, sf_dir), dim_category(spark, sf_dir),
        T.stock_statuses(spark), T.RUN_AT,
    )


def dim_customer(spark, sf_dir):
    return dimensions.customers(T.staged(spark, sf_dir, "customers"))


def dim_status_website(spark, sf_dir):
    """Statuses seen in website orders beside a seed that lacks the completed one."""
    known = seeds.order_statuses(spark).where("source_channel = 'website' AND source_id <> 5")
    return dimensions.add_statuses(known, dimensions.website_statuses(T.staged(spark, sf_dir, "orders")))


def dim_status_marketplace(spark, sf_dir):
    known = seeds.order_statuses(spark).where("source_channel = 'marketplace' AND source_id <> 45")
    seen = dimensions.marketplace_statuses(T.staged(spark, sf_dir, "marketplace_orders"))
    return dimensions.add_statuses(known, seen)


def fact_orders_website(spark, sf_dir):
    checked = accepted(facts.flag_website_orders(T.staged(spark, sf_dir, "orders"), T.days(spark)))
    return facts.website_orders(checked, dim_customer(spark, sf_dir), seeds.order_statuses(spark))


def fact_orders_marketplace(spark, sf_dir):
    staged = T.staged(spark, sf_dir, "marketplace_orders")
    checked = accepted(facts.flag_marketplace_orders(staged, T.days(spark)))
    return facts.marketplace_orders(checked, seeds.order_statuses(spark))


def fact_orders_all(spark, sf_dir):
    return facts.both_channels(fact_orders_website(spark, sf_dir), fact_orders_marketplace(spark, sf_dir))


def fact_lines_website(spark, sf_dir):
    """Two order batches before the lines: the lines keep the rate their order was first loaded with."""
    first, second = (
        facts.website_orders(
            accepted(facts.flag_website_orders(stage(None, batch, staging.WEBSITE_ORDERS, T.RUN_AT), T.days(spark))),
            dim_customer(spark, sf_dir),
            seeds.order_statuses(spark),
        )
        for batch in (T.orders_first(spark, sf_dir), T.orders_second(spark, sf_dir))
    )
    orders = facts.merge_orders(first, second)
    lines = accepted(facts.flag_lines(T.staged(spark, sf_dir, "order_lines")))
    return facts.website_lines(lines, orders, dim_product(spark, sf_dir))


def fact_lines_marketplace(spark, sf_dir):
    lines = accepted(facts.flag_lines(T.staged(spark, sf_dir, "marketplace_order_lines")))
    return facts.marketplace_lines(lines, fact_orders_marketplace(spark, sf_dir), dim_product(spark, sf_dir))


def fact_quarantine(spark, sf_dir):
    """Orders outside a shorter calendar, and waybills too long for their column."""
    days = calendar(spark, QUARANTINE_FROM, QUARANTINE_TO)
    website = rejected(facts.flag_website_orders(T.staged(spark, sf_dir, "orders"), days))
    other = rejected(facts.flag_marketplace_orders(T.staged(spark, sf_dir, "marketplace_orders"), days))
    return website.select(
        F.lit(CHANNEL_ID[WEBSITE]).alias("channel_id"), F.col("order_id").alias("source_order_id"), "date_id", "violation"
    ).unionByName(
        other.select(
            F.lit(CHANNEL_ID[MARKETPLACE]).alias("channel_id"),
            F.col("marketplace_order_id").alias("source_order_id"),
            *["date_id", "violation"],
        )
    )


def quarantine_redrive(spark, sf_dir):
    """Rows set aside for want of their day or order, what became of them when the calendar had grown, and how many
    facts they are now."""
    store = T.redriven_store(spark, sf_dir)
    keys = ["kind", "violation"]
    still = refresh.quarantine(store).groupBy(*keys).agg(F.count("*").alias("second_run"))
    resolved = store.log(refresh.RESOLVED_LOG, refresh.RESOLVED_SCHEMA)
    orders, lines = store.read("fact_orders"), store.read("fact_order_lines")
    web, other = F.col("channel_id") == CHANNEL_ID[WEBSITE], F.col("channel_id") == CHANNEL_ID[MARKETPLACE]
    loaded = _union(
        rows.select(F.lit(kind).alias("kind"), F.col(key).alias("source_id"))
        for kind, rows, key in (
            ("website_orders", orders.where(web), "source_order_id"),
            ("marketplace_orders", orders.where(other), "source_order_id"),
            ("website_lines", lines.where(web), "source_line_id"),
            ("marketplace_lines", lines.where(other), "source_line_id"),
        )
    )
    facts_of = resolved.join(loaded, ["kind", "source_id"]).groupBy(*keys).agg(F.count("*").alias("loaded"))
    counted = resolved.groupBy(*keys).agg(F.count("*").alias("resolved"))
    whole = store.read("first_run").join(still, keys, "full_outer").join(counted, keys, "full_outer")
    return whole.join(facts_of, keys, "full_outer").na.fill(0)


def transform_counts(spark, sf_dir):
    """What the steps of two transforms did, the first with rejected rows, the second with those that became loadable."""
    log = T.redriven_store(spark, sf_dir).log(refresh.COUNT_LOG, refresh.COUNT_LOG_SCHEMA)
    return log


def seed_load(spark, sf_dir):
    """Seeds loaded into a store that has some customers' rules already, and once more: nothing is there twice."""
    store = T.new_store(spark, sf_dir, "seeds")
    store.write(refresh.RULES, T.supplier_rules(spark, sf_dir))
    for _ in range(2):
        refresh.seed(store, T.RULES_CREATED)
    return _union(
        [
            store.read(refresh.RULES).select(F.lit("rule").alias("seed"), F.col("rule_id").cast("long").alias("id"), F.col("rule_name").alias("label")),
            store.read(refresh.CHANNELS).select(F.lit("channel").alias("seed"), F.col("channel_id").cast("long").alias("id"), F.col("channel_name").alias("label")),
            store.read("dim_order_status").select(F.lit("status").alias("seed"), F.col("status_id").alias("id"), F.col("name_en").alias("label")),
        ]
    )


# Reports


def revenue_by_channel(spark, sf_dir):
    return reports.revenue_by_channel(T.mart(spark, sf_dir), FROM, dt.date(2001, 12, 31))


def top_books(spark, sf_dir):
    return reports.top_books(T.mart(spark, sf_dir), FROM, TO, None, 50)


def top_books_website(spark, sf_dir):
    return reports.top_books(T.mart(spark, sf_dir), dt.date(1999, 1, 1), TO, CHANNEL_ID[WEBSITE], 10)


def sales_by_category(spark, sf_dir):
    return reports.sales_by_category(T.mart(spark, sf_dir), FROM, TO)


def sales_by_category_marketplace(spark, sf_dir):
    return reports.sales_by_category(T.mart(spark, sf_dir), dt.date(1998, 3, 1), TO, CHANNEL_ID[MARKETPLACE])


def seasonal_trend(spark, sf_dir):
    return reports.seasonal_trend(T.mart(spark, sf_dir), FROM, dt.date(2001, 12, 31))


def seasonal_trend_website(spark, sf_dir):
    return reports.seasonal_trend(T.mart(spark, sf_dir), FROM, TO, CHANNEL_ID[WEBSITE])


def inventory_status(spark, sf_dir):
    return reports.inventory_status(T.mart(spark, sf_dir))


def inventory_status_filtered(spark, sf_dir):
    return reports.inventory_status(T.mart(spark, sf_dir), "active", 105)


def weekly_sales(spark, sf_dir):
    return reports.weekly_sales(T.mart(spark, sf_dir), T.AS_OF)


def weekly_sales_order_grain(spark, sf_dir):
    return reports.weekly_sales_order_grain(T.mart(spark, sf_dir), T.AS_OF)


def kpi_mtd(spark, sf_dir):
    return reports.kpi_mtd(T.mart(spark, sf_dir), T.AS_OF)


def kpi_top_book(spark, sf_dir):
    return reports.kpi_top_book(T.mart(spark, sf_dir), T.AS_OF)


def kpi_low_stock(spark, sf_dir):
    return reports.kpi_low_stock(T.mart(spark, sf_dir), T.alert_rules(spark))


def kpi_low_stock_supplier_rules(spark, sf_dir):
    """Stock rules that grow with the data."""
    return reports.kpi_low_stock(T.mart(spark, sf_dir), T.supplier_rules(spark, sf_dir))


def kpi_last_sync(spark, sf_dir):
    return reports.kpi_last_sync(T.sync_log(spark, sf_dir))


def kpi_summary(spark, sf_dir):
    return reports.kpi_summary(T.mart(spark, sf_dir), T.alert_rules(spark), T.sync_log(spark, sf_dir), T.AS_OF)


def _dispatched(spark, sf_dir):
    mart = T.mart(spark, sf_dir)
    return {name: reports.report(name, mart, FROM, TO, T.AS_OF) for name in reports.REPORTS}


def _union(frames):
    whole = None
    for frame in frames:
        whole = frame if whole is None else whole.unionByName(frame)
    return whole


def report_dispatch(spark, sf_dir):
    return _union(
        frame.agg(F.lit(name).alias("report_type"), F.count("*").alias("row_count"))
        for name, frame in _dispatched(spark, sf_dir).items()
    )


def _requests():
    return [export.Request(name, FROM, TO) for name in reports.REPORTS]


def _reported(spark, sf_dir, *runs):
    store = T.new_store(spark, sf_dir, "reports")
    for run_id in runs:
        export.run_reports(store, T.mart(spark, sf_dir), _requests(), T.AS_OF, run_id, user_id=7)
    return store


def report_catalogue(spark, sf_dir):
    """Every report written as Parquet by one run, with its catalogue row and the number of rows that were written."""
    store = _reported(spark, sf_dir, "all")
    counted = export.report_log(store).select("report_type", F.col("rows").alias("row_count"))
    return export.catalogue(store).drop("report_id", "file_path").join(counted, "report_type")


def report_run(spark, sf_dir):
    """A run that was repeated leaves each report once: the rows in its files and those counted while writing."""
    store = _reported(spark, sf_dir, "again", "again")
    logged = {r["report_type"]: r for r in export.report_log(store).collect()}
    found = _union(
        spark.read.parquet(r["file_path"]).agg(
            F.lit(name).alias("report_type"), F.lit(r["rows"]).alias("counted"), F.count("*").alias("row_count")
        )
        for name, r in logged.items()
    )
    times = export.report_log(store).groupBy("report_type").agg(F.count("*").alias("entries"))
    return found.join(times, "report_type")


def audit_append(spark, sf_dir):
    """The actions of a report run among all that users did."""
    ours = export.audit(_reported(spark, sf_dir, "audited")).drop("log_id")
    return T.audit_log(spark, sf_dir).drop("log_id").unionByName(ours)


def report_headers(spark, sf_dir):
    """A report as a spreadsheet has it."""
    return with_headers(reports.sales_by_category(T.mart(spark, sf_dir), FROM, TO).drop("pct_of_total"))


def report_page(spark, sf_dir):
    """A report as a page has it: text, blank where there is nothing."""
    return printable(reports.inventory_status(T.mart(spark, sf_dir)))


def dashboard_bundle(spark, sf_dir):
    """The four dashboard blocks as (section, item, measure, value)."""
    blocks = reports.dashboard(
        T.mart(spark, sf_dir), T.alert_rules(spark), T.sync_log(spark, sf_dir), T.AS_OF, FROM
    )
    items = {
        "kpi": (F.lit("all"), ["total_revenue_mtd", "orders_mtd", "top_book_units", "low_stock_count"]),
        "revenue_by_channel": (
            F.concat_ws(" ", F.col("year") * 100 + F.col("month"), "channel_name"),
            ["total_revenue_uah", "order_count"],
        ),
        "top_books": (F.col("product_id").cast("string"), ["units_sold", "revenue_uah"]),
        "sales_by_category": (F.col("category_name"), ["units_sold", "revenue_uah"]),
    }
    return _union(
        blocks[section].select(
            F.lit(section).alias("section"),
            item.alias("item"),
            F.explode(
                F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
            ).alias("pair"),
        )
        for section, (item, measures) in items.items()
    ).select("section", "item", "pair.*")


# Alerts


def _stock(spark, sf_dir):
    return alerts.low_stock(
        T.mart(spark, sf_dir), T.alert_rules(spark), T.alert_events(spark, sf_dir), T.COOLDOWN_AT
    )


def _swings(spark, sf_dir):
    return alerts.revenue_swing(T.mart(spark, sf_dir).order_months, T.alert_rules(spark))


def _silent(spark, sf_dir):
    return alerts.no_orders(T.mart(spark, sf_dir).fact_orders, T.alert_rules(spark), NO_ORDERS_AT)


def alert_low_stock(spark, sf_dir):
    pairs = reports.low_stock_pairs(T.mart(spark, sf_dir), T.alert_rules(spark))
    return pairs.select("rule_id", "product_id", "title", "author", "quantity_in_stock", "threshold")


def alert_cooldown(spark, sf_dir):
    return _stock(spark, sf_dir).select("rule_id", "product_id", "quantity_in_stock")


def alert_revenue_swing(spark, sf_dir):
    return _swings(spark, sf_dir).drop("notify_email")


def alert_no_orders(spark, sf_dir):
    return _silent(spark, sf_dir)


def alert_events_new(spark, sf_dir):
    return alerts.new_events(_stock(spark, sf_dir), _swings(spark, sf_dir), T.COOLDOWN_AT).drop("event_id")


def alert_notifications(spark, sf_dir):
    return alerts.notifications(
        _stock(spark, sf_dir), _swings(spark, sf_dir), _silent(spark, sf_dir), T.COOLDOWN_AT, DEFAULT_RECIPIENT
    )


def _alert_store(spark, sf_dir, *moments):
    """A store after alert runs at the given times, on top of the sample's events."""
    store = T.new_store(spark, sf_dir, "alerts")
    store.append(alerts.EVENT_LOG, T.alert_events(spark, sf_dir))
    for moment in moments:
        alerts.run_alerts(store, T.mart(spark, sf_dir), T.alert_rules(spark), moment, DEFAULT_RECIPIENT)
    return store


def alert_run_twice(spark, sf_dir):
    """Events that two runs add; the second is within the cooldown of the first, so it adds no stock event."""
    later = T.COOLDOWN_AT + dt.timedelta(hours=1)
    events = _alert_store(spark, sf_dir, T.COOLDOWN_AT, later).log(alerts.EVENT_LOG, schemas.ALERT_EVENT)
    added = events.where(F.col("detail").isNotNull())
    return added.groupBy("rule_id", "triggered_at").agg(
        F.count("*").alias("events"), F.count_distinct("event_id").alias("ids")
    )


def alert_books(spark, sf_dir):
    store = _alert_store(spark, sf_dir, T.COOLDOWN_AT)
    return spark.read.parquet(f"{store.root}/{alerts.BOOK_LOG}")


def alert_dispatch(spark, sf_dir):
    return alerts.dispatch(
        T.alert_rules(spark), _stock(spark, sf_dir), _swings(spark, sf_dir), _silent(spark, sf_dir)
    )


# History


def sync_history(spark, sf_dir):
    return history.sync_history(T.sync_log(spark, sf_dir))


def alert_event_history(spark, sf_dir):
    return history.alert_event_history(
        T.alert_events(spark, sf_dir), T.alert_rules(spark), T.mart(spark, sf_dir).dim_product
    )


def audit_history(spark, sf_dir):
    return history.audit_history(T.audit_log(spark, sf_dir), T.users(spark, sf_dir))


def report_history(spark, sf_dir):
    return history.report_history(T.report_catalogue(spark, sf_dir))


def alert_rule_list(spark, sf_dir):
    return history.alert_rule_list(T.supplier_rules(spark, sf_dir))


def channel_list(spark, sf_dir):
    """The channels that have orders."""
    used = T.mart(spark, sf_dir).fact_orders.select("channel_id").distinct()
    return history.channel_list(seeds.sales_channels(spark).join(used, "channel_id", "left_semi"))


REGISTERED = [
    src_orders_incremental, src_order_lines_semi, src_products_enriched, src_categories_full, src_publishers_full,
    src_customers_incremental, src_marketplace_orders, src_marketplace_lines, src_marketplace_defaults,
    stream_marketplace_ingest, cycle_incremental,
    sync_watermark, dim_date, seed_order_status, source_profile,
    coerce_website_money, coerce_marketplace_money, raw_json_payload, date_key_roundtrip, currency_convert,
    report_sanitise,
    upsert_orders, upsert_order_lines, upsert_products, upsert_categories, upsert_publishers, upsert_customers,
    upsert_mkt_orders, upsert_mkt_lines, quarantine_counts, insert_absent, sync_log_append,
    dim_publisher, dim_category, dim_category_deep, category_quarantine, dim_product, dim_customer, dim_status_website, dim_status_marketplace,
    fact_orders_website, fact_orders_marketplace, fact_orders_all, fact_lines_website, fact_lines_marketplace,
    fact_quarantine, quarantine_redrive, transform_counts, seed_load,
    kpi_summary, kpi_mtd, kpi_top_book, kpi_low_stock, kpi_low_stock_supplier_rules, kpi_last_sync,
    revenue_by_channel, top_books, top_books_website, sales_by_category, sales_by_category_marketplace,
    seasonal_trend, seasonal_trend_website, inventory_status, inventory_status_filtered, weekly_sales,
    weekly_sales_order_grain, report_dispatch, report_catalogue, report_run, audit_append,
    report_headers, report_page, dashboard_bundle,
    alert_dispatch, alert_low_stock, alert_cooldown, alert_revenue_swing, alert_no_orders, alert_events_new,
    alert_notifications, alert_run_twice, alert_books,
    sync_history, alert_event_history, audit_history, report_history, alert_rule_list, channel_list,
]

# Registered under the operator's name.
NAMES = {"insert_absent": "insert_if_absent"}


def _presented(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return sanitise(build(spark, sf_dir))

    run.__doc__ = build.__doc__
    return run


def registry():
    return {NAMES.get(build.__name__, build.__name__): _presented(build) for build in REGISTERED}
