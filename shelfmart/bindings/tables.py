"""Sample tables (orders, lineitem, part, ...) as shop tables, marketplace documents and logs.

Every frame is a projection of whole sample tables; the mapping is described in FIXTURES.md.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmart import schemas, seeds
from shelfmart.functions.calendar import at, calendar
from shelfmart.functions.keys import KEY_SPAN, CHANNEL_ID, WEBSITE
from shelfmart.operators.constants import fixed_table
from shelfmart.plans import refresh, staging
from shelfmart.plans.mart import Mart
from shelfmart.plans.staging import stage
from shelfmart.session import configure, shared_dir
from shelfmart.sources import shop
from shelfmart.storage import TableStore, together

AS_OF = dt.datetime(2001, 7, 31, 12)
RUN_AT = dt.datetime(2001, 8, 2)
SECOND_RUN_AT = dt.datetime(2001, 8, 3)
COOLDOWN_AT = dt.datetime(2024, 1, 31)
FIRST_DAY, LAST_DAY = dt.date(1994, 12, 1), dt.date(2001, 12, 31)
CUT = dt.datetime(2000, 1, 1)
EVERYTHING = dt.datetime(1990, 1, 1)

# The first three order priorities are the website's orders, the others the marketplace's.
FIRST_MARKETPLACE_PRIORITY = "4"
DAY_ZERO = dt.date(1995, 1, 1)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column: str, values: dict, otherwise=None) -> Column:
    branch = F
    for key, value in values.items():
        branch = branch.when(F.col(column) == key, value)
    return branch.otherwise(otherwise)


def _by_day(column: str) -> Column:
    """Day number of a date, below 10,000."""
    return F.datediff(F.col(column).cast("date"), F.lit(DAY_ZERO))


def _line_id() -> Column:
    """Order, line number and ship day in one number; rows that agree in all three are versions of one line."""
    return F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + _by_day("l_shipdate")


def _placed() -> Column:
    """Orders are placed some hours before their last change."""
    return F.col("o_orderdate") - F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))


def _line_total(to: str) -> Column:
    price, discount = F.col("l_extendedprice").cast("decimal(15,2)"), F.col("l_discount").cast("decimal(4,2)")
    return (price * (1 - discount)).cast(to)


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(15,4)")


# Website


def website_orders(spark, sf_dir) -> DataFrame:
    orders = raw(spark, sf_dir, "orders").where(F.col("o_orderpriority") < FIRST_MARKETPLACE_PRIORITY)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.lit(0).alias("store_id"),
        F.when(F.col("o_custkey") % 10 == 0, 0).otherwise(F.col("o_custkey") + 1).alias("customer_id"),
        F.lit(0).alias("customer_group_id"),
        F.lit("Kyiv").alias("payment_city"),
        F.lit("Ukraine").alias("payment_country"),
        F.concat(F.lit("City "), (F.col("o_custkey") % 25).cast("string")).alias("shipping_city"),
        F.lit("courier").alias("shipping_method"),
        F.col("o_orderpriority").alias("payment_method"),
        _money("o_totalprice").alias("total"),
        _mapped("o_orderstatus", {"F": 5, "O": 1}, 7).alias("order_status_id"),
        F.when(urgent, "USD").otherwise("UAH").alias("currency_code"),
        F.when(urgent, F.lit("41.5")).otherwise("1").cast("decimal(15,8)").alias("currency_value"),
        _placed().alias("date_added"),
        F.col("o_orderdate").alias("date_modified"),
    )


def _lines_of(spark, sf_dir, website: bool) -> DataFrame:
    """Lines of one channel's orders."""
    on_website = F.col("o_orderpriority") < FIRST_MARKETPLACE_PRIORITY
    orders = raw(spark, sf_dir, "orders").where(on_website if website else ~on_website)
    keys = orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return raw(spark, sf_dir, "lineitem").join(keys, "l_orderkey", "left_semi")


def order_products(spark, sf_dir, lines: DataFrame) -> DataFrame:
    part = F.col("l_partkey").cast("string")
    return lines.select(
        _line_id().alias("order_product_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.concat(F.lit("part "), part).alias("name"),
        F.concat(F.lit("M"), part).alias("model"),
        F.col("l_quantity").cast("int").alias("quantity"),
        _money("l_extendedprice").alias("price"),
        _line_total("decimal(15,4)").alias("total"),
        _money("l_tax").alias("tax"),
    )


def website_lines(spark, sf_dir) -> DataFrame:
    return order_products(spark, sf_dir, _lines_of(spark, sf_dir, website=True))


def shop_reader(spark: SparkSession, sf_dir: str) -> shop.Reader:
    """The normalised shop tables."""

    def products():
        return raw(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("product_id"),
            F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("model"),
            F.col("p_type").alias("sku"),
            F.lit(None).cast("string").alias("isbn"),
            F.col("p_size").alias("quantity"),
            F.when(F.col("p_size") > 0, 7).alias("stock_status_id"),
            (F.col("p_partkey") % 10).alias("manufacturer_id"),
            _money("p_retailprice").alias("price"),
            F.when(F.col("p_size") < 10, "0000-00-00").otherwise("1999-05-01").alias("date_available"),
            F.lit(1999).cast("short").alias("publishing_year"),
            F.col("p_size").cast("short").alias("pages_number"),
            F.col("p_brand").alias("author"),
            F.lit(None).cast("string").alias("publisher"),
            F.lit("Paperback").alias("pereplet"),
            F.when(F.col("p_partkey") % 10 == 0, 0).otherwise(1).cast("short").alias("status"),
            F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").alias("date_added"),
            (
                F.lit("2001-01-01 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(F.col("p_size") * 10)
            ).alias("date_modified"),
        )

    def product_descriptions():
        return raw(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("product_id"),
            F.explode(F.array(F.lit(1), F.lit(2))).alias("language_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("description"),
        )

    def product_to_category():
        main = F.when(F.col("p_partkey") % 17 != 0, 101 + F.col("p_partkey") % 25)
        return (
            raw(spark, sf_dir, "part")
            .select(
                F.col("p_partkey").alias("product_id"),
                F.explode(
                    F.array(
                        F.struct(main.cast("int").alias("category_id"), F.lit(1).alias("main_category")),
                        F.struct(F.lit(1).alias("category_id"), F.lit(0).alias("main_category")),
                    )
                ).alias("link"),
            )
            .select("product_id", "link.*")
            .where(F.col("category_id").isNotNull())
        )

    def categories():
        roots = raw(spark, sf_dir, "region").select(
            (F.col("r_regionkey") + 1).alias("category_id"), F.lit(0).alias("parent_id"), "r_regionkey"
        )
        children = raw(spark, sf_dir, "nation").select(
            (F.col("n_nationkey") + 101).alias("category_id"), (F.col("n_regionkey") + 1).alias("parent_id"),
            "n_nationkey",
        )
        return roots.union(children).toDF("category_id", "parent_id", "sort_order").select(
            "category_id", "parent_id", F.lit(1).cast("short").alias("status"), "sort_order"
        )

    def category_descriptions():
        names = raw(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("category_id"), "r_name").union(
            raw(spark, sf_dir, "nation").select(F.col("n_nationkey") + 101, "n_name")
        )
        return names.select(
            "category_id",
            F.explode(F.array(F.lit(1), F.lit(2))).alias("language_id"),
            F.col("r_name").alias("name"),
            F.lit(None).cast("string").alias("description"),
        )

    def manufacturers():
        return raw(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("manufacturer_id"), F.col("s_name").alias("name")
        )

    def manufacturer_descriptions():
        return raw(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("manufacturer_id"),
            F.lit(1).alias("language_id"),
            F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("description"),
        )

    def customers():
        return raw(spark, sf_dir, "customer").select(
            (F.col("c_custkey") + 1).alias("customer_id"),
            F.length("c_mktsegment").alias("customer_group_id"),
            F.lit(0).alias("store_id"),
            (F.col("c_custkey") % 2 == 0).alias("newsletter"),
            (
                F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
                + F.make_dt_interval((F.col("c_custkey") % 2000).cast("int"))
            ).alias("date_added"),
        )

    def customer_group_descriptions():
        """Segments are told apart by the length of their name; the lowest name of a length labels the group."""
        return (
            raw(spark, sf_dir, "customer")
            .groupBy(F.length("c_mktsegment").alias("customer_group_id"))
            .agg(F.lit(1).alias("language_id"), F.min("c_mktsegment").alias("name"))
        )

    builders = {
        "orders": lambda: website_orders(spark, sf_dir),
        "order_products": lambda: order_products(spark, sf_dir, raw(spark, sf_dir, "lineitem")),
        "products": products,
        "product_descriptions": product_descriptions,
        "product_to_category": product_to_category,
        "categories": categories,
        "category_descriptions": category_descriptions,
        "manufacturers": manufacturers,
        "manufacturer_descriptions": manufacturer_descriptions,
        "customers": customers,
        "customer_group_descriptions": customer_group_descriptions,
    }
    return lambda name: builders[name]()


# Marketplace


def marketplace_orders(spark, sf_dir) -> DataFrame:
    orders = raw(spark, sf_dir, "orders").where(F.col("o_orderpriority") >= FIRST_MARKETPLACE_PRIORITY)
    amount = F.col("o_totalprice").cast("decimal(12,2)")
    return orders.select(
        F.col("o_orderkey").alias("marketplace_order_id"),
        F.lit(1).alias("market_id"),
        _placed().alias("created"),
        F.col("o_orderdate").alias("changed"),
        amount.alias("amount"),
        amount.alias("amount_with_discount"),
        F.lit(None).cast("decimal(12,2)").alias("cost"),
        amount.alias("cost_with_discount"),
        _mapped("o_orderstatus", {"F": 6, "O": 1}, 45).alias("status"),
        _mapped("o_orderstatus", {"F": 2, "O": 1}, 3).alias("status_group"),
        F.concat(F.lit("City "), (F.col("o_custkey") % 25).cast("string")).alias("delivery_city"),
        F.lit("post").alias("delivery_service"),
        F.repeat(F.lit("7"), (F.floor("o_totalprice") % 80).cast("int")).alias("ttn"),
        F.lit(None).cast("int").alias("total_quantity"),
    )


def purchases(spark, sf_dir, lines: DataFrame) -> DataFrame:
    titles = raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    unlisted = F.concat(F.lit("unlisted "), F.col("l_partkey").cast("string"))
    amount = F.col("l_extendedprice").cast("decimal(12,2)")
    return lines.join(titles, "l_partkey", "left").select(
        F.col("l_orderkey").alias("marketplace_order_id"),
        _line_id().alias("purchase_id"),
        F.col("l_partkey").alias("item_id"),
        F.when(F.col("l_partkey") % 7 == 0, unlisted)
        .otherwise(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")))
        .alias("item_name"),
        F.col("l_quantity").cast("int").alias("quantity"),
        amount.alias("price"),
        amount.alias("cost"),
        _line_total("decimal(12,2)").alias("cost_with_discount"),
    )


def marketplace_lines(spark, sf_dir) -> DataFrame:
    return purchases(spark, sf_dir, _lines_of(spark, sf_dir, website=False))


def landing_documents(spark, sf_dir, sparse: bool = False) -> DataFrame:
    """One envelope of JSON text per marketplace order and ship year. In a `sparse` one every third purchase has no
    quantity.

    Purchases are grouped by order and year; line numbers are single digits, so an envelope holds at most 3,660 of
    them however many lines an order has.
    """
    lacking = F.lit(sparse) & (F.col("purchase_id") % 3 == 0)
    item = F.struct(
        F.col("purchase_id").alias("id"), "item_id", "item_name",
        F.when(~lacking, F.col("quantity")).alias("quantity"),
        *[F.col(c).cast("string").alias(c) for c in ("price", "cost", "cost_with_discount")],
    )
    once = stage(None, marketplace_lines(spark, sf_dir), staging.MARKETPLACE_ORDER_LINES, RUN_AT)
    year = F.floor(F.col("purchase_id") % 10000 / 366)
    bought = once.groupBy("marketplace_order_id", year.alias("part")).agg(F.collect_list(item).alias("purchases"))
    order = marketplace_orders(spark, sf_dir)
    stamp = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("created", "changed")}
    amounts = ("amount", "amount_with_discount", "cost", "cost_with_discount")
    document = F.struct(
        F.col("marketplace_order_id").alias("id"), "market_id", *stamp.values(),
        *[F.col(c).cast("string").alias(c) for c in amounts], "status", "status_group", "ttn", "total_quantity",
        F.struct(
            F.col("delivery_service").alias("delivery_service_name"),
            F.struct(F.col("delivery_city").alias("name")).alias("city"),
        ).alias("delivery"),
        F.coalesce("purchases", F.expr("array()").cast(bought.schema["purchases"].dataType)).alias("purchases"),
    )
    envelope = F.struct(F.lit(True).alias("success"), F.struct(F.array(document).alias("orders")).alias("content"))
    return order.join(bought, "marketplace_order_id", "left").select(F.to_json(envelope).alias("value"))


def sparse_pages(spark, sf_dir) -> DataFrame:
    """Parsed pages whose purchases partly lack a quantity."""
    text = landing_documents(spark, sf_dir, sparse=True)
    parsed = F.from_json("value", schemas.PAGE_FIELDS, {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"})
    return text.select(parsed.alias("page")).select("page.*", F.lit(None).cast("string").alias(schemas.CORRUPT))


def landing_folder(spark, sf_dir) -> str:
    """The envelopes written as compressed JSON lines, once per session and data set."""
    return _once(spark, sf_dir, "landing", lambda path: landing_documents(spark, sf_dir).write.text(path, "gzip"))


# Second batches: rows after a cut are new, rows before it come again with every column changed


def orders_first(spark, sf_dir) -> DataFrame:
    return website_orders(spark, sf_dir).where(F.col("date_modified") < at(CUT))


def orders_second(spark, sf_dir) -> DataFrame:
    orders = website_orders(spark, sf_dir)
    late = orders.where(F.col("date_modified") >= at(CUT))
    reopened = orders.where((F.col("date_modified") < at(CUT)) & (F.col("order_status_id") == 1))

    def changed(rows, days, more, status):
        return rows.withColumns(
            {
                "total": (F.col("total") + more).cast("decimal(15,4)"),
                "order_status_id": F.lit(status),
                "currency_value": F.lit(2).cast("decimal(15,8)"),
                "shipping_city": F.lit("moved"),
                "date_modified": F.col("date_modified") + F.make_dt_interval(F.lit(days)),
            }
        )

    twice = reopened.where(F.col("currency_code") == "USD")
    return late.unionByName(changed(reopened, 2, 1, 5)).unionByName(changed(twice, 3, 2, 7))


def lines_first(spark, sf_dir, lines) -> DataFrame:
    return lines.where(F.col("l_shipdate") < at(CUT))


def lines_second(spark, sf_dir, lines) -> DataFrame:
    """Later lines, and earlier ones that were returned."""
    returned = (F.col("l_shipdate") < at(CUT)) & (F.col("l_returnflag") == "R")
    again = lines.where(returned).withColumns(
        {
            "l_quantity": F.col("l_quantity") + 1,
            "l_extendedprice": F.lit(10.0),
            "l_tax": F.lit(0.5),
        }
    )
    return lines.where(F.col("l_shipdate") >= at(CUT)).unionByName(again)


# Logs and rules


def sync_log(spark, sf_dir) -> DataFrame:
    return raw(spark, sf_dir, "events").select(
        F.col("event_id").alias("sync_id"),
        F.when(F.col("user_id") % 2 == 0, "website").otherwise("marketplace").alias("channel"),
        F.lit("scheduled").alias("sync_type"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.expr("interval 5 minutes")).alias("completed_at"),
        F.floor("value").cast("long").alias("records_ingested"),
        F.lit(0).cast("long").alias("records_failed"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error_detail"),
    )


def audit_log(spark, sf_dir) -> DataFrame:
    return raw(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"),
        "user_id",
        F.col("event_type").alias("action"),
        F.col("props").alias("resource"),
        F.lit(None).cast("string").alias("ip_address"),
        F.lit(None).cast("string").alias("detail"),
        F.col("ts").alias("created_at"),
    )


def users(spark, sf_dir) -> DataFrame:
    return raw(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))


def alert_events(spark, sf_dir) -> DataFrame:
    return (
        raw(spark, sf_dir, "events")
        .select(
            F.col("event_id"),
            (1 + F.col("event_id") % 2).cast("int").alias("rule_id"),
            (F.lit(CHANNEL_ID[WEBSITE] * KEY_SPAN) + F.col("event_id") % 200).alias("product_id"),
            F.col("ts").alias("triggered_at"),
            F.lit(None).cast("string").alias("detail"),
            F.lit(True).alias("email_sent"),
        )
    )


def report_catalogue(spark, sf_dir) -> DataFrame:
    return raw(spark, sf_dir, "events").select(
        F.col("event_id").alias("report_id"),
        F.col("event_type").alias("report_type"),
        F.lit("xlsx").alias("format"),
        F.col("props").alias("parameters"),
        F.lit(None).cast("string").alias("file_path"),
        F.col("ts").alias("generated_at"),
        F.col("user_id").cast("int").alias("generated_by"),
        F.lit(None).cast("string").alias("schedule"),
    )


RULES_CREATED = dt.datetime(2001, 1, 1)


def alert_rules(spark) -> DataFrame:
    """The default rules, and one each of: revenue change, one channel's orders, switched off, unknown type."""
    extra = [
        (4, "revenue_spike", "Website revenue", Decimal("10"), 1, None, True, 24, None, RULES_CREATED),
        (5, "no_orders", "Marketplace orders", Decimal("1"), 2, None, True, 24, "ops@example.org", RULES_CREATED),
        (6, "low_stock", "Switched off", Decimal("50"), None, None, False, 24, None, RULES_CREATED),
        (7, "price_drop", "Unknown", Decimal("1"), None, None, True, 24, None, RULES_CREATED),
        (8, "revenue_spike", "All revenue", Decimal("10"), None, None, True, 24, None, RULES_CREATED),
    ]
    return seeds.alert_rules(spark, RULES_CREATED).unionByName(fixed_table(spark, extra, schemas.ALERT_RULE))


def supplier_rules(spark, sf_dir) -> DataFrame:
    """A rule table that grows with the data: one stock rule per supplier."""
    return raw(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("rule_id"),
        F.lit("low_stock").alias("rule_type"),
        F.concat(F.lit("Stock of "), F.col("s_name")).alias("rule_name"),
        (F.col("s_nationkey") % 6).cast("decimal(12,2)").alias("threshold"),
        F.lit(None).cast("int").alias("channel_id"),
        F.lit(None).cast("long").alias("category_id"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
        F.lit(24).alias("cooldown_hours"),
        F.lit(None).cast("string").alias("notify_email"),
        (F.lit("2001-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("s_nationkey"))).alias("created_at"),
    )


# Shop tables that the sample cannot show.
ABSENT = ("stock_statuses",)


def deep_categories(spark, sf_dir) -> DataFrame:
    """Customers as a category tree: a binary heap of ids, with some links to nowhere and some in a circle."""
    key = F.col("c_custkey")
    parent = (
        F.when(key == 0, F.lit(0))
        .when(key % 97 == 5, key + 100_000_000)
        .when(key % 89 == 7, key + 1)
        .otherwise(F.expr("(c_custkey + 1) div 2"))
    )
    return raw(spark, sf_dir, "customer").select(
        (key + 1).alias("category_id"), F.col("c_name").alias("name"), parent.alias("parent_id"), F.lit(0).alias("sort_order")
    )


def stock_statuses(spark) -> DataFrame:
    return fixed_table(spark, [(7, 1, "In stock"), (7, 2, "На складі")], schemas.SHOP["stock_statuses"])


def days(spark) -> DataFrame:
    return calendar(spark, FIRST_DAY, LAST_DAY)


# Staging and star schema

STAGED = {
    "orders": staging.WEBSITE_ORDERS,
    "order_lines": staging.WEBSITE_ORDER_LINES,
    "products": staging.WEBSITE_PRODUCTS,
    "categories": staging.WEBSITE_CATEGORIES,
    "manufacturers": staging.WEBSITE_MANUFACTURERS,
    "customers": staging.WEBSITE_CUSTOMERS,
    "marketplace_orders": staging.MARKETPLACE_ORDERS,
    "marketplace_order_lines": staging.MARKETPLACE_ORDER_LINES,
}


def _staging(spark, sf_dir) -> TableStore:
    """The store of the staging tables after a first load, which the others share."""
    key = (spark.sparkContext.applicationId, sf_dir, "staging")
    if key not in _WRITTEN:
        _WRITTEN[key] = new_store(spark, sf_dir, "staging")
    return _WRITTEN[key]


def staged(spark, sf_dir, name: str) -> DataFrame:
    """A staging table after a first load, stored once per session and data set."""
    store, table = _staging(spark, sf_dir), STAGED[name]
    read = shop_reader(spark, sf_dir)
    batches = {
        "orders": lambda: shop.coerce_orders(website_orders(spark, sf_dir)),
        "order_lines": lambda: shop.coerce_order_lines(website_lines(spark, sf_dir)),
        "products": lambda: shop.coerce_products(shop.products(read, EVERYTHING)),
        "categories": lambda: shop.coerce_categories(shop.categories(read)),
        "manufacturers": lambda: shop.publishers(read),
        "customers": lambda: shop.coerce_customers(shop.customers(read, EVERYTHING)),
        "marketplace_orders": lambda: marketplace_orders(spark, sf_dir),
        "marketplace_order_lines": lambda: marketplace_lines(spark, sf_dir),
    }
    if store.read(table.name) is None:
        rows = stage(None, batches[name](), table, RUN_AT)
        if table.block is not None:
            rows = rows.withColumn(staging.BLOCK, F.expr(f"{table.keys[0]} div {table.block}"))
        store.write(table.name, rows)
    return store.read(table.name).drop(staging.BLOCK)


_WRITTEN: dict[tuple[str, str, str], object] = {}


def _folder(spark, sf_dir: str, name: str) -> str:
    data_set = sf_dir.rstrip("/").rsplit("/", 1)[-1]
    stamp = dt.datetime.now().strftime("%H%M%S%f")
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{data_set}/{name}-{stamp}"


def _once(spark, sf_dir, name, write):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = _folder(spark, sf_dir, name)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def new_store(spark, sf_dir, name: str) -> TableStore:
    return TableStore(spark, _folder(spark, sf_dir, name))


def _staged_store(spark, sf_dir, name: str) -> TableStore:
    store, loaded = new_store(spark, sf_dir, name), _staging(spark, sf_dir)
    together(*[lambda k=key: staged(spark, sf_dir, k) for key in STAGED])
    store.share(loaded, [table.name for table in STAGED.values()])
    return store


def mart(spark: SparkSession, sf_dir: str) -> Mart:
    """The star schema of a first load, written once per session and data set."""
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir, "mart")
    if key not in _WRITTEN:
        store = _staged_store(spark, sf_dir, "mart")
        _WRITTEN[key] = refresh.transform(
            store, days(spark), seeds.sales_channels(spark), seeds.order_statuses(spark), RUN_AT, stock_statuses(spark)
        ).mart
    return _WRITTEN[key]


SHORT_CALENDAR = (dt.date(1996, 1, 1), dt.date(2000, 12, 31))


def redriven_store(spark, sf_dir) -> TableStore:
    """A store after a transform with a calendar too short for all orders and a second one with the whole calendar.
    The status that a third of the marketplace orders has is no seed here."""
    key = (spark.sparkContext.applicationId, sf_dir, "redriven")
    if key not in _WRITTEN:
        store = _staged_store(spark, sf_dir, "redriven")
        known = seeds.order_statuses(spark).where("source_id <> 45")
        channels = seeds.sales_channels(spark)
        refresh.transform(store, calendar(spark, *SHORT_CALENDAR), channels, known, RUN_AT, stock_statuses(spark))
        first = refresh.quarantine(store).groupBy("kind", "violation").agg(F.count("*").alias("first_run"))
        store.write("first_run", first)
        mark = refresh.Mark(RUN_AT, store.newest(refresh.STAGED))
        refresh.transform(store, days(spark), channels, known, SECOND_RUN_AT, stock_statuses(spark), mark)
        _WRITTEN[key] = store
    return _WRITTEN[key]


def cycled_store(spark, sf_dir) -> TableStore:
    """A store after two scheduled runs: early website orders and half of the landed files, then all that is new."""
    key = (spark.sparkContext.applicationId, sf_dir, "cycled")
    if key not in _WRITTEN:
        store = new_store(spark, sf_dir, "cycled")
        folder = f"{store.root}/landing"
        read, whole = shop_reader(spark, sf_dir), spark.read.text(landing_folder(spark, sf_dir))
        half = F.pmod(F.xxhash64("value"), F.lit(2))
        early = lambda name: read(name).where(F.col("date_modified") < at(CUT)) if name == "orders" else read(name)
        start = fixed_table(
            spark, [(0, c, "historical", EVERYTHING, EVERYTHING, 0, 0, "success", None) for c in CHANNEL_ID], schemas.SYNC_LOG
        )
        store.append(refresh.SYNC_LOG, start)
        for number, (reader, run_at) in enumerate([(early, CUT), (read, RUN_AT)]):
            whole.where(half == number).write.mode("append").text(folder, "gzip")
            refresh.cycle(
                store, reader, folder, run_at, days(spark), seeds.sales_channels(spark), seeds.order_statuses(spark),
                stock_statuses(spark),
            )
        _WRITTEN[key] = store
    return _WRITTEN[key]
