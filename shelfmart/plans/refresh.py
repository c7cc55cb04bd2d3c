"""Loads and the transform: batches into staging, staging into the star schema, each step one stored snapshot."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, functions as F

from shelfmart import schemas, seeds
from shelfmart.functions.calendar import at
from shelfmart.functions.keys import CHANNEL_ID, MARKETPLACE, WEBSITE
from shelfmart.operators.constants import fixed_table
from shelfmart.operators.quarantine import VIOLATION, accepted, rejected
from shelfmart.plans import dimensions, facts, staging
from shelfmart.plans.mart import Mart
from shelfmart.plans.staging import BLOCK, StagingTable, collapsed, stored_version
from shelfmart.sources import marketplace, shop
from shelfmart.sources.watermark import sync_record, watermarks
from shelfmart.storage import Merged, TableStore, together

logger = logging.getLogger(__name__)

SYNC_LOG = "sync_log"
TRANSFORM_LOG, TRANSFORM_LOG_SCHEMA = "transform_log", "run_at timestamp_ntz, version long"
COUNT_LOG = "transform_counts"
COUNT_LOG_SCHEMA = "run_at timestamp_ntz, position int, step string, inserted long, updated long, rejected long"


@dataclass(frozen=True)
class Landed:
    rows: DataFrame
    staged: int
    failed: int


def _violation(batch: DataFrame, table: StagingTable) -> DataFrame:
    """A row without a key breaks the last rule of a batch."""
    keyless = F.when(reduce(or_, [F.col(key).isNull() for key in table.keys]), "key_null")
    return batch.withColumn(VIOLATION, F.coalesce(VIOLATION, keyless) if VIOLATION in batch.columns else keyless)


def _split(store: TableStore, name: str, flagged: DataFrame) -> Landed:
    """Flagged rows stored once and counted while they are written. `rows` are all of them."""
    bad = F.col(VIOLATION).isNotNull()
    seen = Observation()
    rows, _ = store.spool(name, flagged.observe(seen, F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad")))
    return Landed(rows, seen.get["good"], seen.get["bad"])


def land(store: TableStore, table: StagingTable, batch: DataFrame, run_at: dt.datetime) -> Landed:
    """Store a batch once, count it while writing, and merge the stored rows into the staging table.

    Rows that break a rule or lack a key are counted and set aside.
    """
    landed = _split(store, table.name, _violation(batch, table))
    if landed.failed:
        store.append(f"rejected_{table.name}", rejected(landed.rows))
    good = accepted(landed.rows)
    rows = collapsed(good, table, run_at)
    if table.block is None:
        store.merge(table.name, rows, table.keys, table.updated, version_by=stored_version(table))
    else:
        rows = rows.withColumn(BLOCK, F.expr(f"{table.keys[0]} div {table.block}"))
        store.merge(
            table.name, rows, table.keys, table.updated, BLOCK, table.keys[0], fixed_by_key=True,
            version_by=stored_version(table),
        )
    return Landed(good, landed.staged, landed.failed)


def _logged(
    store: TableStore, channel: str, run_at: dt.datetime, sync_type: str, work: Callable[[], tuple[int, int]]
) -> None:
    """Run a load and log it, failed ones too. The row carries the start of the run as its end, so that the next
    window begins where this one's reads did."""

    def log(ingested, failed, status, error=None):
        counts = store.spark.range(1).select(
            F.lit(ingested).alias("records_ingested"), F.lit(failed).alias("records_failed")
        )
        sync_id = int(run_at.timestamp() * 1000)
        record = sync_record(counts, sync_id, channel, run_at, run_at, status, error, sync_type)
        store.append(SYNC_LOG, record)

    try:
        ingested, failed = work()
    except Exception as error:
        log(0, 0, "failed", str(error))
        raise
    log(ingested, failed, "success")


def load_website(
    store: TableStore,
    read: shop.Reader,
    since: dt.datetime,
    run_at: dt.datetime,
    until: dt.datetime | None = None,
    sync_type: str = "scheduled",
) -> None:
    """Website batch into staging; the log counts orders and products."""

    def orders():
        changed = shop.coerce_orders(shop.orders(read, since, until))
        found = land(store, staging.WEBSITE_ORDERS, changed, run_at)
        lines = shop.coerce_order_lines(shop.lines_since(read, found.rows, since, until))
        landed = land(store, staging.WEBSITE_ORDER_LINES, lines, run_at)
        store.drop_spooled(found.rows, landed.rows)
        return found.staged

    def work():
        n_orders, n_products, *_ = together(
            orders,
            lambda: land(
                store, staging.WEBSITE_PRODUCTS, shop.coerce_products(shop.products(read, since, until)), run_at
            ).staged,
            lambda: land(store, staging.WEBSITE_CATEGORIES, shop.coerce_categories(shop.categories(read)), run_at),
            lambda: land(store, staging.WEBSITE_MANUFACTURERS, shop.publishers(read), run_at),
            lambda: land(
                store, staging.WEBSITE_CUSTOMERS, shop.coerce_customers(shop.customers(read, since, until)), run_at
            ),
        )
        return n_orders + n_products, 0

    _logged(store, WEBSITE, run_at, sync_type, work)


PAGE_LOG = "rejected_pages"


def stage_marketplace(
    store: TableStore, pages: DataFrame, run_at: dt.datetime, since: dt.date | None = None, until: dt.date | None = None
) -> tuple[int, int]:
    """Pages into staging. Their text is parsed once; orders and lines are taken from the stored pages. Pages that are
    no documents and rows that break a rule are set aside, the rest of their batch goes on. Staged orders and set-aside
    rows are returned."""
    seen = Observation()
    bad = marketplace.failed(pages)
    landed, _ = store.spool("pages", pages.observe(seen, F.count_if(bad).alias("bad")))
    if seen.get["bad"]:
        store.append(PAGE_LOG, marketplace.failed_pages(landed))
    orders, lines = together(
        lambda: land(store, staging.MARKETPLACE_ORDERS, marketplace.flagged_orders(landed, since, until), run_at),
        lambda: land(store, staging.MARKETPLACE_ORDER_LINES, marketplace.flagged_order_lines(landed, since, until), run_at),
    )
    store.drop_spooled(landed, orders.rows, lines.rows)
    return orders.staged, orders.failed + lines.failed


def stage_new_files(
    store: TableStore, folder: str, run_at: dt.datetime, max_files: int | None = None, timeout: int | None = None
) -> tuple[int, int]:
    """`stage_marketplace` for the files of a folder that this store has not taken before."""
    totals = [0, 0]

    def merge(pages: DataFrame, batch_id: int) -> None:
        staged, failed = stage_marketplace(store, pages, run_at)
        totals[0] += staged
        totals[1] += failed

    checkpoint = f"{store.root}/_checkpoints/marketplace"
    marketplace.each_new_batch(store.spark, folder, checkpoint, merge, max_files, timeout)
    return totals[0], totals[1]


def load_marketplace(
    store: TableStore,
    pages: DataFrame | str,
    run_at: dt.datetime,
    since: dt.date | None = None,
    until: dt.date | None = None,
    sync_type: str = "scheduled",
) -> None:
    """Pages of a frame, or those files of a landing folder that no load has taken before."""
    if isinstance(pages, str):
        work = lambda: stage_new_files(store, pages, run_at)
    else:
        work = lambda: stage_marketplace(store, pages, run_at, since, until)
    _logged(store, MARKETPLACE, run_at, sync_type, work)


def _start_empty(store: TableStore, run_at: dt.datetime) -> None:
    """Empty staging tables for those no load has written yet, so that the transform of the others goes on."""
    spark = store.spark
    none = lambda name: spark.createDataFrame([], schemas.SHOP[name])
    pages = spark.createDataFrame([], schemas.PAGE)
    orders = shop.orders(none, run_at)
    first = {
        staging.WEBSITE_ORDERS: lambda: shop.coerce_orders(orders),
        staging.WEBSITE_ORDER_LINES: lambda: shop.coerce_order_lines(shop.order_lines(none, orders)),
        staging.WEBSITE_PRODUCTS: lambda: shop.coerce_products(shop.products(none, run_at)),
        staging.WEBSITE_CATEGORIES: lambda: shop.coerce_categories(shop.categories(none)),
        staging.WEBSITE_MANUFACTURERS: lambda: shop.publishers(none),
        staging.WEBSITE_CUSTOMERS: lambda: shop.coerce_customers(shop.customers(none, run_at)),
        staging.MARKETPLACE_ORDERS: lambda: marketplace.orders(pages),
        staging.MARKETPLACE_ORDER_LINES: lambda: marketplace.order_lines(pages),
    }
    for table, rows in first.items():
        if store.read(table.name) is None:
            land(store, table, rows(), run_at)


@dataclass(frozen=True)
class Run:
    """What a transform left: the tables to read, and what its steps did (COUNT_LOG_SCHEMA)."""

    mart: Mart
    counts: DataFrame


@dataclass(frozen=True)
class Mark:
    """What a transform has worked through: rows staged up to its time, in folders up to a version of the store."""

    run_at: dt.datetime
    version: int = 0


def cycle(
    store: TableStore,
    read: shop.Reader,
    pages: DataFrame | str,
    run_at: dt.datetime,
    dim_date: DataFrame,
    dim_sales_channel: DataFrame,
    seed_statuses: DataFrame,
    stock_statuses: DataFrame | None = None,
    sync_type: str = "scheduled",
) -> Run:
    """One scheduled run: both loads, then the transform of what they changed. The website is read from its high-water
    mark, and of a landing folder only files that are new. A source that fails is logged and does not hold up the other.
    """
    channels = fixed_table(store.spark, [(WEBSITE,), (MARKETPLACE,)], "channel string")
    marks = watermarks(store.log(SYNC_LOG, schemas.SYNC_LOG), channels).toLocalIterator()
    since = {row["channel"]: row["since"] for row in marks}
    loads = {
        WEBSITE: lambda: load_website(store, read, since[WEBSITE], run_at, sync_type=sync_type),
        # no filter on the day of creation: an order of any age may have changed
        MARKETPLACE: lambda: load_marketplace(store, pages, run_at, sync_type=sync_type),
    }

    def attempt(channel):
        try:
            loads[channel]()
        except Exception:
            logger.exception("load of %s failed", channel)

    together(*[lambda c=channel: attempt(c) for channel in loads])
    _start_empty(store, run_at)
    log = store.log(TRANSFORM_LOG, TRANSFORM_LOG_SCHEMA)
    done = log.agg(F.max(F.struct("run_at", "version")).alias("done")).first()["done"]
    version = store.newest(STAGED)
    after = Mark(done["run_at"], done["version"]) if done else None
    run = transform(store, dim_date, dim_sales_channel, seed_statuses, run_at, stock_statuses, after)
    entry = store.spark.range(1).select(at(run_at).alias("run_at"), F.lit(version).cast("long").alias("version"))
    store.append(TRANSFORM_LOG, entry)
    return run


# Seeds, loaded once and completed by every later run

CHANNELS, RULES = "sales_channels", "alert_rules"


def seed(store: TableStore, created_at: dt.datetime, website_url: str | None = None, marketplace_url: str | None = None) -> None:
    """Sales channels, order statuses and alert rules a store does not have yet. What is there stays as it is: rules are
    told apart by type and name, so that a changed threshold is kept."""
    spark = store.spark
    store.merge(CHANNELS, seeds.sales_channels(spark, website_url, marketplace_url), ["channel_id"], [])
    store.merge("dim_order_status", seeds.order_statuses(spark), ["source_id", "source_channel"], [])
    wanted, rules = seeds.alert_rules(spark, created_at), store.read(RULES)
    store.write(RULES, wanted if rules is None else seeds.with_missing_rules(rules, wanted))


# Rows that could not be loaded yet, by kind: the staging table and its key

PENDING_SCHEMA = "source_id long, violation string, since timestamp_ntz"
RESOLVED_LOG, RESOLVED_SCHEMA = "quarantine_resolved", f"kind string, {PENDING_SCHEMA}, resolved_at timestamp_ntz"

STAGED = [
    t.name
    for t in (
        staging.WEBSITE_ORDERS, staging.WEBSITE_ORDER_LINES, staging.WEBSITE_PRODUCTS, staging.WEBSITE_CATEGORIES,
        staging.WEBSITE_MANUFACTURERS, staging.WEBSITE_CUSTOMERS, staging.MARKETPLACE_ORDERS,
        staging.MARKETPLACE_ORDER_LINES,
    )
]


def pending(store: TableStore, kind: str) -> DataFrame | None:
    """Staged rows of a kind that are not loaded: their key, the rule they break and since when."""
    return store.read(f"pending_{kind}")


def quarantine(store: TableStore) -> DataFrame:
    """All rows that are staged and not loaded, of every kind."""
    whole = store.spark.createDataFrame([], f"kind string, {PENDING_SCHEMA}")
    for kind in KINDS:
        rows = pending(store, kind)
        if rows is not None:
            whole = whole.unionByName(rows.select(F.lit(kind).alias("kind"), "*"))
    return whole


def settle(store: TableStore, kind: str, checked: DataFrame, key: str, run_at: dt.datetime, failed: int) -> None:
    """Bring the pending rows of a kind up to date with the rows a run has checked (one per key, with their violation).
    What is loaded now leaves the table and is logged as resolved, what still breaks a rule keeps its first day, and
    rows that were not checked stay."""
    old = pending(store, kind)
    if old is None and not failed:
        return
    seen = checked.select(F.col(key).cast("long").alias("source_id"), F.col(VIOLATION).alias("_now"), F.lit(True).alias("_seen"))
    if old is None:
        old = store.spark.createDataFrame([], PENDING_SCHEMA)
    both = old.join(seen, "source_id", "full_outer")
    broken = F.when(F.col("_seen"), F.col("_now")).otherwise(F.col(VIOLATION))
    rows = both.where(F.col("since").isNotNull() | F.col("_now").isNotNull()).select(
        "source_id", broken.alias("_broken"), VIOLATION, "since"
    )
    rows, _ = store.spool(f"settled_{kind}", rows)
    since = F.coalesce("since", at(run_at)).alias("since")
    still = rows.where(F.col("_broken").isNotNull())
    store.write(f"pending_{kind}", still.select("source_id", F.col("_broken").alias(VIOLATION), since))
    gone = rows.where(F.col("_broken").isNull())
    store.append(
        RESOLVED_LOG,
        gone.select(F.lit(kind).alias("kind"), "source_id", VIOLATION, "since", at(run_at).alias("resolved_at")),
    )
    store.drop_spooled(rows)


def _due(store: TableStore, kind: str, table: StagingTable, after: Mark | None) -> DataFrame:
    """Staged rows a transform has to look at: those staged since, from folders written since, and those pending, from
    the blocks of their keys."""
    staged = store.read(table.name).drop("raw_json")
    if after is None:
        return staged
    fresh = store.read_since(table.name, after.version).drop("raw_json").where(F.col("ingested_at") > at(after.run_at))
    waiting = pending(store, kind)
    if waiting is None:
        return fresh
    key = table.keys[0]
    keys = waiting.select(F.col("source_id").alias(key))
    if BLOCK in staged.columns:
        blocks = [r[0] for r in keys.select(F.expr(f"{key} div {table.block}")).distinct().toLocalIterator()]
        staged = staged.where(F.col(BLOCK).isin(blocks))
    again = staged.join(keys, key, "left_semi").join(fresh.select(key), key, "left_anti")
    return fresh.unionByName(again)


# Which month an order is of, kept by blocks of source ids, so that lines find their orders without the whole fact

ORDER_INDEX = "order_index"
INDEX_KEYS = ["channel_id", "source_order_id"]


def _index_block(channel_id: Column, source_order_id: Column) -> Column:
    return channel_id * 1_000_000 + F.floor(source_order_id / staging.ORDER_BLOCK)


def _keep_index(store: TableStore, orders: DataFrame) -> None:
    block = _index_block(F.col("channel_id"), F.col("source_order_id")).cast("long").alias(BLOCK)
    rows = orders.select(*INDEX_KEYS, facts.MONTH, block)
    store.merge(ORDER_INDEX, rows, INDEX_KEYS, [], partition_by=BLOCK, sort_by="source_order_id", fixed_by_key=True)


def orders_of_lines(store: TableStore, lines: DataFrame, key: str, channel: str) -> DataFrame:
    """The fact of orders, cut down to the months that the orders of these lines are of: the index tells them from the
    blocks their ids lie in, and the months, as many as the calendar has at most, become a filter of the partitions."""
    orders, index = store.read("fact_orders"), store.read(ORDER_INDEX)
    channel_id = CHANNEL_ID[channel]
    ids = lines.select(F.col(key).cast("long").alias("source_order_id")).distinct()
    ids, _ = store.spool("order_ids", ids)
    blocks = [r[0] for r in ids.select(_index_block(F.lit(channel_id), F.col("source_order_id"))).distinct().toLocalIterator()]
    # an empty fact has no partitions
    if facts.MONTH not in orders.columns or BLOCK not in index.columns:
        store.drop_spooled(ids)
        return orders
    known = index.where(F.col(BLOCK).isin(blocks) & (F.col("channel_id") == channel_id))
    months = known.join(ids, "source_order_id", "left_semi").select(facts.MONTH).distinct()
    found = [r[0] for r in months.toLocalIterator()]
    store.drop_spooled(ids)
    return orders.where(F.col(facts.MONTH).isin(found))


def _keep_totals(store: TableStore, merged: Merged) -> DataFrame:
    """Totals by month, made anew for the months a merge has touched; what those months summed up to before goes."""
    old = store.read(facts.TOTALS)
    if old is None or merged.parts is None:
        return store.write(facts.TOTALS, facts.month_totals(merged.table))
    if not merged.parts:
        return old
    touched = F.col(facts.MONTH).isin(merged.parts)
    fresh = facts.month_totals(merged.table.where(touched))
    return store.write(facts.TOTALS, old.where(~touched).unionByName(fresh))


def _keep_dimension(
    store: TableStore, name: str, incoming: DataFrame, keys: list[str], updates: list[str]
) -> tuple[DataFrame, tuple[int, int]]:
    """Merge a dimension; only blocks of ids with new or changed rows are written."""
    rows = dimensions.stored_form(incoming, keys[1], updates)
    stored = store.read(name)
    if stored is not None:
        rows = dimensions.changed_rows(stored, rows, keys)
    merged = store.merge(
        name, rows, keys, [*updates, dimensions.ROW_HASH], partition_by=dimensions.DIM_BLOCK, fixed_by_key=True
    )
    return dimensions.public(merged.table), merged.counts["all"]


KINDS = (
    "publishers", "categories", "products", "website_orders", "marketplace_orders", "website_lines", "marketplace_lines",
)


def transform(
    store: TableStore,
    dim_date: DataFrame,
    dim_sales_channel: DataFrame,
    seed_statuses: DataFrame,
    run_at: dt.datetime,
    stock_statuses: DataFrame | None = None,
    changed_after: Mark | None = None,
) -> Run:
    """Dimensions, then facts, from the staging tables of `store`. Facts are stored by month, dimensions by id.

    With `changed_after` only orders and lines staged since then are worked through, besides those that could not be
    loaded before, and only the months they touch are rewritten. Rows that break a rule, lack
    their order or have no root are recorded as pending (`quarantine`) and tried again by every run.
    """
    spark = store.spark
    if stock_statuses is None:
        stock_statuses = spark.createDataFrame([], schemas.SHOP["stock_statuses"])
    counts: list[tuple[str, int, int, int]] = []

    def checked(kind: str, flagged: DataFrame, key: str) -> Landed:
        found = _split(store, kind, flagged)
        settle(store, kind, found.rows, key, run_at, found.failed)
        return found

    def publishers():
        staged = store.read(staging.WEBSITE_MANUFACTURERS.name)
        found = checked("publishers", dimensions.flag_publishers(staged), "manufacturer_id")
        table, done = _keep_dimension(
            store, "dim_publisher", dimensions.publishers(staged), dimensions.PUBLISHER_KEYS, dimensions.PUBLISHER_UPDATES
        )
        return table, ("publishers", *done, found.failed)

    def categories():
        staged = store.read(staging.WEBSITE_CATEGORIES.name)
        lost = dimensions.rejected_categories(staged).select("category_id", F.col(VIOLATION).alias("_lost"))
        flagged = staged.select("category_id").join(lost, "category_id", "left").withColumnRenamed("_lost", VIOLATION)
        found = checked("categories", flagged, "category_id")
        table, done = _keep_dimension(
            store, "dim_category", dimensions.categories(staged), dimensions.CATEGORY_KEYS, dimensions.CATEGORY_UPDATES
        )
        return table, ("categories", *done, found.failed)

    def products():
        staged = store.read(staging.WEBSITE_PRODUCTS.name)
        found = checked("products", dimensions.flag_products(staged).select("product_id", VIOLATION), "product_id")
        table, done = _keep_dimension(
            store, "dim_product", dimensions.products(staged, publisher, category, stock_statuses, run_at),
            dimensions.PRODUCT_KEYS, dimensions.PRODUCT_UPDATES,
        )
        return table, ("products", *done, found.failed)

    def customers():
        table, done = _keep_dimension(
            store, "dim_customer", dimensions.customers(store.read(staging.WEBSITE_CUSTOMERS.name)),
            dimensions.CUSTOMER_KEYS, dimensions.CUSTOMER_UPDATES,
        )
        return table, ("customers", *done, 0)

    web_staged = _due(store, "website_orders", staging.WEBSITE_ORDERS, changed_after)
    mkt_staged = _due(store, "marketplace_orders", staging.MARKETPLACE_ORDERS, changed_after)

    def order_statuses():
        if store.read("dim_order_status") is None:
            store.write("dim_order_status", seed_statuses)
        seen = dimensions.website_statuses(web_staged).unionByName(dimensions.marketplace_statuses(mkt_staged))
        merged = store.merge("dim_order_status", seen, ["source_id", "source_channel"], [])
        return merged.table, ("order_statuses", *merged.counts["all"], 0)

    def checked_orders():
        days = store.write("dim_date", dim_date)
        web, mkt = together(
            lambda: checked("website_orders", facts.flag_website_orders(web_staged, days), "order_id"),
            lambda: checked(
                "marketplace_orders", facts.flag_marketplace_orders(mkt_staged, days), "marketplace_order_id"
            ),
        )
        return days, web, mkt

    (publisher, of_publishers), (category, of_categories), (customer, of_customers), (statuses, of_statuses), checks = (
        together(publishers, categories, customers, order_statuses, checked_orders)
    )
    days, web, mkt = checks
    product, of_products = products()
    counts += [of_publishers, of_categories, of_products, of_customers, of_statuses]
    of_channel = {c: F.col("channel_id") == CHANNEL_ID[c] for c in (WEBSITE, MARKETPLACE)}
    merged = store.merge(
        "fact_orders",
        facts.with_month(
            facts.both_channels(
                facts.website_orders(accepted(web.rows), customer, statuses),
                facts.marketplace_orders(accepted(mkt.rows), statuses),
            )
        ),
        facts.ORDER_KEYS,
        facts.ORDER_UPDATES,
        partition_by=facts.MONTH,
        sort_by="date_added",
        fixed_by_key=True,  # the day an order is created on never changes in staging
        version_by=["date_modified"],
        groups=of_channel,
    )
    orders = merged.table
    counts.append(("website_orders", *merged.counts[WEBSITE], web.failed))
    counts.append(("marketplace_orders", *merged.counts[MARKETPLACE], mkt.failed))
    touched = orders if merged.parts is None else orders.where(F.col(facts.MONTH).isin(merged.parts))
    totals, _ = together(lambda: _keep_totals(store, merged), lambda: _keep_index(store, touched))

    store.drop_spooled(web.rows, mkt.rows)

    def with_orders(kind, table, key, channel, flag_lines, placed):
        lines = _due(store, kind, table, changed_after)
        of_lines = orders if changed_after is None else orders_of_lines(store, lines, key, channel)
        return checked(kind, flag_lines(lines, of_lines).select(*placed, VIOLATION), table.keys[0])

    web, mkt = together(
        lambda: with_orders(
            "website_lines", staging.WEBSITE_ORDER_LINES, "order_id", WEBSITE, facts.flag_website_lines,
            facts.WEBSITE_PLACED,
        ),
        lambda: with_orders(
            "marketplace_lines", staging.MARKETPLACE_ORDER_LINES, "marketplace_order_id", MARKETPLACE,
            facts.flag_marketplace_lines, facts.MARKETPLACE_PLACED,
        ),
    )
    merged = store.merge(
        "fact_order_lines",
        facts.with_month(
            facts.both_channels(
                facts.placed_website_lines(accepted(web.rows), product),
                facts.placed_marketplace_lines(accepted(mkt.rows), product),
            )
        ),
        facts.LINE_KEYS,
        facts.LINE_UPDATES,
        partition_by=facts.MONTH,
        sort_by="order_id",
        fixed_by_key=True,
        groups=of_channel,
    )
    store.drop_spooled(web.rows, mkt.rows)
    counts.append(("website_lines", *merged.counts[WEBSITE], web.failed))
    counts.append(("marketplace_lines", *merged.counts[MARKETPLACE], mkt.failed))
    mart = Mart(
        days, dim_sales_channel, category, publisher, product, customer, statuses, orders, merged.table, totals
    )
    rows = fixed_table(
        spark, [(run_at, position, *row) for position, row in enumerate(counts, start=1)], COUNT_LOG_SCHEMA
    )
    store.append(COUNT_LOG, rows)
    return Run(mart, rows)
