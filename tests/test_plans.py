"""Physical plans of the registered queries: join kinds, pushdown, pruning, no Python in the data path."""

import datetime as dt
import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries as every_query
from shelfmart.bindings import tables as T
from shelfmart.bindings.queries import registry as queries
from shelfmart.operators.merge import merge_batch
from shelfmart.plans import reports
from shelfmart.sources import shop
from shelfmart.storage import TableStore

UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow", "PythonUDF")


@pytest.fixture
def plan(capsys):
    def text(df):
        df.explain("formatted")
        return capsys.readouterr().out

    return text


# The windows: months ranked per channel, running sums over stock figures.
WINDOWED = {
    "alert_revenue_swing", "alert_events_new", "alert_notifications", "alert_dispatch",
    "kpi_low_stock", "kpi_low_stock_supplier_rules", "kpi_summary", "dashboard_bundle",
}


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_nested_loops_or_python(spark, small, plan, name):
    text = plan(queries()[name](spark, small))
    assert [word for word in UNWANTED if word in text] == []
    if re.search(r"\bWindow\b", text):
        assert name in WINDOWED


def test_category_total_is_taken_from_sums(spark, small, plan):
    text = plan(queries()["sales_by_category"](spark, small))
    assert "Window" not in text
    assert "Subquery:" in text


def test_months_are_ranked_per_channel(spark, small, plan):
    text = plan(queries()["alert_revenue_swing"](spark, small))
    assert re.search(r"windowspecdefinition\(scope", text)


def test_incremental_read_is_pushed_down(spark, small, plan):
    text = plan(queries()["src_orders_incremental"](spark, small))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(o_orderdate", text)
    assert re.search(r"PushedFilters: .*LessThan\(o_orderpriority", text)


def test_columns_are_pruned(spark, small, plan):
    text = plan(shop.orders(T.shop_reader(spark, small), T.EVERYTHING).select("order_id"))
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>", text)


def test_reports_read_only_their_months(spark, small, plan):
    text = plan(reports.kpi_mtd(T.mart(spark, small), T.AS_OF))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(order_month,200107\).*LessThanOrEqual\(order_month,200107\)", text)
    assert "/fact_orders/" not in text
    text = plan(reports.revenue_by_channel(T.mart(spark, small), dt.date(2001, 7, 2), dt.date(2001, 7, 20)))
    assert re.search(r"PartitionFilters: .*order_month#\d+ >= 200107.*order_month#\d+ <= 200107", text)
    text = plan(reports.top_books(T.mart(spark, small), T.FIRST_DAY, T.AS_OF.date()))
    assert len(re.findall(r"PartitionFilters: \[isnotnull\(order_month", text)) == 2


def test_small_batch_does_not_shuffle_its_target(spark, plan, tmp_path):
    spark.range(1000).selectExpr("id", "id AS value", "id AS other").write.parquet(str(tmp_path / "target"))
    spark.range(3).selectExpr("id", "-id AS value", "id AS other").write.parquet(str(tmp_path / "batch"))
    target, batch = spark.read.parquet(str(tmp_path / "target")), spark.read.parquet(str(tmp_path / "batch"))
    text = plan(merge_batch(target, batch, ["id"], ["value"]))
    assert "SortMergeJoin" not in text
    assert not re.search(r"Exchange\b.*hashpartitioning", text)


def test_well_compressed_keys_are_not_broadcast(spark, plan, tmp_path):
    """Millions of keys in a file of less than a byte a row would be a hundred times as large on the driver."""
    store = TableStore(spark, str(tmp_path))
    keys = store.write("keys", spark.range(4_000_000).selectExpr("id AS key", "'website' AS kind", "id % 3 AS what"))
    rows = store.write("rows", spark.range(200_000).selectExpr("id AS key", "uuid() AS text"))
    assert sum(f.stat().st_size for f in (tmp_path / "keys").rglob("*.parquet")) < 10 << 20
    assert "BroadcastExchange" not in plan(rows.join(keys.select("key", "kind"), "key", "left_semi"))
    few = store.write("few", spark.range(36).selectExpr("id AS key", "'x' AS label"))
    assert "BroadcastExchange" in plan(rows.join(few, "key", "left"))


def test_sums_not_orders_are_shuffled_by_status(spark, small, plan):
    """With a status table too large to broadcast the look-up stays above the sums by status."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        text = plan(reports.seasonal_trend(T.mart(spark, small), T.FIRST_DAY + dt.timedelta(days=1), T.LAST_DAY))
    finally:
        spark.conf.set(limit, before)
    shuffled = text[text.index("LeftSemi") :]
    assert shuffled.index("HashAggregate") < shuffled.index("Scan parquet")
    assert "hashpartitioning(status_id" in text


def test_entry_and_names(spark):
    assert entry(spark).columns == ["year", "month", "month_name", "channel_name", "total_revenue_uah", "order_count"]
    assert set(oracle_sql()) <= set(every_query())
