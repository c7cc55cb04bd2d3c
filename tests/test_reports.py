"""Reports, alerts and history on hand-made facts."""

import datetime as dt
import json
import re
from decimal import Decimal

import pytest

from shelfmart import schemas, seeds
from shelfmart.functions.calendar import calendar
from shelfmart.functions.keys import KEY_SPAN
from shelfmart.plans import alerts, export, facts, history, reports
from shelfmart.plans.mart import Mart
from shelfmart.storage import TableStore
from tests.conftest import rows

W, M = KEY_SPAN, 2 * KEY_SPAN
DONE = {1: W + 5, 2: M + 6}
OPEN = {1: W + 1, 2: M + 1}
ORDER = "order_id long, channel_id int, date_id int, status_id long, total_amount_uah decimal(15,4), date_added timestamp_ntz"
LINE = "order_id long, product_id long, category_id long, channel_id int, date_id int, quantity_sold int, line_total_uah decimal(15,4)"


def build(spark, orders, lines=(), products=None, categories=None):
    """Orders: (id, channel, time, amount, done); lines: (order id, product, category, quantity, amount)."""
    placed = {o[0]: (o[1], dt.datetime.fromisoformat(o[2])) for o in orders}
    key = {n: int(t.strftime("%Y%m%d")) for n, (_, t) in placed.items()}
    order_rows = [
        (n, ch, key[n], (DONE if done else OPEN)[ch], None if amount is None else Decimal(amount), placed[n][1])
        for n, ch, _, amount, done in orders
    ]
    line_rows = [(n, p, c, placed[n][0], key[n], q, Decimal(a)) for n, p, c, q, a in lines]
    products = products or [(1, "One", 10, "active", 1), (2, "Two", 5, "active", None), (3, "Three", 1, "inactive", 2), (4, "One", 0, "active", 1)]
    categories = categories or [(1, "Tales", "Kids"), (2, "Kids", None)]
    fact_orders = facts.with_month(spark.createDataFrame(order_rows, ORDER))
    return Mart(
        dim_date=calendar(spark, dt.date(2019, 1, 1), dt.date(2021, 12, 31)),
        dim_sales_channel=seeds.sales_channels(spark),
        dim_category=spark.createDataFrame(categories, "category_id long, name string, parent_name string"),
        dim_publisher=None,
        dim_product=spark.createDataFrame(products, "product_id long, title string, quantity_in_stock int, status string, category_id long").selectExpr(
            "*", "CAST(NULL AS string) author", "CAST(NULL AS string) isbn", "CAST(1 AS decimal(15,4)) price", "CAST(NULL AS string) stock_status"
        ),
        dim_customer=None,
        dim_order_status=seeds.order_statuses(spark),
        fact_orders=fact_orders,
        fact_order_lines=facts.with_month(spark.createDataFrame(line_rows, LINE)),
        order_months=facts.month_totals(fact_orders),
    )


ORDERS = [
    (1, 1, "2020-01-31 23:59:59", "10", True),
    (2, 2, "2020-02-01 00:00:00", "20", True),
    (3, 1, "2020-02-15 12:00:00", "30", False),
    (4, 1, "2020-02-29 00:00:00", "40", True),
    (5, 1, "2020-02-29 00:00:01", "50", True),
]
LINES = [(1, 1, 1, 1, "10"), (2, 2, None, 5, "20"), (3, 1, 1, 100, "30"), (4, 3, 2, 4, "25"), (4, 1, 1, 1, "15"), (5, 4, 1, 9, "50")]
FEB, END = dt.date(2020, 2, 1), dt.date(2020, 2, 29)


@pytest.fixture(scope="module")
def mart(spark):
    return build(spark, ORDERS, LINES)


def test_revenue_has_every_month_and_channel(mart):
    found = reports.revenue_by_channel(mart, dt.date(2020, 1, 15), dt.date(2020, 3, 1)).collect()
    assert [(r["month"], r["channel_name"], r["total_revenue_uah"], r["order_count"]) for r in found] == [
        (1, "Marketplace", 0, 0), (1, "Website", 10, 1), (2, "Marketplace", 20, 1), (2, "Website", 90, 2),
        (3, "Marketplace", 0, 0), (3, "Website", 0, 0),
    ]


def test_revenue_outside_the_calendar_is_empty(mart):
    assert reports.revenue_by_channel(mart, dt.date(2030, 1, 1), dt.date(2030, 2, 1)).count() == 0
    assert reports.revenue_by_channel(mart, dt.date(2015, 1, 1), dt.date(2099, 12, 31)).count() == 36 * 2


def test_seasonal_trend(mart):
    found = reports.seasonal_trend(mart, FEB, END, 1).collect()
    assert [(r["season"], r["total_revenue_uah"], r["order_count"]) for r in found] == [("Winter", 90, 2)]


def test_last_day_ends_at_its_midnight_in_line_reports(mart):
    found = reports.top_books(mart, FEB, END).collect()
    assert [(r["product_id"], r["units_sold"], r["revenue_uah"]) for r in found] == [(2, 5, 20), (3, 4, 25), (1, 1, 15)]


def test_top_books_ties_and_limit(spark):
    mart = build(spark, ORDERS[:1], [(1, 4, 1, 2, "1"), (1, 1, 1, 2, "1"), (1, 2, 1, 2, "1")])
    found = reports.top_books(mart, dt.date(2020, 1, 1), END, limit=2).collect()
    assert [r["product_id"] for r in found] == [1, 2]


def test_share_counts_lines_without_category(mart):
    found = reports.sales_by_category(mart, FEB, END).collect()
    assert [(r["category_name"], r["revenue_uah"], float(r["pct_of_total"])) for r in found] == [
        ("Kids", 25, 41.67), ("Tales", 15, 25.0),
    ]


def test_share_of_nothing_is_missing(spark):
    mart = build(spark, ORDERS[:1], [(1, 1, 1, 2, "0")])
    found = reports.sales_by_category(mart, dt.date(2020, 1, 1), END).collect()
    assert [(r["revenue_uah"], r["pct_of_total"]) for r in found] == [(0, None)]
    assert reports.sales_by_category(mart, dt.date(2021, 1, 1), dt.date(2021, 2, 1)).count() == 0


def test_inventory_filters_and_order(mart):
    assert [r["product_id"] for r in reports.inventory_status(mart).collect()] == [4, 3, 2, 1]
    assert [r["age_group"] for r in reports.inventory_status(mart, "active").collect()] == ["Kids", None, "Kids"]


def test_weekly_counts_lines_and_the_variant_counts_orders(mart):
    as_of = dt.datetime(2020, 3, 1)
    found = reports.weekly_sales(mart, as_of).first()
    assert (found["order_count"], found["revenue_uah"], found["units_sold"]) == (3, 130, 14)
    assert found["avg_order_value_uah"] == pytest.approx(130 / 3)
    found = reports.weekly_sales_order_grain(mart, as_of).first()
    assert (found["order_count"], found["revenue_uah"], found["units_sold"], found["avg_order_value_uah"]) == (2, 90, 14, 45)


def test_weekly_ignores_missing_amounts_in_the_average(spark):
    mart = build(spark, [(1, 1, "2020-02-29", None, True), (2, 1, "2020-02-29", "7", True)], [(1, 1, 1, 1, "1"), (2, 1, 1, 1, "1")])
    found = reports.weekly_sales(mart, dt.datetime(2020, 3, 1)).first()
    assert (found["order_count"], found["avg_order_value_uah"]) == (2, 7)


def sync_log(spark):
    t = dt.datetime(2020, 2, 1)
    return spark.createDataFrame(
        [(1, "website", "scheduled", t, t, 1, 0, "success", None),
         (2, "website", "scheduled", t, t + dt.timedelta(1), 1, 0, "failed", "x")],
        schemas.SYNC_LOG,
    )


def test_kpi_row(spark, mart):
    rules = seeds.alert_rules(spark, dt.datetime(2020, 1, 1))
    row = reports.kpi_summary(mart, rules, sync_log(spark), dt.datetime(2020, 2, 20)).first().asDict()
    assert row == {
        "total_revenue_mtd": 110, "orders_mtd": 3, "top_book_title": "One", "top_book_units": 110, "low_stock_count": 3,
        "last_sync_website": dt.datetime(2020, 2, 1), "last_sync_marketplace": None,
    }
    row = reports.kpi_summary(mart, rules, sync_log(spark), dt.datetime(2021, 6, 1)).first().asDict()
    assert (row["total_revenue_mtd"], row["orders_mtd"], row["top_book_title"]) == (0, 0, None)
    assert rows(reports.kpi_low_stock(mart, rules)) == [(3, 2)]
    none = rules.where("false")
    assert rows(reports.kpi_low_stock(mart, none)) == [(0, 0)]


def test_dispatch_knows_its_reports(mart):
    with pytest.raises(ValueError):
        reports.report("nonsense", mart, FEB, END, dt.datetime(2020, 3, 1))
    for name in reports.REPORTS:
        reports.report(name, mart, FEB, END, dt.datetime(2020, 3, 1), channel_id=1).count()


def test_report_files_and_catalogue(spark, mart, tmp_path):
    empty = reports.top_books(mart, dt.date(2021, 1, 1), dt.date(2021, 1, 2))
    assert export.write_report(empty, str(tmp_path / "empty"), "parquet") == 0
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0
    books = reports.top_books(mart, FEB, END)
    assert export.write_report(books, str(tmp_path / "books"), "csv") == books.count() > 0
    assert spark.read.option("header", True).csv(str(tmp_path / "books")).columns[0] == "Product Id"
    export.write_report(books, str(tmp_path / "page"), "page")
    page = spark.read.option("header", True).csv(str(tmp_path / "page"))
    assert page.columns == spark.read.option("header", True).csv(str(tmp_path / "books")).columns


def test_a_report_run_is_logged_once(spark, mart, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert export.report_log(store).count() == 0
    requests = [export.Request("top_books", FEB, END, "csv", channel_id=1), export.Request("inventory", FEB, END)]
    for _ in range(2):
        log = export.run_reports(store, mart, requests, dt.datetime(2020, 3, 1), "r1", user_id=3)
    export.run_reports(store, mart, requests[1:], dt.datetime(2020, 3, 2), "r2")
    assert rows(log.select("report_type", "rows")) == [("inventory", 3), ("top_books", 2)]
    catalogue = export.catalogue(store)
    assert catalogue.schema.fieldNames() == spark.createDataFrame([], schemas.REPORT_CATALOGUE).schema.fieldNames()
    assert rows(catalogue.select("report_type", "generated_by")) == [("inventory", 3), ("inventory", None), ("top_books", 3)]
    first = catalogue.where("report_type = 'top_books'").first()
    assert json.loads(first["parameters"]) == {"from_date": "2020-02-01", "to_date": "2020-02-29", "channel_id": 1, "category_id": None}
    assert history.report_history(catalogue).count() == 3 and catalogue.select("report_id").distinct().count() == 3
    audit = export.audit(store)
    assert audit.schema.fieldNames() == spark.createDataFrame([], schemas.AUDIT_LOG).schema.fieldNames()
    assert rows(audit.select("user_id", "action", "resource")) == [
        (3, "generate_report", "report:inventory"), (3, "generate_report", "report:top_books"), (None, "generate_report", "report:inventory"),
    ]
    with pytest.raises(ValueError):
        export.run_reports(store, mart, [export.Request("nonsense", FEB, END)], NOW, "r3")
    assert export.report_log(store).count() == 3


def test_dashboard_reads_each_fact_once(spark, small, capsys):
    from shelfmart.bindings import tables as T

    stored = T.mart(spark, small)

    def scans(df):
        df.explain("formatted")
        text = capsys.readouterr().out
        found = re.findall(r"Location: \w+ ?\[?[^\n]*?/(fact_order_lines|fact_orders)/", text)
        return sorted(found)

    assert scans(reports.dashboard_sums(stored, T.AS_OF)) == ["fact_order_lines", "fact_orders"]
    blocks = reports.dashboard(stored, T.alert_rules(spark), T.sync_log(spark, small), T.AS_OF)
    for block in blocks.values():
        assert scans(block) == []
    assert scans(alerts.revenue_swing(stored.order_months, T.alert_rules(spark))) == []


def test_dashboard_blocks_are_those_of_the_reports(spark, small):
    from shelfmart.bindings import tables as T

    stored, rules, log = T.mart(spark, small), T.alert_rules(spark), T.sync_log(spark, small)
    blocks = reports.dashboard(stored, rules, log, T.AS_OF)
    year, end = dt.date(2001, 1, 1), reports.DASHBOARD_TO
    assert rows(blocks["kpi"]) == rows(reports.kpi_summary(stored, rules, log, T.AS_OF))
    assert rows(blocks["top_books"]) == rows(reports.top_books(stored, year, end, None, 10))
    assert rows(blocks["sales_by_category"]) == rows(reports.sales_by_category(stored, year, end))


def test_months_in_part_and_whole_give_the_same_sums(mart):
    whole = reports.revenue_by_channel(mart, dt.date(2020, 1, 1), END)
    part = reports.revenue_by_channel(mart, dt.date(2020, 1, 2), END)
    assert rows(whole) == rows(part)
    assert "order_months" not in repr(mart.fact_orders.columns)


def test_rule_types_nobody_evaluates_are_logged(spark, mart, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rules = rules_of(spark, rule(1, "mystery", "1"), rule(2, "mystery", "2"), rule(3, "odd", "1", on=False), rule(4, "no_orders", "1"))
    alerts.run_alerts(store, mart, rules, NOW, "all@example.org")
    log = store.log(alerts.RUN_LOG, alerts.RUN_LOG_SCHEMA)
    assert rows(log.select("rule_type", "error")) == [
        ("low_stock", None), ("mystery", "unknown type"), ("no_orders", None), ("revenue_spike", None),
    ]


def test_dashboard(spark, mart):
    rules = seeds.alert_rules(spark, dt.datetime(2020, 1, 1))
    blocks = reports.dashboard(mart, rules, sync_log(spark), dt.datetime(2020, 2, 20))
    assert {name: block.count() for name, block in blocks.items()} == {
        "kpi": 1, "revenue_by_channel": 72, "top_books": 4, "sales_by_category": 2,
    }


def rule(number, kind, threshold, channel=None, on=True, cooldown=24, email=None):
    return (number, kind, f"rule {number}", Decimal(threshold), channel, None, on, cooldown, email, dt.datetime(2020, 1, number))


def rules_of(spark, *some):
    return spark.createDataFrame(list(some), schemas.ALERT_RULE)


def events_of(spark, *some):
    return spark.createDataFrame([(i, r, p, dt.datetime.fromisoformat(t), None, True) for i, (r, p, t) in enumerate(some)], schemas.ALERT_EVENT)


NOW = dt.datetime(2020, 3, 10, 12)


def test_cooldown_edge(spark, mart):
    rules = rules_of(spark, rule(1, "low_stock", "5"), rule(2, "low_stock", "0", cooldown=0), rule(3, "low_stock", "0", cooldown=None),
                     rule(4, "low_stock", "99", on=False), rule(5, "low_stock", "0", cooldown=1))
    events = events_of(spark, (1, 4, "2020-03-09 12:00:00"), (1, 2, "2020-03-09 12:00:01"), (2, 4, "2020-03-10 11:00:00"),
                       (3, 4, "2020-03-09 12:00:00"), (5, 4, "2020-03-10 10:00:00"), (5, 4, "2020-03-10 11:30:00"))
    found = alerts.low_stock(mart, rules, events, NOW)
    assert rows(found.select("rule_id", "product_id")) == [(1, 4), (3, 4)]


def test_revenue_swing(spark, mart):
    rules = rules_of(spark, rule(1, "revenue_spike", "10", 1), rule(2, "revenue_spike", "10", 2), rule(3, "revenue_spike", "1299"),
                     rule(4, "revenue_spike", "1301"))
    found = alerts.revenue_swing(mart.order_months, rules)
    # Website: 120 after 10. Marketplace: one month only. All: 140 after 10.
    assert rows(found.select("rule_id", "current_rev", "prior_rev", "direction")) == [
        (1, 120.0, 10.0, "increase"), (3, 140.0, 10.0, "increase"),
    ]
    nothing_before = build(spark, [(1, 1, "2020-01-01", "0", True), (2, 1, "2020-02-01", "5", True)])
    assert alerts.revenue_swing(nothing_before.order_months, rules).count() == 0


def test_no_orders(spark, mart):
    rules = rules_of(spark, rule(1, "no_orders", "48"), rule(2, "no_orders", "48", 2), rule(3, "no_orders", "48", 1))
    found = alerts.no_orders(mart.fact_orders, rules, dt.datetime(2020, 3, 2))
    assert rows(found.select("rule_id")) == [(2,)]
    at_edge = alerts.no_orders(mart.fact_orders, rules, dt.datetime(2020, 3, 2, 0, 0, 1))
    assert rows(at_edge.select("rule_id")) == [(2,)]
    later = alerts.no_orders(mart.fact_orders, rules, dt.datetime(2020, 3, 2, 0, 0, 2))
    assert rows(later.select("rule_id")) == [(1,), (2,), (3,)]
    nothing = alerts.no_orders(mart.fact_orders.where("false"), rules, NOW)
    assert rows(nothing.select("rule_id")) == [(1,), (2,), (3,)]


def test_events_notifications_and_dispatch(spark, mart):
    rules = rules_of(spark, rule(1, "low_stock", "5", email="stock@example.org"), rule(2, "revenue_spike", "10", 1),
                     rule(3, "no_orders", "1"), rule(4, "mystery", "1"), rule(5, "low_stock", "0", on=False))
    stock = alerts.low_stock(mart, rules, events_of(spark, (9, 9, "2020-01-01")), NOW)
    swings = alerts.revenue_swing(mart.order_months, rules)
    silent = alerts.no_orders(mart.fact_orders, rules, NOW)
    events = alerts.new_events(stock, swings, NOW)
    assert [f.name for f in events.schema] == [f.name for f in spark.createDataFrame([], schemas.ALERT_EVENT).schema]
    assert rows(events.select("rule_id", "product_id", "detail")) == [
        (1, 2, '{"quantity_in_stock":5}'), (1, 4, '{"quantity_in_stock":0}'),
        (2, None, '{"pct_change":1100.00,"direction":"increase"}'),
    ]
    sent = alerts.notifications(stock, swings, silent, NOW, "all@example.org")
    assert rows(sent.select("rule_id", "recipient", "subject")) == [
        (1, "stock@example.org", "Stock running out: 2 titles"),
        (2, "all@example.org", "Month revenue moved: increase of 1100.0 percent"),
        (3, "all@example.org", "Nothing ordered for 1 hours"),
    ]
    assert rows(alerts.dispatch(rules, stock, swings, silent)) == [
        (1, "low_stock", "checked", 2), (2, "revenue_spike", "checked", 1), (3, "no_orders", "checked", 1), (4, "mystery", "unknown type", 0),
    ]
    assert rows(alerts.unknown_rules(rules).select("rule_id")) == [(4,)]
    again = alerts.low_stock(mart, rules, events, NOW + dt.timedelta(hours=1))
    assert again.count() == 0


def test_history_order_and_limits(spark, mart):
    rules = rules_of(spark, rule(1, "low_stock", "5"), rule(2, "low_stock", "5"))
    events = events_of(spark, (1, 1, "2020-01-01"), (2, None, "2020-01-03"), (1, 77, "2020-01-03"), (8, 1, "2020-01-09"))
    found = history.alert_event_history(events, rules, mart.dim_product, 2).collect()
    assert [(r["event_id"], r["rule_name"], r["product_title"]) for r in found] == [(2, "rule 1", None), (1, "rule 2", None)]
    assert [r["rule_id"] for r in history.alert_rule_list(rules).collect()] == [2, 1]
    assert [r["sync_id"] for r in history.sync_history(sync_log(spark), 1).collect()] == [2]
    assert rows(history.channel_list(mart.dim_sales_channel)) == [(1, "Website"), (2, "Marketplace")]
    audit = spark.createDataFrame([(1, 5, "a", None, None, None, dt.datetime(2020, 1, 1)), (2, None, "b", None, None, None, dt.datetime(2020, 1, 1))], schemas.AUDIT_LOG)
    users = spark.createDataFrame([(5, "ann")], "user_id long, username string")
    assert [(r["log_id"], r["username"]) for r in history.audit_history(audit, users).collect()] == [(2, None), (1, "ann")]
