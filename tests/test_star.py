"""Dimensions and facts on hand-made rows."""

from decimal import Decimal

import pytest

from shelfmart import schemas, seeds
from shelfmart.functions.calendar import calendar
from shelfmart.functions.keys import KEY_SPAN
from shelfmart.operators.quarantine import accepted, rejected
from shelfmart.plans import dimensions, facts
from tests.conftest import rows

W, M = KEY_SPAN, 2 * KEY_SPAN

CATEGORY = "category_id int, parent_id int, sort_order int, name string"


def test_categories_resolve_parents_and_drop_orphans(spark):
    staged = spark.createDataFrame(
        [(1, 0, 1, "Kids"), (2, 1, 2, "Tales"), (3, 2, 3, "Bears"), (4, 99, 4, "Orphan"), (5, 4, 5, "Of orphan"),
         (6, 7, 6, "Ring a"), (7, 6, 7, "Ring b"), (8, 0, 8, None)],
        CATEGORY,
    )
    found = dimensions.categories(staged)
    assert rows(found.select("source_category_id", "parent_id", "parent_name", "is_age_group")) == [
        (1, None, None, True), (2, W + 1, "Kids", False), (3, W + 2, "Tales", False),
    ]
    assert rows(rejected(dimensions.flag_categories(staged)).select("category_id", "violation")) == [(8, "name_null")]


def test_trees_of_more_than_a_million_categories(spark):
    n = 1_000_100
    tree = spark.range(1, n + 1).selectExpr("cast(id as int) category_id", "if(id % 2 = 1, 0, cast(id - 1 as int)) parent_id", "0 sort_order", "'c' name")
    lost = spark.createDataFrame([(n + 1, n + 2, 1, "X")], CATEGORY)
    staged = tree.select("category_id", "parent_id", "sort_order", "name").unionAll(lost)
    assert dimensions.categories(staged).count() == n
    assert rows(dimensions.unrooted_categories(staged).select("category_id")) == [(n + 1,)]


def test_category_may_change_between_root_and_child(spark):
    first = dimensions.categories(spark.createDataFrame([(1, 0, 1, "A"), (2, 1, 2, "B")], CATEGORY))
    second = dimensions.categories(spark.createDataFrame([(1, 2, 5, "A2"), (2, 0, 6, "B2")], CATEGORY), first)
    assert rows(second.select("source_category_id", "name", "parent_name", "is_age_group", "sort_order")) == [
        (1, "A2", "B2", False, 5), (2, "B2", None, True, 6),
    ]


def products(spark, more=()):
    return spark.createDataFrame(
        [(1, "One", 10, 100, 7, 1, "5", 3), *more],
        "product_id int, name string, manufacturer_id int, main_category_id int, stock_status_id int, status int, "
        "price string, quantity int",
    ).selectExpr(
        "*", "CAST(NULL AS string) author", "CAST(NULL AS string) isbn", "CAST(NULL AS short) publishing_year",
        "CAST(NULL AS short) pages_number", "CAST(NULL AS string) binding_type", "CAST(NULL AS date) date_available",
        "CAST(NULL AS timestamp_ntz) date_added",
    )


def test_product_label_in_two_languages_and_updates(spark, at):
    publisher = dimensions.publishers(spark.createDataFrame([(10, "Pub", None)], "manufacturer_id int, name string, description string"))
    category = dimensions.categories(spark.createDataFrame([(100, 0, 1, "Kids")], CATEGORY))
    labels = spark.createDataFrame([(7, 1, "In stock"), (7, 2, "Auf Lager")], schemas.SHOP["stock_statuses"])
    first = dimensions.products(products(spark, [(2, None, 1, 1, 1, 1, "1", 1)]), publisher, category, labels, at("2020-01-01"))
    row = first.first()
    assert first.count() == 1
    assert (row["stock_status"], row["publisher_id"], row["category_id"], row["status"]) == ("In stock", W + 10, W + 100, "active")
    changed = products(spark).selectExpr("* EXCEPT (name, main_category_id, status)", "'Uno' name", "5 main_category_id", "0 status")
    row = dimensions.products(changed, publisher, category, labels, at("2020-01-02"), first).first()
    assert (row["title"], row["status"], row["last_updated"]) == ("Uno", "inactive", at("2020-01-02"))
    assert row["category_id"] == W + 100


def test_statuses_seed_wins_then_fallback(spark):
    seeded = seeds.order_statuses(spark)
    web = spark.createDataFrame([(5,), (17,), (17,), (12,), (None,)], "order_status_id int")
    found = dimensions.add_statuses(seeded, dimensions.website_statuses(web))
    assert found.count() == seeded.count() + 1
    assert rows(found.where("source_channel = 'website' AND source_id IN (5, 12, 17)").select("source_id", "name_en", "status_group")) == [
        (5, "Complete", 2), (12, "Reversed", 3), (17, "Status 17", 3),
    ]
    mkt = spark.createDataFrame([(99, 3), (99, 2), (None, 1), (6, 1)], "status int, status_group int")
    found = dimensions.add_statuses(seeded, dimensions.marketplace_statuses(mkt))
    assert rows(found.where("source_id IN (6, 99) AND source_channel = 'marketplace'").select("name_en", "status_group")) == [
        ("Marketplace status 99", 2), ("Parcel received", 2),
    ]


def test_seeding_rules_twice_changes_nothing(spark, at):
    rules = seeds.alert_rules(spark, at("2020-01-01"))
    assert rows(seeds.with_missing_rules(rules, rules)) == rows(rules)
    grown = seeds.with_missing_rules(rules.where("rule_id = 2"), rules)
    assert grown.select("rule_id").distinct().count() == 3


WEB_ORDER = (
    "order_id int, customer_id int, order_status_id int, total decimal(15,4), currency_code string, "
    "currency_value decimal(15,8), shipping_city string, shipping_method string, payment_method string, "
    "date_added timestamp_ntz, date_modified timestamp_ntz"
)


def web_order(at, number, total="10", rate="2", status=5, day="2020-03-01 10:00:00", code="USD"):
    day = at(day) if day else None
    return (number, 1, status, Decimal(total), code, Decimal(rate), "Kyiv", None, None, day, day)


@pytest.fixture
def small_star(spark, at):
    days = calendar(spark)
    customer = dimensions.customers(
        spark.createDataFrame([(1, "Retail", at("2019-01-01"), True)],
                              "customer_id int, customer_group_name string, date_added timestamp_ntz, is_newsletter boolean")
    )
    return days, customer, seeds.order_statuses(spark)


def test_order_fact_freezes_date_and_rate(spark, at, small_star):
    days, customer, statuses = small_star

    def incoming(*orders):
        flagged = facts.flag_website_orders(spark.createDataFrame(list(orders), WEB_ORDER), days)
        return facts.website_orders(accepted(flagged), customer, statuses)

    first = facts.merge_orders(None, incoming(web_order(at, 1)))
    second = facts.merge_orders(first, incoming(web_order(at, 1, "20", "3", 7, "2020-04-01"), web_order(at, 2)))
    row = second.where("source_order_id = 1").first()
    assert (row["total_amount"], row["total_amount_uah"], row["currency_value"]) == (20, 60, 2)
    assert (row["date_id"], row["status_id"], row["customer_id"]) == (20200301, W + 7, W + 1)
    assert second.count() == 2
    lines = spark.createDataFrame(
        [(1, 1, 9, 1, Decimal(5), Decimal(5), Decimal(0)), (2, 77, 9, 1, Decimal(5), Decimal(5), Decimal(0))],
        "order_product_id int, order_id int, product_id int, quantity int, price decimal(15,4), total decimal(15,4), tax decimal(15,4)",
    )
    no_products = spark.createDataFrame([], "source_channel string, source_product_id int, product_id long, category_id long")
    line = facts.website_lines(lines, second, no_products).collect()
    assert [(r["source_line_id"], r["line_total_uah"], r["product_id"]) for r in line] == [(1, 10, None)]


def test_bad_orders_are_named(spark, at, small_star):
    days = small_star[0]
    staged = spark.createDataFrame(
        [web_order(at, 1), web_order(at, 2, day="2014-12-31"), web_order(at, 3, day=None), web_order(at, 4, code="EURO")],
        WEB_ORDER,
    )
    flagged = facts.flag_website_orders(staged, days)
    assert rows(flagged.select("order_id", "violation")) == [
        (1, None), (2, "date_unknown"), (3, "date_null"), (4, "currency_length"),
    ]


def test_marketplace_lines_match_one_product_by_title(spark, at):
    dim = spark.createDataFrame(
        [(W + 3, " The Book", W + 30, "website"), (W + 2, "the book ", W + 20, "website"), (W + 4, "Other", None, "website")],
        "product_id long, title string, category_id long, source_channel string",
    )
    orders = spark.createDataFrame([(5, M + 5, 20200101, 2), (5, W + 5, 20200101, 1)],
                                   "source_order_id long, order_id long, date_id int, channel_id int")
    lines = spark.createDataFrame(
        [(1, 5, "THE BOOK", 1), (2, 5, "No such", 1), (3, 5, None, 1), (4, 6, "Other", 1), (5, 5, "other", None)],
        "purchase_id long, marketplace_order_id long, item_name string, quantity int",
    ).selectExpr("*", "cast(2 as decimal(12,2)) price", "cast(2 as decimal(12,2)) cost_with_discount")
    flagged = facts.flag_lines(lines)
    assert rows(rejected(flagged).select("purchase_id", "violation")) == [(5, "quantity_null")]
    found = facts.marketplace_lines(accepted(flagged), orders, dim)
    assert rows(found.select("source_line_id", "order_id", "product_id", "category_id")) == [
        (1, M + 5, W + 2, W + 20), (2, M + 5, None, None), (3, M + 5, None, None),
    ]
