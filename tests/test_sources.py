"""Shop reads, landed documents, stream, watermark and profile."""

import datetime as dt
import json
from decimal import Decimal

from shelfmart import schemas
from shelfmart.bindings import tables as T
from shelfmart.operators.constants import fixed_table
from shelfmart.operators.quarantine import accepted, outcome_counts, rejected
from shelfmart.plans import staging
from shelfmart.sources import marketplace, profile, shop, watermark
from shelfmart.storage import TableStore
from shelfmart.streaming.landing import ingest_available
from tests.conftest import rows


def document(number, created="2020-01-05 10:00:00", **more):
    return {"id": number, "created": created, "changed": created, "status": 6, "status_group": 2, **more}


def land(folder, name, *envelopes):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(e if isinstance(e, str) else json.dumps(e) + "\n" for e in envelopes))


def page(*orders):
    return {"success": True, "content": {"orders": list(orders), "_meta": {"totalCount": len(orders)}}}


def landed(spark, tmp_path):
    full = document(
        1, amount=10.5, cost="0", cost_with_discount="9.99", user_phone="123",
        delivery={"delivery_service_name": "Post", "recipient_title": "A. Person", "city": {"name": "Lviv"}},
        purchases=[{"id": 11, "item_name": "A", "quantity": 2, "price": 5, "cost": 0}, {"id": 12, "item_name": "B", "cost_with_discount": "x"}],
    )
    land(
        tmp_path / "in", "a.json",
        page(full, document(2, delivery={"delivery_service_name": "Post"}), document(3, purchases=[])),
        {"success": False, "errors": {"message": "no access", "code": 1}},
        "this is no document\n",
        page(),
    )
    land(
        tmp_path / "in", "b.json",
        page(document(1, created="2020-01-06 00:00:00", cost_with_discount="8", ttn="7" * 65)),
        page(document(4, created="2020-01-06 23:59:59", amount="ten")),
        page(document(5, created="2020-01-07 00:00:00")),
    )
    return marketplace.pages(spark, str(tmp_path / "in"))


def test_orders_are_flattened_and_bad_ones_named(spark, tmp_path):
    pages = landed(spark, tmp_path)
    flagged = marketplace.flagged_orders(pages, dt.date(2020, 1, 5), dt.date(2020, 1, 6))
    assert rows(flagged.select("marketplace_order_id", "violation")) == [
        (1, "waybill_length"), (1, None), (2, None), (3, None), (4, "amount_text"),
    ]
    first = flagged.where("marketplace_order_id = 1 AND violation IS NULL").first()
    assert (first["amount"], first["cost"], first["cost_with_discount"]) == (Decimal("10.50"), None, Decimal("9.99"))
    assert (first["delivery_city"], first["delivery_service"]) == ("Lviv", "Post")
    kept = staging.stage(None, accepted(flagged), staging.MARKETPLACE_ORDERS, dt.datetime(2020, 2, 1)).where("marketplace_order_id = 1").first()
    assert "Lviv" in kept["raw_json"] and "Person" not in kept["raw_json"] and "123" not in kept["raw_json"]
    assert rows(outcome_counts(flagged)) == [(3, 2)]
    assert marketplace.orders(pages).count() == 6
    assert marketplace.orders(pages, dt.date(2020, 1, 7)).count() == 1


def test_lines_default_quantity_and_zero_amounts(spark, tmp_path):
    lines = marketplace.flagged_order_lines(landed(spark, tmp_path))
    assert rows(lines.select("purchase_id", "quantity", "price", "cost", "violation")) == [
        (11, 2, Decimal("5.00"), None, None), (12, 1, None, None, "amount_text"),
    ]


def test_error_pages_are_kept_apart(spark, tmp_path):
    failed = marketplace.failed_pages(landed(spark, tmp_path))
    assert rows(failed) == [("no access", "1", None), (None, None, "this is no document")]


def test_stream_reads_each_file_once(spark, tmp_path, at):
    landed(spark, tmp_path)
    store = TableStore(spark, str(tmp_path / "store"))
    ingest_available(store, str(tmp_path / "in"), at("2020-02-01"), max_files=1)
    orders = store.read(staging.MARKETPLACE_ORDERS.name)
    assert rows(orders.select("marketplace_order_id")) == [(1,), (2,), (3,), (5,)]
    assert rows(store.read(staging.MARKETPLACE_ORDER_LINES.name).select("purchase_id")) == [(11,)]
    land(tmp_path / "in", "c.json", page(document(1, created="2020-01-09 00:00:00", status=45, delivery={"city": {"name": "Odesa"}})))
    ingest_available(store, str(tmp_path / "in"), at("2020-02-02"))
    found = store.read(staging.MARKETPLACE_ORDERS.name).where("marketplace_order_id = 1").first()
    assert (found["status"], found["delivery_city"], found["created"]) == (45, "Lviv", at("2020-01-05 10:00:00"))
    assert found["ingested_at"] == at("2020-02-02")
    untouched = store.read(staging.MARKETPLACE_ORDERS.name).where("marketplace_order_id = 2").first()
    assert untouched["ingested_at"] == at("2020-02-01")


def test_parquet_reader_uses_the_stated_schema(spark, tmp_path):
    spark.sql("SELECT 1 AS category_id, 0 AS parent_id, 1S AS status, 2 AS sort_order").write.parquet(str(tmp_path / "categories"))
    spark.sql("SELECT * FROM VALUES (1, 1, 'Kids', null), (1, 2, 'Kinder', null) t(category_id, language_id, name, description)").selectExpr(
        "category_id", "language_id", "name", "cast(description as string) description"
    ).write.parquet(str(tmp_path / "category_descriptions"))
    found = shop.categories(shop.parquet_reader(spark, str(tmp_path)))
    assert rows(found) == [(1, 0, 1, 2, "Kids", None)]


def test_order_bounds_are_inclusive(spark, small):
    read = T.shop_reader(spark, small)
    moment = dt.datetime(2000, 6, 1)
    inside = shop.orders(read, moment, moment + dt.timedelta(days=30))
    assert inside.where("date_modified < '2000-06-01' OR date_modified > '2000-07-01'").count() == 0
    assert inside.count() == read("orders").where("date_modified BETWEEN '2000-06-01' AND '2000-07-01'").count() > 0


def test_watermark(spark, at):
    log = spark.createDataFrame(
        [(1, "website", None, None, at("2020-01-01"), 0, 0, "success", None), (2, "website", None, None, at("2020-01-02"), 0, 0, "failed", None)],
        schemas.SYNC_LOG,
    )
    channels = fixed_table(spark, [("website",), ("marketplace",)], "channel string")
    assert rows(watermark.watermarks(log, channels)) == [("marketplace", at("2015-01-01")), ("website", at("2020-01-01"))]


def test_profile(spark):
    assert set(profile.missing_tables(["orders", "products"])) == set(schemas.SHOP) - {"orders", "products"}
    tables = {"orders": spark.sql("SELECT timestamp_ntz'2020-01-01' AS added"), "products": spark.range(3)}
    found = {r["table_name"]: r["row_count"] for r in profile.profile(tables, {"orders": "added"}).collect()}
    assert found == {**dict.fromkeys(schemas.SHOP), "orders": 1, "products": 3}


def test_rejected_rows_keep_their_columns(spark, tmp_path):
    bad = rejected(marketplace.flagged_orders(landed(spark, tmp_path)))
    assert {"violation", "ttn"} <= set(bad.columns)


def test_changed_lines_are_selected_by_the_database(at):
    reader = shop.JdbcReader(
        None, "jdbc:x", {"orders": "oc_order", "order_products": "oc_order_product"},
        {"order_products": ("order_product_id", 1, 90, 3)}, rows_a_partition=100,
    )
    query = reader.changed_lines_query(at("2020-01-01"), at("2020-01-02 03:04:05"))
    assert query == (
        "SELECT p.* FROM oc_order_product p WHERE p.order_id IN (SELECT o.order_id FROM oc_order o "
        "WHERE o.date_modified >= '2020-01-01 00:00:00' AND o.date_modified <= '2020-01-02 03:04:05')"
    )
    assert "<=" not in reader.changed_lines_query(at("2020-01-01"), None)
    assert reader.bounds_options(query)["dbtable"].startswith("(SELECT MIN(q.order_product_id)")
    table = {"dbtable": f"({query}) AS changed_lines"}
    assert reader.changed_lines_options(query, None, None, 0) == table == reader.changed_lines_options(query, 5, 9, 100)
    assert reader.changed_lines_options(query, 5, 904, 250) == {
        **table, "partitionColumn": "order_product_id", "lowerBound": "5", "upperBound": "905", "numPartitions": "3",
    }
    assert reader.table_options("orders") == {"dbtable": "oc_order"}
    assert reader.table_options("order_products")["numPartitions"] == "3"


def test_lines_of_a_database_are_not_joined(spark, small, at, monkeypatch):
    loads = []
    monkeypatch.setattr(shop.JdbcReader, "_load", lambda self, options: loads.append(options["dbtable"]) or spark.createDataFrame([(1, 2, 2)], "low long, high long, lines long"))
    reader = shop.JdbcReader(spark, "jdbc:x", {"orders": "o", "order_products": "p"})
    shop.lines_since(reader, None, at("2020-01-01"))
    assert len(loads) == 2 and loads[1].endswith("AS changed_lines")
    read = T.shop_reader(spark, small)
    changed = shop.orders(read, at("2000-06-01"))
    assert rows(shop.lines_since(read, changed, at("2000-06-01"))) == rows(shop.order_lines(read, changed))
