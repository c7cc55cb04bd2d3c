"""Stored tables, loads and the transform, run more than once."""

import pytest
from pyspark.sql import functions as F

from shelfmart import schemas, seeds, storage
from shelfmart.bindings import tables as T
from shelfmart.plans import refresh, staging
from shelfmart.storage import TableStore
from tests.conftest import rows

FACTS = ("fact_orders", "fact_order_lines")
STORED = (*FACTS, "dim_publisher", "dim_category", "dim_customer", "dim_order_status")


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    schema = "id int, value string, part int"
    store.write("t", spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], schema), partition_by="part")
    batch = spark.createDataFrame([(1, "A", 2), (4, "D", 4)], schema)
    merged = store.merge("t", batch, ["id"], ["value"], partition_by="part")
    found = merged.table
    assert merged.counts == {"all": (1, 1)} and sorted(merged.parts) == [1, 2, 4]
    assert rows(found.select("id", "value", "part")) == [(1, "A", 1), (2, "b", 2), (3, "c", 3), (4, "D", 4)]
    versions = {path.split("/v=")[1].split("/")[0] for path in store._paths("t")}
    assert len(store._paths("t")) == 4 and len(versions) == 2
    reopened = TableStore(spark, str(tmp_path))
    assert rows(reopened.read("t").select("id", "value", "part")) == rows(found.select("id", "value", "part"))
    reopened.write("t", spark.createDataFrame([(9, "z", 1)], schema), partition_by="part")
    assert rows(TableStore(spark, str(tmp_path)).read("t").select("id")) == [(9,)]
    assert TableStore(spark, str(tmp_path)).read("other") is None


def test_a_merge_in_waves_does_what_one_does(spark, tmp_path, monkeypatch):
    made = []
    write = TableStore._write_partitions
    monkeypatch.setattr(TableStore, "_write_partitions", lambda self, *a: made.append(a[0]) or write(self, *a))
    found = {}
    for wave in (1 << 30, 1):
        monkeypatch.setattr(storage, "WAVE_BYTES", wave)
        store = TableStore(spark, str(tmp_path / str(wave)))
        some = lambda *ids: spark.range(60).where(F.col("id").isin(*ids)).selectExpr("id", "id * 10 AS value", "id div 10 AS part")
        store.write("t", some(*range(0, 60, 3)), partition_by="part")
        made.clear()
        batch = some(0, 1, 3, 12, 13, 41, 42, 59).withColumn("value", F.col("value") + 1)
        groups = {"even": F.col("id") % 2 == 0, "odd": F.col("id") % 2 == 1}
        merged = store.merge("t", batch, ["id"], ["value"], "part", fixed_by_key=True, groups=groups)
        found[wave] = rows(merged.table.select("id", "value", "part")), merged.counts, sorted(merged.parts), len(made)
    assert found[1][:3] == found[1 << 30][:3]
    assert found[1][3] == 4 and found[1 << 30][3] == 1
    assert found[1][1] == {"even": (0, 3), "odd": (4, 1)}


def test_a_table_is_listed_once_until_it_changes(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("t", spark.createDataFrame([(1, "a", 1)], "id int, value string, part int"), partition_by="part")
    before = store.read("t")
    assert store.read("t") is before
    store.merge("t", spark.createDataFrame([(2, "b", 2)], "id int, value string, part int"), ["id"], ["value"], "part")
    assert store.read("t") is not before and rows(store.read("t").select("id")) == [(1,), (2,)]
    assert rows(before.select("id")) == [(1,)]


def test_merge_with_partitions_fixed_by_key(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    schema = "id int, value string, part int"
    store.merge("t", spark.createDataFrame([(1, "a", 0), (11, "b", 1)], schema), ["id"], ["value"], "part", fixed_by_key=True)
    store.merge("t", spark.createDataFrame([(11, "B", 1), (12, "c", 1)], schema), ["id"], ["value"], "part", fixed_by_key=True)
    assert rows(store.read("t").select("id", "value")) == [(1, "a"), (11, "B"), (12, "c")]
    before = store._paths("t")
    store.merge("t", spark.createDataFrame([], schema), ["id"], ["value"], "part", fixed_by_key=True)
    assert store._paths("t") == before


def transform(spark, store, run_at, after=None):
    return refresh.transform(
        store, T.days(spark), seeds.sales_channels(spark), seeds.order_statuses(spark), run_at, T.stock_statuses(spark), after
    )


def first_load(spark, small, store):
    refresh.load_website(store, T.shop_reader(spark, small), T.EVERYTHING, T.RUN_AT)
    refresh.land(store, staging.MARKETPLACE_ORDERS, T.marketplace_orders(spark, small), T.RUN_AT)
    refresh.land(store, staging.MARKETPLACE_ORDER_LINES, T.marketplace_lines(spark, small), T.RUN_AT)
    return transform(spark, store, T.RUN_AT)


def content(store, name):
    frame = store.read(name)
    return rows(frame.select(*sorted(frame.columns)))


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    store = TableStore(spark, str(tmp_path_factory.mktemp("store")))
    first_load(spark, "/root/testdata/sf0.001", store)
    return store


def test_running_again_changes_nothing(spark, small, loaded):
    before = {name: content(loaded, name) for name in STORED}
    refresh.load_website(loaded, T.shop_reader(spark, small), T.EVERYTHING, T.RUN_AT)
    transform(spark, loaded, T.RUN_AT)
    assert {name: content(loaded, name) for name in STORED} == before


def test_website_log_counts_orders_and_products(spark, small, loaded):
    log = loaded.log(refresh.SYNC_LOG, schemas.SYNC_LOG).where("status = 'success'")
    orders, products = T.website_orders(spark, small).count(), T.raw(spark, small, "part").count()
    assert {r["records_ingested"] for r in log.collect()} == {orders + products}


def test_changed_rows_alone_give_the_same_facts(spark, small, tmp_path):
    """A second batch worked through with `changed_after` against the same batch in a full transform."""
    stores = [TableStore(spark, str(tmp_path / name)) for name in ("part", "whole")]
    for store, after in zip(stores, (refresh.Mark(T.RUN_AT), None)):
        refresh.load_website(store, T.shop_reader(spark, small), T.EVERYTHING, T.RUN_AT)
        orders = T.marketplace_orders(spark, small)
        early = F.col("changed") < "1998-01-01"
        refresh.land(store, staging.MARKETPLACE_ORDERS, orders.where(early), T.RUN_AT)
        refresh.land(store, staging.MARKETPLACE_ORDER_LINES, T.marketplace_lines(spark, small), T.RUN_AT)
        transform(spark, store, T.RUN_AT)
        refresh.land(store, staging.WEBSITE_ORDERS, T.orders_second(spark, small), T.SECOND_RUN_AT)
        refresh.land(store, staging.MARKETPLACE_ORDERS, orders.where(~early), T.SECOND_RUN_AT)
        transform(spark, store, T.SECOND_RUN_AT, after)
    for name in FACTS:
        part, whole = content(stores[0], name), content(stores[1], name)
        assert len(part) > 0 and part == whole


def test_cycle_logs_a_failed_source_and_loads_the_other(spark, small, tmp_path):
    from shelfmart.sources import marketplace

    store = TableStore(spark, str(tmp_path / "store"))
    read = T.shop_reader(spark, small)
    folder = str(tmp_path / "landing")
    T.landing_documents(spark, small).write.text(folder)
    pages = marketplace.pages(spark, folder)

    def run(reader, run_at):
        return refresh.cycle(
            store, reader, pages, run_at, T.days(spark), seeds.sales_channels(spark), seeds.order_statuses(spark)
        )

    # Rows from before the start of a first load are not read by a default high-water mark.
    store.append(refresh.SYNC_LOG, spark.createDataFrame(
        [(0, c, "historical", T.EVERYTHING, T.EVERYTHING, 0, 0, "success", None) for c in ("website", "marketplace")], schemas.SYNC_LOG
    ))
    run(read, T.RUN_AT)
    before = content(store, "fact_orders")
    assert len(before) > 0

    def broken(name):
        raise RuntimeError("no route to host")

    run(broken, T.SECOND_RUN_AT)
    log = store.log(refresh.SYNC_LOG, schemas.SYNC_LOG).where(F.col("started_at") == T.SECOND_RUN_AT.isoformat())
    assert rows(log.select("channel", "status", "error_detail")) == [
        ("marketplace", "success", None), ("website", "failed", "no route to host"),
    ]
    assert content(store, "fact_orders") == before
    failed = store.log(refresh.SYNC_LOG, schemas.SYNC_LOG).where("channel = 'marketplace' AND sync_type = 'scheduled'")
    assert all(r["records_failed"] > 0 for r in failed.where(F.col("started_at") == T.RUN_AT.isoformat()).collect())


def test_shared_folder_comes_from_the_session(spark):
    from shelfmart.session import shared_dir

    assert shared_dir(spark) == shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_an_empty_batch_is_staged_as_nothing(spark, small, tmp_path):
    store = TableStore(spark, str(tmp_path))
    orders = T.marketplace_orders(spark, small)
    nothing = orders.where("marketplace_order_id IS NULL")
    assert refresh.land(store, staging.MARKETPLACE_ORDERS, orders, T.RUN_AT).staged == orders.count()
    assert refresh.land(store, staging.MARKETPLACE_ORDERS, nothing, T.SECOND_RUN_AT).staged == 0
    assert refresh.land(store, staging.MARKETPLACE_ORDERS, spark.createDataFrame([], orders.schema), T.SECOND_RUN_AT).staged == 0
    assert store.read(staging.MARKETPLACE_ORDERS.name).count() == orders.count()


def test_a_first_load_may_be_empty(spark, small, tmp_path):
    store = TableStore(spark, str(tmp_path))
    orders = T.marketplace_orders(spark, small)
    assert refresh.land(store, staging.MARKETPLACE_ORDERS, spark.createDataFrame([], orders.schema), T.RUN_AT).staged == 0
    assert refresh.land(store, staging.MARKETPLACE_ORDERS, orders, T.SECOND_RUN_AT).staged == orders.count()
    assert store.read(staging.MARKETPLACE_ORDERS.name).count() == orders.count()


def test_a_cycle_takes_each_landed_file_once(spark, small, tmp_path):
    """The second of two runs reads the new file only and leaves the facts of a full load."""
    store = TableStore(spark, str(tmp_path / "store"))
    folder = str(tmp_path / "landing")
    documents = T.landing_documents(spark, small).coalesce(1).cache()
    first, second = (documents.where(F.pmod(F.xxhash64("value"), F.lit(2)) == k) for k in (0, 1))
    none = lambda name: spark.createDataFrame([], schemas.SHOP[name])

    def run(run_at):
        return refresh.cycle(
            store, none, folder, run_at, T.days(spark), seeds.sales_channels(spark), seeds.order_statuses(spark)
        )

    for part, run_at in ((first, T.RUN_AT), (second, T.SECOND_RUN_AT)):
        part.write.mode("append").text(folder)
        run(run_at)
    log = store.log(refresh.SYNC_LOG, schemas.SYNC_LOG).where("channel = 'marketplace'").orderBy("started_at").collect()
    taken = [r["records_ingested"] + r["records_failed"] for r in log]
    orders = spark.read.json(documents.rdd.map(lambda r: r["value"])).selectExpr("explode(content.orders) o").select("o.id", "o.ttn")
    long = F.length("ttn") > 64
    parts = [part.count() for part in (first, second)]
    assert len(taken) == 2 and all(0 < t for t in taken) and sum(taken) >= sum(parts) - orders.where(long).count()
    assert max(taken) < sum(parts)
    fitting = orders.where(~long).select("id").distinct().count()
    assert store.read("fact_orders").count() == fitting
    before = store._paths("fact_orders")
    run(T.SECOND_RUN_AT + (T.SECOND_RUN_AT - T.RUN_AT))
    assert store._paths("fact_orders") == before


def test_lines_read_the_months_of_their_orders(spark, loaded, capsys):
    month = 199603
    lines = loaded.read(staging.WEBSITE_ORDER_LINES.name)
    of_month = loaded.read("fact_orders").where(f"order_month = {month} AND channel_id = 1").select(F.col("source_order_id").alias("order_id"))
    batch = lines.join(of_month, "order_id", "left_semi")
    found = refresh.orders_of_lines(loaded, batch, "order_id", "website")
    found.explain("formatted")
    text = capsys.readouterr().out
    assert f"PartitionFilters: [isnotnull(order_month" in text or f"order_month" in text.split("PartitionFilters:")[1].split("\n")[0]
    assert found.select("order_month").distinct().collect()[0][0] == month and found.select("order_month").distinct().count() == 1
    assert of_month.count() > 0 and batch.join(found.select(F.col("source_order_id").alias("order_id")), "order_id", "left_anti").count() == 0


def test_only_touched_blocks_of_a_dimension_are_written(spark, small, tmp_path, monkeypatch):
    from shelfmart.plans import dimensions

    monkeypatch.setattr(dimensions, "BLOCK_IDS", 50)
    store = TableStore(spark, str(tmp_path))
    first_load(spark, small, store)
    products, before = content(store, "dim_product"), set(store._paths("dim_product"))
    customers = store._paths("dim_customer")
    transform(spark, store, T.SECOND_RUN_AT, refresh.Mark(T.RUN_AT))
    assert set(store._paths("dim_product")) == before and store._paths("dim_customer") == customers
    staged = store.read(staging.WEBSITE_PRODUCTS.name)
    one = staged.where("product_id = 60").drop("raw_json", "ingested_at").withColumn("price", F.lit(1).cast("decimal(15,4)"))
    refresh.land(store, staging.WEBSITE_PRODUCTS, one.withColumn("date_modified", F.col("date_modified") + F.expr("interval 1 day")), T.SECOND_RUN_AT)
    run = transform(spark, store, T.SECOND_RUN_AT, refresh.Mark(T.RUN_AT))
    kept = before & set(store._paths("dim_product"))
    assert len(kept) == len(before) - 1 and len(before) >= 4
    changed = [r for r, old in zip(content(store, "dim_product"), products) if r != old]
    assert len(changed) == 1
    counts = {r["step"]: (r["inserted"], r["updated"], r["rejected"]) for r in run.counts.collect()}
    assert counts["products"] == (0, 1, 0) and counts["customers"] == (0, 0, 0)


def test_totals_follow_a_changed_order(spark, small, tmp_path):
    from shelfmart.plans import facts

    store = TableStore(spark, str(tmp_path))
    first_load(spark, small, store)
    before = store._paths("fact_orders")
    order = store.read(staging.WEBSITE_ORDERS.name).where("date_added < '1997-01-01'").orderBy("order_id").limit(1)
    again = order.drop("raw_json", "ingested_at", staging.BLOCK).withColumns(
        {"total": F.lit(5).cast("decimal(15,4)"), "order_status_id": F.lit(7), "date_modified": F.col("date_modified") + F.expr("interval 1 day")}
    )
    refresh.land(store, staging.WEBSITE_ORDERS, again, T.SECOND_RUN_AT)
    run = transform(spark, store, T.SECOND_RUN_AT, refresh.Mark(T.RUN_AT))
    assert len(set(store._paths("fact_orders")) - set(before)) == 1
    keys = ["channel_id", "order_month", "status_id"]
    assert rows(run.mart.order_months.select(*keys, "revenue", "orders")) == rows(facts.month_totals(store.read("fact_orders")).select(*keys, "revenue", "orders"))
    counts = {r["step"]: (r["inserted"], r["updated"], r["rejected"]) for r in run.counts.collect()}
    assert counts["website_orders"] == (0, 1, 0) and counts["website_lines"] == (0, 0, 0)


def test_rows_that_cannot_be_loaded_are_kept_and_tried_again(spark, tmp_path, at):
    """Bad rows of every kind, and what becomes of them when they are mended."""
    store = TableStore(spark, str(tmp_path))
    shop_rows = {
        "orders": [(1, 0, 1, 0, None, None, "c", "s", "p", "10", 5, "UAH", "1", "1996-03-01", "1996-03-01"),
                   (2, 0, 1, 0, None, None, "c", "s", "p", "10", 5, "UAH", "99999", "1996-03-01", "1996-03-01"),
                   (3, 0, 1, 0, None, None, "c", "s", "p", "10", 5, "UAH", "1", "2030-03-01", "1996-03-01")],
        "order_products": [(11, 1, 7, "n", "m", 1, "5", "5", "0"), (12, 1, 7, "n", "m", None, "5", "5", "0"),
                           (13, 1, 7, "n", "m", -1, "5", "5", "0"), (14, 2, 7, "n", "m", 1, "5", "99999999999", "0"),
                           (15, 3, 7, "n", "m", 1, "5", "5", "0")],
        "products": [(7, "m", "s", None, 1, 1, 1, "5", None, 1, 1, "a", None, "x", 1, "1996-01-01", "1996-01-01"),
                     (8, "m", "s", None, 1, 1, 1, "5", None, 1, 1, "a", None, "x", 1, "1996-01-01", "1996-01-01")],
        "product_descriptions": [(7, 1, "Seven", "d"), (8, 1, "x" * 300, "d")],
        "categories": [(1, 0, 1, 0), (2, 1, 1, 0), (3, 99, 1, 0), (4, 5, 1, 0), (5, 4, 1, 0)],
        "category_descriptions": [(k, 1, f"c{k}", "d") for k in (1, 2, 3, 4, 5)],
        "manufacturers": [(1, "One"), (2, "y" * 65)],
    }
    def read(name):
        text = ", ".join(f"{c.split()[0]} string" for c in schemas.SHOP[name].replace("decimal(15,4)", "d").replace("decimal(15,8)", "d").split(", "))
        found = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in shop_rows.get(name, [])], text)
        wanted = spark.createDataFrame([], schemas.SHOP[name]).schema
        return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])

    def run(run_at, days=None, after=None):
        refresh.load_website(store, read, T.EVERYTHING, run_at)
        refresh._start_empty(store, run_at)
        return refresh.transform(store, days or T.days(spark), seeds.sales_channels(spark), seeds.order_statuses(spark), run_at, None, after)

    first = run(at("2001-01-01"))
    assert rows(refresh.quarantine(store).select("kind", "source_id", "violation")) == [
        ("categories", 3, "no_root"), ("categories", 4, "no_root"), ("categories", 5, "no_root"),
        ("products", 8, "title_length"), ("publishers", 2, "name_length"),
        ("website_lines", 12, "quantity_null"), ("website_lines", 13, "quantity_range"),
        ("website_lines", 14, "amount_range"), ("website_lines", 15, "order_missing"),
        ("website_orders", 3, "date_unknown"),
    ]
    assert rows(store.read("fact_order_lines").select("source_line_id")) == [(11,)]
    counts = {r["step"]: (r["inserted"], r["updated"], r["rejected"]) for r in first.counts.collect()}
    assert counts["website_lines"] == (1, 0, 4) and counts["website_orders"] == (2, 0, 1) and counts["categories"] == (2, 0, 3)
    # the calendar grows, the tree is mended, a line is mended
    from shelfmart.functions.calendar import calendar
    import datetime as dt

    shop_rows["categories"][2] = (3, 1, 1, 0)
    shop_rows["order_products"] = [(12, 1, 7, "n", "m", 4, "5", "5", "0")]
    run(at("2001-01-02"), calendar(spark, dt.date(1994, 1, 1), dt.date(2031, 1, 1)), refresh.Mark(at("2001-01-01")))
    assert rows(refresh.quarantine(store).where("kind <> 'categories'").select("source_id", "violation", "since")) == [
        (2, "name_length", at("2001-01-01")), (8, "title_length", at("2001-01-01")),
        (13, "quantity_range", at("2001-01-01")), (14, "amount_range", at("2001-01-01")),
    ]
    assert rows(store.read("fact_order_lines").select("source_line_id", "quantity_sold")) == [(11, 1), (12, 4), (15, 1)]
    gone = store.log(refresh.RESOLVED_LOG, refresh.RESOLVED_SCHEMA)
    assert rows(gone.select("kind", "source_id")) == [("categories", 3), ("website_lines", 12), ("website_lines", 15), ("website_orders", 3)]


def test_steps_may_append_at_the_same_time(spark, tmp_path):
    from shelfmart.storage import together

    store = TableStore(spark, str(tmp_path))
    one = lambda k: spark.range(k, k + 1).selectExpr("id", "id AS part")
    together(*[lambda k=k: store.append("log", one(k)) for k in range(6)])
    together(*[lambda k=k: store.write(f"t{k}", one(k), "part") for k in range(6)])
    assert rows(store.log("log", "id long").select("id")) == [(k,) for k in range(6)]
    assert [TableStore(spark, str(tmp_path)).read(f"t{k}").first()["id"] for k in range(6)] == list(range(6))
    with pytest.raises(ZeroDivisionError):
        together(lambda: 1, lambda: 1 // 0)


def test_stores_share_staging_tables(spark, small, tmp_path):
    mart, redriven = (T._staged_store(spark, small, name) for name in ("shared-a", "shared-b"))
    for table in T.STAGED.values():
        assert mart._paths(table.name) == redriven._paths(table.name)
    assert rows(TableStore(spark, mart.root).read(staging.WEBSITE_CATEGORIES.name)) == rows(
        redriven.read(staging.WEBSITE_CATEGORIES.name)
    )


def test_a_shared_table_is_merged_and_the_other_store_keeps_its_rows(spark, tmp_path):
    schema = "id long, value string, part long"
    first, second = TableStore(spark, f"{tmp_path}/a"), TableStore(spark, f"{tmp_path}/b")
    first.write("t", spark.createDataFrame([(1, "a", 0), (11, "b", 1)], schema))
    first.write("p", spark.createDataFrame([(1, "a", 0), (11, "b", 1)], schema), partition_by="part")
    second.share(first, ["t", "p"])
    batch = spark.createDataFrame([(11, "B", 1), (12, "c", 1)], schema)
    for name in ("t", "p"):
        merged = second.merge(name, batch, ["id"], ["value"], "part", fixed_by_key=True)
        assert merged.counts == {"all": (1, 1)}
        assert rows(TableStore(spark, second.root).read(name).select("id", "value")) == [(1, "a"), (11, "B"), (12, "c")]
        assert rows(first.read(name).select("id", "value")) == [(1, "a"), (11, "b")]


def test_rows_stored_between_steps_are_dropped(spark, small, tmp_path):
    """What is left are the checked rows of small dimensions."""
    store = TableStore(spark, str(tmp_path))
    first_load(spark, small, store)
    refresh.land(store, staging.WEBSITE_CATEGORIES, spark.createDataFrame([], store.read(staging.WEBSITE_CATEGORIES.name).schema), T.RUN_AT)
    left = {p.parent.parent.name for p in (tmp_path / "_spool").rglob("*.parquet")}
    assert not left & {
        "website_orders", "website_lines", "marketplace_orders", "marketplace_lines", "fact_orders", "fact_order_lines",
        staging.WEBSITE_ORDERS.name, staging.WEBSITE_ORDER_LINES.name, "order_index", "settled_website_lines",
    }


def test_landed_files_are_compressed(spark, small):
    import os

    files = [f for f in os.listdir(T.landing_folder(spark, small)) if f.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)
