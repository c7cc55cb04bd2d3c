"""Keyed merge, insert-if-absent, quarantine and threshold match."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from shelfmart.operators.merge import collapse, insert_if_absent, merge_batch, merge_full
from shelfmart.operators.quarantine import accepted, flag, flag_unknown_day, missing, outcome_counts, rejected, too_long
from shelfmart.operators.threshold import count_matches, match_thresholds
from shelfmart.plans import staging
from tests.conftest import rows

SCHEMA = "id int, changes string, stays string, ver int"


def test_collapse_takes_first_and_last_version(spark):
    batch = spark.createDataFrame([(1, "b", "B", 2), (1, "a", "A", 1), (1, "c", "C", 3), (2, None, None, None)], SCHEMA)
    assert rows(collapse(batch, ["id"], ["changes"], ["ver"])) == [(1, "c", "A"), (2, None, None)]


def test_collapse_keeps_a_version_that_is_data(spark):
    batch = spark.createDataFrame([(1, "b", "B", 2), (1, "a", "A", 1)], SCHEMA)
    assert rows(collapse(batch, ["id"], ["changes", "ver"], ["ver"])) == [(1, "b", "A", 2)]


@pytest.mark.parametrize("merge", [merge_batch, merge_full])
def test_merge_updates_listed_columns_only(spark, merge):
    schema = "id int, changes string, stays string"
    target = spark.createDataFrame([(1, "old", "first"), (2, "old", "first"), (4, None, "first")], schema)
    batch = spark.createDataFrame([(2, "new", "second"), (3, "new", "second"), (4, "new", None)], schema)
    assert rows(merge(target, batch, ["id"], ["changes"])) == [
        (1, "old", "first"), (2, "new", "first"), (3, "new", "second"), (4, "new", "first"),
    ]
    nulled = spark.createDataFrame([(1, None, None)], schema)
    assert rows(merge(target, nulled, ["id"], ["changes"]))[0] == (1, None, "first")


@pytest.mark.parametrize("merge", [merge_batch, merge_full])
def test_merging_twice_changes_nothing(spark, merge):
    schema = "id int, changes string, stays string"
    target = spark.createDataFrame([(1, "a", "b")], schema)
    batch = spark.createDataFrame([(1, "c", "d"), (2, "e", "f")], schema)
    once = merge(target, batch, ["id"], ["changes"])
    assert rows(merge(once, batch, ["id"], ["changes"])) == rows(once)


versions = st.lists(
    st.tuples(st.integers(1, 4), st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=12
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(old=versions, new=versions)
def test_merge_equals_row_by_row_upserts(spark, old, new):
    """Against a loop that inserts or updates one version after another."""

    def upsert(state, batch):
        for key, changes, stays in batch:
            state[key] = (changes, state[key][1] if key in state else stays)
        return state

    def frame(batch):
        numbered = [(k, c, s, i) for i, (k, c, s) in enumerate(batch)]
        return collapse(spark.createDataFrame(numbered, "id int, changes int, stays int, ver int"), ["id"], ["changes"], ["ver"])

    expected = upsert(upsert({}, old), new)
    for merge in (merge_batch, merge_full):
        found = merge(frame(old), frame(new), ["id"], ["changes"])
        assert {r["id"]: (r["changes"], r["stays"]) for r in found.collect()} == expected


TABLES = [value for value in vars(staging).values() if isinstance(value, staging.StagingTable)]


@pytest.mark.parametrize("table", TABLES, ids=lambda t: t.name)
def test_every_staging_table_freezes_unlisted_columns(spark, at, table):
    columns = [c for c in table.updated if c not in ("raw_json", "ingested_at")] + ["frozen"]
    names = ", ".join([f"{table.keys[0]} int"] + [f"{c} string" for c in columns])
    first = spark.createDataFrame([(1, *["1 old"] * len(columns))], names)
    second = spark.createDataFrame([(1, *["2 new"] * len(columns))], names)
    loaded = staging.stage(None, first, table, at("2020-01-01"))
    row = staging.stage(loaded, second, table, at("2020-01-02")).first().asDict()
    assert row["frozen"] == "1 old"
    assert all(row[c] == "2 new" for c in columns if c != "frozen")
    assert row["ingested_at"] == at("2020-01-02")
    assert ("raw_json" in row) == table.keeps_payload


def test_an_older_batch_changes_nothing(spark, at):
    names = "order_id long, total decimal(15,4), order_status_id int, date_modified timestamp_ntz, shipping_city string"
    fifth = spark.createDataFrame([(1, None, 5, at("2020-01-05"), "a")], names)
    third = spark.createDataFrame([(1, None, 3, at("2020-01-03"), "b")], names)
    loaded = staging.stage(None, fifth, staging.WEBSITE_ORDERS, at("2020-01-06"))
    again = staging.stage(loaded, third, staging.WEBSITE_ORDERS, at("2020-01-07"))
    assert rows(again) == rows(loaded)


def test_a_collapsed_row_is_one_that_upserts_give(spark):
    batch = spark.createDataFrame([(1, 5, 1), (1, 3, 2)], "id int, quantity int, tax int")
    assert rows(collapse(batch, ["id"], ["quantity"])) == [(1, 5, 2)]


def test_insert_if_absent(spark):
    target = spark.createDataFrame([(1, "kept")], "id int, name string")
    batch = spark.createDataFrame([(1, "ignored"), (2, "added")], "id int, name string")
    assert rows(insert_if_absent(target, batch, ["id"])) == [(1, "kept"), (2, "added")]


def test_quarantine_names_the_first_broken_rule(spark):
    df = spark.createDataFrame([(1, "ok"), (2, None), (3, "x" * 9)], "id int, name string")
    flagged = flag(df, {"name_null": missing("name"), "name_length": too_long("name", 8)})
    assert rows(accepted(flagged)) == [(1, "ok")]
    assert rows(rejected(flagged).select("id", "violation")) == [(2, "name_null"), (3, "name_length")]
    assert rows(outcome_counts(flagged)) == [(1, 2)]


def test_unknown_and_missing_days(spark):
    days = spark.createDataFrame([(20200101,)], "date_id int")
    df = spark.createDataFrame([(1, 20200101), (2, 20200102), (3, None)], "id int, date_id int")
    flagged = flag_unknown_day(df, days, {})
    assert rows(flagged.select("id", "violation")) == [(1, None), (2, "date_unknown"), (3, "date_null")]


def test_thresholds_against_brute_force(spark):
    draw = random.Random(7)
    values = [draw.randint(-50, 300) for _ in range(200)] + [None, -(2**31), 2**31 - 1, 0]
    limits = [round(draw.uniform(-60, 310), 2) for _ in range(30)] + [0.0, -1.0, 2.0**31 - 1, 9999999999.0, -9999999999.0, None]
    items = spark.createDataFrame(list(enumerate(values)), "item int, stock int")
    rules = spark.createDataFrame(list(enumerate(limits)), "rule int, cap double").withColumn(
        "cap", F.col("cap").cast("decimal(12,2)")
    )
    found = match_thresholds(items, "stock", rules, "cap", ["rule"])
    expected = {(i, r) for i, v in enumerate(values) if v is not None for r, cap in enumerate(limits) if cap is not None and v <= cap}
    pairs = [(row["item"], row["rule"]) for row in found.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected
    counted = count_matches(items, "stock", rules, "cap").first()
    assert tuple(counted) == (len(expected), len({i for i, _ in expected}))
