"""One key with a third of all rows: results stay whole and the hot key is split."""

import pytest
from pyspark.sql import functions as F

from shelfmart.operators.merge import collapse
from shelfmart.plans import facts
from tests.conftest import rows

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
}


@pytest.fixture
def splitting(spark):
    before = {key: spark.conf.get(key, None) for key in CONF}
    for key, value in CONF.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


N = 60_000


def hot_lines(spark):
    """Order 7 and product 3 hold a third of the lines."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, N, numPartitions=8).select(
        F.col("id").alias("order_product_id"),
        F.when(hot, 7).otherwise(F.col("id") % 5000).alias("order_id"),
        F.when(hot, 3).otherwise(F.col("id") % 700).alias("product_id"),
        F.lit(1).alias("quantity"),
        *[F.lit(1).cast("decimal(15,4)").alias(c) for c in ("price", "total", "tax")],
    )


def test_hot_order_and_product_are_split(spark, splitting, capsys):
    orders = spark.range(5000).selectExpr(
        "id AS source_order_id", "id AS order_id", "20200101 AS date_id", "cast(2 AS decimal(15,8)) AS currency_value", "1 AS channel_id"
    )
    products = spark.range(600).selectExpr(
        "id AS source_product_id", "id AS product_id", "id % 9 AS category_id", "'website' AS source_channel"
    )
    found = facts.website_lines(hot_lines(spark), orders, products)
    kept = {r["source_line_id"]: (r["order_id"], r["product_id"], int(r["line_total_uah"])) for r in found.collect()}
    expected = {}
    for i in range(N):
        order, product = (7, 3) if i % 3 == 0 else (i % 5000, i % 700)
        expected[i] = (order, product if product < 600 else None, 2)
    assert kept == expected
    found.explain()
    assert "skew=true" in capsys.readouterr().out


def test_hot_key_is_reduced_before_the_shuffle(spark, capsys):
    versions = hot_lines(spark).select("order_id", F.col("order_product_id").alias("ver"), "quantity")
    found = collapse(versions, ["order_id"], ["quantity", "ver"], ["ver"])
    newest = versions.groupBy("order_id").agg(F.max("ver").alias("ver"))
    assert rows(found.select("order_id", "ver")) == rows(newest)
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "partial_max" in plan and "partial_max" in plan[plan.index("Exchange") :]
