"""Pairs of items and rules with `value <= threshold`, without a nested-loop or cross join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_SHIFT = 1 << 31
_LEVELS = 32


def reached(values: DataFrame, value: str, limits: DataFrame, limit: str) -> DataFrame:
    """(value, limit) for every limit that is at least an integer value; both sides hold each value once.

    An equi-join on aligned power-of-two blocks: a limit's integers, all up to it, split into at most 32 such blocks,
    and each value lies in exactly one of them. NULL reaches nothing and is reached by nothing.
    """
    count = F.greatest(
        F.lit(0).cast("long"),
        F.least(F.floor(F.col(limit)).cast("long"), F.lit(_SHIFT - 1)) + F.lit(_SHIFT + 1),
    )
    covers = limits.where(F.col(limit).isNotNull()).select(
        limit, count.alias("_count"), F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))).alias("_level")
    )
    covers = covers.where(_shift_right("_count", "_level") % 2 == 1).select(
        limit, "_level", (_shift_right("_count", "_level") - 1).alias("_block")
    )
    placed = values.where(F.col(value).isNotNull()).select(
        value,
        (F.col(value).cast("long") + F.lit(_SHIFT)).alias("_point"),
        F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))).alias("_level"),
    )
    placed = placed.withColumn("_block", _shift_right("_point", "_level"))
    return placed.join(covers, ["_level", "_block"]).select(value, limit)


def match_thresholds(
    items: DataFrame, value: str, rules: DataFrame, threshold: str, rule_cols: Sequence[str]
) -> DataFrame:
    """Items with the `rule_cols` of every rule whose threshold is at least the item's integer `value`.

    The different values meet the different thresholds first, however many rows share them; items and rules then join
    these on their own value. Rules without a threshold match nothing.
    """
    limits = rules.select(F.col(threshold).alias("_limit"), *rule_cols)
    pairs = reached(items.select(value).distinct(), value, limits.select("_limit").distinct(), "_limit")
    return items.join(pairs, value).join(limits, "_limit").select(*items.columns, *rule_cols)


# Points of the running sum are worked through in stretches of this many integers, so that no task holds more.
_STRETCH_BITS = 16


def count_matches(items: DataFrame, value: str, rules: DataFrame, threshold: str) -> DataFrame:
    """One row with `pairs`, the rows `match_thresholds` has, and `items`, how many items have any.

    A running sum: items per value and rules per threshold are points on one line, and an item reaches the rules at its
    point and above. Points are cut into stretches; the rules of all stretches above are summed over the stretches, of
    which there are 65,536 at most, and those within over the points of each. No value meets a threshold.
    """
    point = lambda number: F.greatest(F.lit(-_SHIFT), F.least(number.cast("long"), F.lit(_SHIFT - 1)))
    of_items = items.where(F.col(value).isNotNull()).groupBy(point(F.col(value)).alias("point"))
    of_rules = rules.where(F.col(threshold) >= -_SHIFT).groupBy(point(F.floor(threshold)).alias("point"))
    none = F.lit(0).cast("long")
    points = of_items.agg(F.count("*").alias("items"), none.alias("rules")).unionByName(
        of_rules.agg(none.alias("items"), F.count("*").alias("rules"))
    )
    points = points.groupBy("point").agg(F.sum("items").alias("items"), F.sum("rules").alias("rules"))
    points = points.withColumn("stretch", F.expr(f"shiftright(point, {_STRETCH_BITS})"))
    higher = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    above = points.groupBy("stretch").agg(F.sum("rules").alias("_rules"))
    above = above.select("stretch", F.coalesce(F.sum("_rules").over(higher), none).alias("above"))
    inside = Window.partitionBy("stretch").orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, 0)
    reached_rules = F.col("above") + F.sum("rules").over(inside)
    found = points.join(above, "stretch").select("items", reached_rules.alias("reached"))
    return found.agg(
        F.coalesce(F.sum(F.col("items") * F.col("reached")), none).alias("pairs"),
        F.coalesce(F.sum(F.when(F.col("reached") > 0, F.col("items"))), none).alias("items"),
    )


def _shift_right(name: str, by: str) -> Column:
    return F.expr(f"shiftright({name}, {by})")
