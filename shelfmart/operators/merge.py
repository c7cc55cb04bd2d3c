"""Keyed merge with a list of updatable columns; every other column keeps the value of its first insert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfmart.functions.coerce import json_payload

# What a merge did to a row: INSERTED, UPDATED, or NULL where it left the row alone.
CHANGE = "_change"
INSERTED, UPDATED = "inserted", "updated"


def collapse(
    batch: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str],
    version: Sequence[str] = (),
    payload: Sequence[str] = (),
) -> DataFrame:
    """One row per key, as if the versions had been upserted in order.

    Updatable columns come from the last version and the others from the first. Both picks follow one order, by
    `version` and then by all other columns, so the row is one that some order of upserts gives. Both are struct
    aggregates: a key repeated any number of times is reduced to one row per input task before the shuffle. The
    `version` columns are not kept unless they are also data columns. With `payload`, `raw_json` holds those columns of
    the last version as JSON text, made after the picks so that they do not carry the text.
    """
    carried = [c for c in batch.columns if c not in keys]
    frozen = [c for c in carried if c not in update_cols and c not in version]
    updated = [c for c in carried if c in update_cols]
    order = [F.col(c).alias(f"_v{i}") for i, c in enumerate(version)]
    picks = []
    if updated or payload:
        picks.append(F.max(F.struct(*order, *carried)).alias("_last"))
    if frozen:
        picks.append(F.min(F.struct(*order, *carried)).alias("_first"))
    if not picks:
        return batch.select(*keys).distinct()
    grouped = batch.groupBy(*keys).agg(*picks)
    last = [F.col(c) if c in keys else F.col(f"_last.{c}") for c in payload]
    return grouped.select(
        *[
            F.col(c) if c in keys else F.col(f"_last.{c}" if c in updated else f"_first.{c}").alias(c)
            for c in batch.columns
            if c in keys or c in updated or c in frozen
        ],
        *([json_payload(*last).alias("raw_json")] if payload else []),
    )


def _newer(version: Sequence[str], old: str, new: str) -> Column:
    """The batch has the key, and its version, if there is one, is not older; a missing version is the oldest."""
    found = F.coalesce("_in_batch", F.lit(False))
    if not version:
        return found
    stored, arriving = (F.struct(*[F.col(f"{prefix}{c}") for c in version]) for prefix in (old, new))
    return found & (arriving >= stored)


def batch_changes(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], update_cols: Sequence[str], version: Sequence[str] = ()
) -> DataFrame:
    """`merge_batch`, with what happened to each row as CHANGE."""
    keys = list(keys)
    patch = batch.select(*keys, F.lit(True).alias("_in_batch"), *[F.col(c).alias(f"_new_{c}") for c in update_cols])
    replaced = _newer(version, "", "_new_")
    kept = target.join(patch, keys, "left").select(
        *[
            F.when(replaced, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update_cols else F.col(c)
            for c in target.columns
        ],
        F.when(replaced & F.lit(bool(update_cols)), UPDATED).alias(CHANGE),
    )
    known = target.select(*keys).join(batch.select(*keys), keys, "left_semi")
    fresh = batch.join(known, keys, "left_anti").select(*target.columns, F.lit(INSERTED).alias(CHANGE))
    return kept.unionByName(fresh)


def merge_batch(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], update_cols: Sequence[str], version: Sequence[str] = ()
) -> DataFrame:
    """Merge a batch (one row per key, all columns of the target) that is small next to its target.

    With `version`, updatable columns of the target, a row of an older version than the stored one changes nothing.

    Existing rows take a left join and new rows an anti join against the keys the batch found in the target. When
    Spark measures the batch as small enough to broadcast, the target is not shuffled at all; otherwise both joins
    are sort-merge joins on the key.
    """
    return batch_changes(target, batch, keys, update_cols, version).drop(CHANGE)


def full_changes(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], update_cols: Sequence[str], version: Sequence[str] = ()
) -> DataFrame:
    """`merge_full`, with what happened to each row as CHANGE."""
    keys = list(keys)
    others = [c for c in target.columns if c not in keys]
    old = target.select(*keys, F.lit(True).alias("_in_target"), *[F.col(c).alias(f"_old_{c}") for c in others])
    new = batch.select(*keys, F.lit(True).alias("_in_batch"), *[F.col(c).alias(f"_new_{c}") for c in others])
    joined = old.join(new, keys, "full_outer")
    fresh = F.col("_in_target").isNull()
    replaced = fresh | _newer(version, "_old_", "_new_")

    def value(c):
        if c in keys:
            return F.col(c)
        if c in update_cols:
            return F.when(replaced, F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c)
        return F.when(F.col("_in_target"), F.col(f"_old_{c}")).otherwise(F.col(f"_new_{c}")).alias(c)

    change = F.when(fresh, INSERTED).when(replaced & F.lit(bool(update_cols)), UPDATED).alias(CHANGE)
    return joined.select(*[value(c) for c in target.columns], change)


def merge_full(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], update_cols: Sequence[str], version: Sequence[str] = ()
) -> DataFrame:
    """Merge a batch (one row per key) of the same order of size as its target: one full outer join on the key. As for
    `version`, see `merge_batch`."""
    return full_changes(target, batch, keys, update_cols, version).drop(CHANGE)


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the batch rows (one per key) whose key the target does not have."""
    keys = list(keys)
    fresh = batch.join(target.select(*keys), keys, "left_anti").select(*target.columns)
    return target.unionByName(fresh)
