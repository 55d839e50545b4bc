"""Keyed state: upsert with republish detection, grace, expiry, marks and selections, as pure merges of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import is_open, text


def last_stated(batch: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """One row a key: of each field the last value that isn't empty. Partial aggregation keeps hot keys small."""
    keep = [F.coalesce(F.max_by(F.col(f), F.when(text(F.col(f)) != "", F.col(order))), F.lit("")).alias(f) for f in fields]
    return batch.groupBy(key).agg(*keep)


def upsert(state: DataFrame, batch: DataFrame, key: str, order: str, fields: Sequence[str], now: str, day_field: str = "posted_date") -> DataFrame:
    """The state after a batch, with ``is_new``.

    Unseen keys enter with first_seen = now. Seen ones take every incoming value that isn't empty. A key whose incoming
    day is after the day of first_seen, and not in the future, counts as published again: first_seen = now, not notified.
    """
    today = now[:10]
    new = last_stated(batch, key, order, fields).select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = state.join(new, F.col(key) == F.col("_k"), "full_outer")
    unseen, present = F.col(key).isNull(), F.col("_k").isNotNull()
    again = present & ~unseen & (F.substring("first_seen", 1, 10) < F.col(f"_{day_field}")) & (F.col(f"_{day_field}") <= today) & (text(F.col(f"_{day_field}")) != "") & (text(F.col("first_seen")) != "")
    fresh = unseen | F.coalesce(again, F.lit(False))
    return both.select(
        F.coalesce(F.col(key), F.col("_k")).alias(key),
        *[F.coalesce(F.nullif(F.col(f"_{f}"), F.lit("")), F.col(f), F.lit("")).alias(f) for f in fields],
        F.when(fresh, now).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(present, today).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(fresh, False).otherwise(F.col("notified")).alias("notified"),
        (fresh & present).alias("is_new"),
    )


def carry_forward(state: DataFrame, present: DataFrame, key: str, today: str, grace_days: int, deadline: str = "deadline") -> DataFrame:
    """Rows missing from this run that are still open and were seen within the grace."""
    since = F.date_sub(F.lit(today).cast("date"), grace_days).cast("string")
    return state.join(present.select(key).distinct(), key, "left_anti").where(is_open(F.col(deadline), F.lit(today)) & (F.col("last_seen") >= since))


def unexpired(state: DataFrame, today: str, deadline: str = "deadline") -> DataFrame:
    return state.where(is_open(F.col(deadline), F.lit(today)))


def mark(state: DataFrame, keys: DataFrame, key: str, **values: Column) -> DataFrame:
    """Set columns of the rows whose key is listed; unknown keys are ignored."""
    listed = keys.select(F.col(key).alias("_k")).distinct().withColumn("_on", F.lit(True))
    joined = state.join(listed, F.col(key) == F.col("_k"), "left")
    return joined.withColumns({n: F.when(F.col("_on"), v).otherwise(F.col(n)) for n, v in values.items()}).drop("_k", "_on")


def remove(state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return state.join(keys.select(key), key, "left_anti")


def targets(state: DataFrame, today: str, most: int, tie: str) -> DataFrame:
    """Open rows not notified yet, oldest first, at most ``most``: a top-k."""
    return state.where(~F.col("notified") & is_open(F.col("deadline"), F.lit(today))).orderBy("first_seen", tie).limit(most)


def suppressed(state: DataFrame, today: str) -> DataFrame:
    """Rows not notified before they expired."""
    return state.where(~F.col("notified") & ~is_open(F.col("deadline"), F.lit(today)))
