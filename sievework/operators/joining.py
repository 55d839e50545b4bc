"""Lookups, hydration, scope fan-out and comparisons of counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import text


HOT = 10_000  # rows of a key that one task takes without harm


def latest_by(df: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """The last row's fields of each key, by partial aggregation."""
    return df.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(order)).alias("_r")).select(key, "_r.*")


def lookup(rows: DataFrame, one: DataFrame, key: str, fields: Sequence[str], count: str, most: int = 4096, at_most: int | None = None) -> DataFrame:
    """Rows inner-joined to a table of one row a key whose column ``count`` says how many rows have that key.

    Keys that hold more than a ``most``-th of all rows are at most ``most``, so they are broadcast and their rows stay
    where they are; only rows of the other keys are shuffled, and none of those keys is hot. Null keys match nothing.
    With fewer rows than ``HOT`` (``at_most``: a bound the caller knows) no key is hot and nothing is measured.
    """
    small = one.select(F.col(key).alias("_k"), F.col(count).alias("_n"), *[F.col(f).alias(f"_{f}") for f in fields])
    if at_most is not None and at_most <= HOT:
        return rows.join(small, F.col(key) == F.col("_k")).select(*rows.columns, *[F.col(f"_{f}").alias(f) for f in fields])
    sizes = small.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("all"), F.coalesce(F.max("_n"), F.lit(0)).alias("top")).first()
    limit = max(sizes["all"] // most, 1)
    if sizes["top"] <= max(limit, HOT):  # no key is hot
        return rows.join(small, F.col(key) == F.col("_k")).select(*rows.columns, *[F.col(f"_{f}").alias(f) for f in fields])
    hot, cold = small.where(F.col("_n") > limit), small.where(F.col("_n") <= limit)
    names = [*rows.columns, *[F.col(f"_{f}").alias(f) for f in fields]]
    near = rows.join(F.broadcast(hot), F.col(key) == F.col("_k")).select(*names)
    rest = rows.join(F.broadcast(hot.select(F.col("_k").alias("_h"))), F.col(key) == F.col("_h"), "left_anti")
    return near.unionByName(rest.join(cold, F.col(key) == F.col("_k")).select(*names))


def hydrate(df: DataFrame, known: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fill empty fields from the known row of the same key."""
    other = known.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = df.join(other, F.col(key) == F.col("_k"), "left")
    filled = {f: F.coalesce(F.nullif(text(F.col(f)), F.lit("")), F.col(f"_{f}"), F.lit("")) for f in fields}
    return joined.withColumns(filled).drop("_k", *[f"_{f}" for f in fields])


def fan_out(items: DataFrame, subscribers: DataFrame, scopes: Mapping[str, Column], item_key: str) -> DataFrame:
    """Items with each subscriber whose scope takes them; items nobody takes stay with a null subscriber.

    Scopes are predicates on the item, so an item is exploded to the scopes that take it and joined on the scope's name:
    an equi-join, no product of items and subscribers that aren't served.
    """
    taken = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in scopes.items()]))
    wide = items.withColumn("scope", F.explode_outer(taken))
    return wide.join(subscribers.withColumnRenamed("scope", "_scope"), F.col("scope") == F.col("_scope"), "left").drop("_scope")


def outcome(deliveries: DataFrame, item_key: str, subscribers: int) -> DataFrame:
    """An item counts as delivered if there is nobody to serve, one attempt went through, or none failed for the moment."""
    sent = deliveries.groupBy(item_key).agg(F.count("result").alias("relevant"), F.count_if(F.col("result") == "ok").alias("ok"), F.count_if(F.col("result") == "fail").alias("transient"))
    done = F.lit(subscribers == 0) | (F.col("relevant") == 0) | (F.col("ok") > 0) | (F.col("transient") == 0)
    return sent.withColumn("delivered", done)


def compare(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """Values of this run beside those of the last, keys of either."""
    a, b = now.select(key, F.col(value).alias("now")), before.select(key, F.col(value).alias("before"))
    return a.join(b, key, "full_outer")
