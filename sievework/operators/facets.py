"""Counts, facets, shares and percentiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet(df: DataFrame, column: str, labels: Sequence[str], name: str = "n") -> DataFrame:
    """Rows of each declared label, zeros included; other labels don't count."""
    declared = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], "place int, label string")
    counts = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias(name))
    return declared.join(counts, "label", "left").select("place", "label", F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name))


def count_by(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    """Rows of each combination of keys."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def boxes(df: DataFrame, declared: DataFrame, label: str, order: str, most: int) -> DataFrame:
    """place, label and the first ``most`` keys in order of each declared label (place, label); empty labels stay."""
    from sievework.operators.ranking import cap

    few = cap(df.where(F.col(label).isNotNull()), [label], [F.col(order)], most)
    lists = few.groupBy(F.col(label).alias("_l")).agg(F.array_sort(F.collect_list(order)).alias("ids"))  # at most ``most`` a label
    return declared.join(lists, F.col("label") == F.col("_l"), "left").select("place", "label", "ids")


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float]) -> DataFrame:
    """Percentiles by nearest rank, index ``p/100 * (n-1)`` rounded half to even.

    Ranks come from counts of distinct values. They are range-sorted, each task counts its own, and the counts of the
    tasks before it (one row a task and group) are added, so that a group of any size is many tasks.
    """
    from pyspark.sql import Window

    from sievework.session import written

    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    part = written(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ranks")
    sums = part.groupBy(*keys, "_part").agg(F.sum("c").alias("own"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_part", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("base"), F.sum("own").over(Window.partitionBy(*keys)).alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_part"]])
    up = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = part.alias("r").join(base.alias("b"), same).select("r.*", "b.base", "b.n")
    placed = joined.withColumn("upto", F.sum("c").over(up) + F.col("base"))
    index = lambda p: F.greatest(F.lit(0), F.least(F.col("n") - 1, F.bround(F.lit(p / 100.0) * (F.col("n") - 1), 0).cast("long")))
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > index(p), F.col(value))).alias(f"p{p:g}") for p in percents])


def below(df: DataFrame, value: str, floors: Sequence[float]) -> DataFrame:
    """How many values lie below each of several floors, in one pass."""
    counts = df.agg(*[F.count_if(F.col(value) < f).alias(f"f{i}") for i, f in enumerate(floors)])
    each = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("floor"), F.col(f"f{i}").alias("below")) for i, f in enumerate(floors)]))
    return counts.select(each.alias("x")).select("x.*")


def conditional(df: DataFrame, keys: Sequence[str], **conditions: Column) -> DataFrame:
    """Counts of rows that meet each condition."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])
