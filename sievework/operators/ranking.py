"""Caps, sorts and top-k. Stable order is always an explicit order column."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cap(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group (0: all); ranked in the map tasks first."""
    if not most:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def placed(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order with their ``place`` from 1: a top-k, numbered after it."""
    return top(df, order, n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def by_list(c: Column, values: Sequence[str]) -> Column:
    """Sort key: place in a list, values outside it after all others."""
    out = None
    for i, v in enumerate(values):
        out = F.when(c == v, i) if out is None else out.when(c == v, i)
    return F.lit(0) if out is None else out.otherwise(len(values))


def previous(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """The value of the group's row before."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def spread(df: DataFrame, list_key: str, category: str, order: str, most_run: int = 2) -> DataFrame:
    """Reorder each list so that no category runs longer than ``most_run`` while another is left; adds ``place``.

    Greedy and sequential by definition, so a list is one group; lists are display pages, capped before.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("place", T.IntegerType())])

    def walk(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(order)
        left, out, run = list(range(len(page))), [], 0
        kinds = page[category].tolist()
        while left:
            last = kinds[out[-1]] if out else None
            at = 0
            if out and run >= most_run and kinds[left[0]] == last:
                at = next((i for i, x in enumerate(left) if kinds[x] != last), 0)
            pick = left.pop(at)
            run = run + 1 if out and kinds[pick] == last else 1
            out.append(pick)
        return page.iloc[out].assign(place=range(len(out))).astype({"place": "int32"})

    return df.groupBy(list_key).applyInPandas(walk, schema)


def pack(df: DataFrame, list_key: str, line: str, order: Sequence[str], most: int, header: str, joint: str = "\n\n") -> DataFrame:
    """Lines of each list packed greedily into messages of at most ``most`` characters; a longer line is one alone.

    list_key, message number, lines and text. Sequential by definition, one fold over each list's sorted array.
    """
    cost = lambda x: F.length(x) + len(joint)
    start = F.struct(F.array().cast("array<struct<size:int,lines:array<string>>>").alias("done"))

    def add(acc: Column, x: Column) -> Column:
        n = F.size(acc["done"])
        last = F.try_element_at(acc["done"], F.lit(-1))
        fits = (n > 0) & (last["size"] + cost(x) <= most)
        one = F.struct((F.lit(len(header) + len(joint)) + cost(x)).cast("int").alias("size"), F.array(x).alias("lines"))
        more = F.struct((last["size"] + cost(x)).cast("int").alias("size"), F.concat(last["lines"], F.array(x)).alias("lines"))
        return F.struct(F.when(fits, F.concat(F.slice(acc["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(more))).otherwise(F.concat(acc["done"], F.array(one))).alias("done"))

    lines = df.groupBy(list_key).agg(F.array_sort(F.collect_list(F.struct(*order, line))).alias("all"))
    folded = lines.select(list_key, F.aggregate(F.transform("all", lambda x: x[line]), start, add)["done"].alias("done"))
    each = folded.select(list_key, F.posexplode("done").alias("message", "m"))
    head = F.concat(F.lit(header), F.when(F.col("message") > 0, F.concat(F.lit(" ("), (F.col("message") + 1).cast("string"), F.lit(")"))).otherwise(""))
    return each.select(list_key, "message", F.size("m.lines").alias("lines"), F.concat_ws(joint, head, F.concat_ws(joint, "m.lines")).alias("text"))
