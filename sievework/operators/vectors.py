"""Vector similarity against prototypes and between candidate pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.scalars import cosine
from sievework.operators.dedup import components, token_pairs
from sievework.session import written


def prototypes(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label: sums per label and position, so partial aggregation keeps the shuffle at labels x length."""
    each = vectors.select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("prototype"))


def similarities(vectors: DataFrame, key: str, vector: str, protos: DataFrame, limit_bytes: int = 8 << 20) -> DataFrame:
    """key, label and cosine with every prototype.

    Prototypes are few by definition (one a label). Their size is measured: within ``limit_bytes`` they are sent to all
    tasks in one piece, beyond it in pieces of that size, each a pass over the vectors, so that no vector is shuffled and
    no task holds more than one piece. A row without a vector has no similarity.
    """
    size = protos.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("prototype")), F.lit(1)).alias("m")).first()
    pieces = max(1, -(-int(size["n"]) * int(size["m"]) * 8 // limit_bytes))
    own = written(protos.withColumn("_piece", F.pmod(F.xxhash64("label"), F.lit(pieces))), "prototypes")
    rows, out = vectors.where(F.col(vector).isNotNull()).select(key, vector), None
    for k in range(pieces):
        held = own.where(F.col("_piece") == k).agg(F.collect_list(F.struct("label", "prototype")).alias("p"))  # one row of bounded size
        each = rows.join(F.broadcast(held)).select(key, vector, F.explode("p").alias("p"))
        part = each.select(key, "p.label", cosine(F.col(vector), F.col("p.prototype")).alias("similarity"))
        out = part if out is None else out.unionByName(part)
    return out


def gate(scores: DataFrame, key: str, floor: float, rows: DataFrame | None = None) -> DataFrame:
    """Keys whose best similarity reaches the floor, with the best label (ties: the smallest) and its lead over the next.

    With ``rows``, keys of it that have no similarity (no vector) are kept, without a label.
    """
    best = scores.groupBy(key).agg(F.max(F.struct("similarity", (-F.col("label")).alias("minus"))).alias("b"), F.sort_array(F.collect_list("similarity"), asc=False).alias("all"))
    out = best.select(key, (-F.col("b.minus")).alias("label"), F.col("b.similarity").alias("similarity"), (F.try_element_at("all", F.lit(1)) - F.coalesce(F.try_element_at("all", F.lit(2)), F.lit(0.0))).alias("margin"))
    passed = out.where(F.col("similarity") >= floor)
    if rows is None:
        return passed
    bare = rows.select(key).join(scores.select(key).distinct(), key, "left_anti")
    return passed.unionByName(bare, allowMissingColumns=True)


def reassign(scores: DataFrame, key: str, current: DataFrame, margin: float) -> DataFrame:
    """label and new_label: the best label replaces the current one if it leads it by more than the margin."""
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), "label")
    best = scores.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, F.col("label").alias("best"), F.col("similarity").alias("top"))
    own = scores.withColumnsRenamed({"label": "own_label", "similarity": "own"})
    joined = current.join(best, key).join(own, (current[key] == own[key]) & (current["label"] == own["own_label"]), "left").drop(own[key])
    moved = (F.col("best") != F.col("label")) & F.col("own").isNotNull() & (F.col("top") - F.col("own") > margin)
    return joined.select(key, "label", F.when(moved, F.col("best")).otherwise(F.col("label")).alias("new_label"))


def edges(vectors: DataFrame, key: str, vector: str, pairs: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (lo, hi) whose vectors reach a cosine."""
    a = vectors.select(F.col(key).alias("lo"), F.col(vector).alias("va"))
    b = vectors.select(F.col(key).alias("hi"), F.col(vector).alias("vb"))
    scored = pairs.select("lo", "hi").join(a, "lo").join(b, "hi").withColumn("similarity", cosine(F.col("va"), F.col("vb")))
    return scored.where(F.col("similarity") >= threshold).select("lo", "hi", "similarity")


def block_edges(vectors: DataFrame, key: str, vector: str, block: str, threshold: float, rows: int = 4096) -> DataFrame:
    """All pairs (lo, hi) of one block whose vectors reach a cosine: a similarity join.

    A block is cut into parts of about ``rows`` rows and each part meets each other part once as two matrices, so that a
    block that holds a third of all rows is many tasks of bounded size. Only pairs that reach the threshold come out.
    """
    sizes = vectors.groupBy(block).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("_parts"))
    own = vectors.join(sizes, vectors[block].eqNullSafe(sizes[block])).drop(sizes[block]).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))
    base = own.select(F.col(block).cast("string").alias("block"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), "_part", "_parts")
    left = base.withColumn("other", F.explode(F.sequence(F.col("_part"), F.col("_parts") - 1))).select("block", F.col("_part").alias("p"), F.col("other").alias("q"), "id", "v")
    right = base.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_part")))).select(*[F.col(a).alias(b) for a, b in (("block", "block"), ("other", "p"), ("_part", "q"), ("id", "id"), ("v", "v"))])

    def meet(key_: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"lo": pd.Series(dtype="int64"), "hi": pd.Series(dtype="int64")})
        if a.empty or b.empty:
            return none
        x, y = np.stack(a.v.to_numpy()), np.stack(b.v.to_numpy())
        norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
        cos = np.divide(x @ y.T, norm, out=np.zeros_like(norm), where=norm > 0)
        i, j = np.nonzero(cos >= threshold)
        m, n = a.id.to_numpy()[i], b.id.to_numpy()[j]
        keep = m < n if key_[1] == key_[2] else m != n
        return pd.DataFrame({"lo": np.minimum(m, n)[keep], "hi": np.maximum(m, n)[keep]})

    keys = ["block", "p", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "lo long, hi long")


def refine(rows: DataFrame, key: str, category: str, signature: str, vectors: DataFrame, vector: str, threshold: float, least: int, fields: Sequence[str], dupes: str = "dupes") -> DataFrame:
    """Rows merged where they share a category, ``least`` title tokens and a cosine, over any number of links.

    The smallest key of a group stays, with its own ``dupes`` first, then each absorbed row followed by its dupes, in key
    order. Rows without tokens, vector or category are never merged and left out before rows meet. Candidates come from an
    exact prefix filter on tokens, so no category is held against itself.
    """
    able = rows.where(F.col(category).isNotNull() & (F.size(signature) > 0)).select(key, category, signature)
    able = written(able.join(vectors.where(F.col(vector).isNotNull()).select(key).distinct(), key, "left_semi"), "able")
    near = written(edges(vectors, key, vector, token_pairs(able, key, signature, category, least), threshold).select("lo", "hi"), "near")
    ends = near.select(F.col("lo").alias("id")).unionByName(near.select(F.col("hi").alias("id"))).distinct()
    linked = components(ends, near).select(F.col("id").alias("_i"), F.col("component"))
    whole = rows.join(linked, F.col(key) == F.col("_i"), "left").withColumn("_g", F.coalesce("component", F.col(key))).drop("_i", "component")
    kind = whole.schema[dupes].dataType if dupes in rows.columns else None
    own = F.array(F.struct(key, *fields))
    held = F.coalesce(F.col(dupes), F.array().cast(kind)) if kind else None
    absorbed = whole.where(F.col(key) != F.col("_g")).withColumn("_d", F.concat(own.cast(kind), held) if kind else own)
    more = absorbed.groupBy(F.col("_g").alias("_c")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(key, "_d"))), lambda x: x["_d"])).alias("_more"))
    kept = whole.where(F.col(key) == F.col("_g")).join(more, F.col("_g") == F.col("_c"), "left")
    both = F.concat(held, F.coalesce("_more", F.array().cast(kind))) if kind else F.col("_more")
    return kept.withColumn(dupes, F.when(F.size(both) > 0, both)).drop("_c", "_more", "_g")


def missing(items: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Items whose vector isn't in the cache."""
    return items.join(cache.select(key).distinct(), key, "left_anti")
