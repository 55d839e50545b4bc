"""What changed between consecutive full snapshots, by subtracting invertible Bloom lookup tables.

Every record becomes an element (128-bit key hash, 64-bit value hash) of the table of its hash bucket and snapshot: three
cells hold a count and the XOR of keys, values and a check. Cells of neighbouring snapshots are subtracted, so that equal
records cancel and only the difference stays. Each bucket's rest is peeled; a bucket that doesn't peel or whose digest
isn't met comes again with four times the cells and other positions. The recovered keys are classified, and an exact
comparison of the few recovered records ends it.

Defined results: rows without uid or snapshot date have no identity and are left out; of several rows of one uid in a
snapshot the latest delivered counts, among equals the largest row id; an unreadable deadline or first_seen counts by its
trimmed text; the first snapshot has no predecessor and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.timestamps import interpret, normal_form, plain_day, plain_second
from sievework.session import written

P1, P2, P3, P4, P5 = (  # fixed values: the primes of the 64-bit xxHash
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
)
HASHES = 3
BUCKET_ROWS = 1024
GROWTH = 4
ROUNDS = 6


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """64-bit xxHash of an 8-byte integer, as Spark's xxhash64 has it."""
    u = np.uint64
    rot = lambda v, r: (v << u(r)) | (v >> u(64 - r))
    with np.errstate(over="ignore"):
        h = seed + u(P5) + u(8)
        h = h ^ (rot(x * u(P2), 31) * u(P1))
        h = rot(h, 27) * u(P1) + u(P4)
        h = (h ^ (h >> u(33))) * u(P2)
        h = (h ^ (h >> u(29))) * u(P3)
        return h ^ (h >> u(32))


def _hash(*longs: np.ndarray) -> np.ndarray:
    h = np.full(len(longs[0]), 42, dtype=np.uint64)
    for x in longs:
        h = _hash_long(np.asarray(x).astype(np.int64).view(np.uint64), h)
    return h.view(np.int64)


def _positions(k1, k2, v, cells: int, turn: int) -> np.ndarray:
    part = cells // HASHES
    e = _hash(k1, k2, v)
    full = np.full(len(e), 0, dtype=np.int64)
    return np.stack([np.mod(_hash(e, full + (turn * HASHES + i)), part) + i * part for i in range(HASHES)])


def _peel(cell, count, k1, k2, v, check, cells: int, turn: int) -> tuple[list[tuple[int, int, int, int]], bool]:
    """Elements (side, k1, k2, v) of a subtracted table, and whether nothing is left."""
    table = np.zeros((5, cells), dtype=np.int64)
    for row, x in enumerate((count, k1, k2, v, check)):
        table[row, cell] = x
    out: list[tuple[int, int, int, int]] = []
    while True:
        at = np.flatnonzero(np.abs(table[0]) == 1)
        if len(at):
            at = at[_hash(table[1, at], table[2, at], table[3, at], np.full(len(at), 7)) == table[4, at]]
        if not len(at):
            break
        _, first = np.unique(table[1:4, at], axis=1, return_index=True)
        at = at[first]
        got = table[:, at].copy()
        out += [tuple(map(int, x)) for x in got[:4].T]
        for pos in _positions(got[1], got[2], got[3], cells, turn):
            np.subtract.at(table[0], pos, got[0])
            for row in range(1, 5):
                np.bitwise_xor.at(table[row], pos, got[row])
    return out, not table.any()


def _round_up(n: float) -> int:
    return max(HASHES * 8, int(np.ceil(n / HASHES)) * HASHES)


def latest(snapshots: DataFrame) -> DataFrame:
    """One row a snapshot and uid, with day and second in one form and the hashes of key and value."""
    best = (
        snapshots.where(F.col("uid").isNotNull() & F.col("snapshot_date").isNotNull())
        .groupBy("snapshot_date", "uid")
        .agg(F.max_by(F.struct("deadline", "first_seen"), F.struct("delivered_at", "snap_row_id")).alias("v"))
        .select("snapshot_date", "uid", "v.*")
    )
    for name in ("deadline", "first_seen"):
        kept = [c for c in best.columns]
        # what is in plain form already isn't read: a null text passes all patterns unevaluated
        plain = plain_day(F.col(name)) if name == "deadline" else plain_second(F.col(name))
        marked = best.withColumn("is_plain", plain)
        read = interpret(marked.withColumns({"text": F.when(~F.col("is_plain") & (F.col(name) != ""), F.col(name)), "zone": F.lit("UTC")}))
        first = F.try_element_at("all", F.lit(1))
        as_is = F.col(name) if name == "deadline" else F.concat(F.col(name), F.lit("Z"))
        form = F.when(F.col("is_plain"), as_is).otherwise(normal_form(first["ep"], F.lit(name == "deadline")))
        best = read.withColumn(name, F.coalesce(form, F.trim(F.coalesce(F.col(name), F.lit(""))))).select(*kept)
    value = F.xxhash64(F.length("deadline"), "deadline", "first_seen")
    return best.withColumns({"k1": F.xxhash64("uid"), "k2": F.xxhash64(F.lit("second"), "uid"), "v": value})


def changes(snapshots: DataFrame, bucket_rows: int = BUCKET_ROWS, first_share: float = 0.75, rounds: int = ROUNDS) -> DataFrame:
    """from_date, to_date, uid and change (added, removed, changed) between neighbouring snapshot dates.

    ``bucket_rows``: mean records of a snapshot in a bucket; ``first_share``: cells of the first round a record.
    """
    spark = snapshots.sparkSession
    rows = written(latest(snapshots), "snapshots")
    sizes = rows.groupBy("snapshot_date").count()
    dates = sizes.select("snapshot_date", F.lag("snapshot_date").over(Window.orderBy("snapshot_date")).alias("before"), "count")
    largest = dates.agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-largest // bucket_rows))
    pairs = dates.where("before is not null").select(F.col("before").alias("from_date"), F.col("snapshot_date").alias("to_date"))
    part_of = F.pmod(F.xxhash64(F.lit(3), "k1", "k2"), F.lit(buckets))
    sides = pairs.select(
        "from_date", "to_date",
        F.explode(F.array(F.struct(F.col("to_date").alias("snapshot_date"), F.lit(1).alias("side")), F.struct(F.col("from_date").alias("snapshot_date"), F.lit(-1).alias("side")))).alias("x"),
    ).select("from_date", "to_date", "x.*")
    elements = rows.select("snapshot_date", "k1", "k2", "v", part_of.alias("bucket"))
    digest = (
        elements.groupBy("snapshot_date", "bucket")
        .agg(F.bit_xor(F.xxhash64("k1", "k2", "v", F.lit(11).cast("long"))).alias("digest"))
        .join(sides, "snapshot_date")
        .groupBy("from_date", "to_date", "bucket")
        .agg(F.bit_xor("digest").alias("digest"))
    )
    todo, recovered = None, []
    cells = _round_up(bucket_rows * first_share)
    for turn in range(rounds):
        own = elements if todo is None else elements.join(
            todo.join(sides, ["from_date", "to_date"]).select("snapshot_date", "bucket").distinct(), ["snapshot_date", "bucket"], "left_semi"
        )
        part = cells // HASHES
        e = F.xxhash64("k1", "k2", "v")
        places = F.array(*[F.pmod(F.xxhash64(e, F.lit(turn * HASHES + i).cast("long")), F.lit(part)) + i * part for i in range(HASHES)])
        check = F.xxhash64("k1", "k2", "v", F.lit(7).cast("long"))
        sums = [F.bit_xor(c).alias(c) for c in ("k1", "k2", "v", "check")]
        table = own.withColumn("check", check).withColumn("cell", F.explode(places)).groupBy("snapshot_date", "bucket", "cell").agg(F.count("*").alias("n"), *sums)
        left = (
            table.join(sides, "snapshot_date")
            .groupBy("from_date", "to_date", "bucket", "cell")
            .agg(F.sum(F.col("n") * F.col("side")).alias("n"), *sums)
            .where("n != 0 or k1 != 0 or k2 != 0 or v != 0 or check != 0")
            .groupBy("from_date", "to_date", "bucket")
            .agg(F.collect_list(F.struct("cell", "n", "k1", "k2", "v", "check")).alias("rest"))
        )
        if todo is not None:
            left = left.join(todo, ["from_date", "to_date", "bucket"], "left_semi")
        left = left.join(digest, ["from_date", "to_date", "bucket"])

        def peel(batches: Iterator[pd.DataFrame], cells: int = cells, turn: int = turn) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for f, t, b, rest, want in zip(batch.from_date, batch.to_date, batch.bucket, batch.rest, batch.digest):
                    x = np.array([[r["cell"], r["n"], r["k1"], r["k2"], r["v"], r["check"]] for r in rest], dtype=np.int64).T
                    got, done = _peel(*x, cells, turn)
                    a = np.array(got, dtype=np.int64).reshape(-1, 4)
                    met = int(np.bitwise_xor.reduce(_hash(a[:, 1], a[:, 2], a[:, 3], np.full(len(a), 11)))) if len(a) else 0
                    if not done or met != want:
                        yield pd.DataFrame({"from_date": [f], "to_date": [t], "bucket": [b], "side": [0], "k1": [0], "k2": [0]})
                    elif len(a):
                        yield pd.DataFrame({"from_date": f, "to_date": t, "bucket": b, "side": a[:, 0], "k1": a[:, 1], "k2": a[:, 2]})

        peeled = written(left.mapInPandas(peel, "from_date string, to_date string, bucket long, side long, k1 long, k2 long"), "peeled")
        recovered.append(peeled.where("side != 0"))
        todo = peeled.where("side = 0").select("from_date", "to_date", "bucket")
        failed = todo.count()
        if not failed:
            break
        cells = _round_up(cells * GROWTH)
    else:
        raise RuntimeError(f"{failed} buckets did not peel after {rounds} rounds; raise rounds or lower bucket_rows")
    keys = recovered[0]
    for more in recovered[1:]:
        keys = keys.unionByName(more)
    classed = keys.groupBy("from_date", "to_date", "k1", "k2").agg(F.max("side").alias("hi"), F.min("side").alias("lo"))
    # the records of the recovered keys, compared exactly
    where = classed.withColumn("snapshot_date", F.when(F.col("hi") == 1, F.col("to_date")).otherwise(F.col("from_date")))
    other = rows.select(F.col("snapshot_date").alias("_d"), F.col("uid").alias("_u"), F.col("deadline").alias("_a"), F.col("first_seen").alias("_b"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    named = where.join(rows, ["snapshot_date", "k1", "k2"]).drop("v")
    both = named.where("hi = 1 and lo = -1").join(
        other, (F.col("_d") == F.col("from_date")) & (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")) & (F.col("_u") == F.col("uid"))
    )
    changed = both.where("deadline != _a or first_seen != _b").select("from_date", "to_date", "uid", F.lit("changed").alias("change"))
    single = named.where("hi = lo").select("from_date", "to_date", "uid", F.when(F.col("hi") == 1, "added").otherwise("removed").alias("change"))
    assert spark is not None
    return single.unionByName(changed)
