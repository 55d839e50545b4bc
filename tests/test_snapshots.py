from __future__ import annotations

import random

from pyspark.sql import functions as F

from sievework.operators import snapshots as sn

SCHEMA = "snap_row_id long, snapshot_date string, delivered string, uid string, deadline string, first_seen string, last_seen string, v string, cell string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("delivered_at", F.col("delivered").cast("timestamp"))


def brute(rows):
    best = {}
    for r in rows:
        if r[1] is None or r[3] is None:
            continue
        k = (r[1], r[3])
        if k not in best or (r[2], r[0]) > (best[k][2], best[k][0]):
            best[k] = r
    dates = sorted({k[0] for k in best})
    out = set()
    for a, b in zip(dates, dates[1:]):
        x = {u: (r[4] or "", r[5]) for (d, u), r in best.items() if d == a}
        y = {u: (r[4] or "", r[5]) for (d, u), r in best.items() if d == b}
        for u in x.keys() | y.keys():
            if u not in x:
                out.add((a, b, u, "added"))
            elif u not in y:
                out.add((a, b, u, "removed"))
            elif x[u] != y[u]:
                out.add((a, b, u, "changed"))
    return out


def random_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for d in ("2026-01-01", "2026-01-09", "2026-01-11"):
        for u in range(n):
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                rows.append((len(rows), d, f"{d} 0{rng.randint(0, 3)}:00:00", f"u{u}", rng.choice(["2026-02-01", "2026-02-02", "", None]), f"2026-01-0{rng.randint(1, 2)}T00:00:00Z", d, "x", None))
    return rows


def test_against_brute_force_with_enlarged_buckets(spark):
    rows = random_rows(400, 1)
    for first_share in (0.9, 0.02):  # the second must enlarge its tables
        got = sn.changes(frame(spark, rows), bucket_rows=64, first_share=first_share)
        assert {tuple(r) for r in got.collect()} == brute(rows)
        assert got.count() == len(brute(rows))


def test_ways_to_write(spark):
    rows = [
        (1, "2026-01-01", "2026-01-01 00:00:00", "a", "2026-02-01", "2026-01-01T02:03:04", "x", "v", None),
        (2, "2026-01-02", "2026-01-02 00:00:00", "a", "2026년 2월 1일", "2026-01-01 02:03:04.000", "y", "v", None),
        (3, "2026-01-01", "2026-01-01 00:00:00", "b", "", "2026-01-01T02:03:04", "x", "v", None),
        (4, "2026-01-02", "2026-01-02 00:00:00", "b", None, "2026-01-01T02:03:04 ", "y", "v", None),
        (5, "2026-01-02", "2026-01-02 00:00:00", None, None, None, None, None, None),
        (6, None, "2026-01-02 00:00:00", "c", None, None, None, None, None),
    ]
    assert sn.changes(frame(spark, rows)).collect() == []
    late = [*rows, (7, "2026-01-01", "2026-03-01 00:00:00", "a", "2026-02-03", "2026-01-01T02:03:04", "x", "v", None)]
    assert [tuple(r) for r in sn.changes(frame(spark, late)).collect()] == [("2026-01-01", "2026-01-02", "a", "changed")]


def test_empty_and_single(spark):
    assert sn.changes(frame(spark, [])).collect() == []
    assert sn.changes(frame(spark, random_rows(5, 2)[:3])).collect() == []
