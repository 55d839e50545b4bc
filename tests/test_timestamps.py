from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import timestamps as ts

SOURCES = [("kr", "Asia/Seoul", "ymd"), ("us", "America/New_York", "mdy"), ("uk", "Europe/London", "dmy"), ("open", "UTC", None)]


def run(spark, rows, tasks=3):
    values = spark.createDataFrame(rows, "kind string, id long, source string, ord int, text string, normal string, same string")
    sources = spark.createDataFrame(SOURCES, "source string, zone string, date_order string")
    return {(r["kind"], r["id"]): (r["normal"], r["same"]) for r in ts.choose(values, sources, tasks=tasks).collect()}


CASES = [
    ("kr", "2026-05-14", "2026-05-14"), ("kr", "2026．05．14", "2026-05-14"), ("kr", "~ 2026.05.14까지", "2026-05-14"),
    ("kr", "2026. 5. 4.", "2026-05-04"), ("kr", "2026년05월14일(목)", "2026-05-14"), ("kr", "26.7.5", "2026-07-05"),
    ("kr", "20260514", "2026-05-14"), ("us", "07-08-2026", "2026-07-08"), ("uk", "07/08/2026", "2026-08-07"), ("uk", "7/8/26", "2026-08-07"),
    ("us", "14/05/2025", "2025-05-14"), ("us", "January 9, 2026", "2026-01-09"), ("uk", "9 Jan 2026", "2026-01-09"), ("uk", "Fri 01-MAY-2026", "2026-05-01"),
    ("kr", "2026-05-14T01:02:03", "2026-05-13T16:02:03Z"), ("kr", "2026-05-14T01:02:03.9Z", "2026-05-14T01:02:03Z"),
    ("kr", "2026-05-14 01:02:03.123456 -0430", "2026-05-14T05:32:03Z"), ("kr", "1778720523", "2026-05-14T01:02:03Z"), ("kr", "1778720523999", "2026-05-14T01:02:03Z"),
    ("kr", "2026.05.14 오후 12:05", "2026-05-14T03:05:00Z"), ("kr", "2026년 5월 14일 오전 12시 5분", "2026-05-13T15:05:00Z"),
    ("kr", "2026.05.14(목) 24:00", "2026-05-14T15:00:00Z"), ("kr", "2026.05.14 24시", "2026-05-14T15:00:00Z"),
    ("us", "March 9, 2026 at 3:14 pm", "2026-03-09T19:14:00Z"), ("us", "2026-11-01 01:30", "2026-11-01T05:30:00Z"), ("uk", "Sun, 26 Oct 2025 02:33:30 +0000", "2025-10-26T02:33:30Z"),
    ("us", "2026-08-15 13:06:40 AEST", "2026-08-15T03:06:40Z"), ("uk", "01/02/2026 7:24 AM", "2026-02-01T07:24:00Z"), (None, "2026-05-14 10:00", "2026-05-14T10:00:00Z"),
]
UNREADABLE = [("us", "2026-03-08 02:30"), ("kr", "2026.02.30"), ("kr", "0000-00-00"), ("kr", "수시"), ("kr", "ASAP 5"), ("kr", "2026-05-14 25:00"), ("kr", ""), ("kr", None), ("kr", "2026-05-14 10:00 XQZ"), ("kr", "x" * 5000)]


def test_forms(spark):
    rows = [("f", i, s, i, t, "clash", "clash") for i, (s, t, _) in enumerate(CASES)] + [("f", 100 + i, s, i, t, None, None) for i, (s, t) in enumerate(UNREADABLE)]
    got = run(spark, rows)
    for i, (_, text, want) in enumerate(CASES):
        assert got[("f", i)] == (want, text == want), text
    assert {k for k in got if k[1] >= 100} == set()


def test_empty(spark):
    assert run(spark, []) == {}


def test_order_from_neighbours(spark):
    # no date order known: the readings that keep the format and don't step back win
    texts = ["13/02/2026", "01/03/2026", "02/03/2026", "14/03/2026"]
    got = run(spark, [("f", i, "open", i, t, "", "") for i, t in enumerate(texts)])
    assert [got[("f", i)][0] for i in range(4)] == ["2026-02-13", "2026-03-01", "2026-03-02", "2026-03-14"]


def test_partitions_do_not_matter(spark):
    rng = random.Random(3)
    rows = [("f", i, "open", i // 2, f"{rng.randint(1, 14):02d}/{rng.randint(1, 14):02d}/2026", "", "") for i in range(300)]
    one, many = run(spark, rows, tasks=1), run(spark, rows, tasks=7)
    cost = lambda got: _cost([got[("f", i)] for i in sorted(k[1] for k in got)], rows)
    assert one.keys() == many.keys() and cost(one) == cost(many)


def _cost(normals, rows):
    total, last = 0, None
    readable = [r for r in rows if _orders(r[4])]
    for (normal, _), r in zip(normals, readable):
        fmt = next(f for f, d in _orders(r[4]).items() if d == normal)
        alike = {f for f, d in _orders(r[4]).items() if d == normal}
        if last is not None:
            total += (not (alike & last[0])) + (normal < last[1])
        last = (alike, normal)
        assert fmt
    return total


def _orders(text):
    a, b, y = text.split("/")
    out = {}
    if 1 <= int(b) <= 12:
        out["dmy"] = f"{y}-{b}-{a}"
    if 1 <= int(a) <= 12:
        out["mdy"] = f"{y}-{a}-{b}"
    return out


@pytest.mark.parametrize("n", [1, 2])
def test_found_skips_normal_forms(spark, n):
    p = spark.createDataFrame([(1, "kr", "2026-05-14", "2026.5.1", 5)] * n, "posting_id long, source string, deadline string, posted_date string, x int").withColumn("scraped_at", F.lit("2026-01-01").cast("timestamp"))
    a = spark.createDataFrame([(1, "uk", "01/02/2026 7:24 AM")], "article_id long, source string, published_at string").withColumn("fetched_at", F.lit("2026-01-01").cast("timestamp"))
    got = ts.found(p, a, spark.createDataFrame(SOURCES, "source string, zone string, date_order string")).collect()
    assert sorted(map(tuple, got)) == [("article", 1, "published_at", "2026-02-01T07:24:00Z")] + [("posting", 1, "posted_date", "2026-05-01")] * n
