from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import scalars as s
from sievework.operators import dedup, facets, joining, ranking, rules, state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


SCALARS = [  # built in the test: expressions need a session
    lambda: (s.squeeze(F.lit("  a 　 b c ")), "a b c"),
    lambda: (s.squeeze(F.lit(None).cast("string")), ""),
    lambda: (s.iso_date(F.lit("등록 2027년 6월 9일 마감")), "2027-06-09"),
    lambda: (s.iso_date(F.lit("2027-13-40, 2027-01-01")), ""),
    lambda: (s.iso_dates(F.lit("2027-01-02 ~ 2027.2.31 ~ 2027/3/4")), ["2027-01-02", "2027-03-04"]),
    lambda: (s.days_left(F.lit("2027-01-13"), F.lit("2027-01-10")), 3),
    lambda: (s.days_left(F.lit("2027-01"), F.lit("2027-01-10")), None),
    lambda: (s.is_open(F.lit(""), F.lit("2027-01-10")), True),
    lambda: (s.is_open(F.lit("2027-01-09"), F.lit("2027-01-10")), False),
    lambda: (s.days_label(F.lit(0)), "today"),
    lambda: (s.rfc822_utc(F.lit("Tue, 19 May 2026 02:20:53 +0900")), "2026-05-18T17:20:53"),
    lambda: (s.rfc822_utc(F.lit("19 May")), ""),
    lambda: (s.byte_count(F.lit("aé가"), 3), 7),
    lambda: (s.ellipsis(F.lit("abcd efgh"), 6), "abcd…"),
    lambda: (s.page_url(F.lit("/a?b#c"), "https://x.example"), "https://x.example/a"),
    lambda: (s.json_object(F.lit('so {"a": {"b": 1}} it is')), '{"a": {"b": 1}}'),
    lambda: (s.minutes_label(F.lit(125.5)), "2 h 6 min"),
    lambda: (s.title_signature(F.lit("[속보] 새 기준 서울 서울 - 어디일보")), ["기준", "서울"]),
    lambda: (s.strip_source_tail(F.lit("Title - Paper"), F.lit("Paper")), "Title"),
    lambda: (s.display_title(F.lit("[가나다 법인] 모집"), F.lit("가나다법인")), "모집"),
    lambda: (s.display_title(F.lit("[가나다]"), F.lit("가나다")), "[가나다]"),
    lambda: (F.length(s.native_id(F.lit(""), F.lit("https://x.example/1"))), 16),
    lambda: (s.native_id(F.lit("7"), F.lit("")), "7"),
]


@pytest.mark.parametrize("case", SCALARS)
def test_scalars(spark, case):
    column, want = case()
    assert one(spark, column) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("신입 환영", True), ("신입불가", False), ("신입 (불가)", True), ("신입 / 불가", False), ("신입불가 신입 가능", True), ("경력", False), ("", False)],
)
def test_unnegated(spark, text, want):
    assert one(spark, rules.unnegated(F.lit(text), ["신입"], ["불가"])) is want


def test_keep_order(spark):
    rows = [("noise here", "", "a"), ("hard", "", "a"), ("hard safe", "", "a"), ("x", "bad", "a"), ("x", "bad", "free"), ("noise", "", "free"), (None, None, None)]
    df = spark.createDataFrame(rows, "title string, body string, source string")
    ok = rules.keep(F.col("title"), F.col("body"), F.col("source"), noise=["noise"], bypass=["free"], hard=["hard"], exclude=["bad"], rescue=["safe"])
    assert [r["ok"] for r in df.select(ok.alias("ok")).collect()] == [False, False, True, False, True, False, True]


def sequential_leaders(n, pairs):
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[b].add(a)
    leaders, out = set(), {}
    for i in range(n):
        led = sorted(near[i] & leaders)
        out[i] = led[0] if led else i
        if not led:
            leaders.add(i)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_and_components(spark, seed):
    rng = random.Random(seed)
    n = 40
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(50)})
    nodes, edges = spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(pairs, "lo long, hi long")
    assert {r["id"]: r["leader"] for r in dedup.leaders(nodes, edges).collect()} == sequential_leaders(n, pairs)
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["id"]: r["component"] for r in dedup.components(nodes, edges).collect()} == dict(enumerate(root))


def test_greedy_keys(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abcdef"), rng.choice("uvwxyz")) for i in range(30)] + [(99, "", None), (100, None, "")]
    seen_a, seen_b, want = set(), set(), []
    for i, a, b in rows:
        if (not a or a not in seen_a) and (not b or b not in seen_b):
            want.append(i)
            seen_a |= {a} if a else set()
            seen_b |= {b} if b else set()
    df = spark.createDataFrame(rows, "ord long, a string, b string")
    for parts in (1, 5):
        assert sorted(r["ord"] for r in dedup.greedy_keys(df.repartition(parts), ["a", "b"], "ord").collect()) == want
    assert dedup.greedy_keys(df.where("ord < 0"), ["a", "b"], "ord").collect() == []


def test_prefix_pairs(spark):
    rng = random.Random(6)
    sets = {i: sorted({rng.choice("abcdefghij") for _ in range(6)}) for i in range(40)}
    df = spark.createDataFrame(list(sets.items()), "id long, sig array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.8}
    assert {(r["lo"], r["hi"]) for r in dedup.prefix_pairs(df, "id", "sig", 0.8).collect()} == want


def test_pack_and_spread(spark):
    df = spark.createDataFrame([("l", i, "x" * n) for i, n in enumerate([5, 5, 30, 5])], "k string, o int, line string")
    got = ranking.pack(df, "k", "line", ["o"], 24, "head").orderBy("message").collect()
    assert [r["lines"] for r in got] == [2, 1, 1] or [r["lines"] for r in got] == [1, 1, 1, 1]
    assert got[1]["text"].startswith("head (2)")
    page = spark.createDataFrame([("p", i, c) for i, c in enumerate("aaaabbc")], "k string, o int, c string")
    out = ranking.spread(page, "k", "c", "o").orderBy("place").collect()
    assert "".join(r["c"] for r in out) == "aabaabc"


def test_nearest_rank(spark):
    values = [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "k string, v double")
    row = facets.nearest_rank(df, ["k"], "v", [50]).where("k = 'a'").first()
    assert row["p50"] == values[2]  # 1.5 rounds to 2


def test_upsert_republish_and_grace(spark):
    old = spark.createDataFrame(
        [("a", "2027-01-20", "2027-01-01", "2027-01-01T00:00:00", "2027-01-09", True), ("b", "2027-01-05", "", "2027-01-01T00:00:00", "2027-01-09", True), ("c", "", "", "2027-01-01T00:00:00", "2027-01-02", True)],
        "uid string, deadline string, posted_date string, first_seen string, last_seen string, notified boolean",
    )
    batch = spark.createDataFrame([("a", "2027-02-01", "2027-01-10", 1), ("a", "", "", 2), ("d", None, "2027-01-10", 3)], "uid string, deadline string, posted_date string, ord int")
    got = {r["uid"]: r for r in state.upsert(old, batch, "uid", "ord", ["deadline", "posted_date"], "2027-01-10T09:00:00").collect()}
    assert (got["a"]["deadline"], got["a"]["is_new"], got["a"]["notified"]) == ("2027-02-01", True, False)
    assert (got["d"]["is_new"], got["d"]["deadline"]) == (True, "")
    assert (got["b"]["is_new"], got["b"]["last_seen"]) == (False, "2027-01-09")
    assert [r["uid"] for r in state.carry_forward(old, batch, "uid", "2027-01-10", 2).collect()] == []
    assert [r["uid"] for r in state.unexpired(old, "2027-01-10").orderBy("uid").collect()] == ["a", "c"]
    again = state.upsert(old, batch.where("uid = 'x'"), "uid", "ord", ["deadline", "posted_date"], "2027-01-10T09:00:00")
    assert again.where("is_new").count() == 0


def test_hydrate_keeps_rows(spark):
    a = spark.createDataFrame([("k", "", "x"), ("m", None, "y")], "id string, v string, _v2 string")
    b = spark.createDataFrame([("k", "filled")], "id string, v string")
    assert sorted(map(tuple, joining.hydrate(a, b, "id", ["v"]).select("id", "v").collect())) == [("k", "filled"), ("m", "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_token_leaders_and_pairs(spark, seed):
    rng = random.Random(seed)
    sets = {i: sorted({rng.choice("abcdefg") for _ in range(rng.randint(0, 7))}) for i in range(60)}
    df = spark.createDataFrame([(i, v, "b") for i, v in sets.items()], "id long, sig array<string>, b string")
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.8]
    assert {r["id"]: r["leader"] for r in dedup.token_leaders(df, "id", "sig", 0.8).collect()} == sequential_leaders(len(sets), near)
    want = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 3}
    assert {(r["lo"], r["hi"]) for r in dedup.token_pairs(df, "id", "sig", "b", 3).collect()} == want


def test_block_edges(spark):
    import numpy as np

    from sievework.operators import vectors

    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], rng.standard_normal(4).tolist()) for i in range(40)] + [(50, "a", [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, k string, v array<double>")
    cos = lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b) or np.inf)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and cos(a[2], b[2]) >= 0.5}
    for size in (4096, 7):
        got = [tuple(r) for r in vectors.block_edges(df, "id", "v", "k", 0.5, rows=size).collect()]
        assert set(got) == want and len(got) == len(want)


def test_prefer_keeps_place(spark):
    rows = [(1, "board", "k", "x"), (2, "ats_a", "k", "x"), (3, "ats_b", "k", "x"), (4, "board", "", "x"), (5, "board", "", "x"), (6, "board", None, "x")]
    df = spark.createDataFrame(rows, "ord long, source string, key string, _p string")
    got = {tuple(r) for r in dedup.prefer(df.drop("_p"), ["key"], F.col("source").startswith("ats_"), "ord").select("ord", "place").collect()}
    assert got == {(2, 1), (4, 4), (5, 5), (6, 6)}
