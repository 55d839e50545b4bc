from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sievework.llm import linkage as lk
from sievework.llm import survivors as sv

SIGHTING = "sighting_id long, cluster_id long, source string, url string, deadline string, body_excerpt string, at string, rank int, key string"
SOURCES = [("a", "UTC", "ymd", 1), ("b", "UTC", "dmy", 2)]


def test_survivors(spark):
    rows = [
        (1, 7, "b", "https://x.example/1", "2027-02-30", "<p>one two</p>…", "2027-01-01 00:00:00", 0, "x"),
        (2, 7, "a", "http://", "01/02/2027", "one  two three (더보기)", "2027-01-02 00:00:00", 0, "x"),
        (3, 7, "a", "javascript:x", "2027-01-01", "one two three", "2027-01-01 00:00:00", 0, "x"),
        (4, 8, "a", "https://x.example/2", "2027-01-01", "alone", "2027-01-01 00:00:00", 0, "x"),
        (5, 9, None, None, None, " - ", None, 0, "x"),
        (6, 9, "", "", "soon", "", None, 0, "x"),
        (7, None, "a", "https://x.example/3", "2027-01-01", "x", "2027-01-01 00:00:00", 0, "x"),
        (8, 10, "b", "https://x.example/4", "13/02/2027", "same", "2027-01-01 00:00:00", 0, "x"),
        (9, 10, "b", "https://x.example/4", "13/02/2027", "same", "2027-01-01 00:00:00", 0, "x"),
    ]
    df = spark.createDataFrame(rows, SIGHTING).withColumn("scraped_at", F.col("at").cast("timestamp"))
    sources = spark.createDataFrame(SOURCES, "source string, zone string, date_order string, trust_rank int")
    got = {(r[0], r[1]): r[2] for r in sv.survivors(df, sources).collect()}
    # 01/02/2027 of a source that writes ymd is still a real date
    assert got == {(7, "source"): 2, (7, "url"): 1, (7, "deadline"): 2, (7, "body_excerpt"): 2, (10, "source"): 8, (10, "url"): 8, (10, "deadline"): 8, (10, "body_excerpt"): 8}
    assert sv.surviving_rows(df, sources).where("cluster_id = 7").first()["url"] == "https://x.example/1"
    assert sv.survivors(df.where("cluster_id = 99"), sources).collect() == []


REF = [(1, "company", "가람솔회계법인", "Garamsol Accounting", None), (2, "company", "나루미테크", "Narumi Tech", None)]
LISTING = "listing_id long, source string, title string, company string, deadline string, location string, a string"


def test_title_reader():
    read = lk.TitleReader().read
    full = read("[인천 동부] 2027년도 1차 M&A 3팀 내부통제 담당자 모집 (선임급 6개월)")
    assert full == {"season": "27r1", "team": "ma3t", "role": "control", "city": "incheon", "area": "east", "grade": "senior", "mode": "6m"}
    assert read("'27년도 1처, M&A 3팀, 내부통제 실무자 2차 충원, Incheon 동부") == {k: full[k] for k in ("season", "team", "role", "city", "area")}
    assert read("수습 CPA 채용 감사 센타")["role"] == "trainee" and read("수습 CPA 채용 감사 센타")["team"] == "auditc"
    assert read("슈습 CPA 채용")["role"] == "trainee" and read("택스 전문인력 모집")["role"] == "cta" and read("택스 애널리스트")["role"] == "taxan"
    assert read(None) == {} and read("x" * 10000) == {}


def test_linkage(spark):
    board = [
        (1, "b", "'27년도 1차 - 감사 3팀 - 세무사 모집 - 인천", "Garamsol Accounting", "2027-03-01", None, "x"),
        (2, "b", "2027년도 1차 감사 3팀 세무사 채용", "(주)가람솔회계법인", None, "전국", "x"),
        (3, "b", "2027년도 1차 감사 2팀 세무사 채용", "가람솔회계법인", "2027-03-01", "인천", "x"),
        (4, "b", "2027년도 1차 감사 3팀 세무사 채용 인천", "가람솔회계법인", "2027-03-20", None, "x"),
        (5, "b", None, None, None, None, None),
    ]
    firm = [(10, "f", "감사 3팀 세무사 모집 (선임급 상근, 인천 동부) 2027년도 1차", "가람솔회계법인", "2027.3.4", "인천 동부", "x"), (11, "f", "감사 3팀 세무사 모집 (선임급 상근, 인천 동부) 2027년도 1차", "나루미테크", "2027-03-04", "인천 동부", "x"), (12, "f", "", "", "", "", "")]
    more = [(100 + i, "f", f"딜자문 {i % 9}팀 공시 담당자 채용 (전임급 상근, 서울) 2026 수시", "나루미테크", "2026-01-01", "서울", "x") for i in range(20)]
    ref = spark.createDataFrame(REF, "ref_id long, field string, name string, name_en string, aliases string")
    a, b = spark.createDataFrame(board, LISTING), spark.createDataFrame(firm + more, LISTING)
    assert sorted(map(tuple, lk.found(a, b, ref).collect())) == [(1, 10), (2, 10)]
    scored = lk.link(a, b, ref).collect()
    assert all(0 <= r["confidence"] <= 1 for r in scored) and len({(r[0], r[1]) for r in scored}) == len(scored)
    assert lk.found(a.where("listing_id > 99"), b, ref).collect() == []


def _pairs(rng, n, levels):
    return np.stack([rng.choice(len(p), size=n, p=p) for p in levels], axis=1)


def test_mixture_separates_matches_from_siblings():
    """Pairs of three kinds: matches with a few misread fields, siblings that differ in the team, chance pairs of a pass."""
    rng, n = np.random.default_rng(1), len(lk.NAMES)
    same, other = [0.002, 0.0, 0.798, 0.2], [0.9, 0.0, 0.05, 0.05]
    true = _pairs(rng, 900, [same] * n)
    siblings = _pairs(rng, 400, [[0, 0, 1, 0]] * 2 + [[0.6, 0.4, 0, 0]] + [same] * (n - 3))
    chance = _pairs(rng, 700, [[0, 0, 1, 0]] * 2 + [other] + [[0, 0, 1, 0]] + [other] * (n - 4))
    patterns, at, counts = np.unique(np.vstack([true, siblings, chance]), axis=0, return_inverse=True, return_counts=True)
    fitted = lk.Mixture(patterns, counts.astype(float), np.full(n, 0.1))
    taken = fitted.posterior[at.ravel()] >= lk.LEAST_CONFIDENCE
    core = (true[:, :4] != 3).all(1)
    assert abs(fitted.share[0] - 0.45) < 0.08
    assert taken[:900][core].mean() > 0.95 and not taken[900:1300].any() and taken[1300:].mean() < 0.02
    assert ((fitted.posterior > 0) & (fitted.posterior < lk.LEAST_CONFIDENCE)).sum() > 10  # the threshold rejects patterns


def test_threshold_rejects_pairs(spark):
    """Proposed pairs with a lower confidence stay out of the result, and it is the confidence alone that keeps them out."""
    ref = spark.createDataFrame(REF, "ref_id long, field string, name string, name_en string, aliases string")
    t = "2027년도 1차 {} {}팀 {} 채용 {}"
    firm, board, true = [], [], []
    for i in range(120):
        unit, role, city = ["감사", "세무", "딜자문"][i % 3], ["세무사", "회계사", "공시 담당자", "자금 담당자"][i % 4], ["서울", "부산", "대구", "인천", "광주"][i % 5]
        number, day = i % 7 + 1, f"2027-0{i % 6 + 1}-{i % 27 + 1:02d}"
        firm.append((1000 + i, "f", t.format(unit, number, role, city), "가람솔회계법인", day, city, "x"))
        board.append((i, "b", t.format(unit, number, role, city), "(주)가람솔회계법인", day, None, "x"))
        true.append((i, 1000 + i))
        if i % 4 == 0:  # a sibling of another team
            board.append((500 + i, "b", t.format(unit, number + 1, role, city), "가람솔회계법인", day, None, "x"))
    a, b = spark.createDataFrame(board, LISTING), spark.createDataFrame(firm, LISTING)
    got = set(map(tuple, lk.found(a, b, ref).collect()))
    scored = {(r[0], r[1]): r[2] for r in lk.link(a, b, ref).collect()}
    assert got == {k for k, v in scored.items() if v >= lk.LEAST_CONFIDENCE} and set(true) <= got
    low = {k for k, v in scored.items() if v < lk.LEAST_CONFIDENCE}
    assert len(low) > 50 and not any((500 + i, 1000 + i) in got for i in range(0, 120, 4))


def test_equal_rows_are_compared_once_and_all_come_out(spark):
    ref = spark.createDataFrame(REF, "ref_id long, field string, name string, name_en string, aliases string")
    t = "2027년도 1차 감사 3팀 세무사 채용 인천 동부 선임급 상근"
    board = [(i, "b", t, "가람솔회계법인", None, None, "x") for i in range(30)]
    firm = [(100 + i, "f", t, "가람솔회계법인", None, None, "x") for i in range(20)]
    a, b = spark.createDataFrame(board, LISTING), spark.createDataFrame(firm, LISTING)
    read = lk.read_rows(a, ref)
    assert lk.profiles(read).count() == 1 and lk.candidates(lk.profiles(read), lk.profiles(lk.read_rows(b, ref))).count() == 1
    assert len(set(map(tuple, lk.found(a, b, ref).collect()))) == 600


def test_pairs_are_proposed_once_without_broadcasts(spark):
    """Silent fields and days: the pairs of a brute force over all passes, each once, and no side sent to the driver however small it looks."""
    rng, values = np.random.default_rng(6), {"firm": ["#1", "#2"], "season": ["26h1", "27h1"], "team": ["tax1t", "tax2t"], "role": ["cpa", "cta"]}
    own = lambda n: [(i, 1, None if rng.random() < 0.3 else int(rng.integers(0, 200)), *[None if f not in values or rng.random() < 0.25 else values[f][rng.integers(0, 2)] for f in lk.FIELDS]) for i in range(n)]
    schema = "id long, n long, day int, " + ", ".join(f"{f} string" for f in lk.FIELDS)
    a, b = own(70), own(80)
    want = set()
    for x in a:
        for y in b:
            apart = x[2] is not None and y[2] is not None and abs(x[2] // lk.WINDOW - y[2] // lk.WINDOW) > 1
            if not apart and any(all(x[3 + k] is not None and x[3 + k] == y[3 + k] for k in map(lk.FIELDS.index, fields)) for fields in lk.PASSES):
                want.add((x[0], y[0]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        pairs = lk.candidates(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
        got = list(map(tuple, pairs.collect()))
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(got) == want and len(got) == len(want) > 100


def test_passes_one_after_the_other_give_the_same_pairs(spark, monkeypatch):
    ref = spark.createDataFrame(REF, "ref_id long, field string, name string, name_en string, aliases string")
    t = "2027년도 1차 감사 {}팀 세무사 채용 인천"
    a = spark.createDataFrame([(i, "b", t.format(i % 9 + 1), "가람솔회계법인", None, None, "x") for i in range(40)], LISTING)
    b = spark.createDataFrame([(100 + i, "f", t.format(i % 7 + 1), "가람솔회계법인", None, None, "x") for i in range(40)], LISTING)
    one = sorted(map(tuple, lk.link(a, b, ref).collect()))
    monkeypatch.setattr(lk, "TOGETHER", 0)
    assert one == sorted(map(tuple, lk.link(a, b, ref).collect())) and one
