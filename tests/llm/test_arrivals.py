from __future__ import annotations

import pytest

from sievework.llm import arrivals as ar

REF = [(1, "company", "가람솔회계법인", "Garamsol Accounting", None)]
SCHEMA = "arrival_id long, batch_no int, source string, native_id string, url string, title string, company string, body_excerpt string, first_seen string, cell int"
BODY = "담당업무는 표본 추출 기록 및 원가 배부 검증이며 팀원 {} 명과 함께합니다. 자격은 운전 가능자 기준이고 문의는 내선 {}번입니다."


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("https://www.x.example/v?b=1&a=2", "http://m.x.example:443/v/?a=2&b=1&utm_source=q#top", True),
        ("HTTPS://X.EXAMPLE/p/1?utm_source=q", "https://x.example/p/1&ref=mail", True),
        ("https://x.example/p/1", "https://x.example/p/2", False),
        ("https://x.example/v?no=1", "https://x.example/v?no=2&page=3", False),
    ],
)
def test_page_key(a, b, same):
    assert (ar.page_key(a) == ar.page_key(b)) is same


def test_no_page():
    assert {ar.page_key(u) for u in (None, "", "/x", "about:blank", "http://", "http://[bad")} == {None}


def rows():
    t = "[인천 동부] 2027년도 1차 감사 {}팀 세무사 모집 (선임급 상근)"
    return [
        (1, 0, "a", "n1", "https://a.example/1", t.format(1), "가람솔회계법인", BODY.format(5, 11), "t1", 0),
        (2, 0, "a", "n2", "https://a.example/2", t.format(2), "가람솔회계법인", BODY.format(5, 11), "t2", 0),
        (3, 1, "a", "n1", "https://a.example/9", "other", None, None, "t3", 0),  # native id
        (4, 1, "b", "n1", "https://b.example/1", "another", "x", "", "t4", 0),  # same id, other source
        (5, 1, "a", "n5", "https://m.a.example/2?utm_source=z", None, None, None, "t5", 0),  # page
        (6, 1, "a", "n6", "", t.format(1).replace("모집", "모집!!"), "Garamsol Accounting", BODY.format(5, 11).replace("팀원", "구성원"), "t6", 0),  # content
        (7, 2, "a", "n7", None, t.format(1).replace("1차", "2차"), "가람솔회계법인", BODY.format(5, 11), "t7", 0),  # another season
        (8, 2, "a", "n7", None, t.format(1).replace("1차", "2차"), "가람솔회계법인", BODY.format(5, 11), "t8", 0),
        (9, 2, "c", "", "https://a.example/9", "x" * 5000, "", None, "t9", 0),  # a chain over 3
        (10, 2, "d", " ", " ", "", "", "", "t10", 0),
    ]


@pytest.mark.parametrize("block", [4096, 1])
def test_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(ar, "BLOCK", block)
    ref = spark.createDataFrame(REF, "ref_id long, field string, name string, name_en string, aliases string")
    df = spark.createDataFrame(rows(), SCHEMA)
    assert sorted(map(tuple, ar.deduplicate(df, ref).collect())) == [(1, 3), (1, 6), (1, 9), (2, 5), (7, 8)]


def test_first_seen_and_empty(spark):
    ref = spark.createDataFrame(REF, "ref_id long, field string, name string, name_en string, aliases string")
    df = spark.createDataFrame(rows()[:3], SCHEMA)
    got = {r["arrival_id"]: (r["is_new"], r["first_seen"]) for r in ar.accepted(df, ref).collect()}
    assert got == {1: (True, "t1"), 2: (True, "t2"), 3: (False, "t1")}
    assert ar.deduplicate(df.where("arrival_id > 99"), ref).collect() == []


def brute(own):
    """Original of every repeat by the rule over all pairs, without keys, cells or blocks."""
    encoder = ar.Encoder(ar.Reference(REF))
    rows = [(tuple(encoder.encode(r[5], r[6])), ar.fold(r[5]), ar.fold(r[7])) for r in own]
    links, more = ar.Links(), {}
    for i in range(len(own)):
        for j in range(i):
            if ar.same_job(rows[i], rows[j]):
                if rows[i][0] == rows[j][0]:
                    links.join(i, j)
                else:
                    a, b = (i, j) if sum(map(bool, rows[i][0])) <= sum(map(bool, rows[j][0])) else (j, i)
                    more.setdefault(a, []).append(b)
    for a, others in more.items():
        lead = rows[min(others)][0]
        for b in others:
            if all(not x or not y or x == y for x, y in zip(rows[b][0], lead)):
                links.join(a, b)
    return dict(links.edges())


def test_search_finds_all_near(spark):
    """Recall of the cells against brute force over all pairs, in five batches."""
    import numpy as np

    rng = np.random.default_rng(3)
    ref = spark.createDataFrame(REF, "ref_id long, field string, name string, name_en string, aliases string")
    teams, cities = ["감사 1팀", "세무 2팀", "딜자문 3본부"], ["서울", "부산 동부", "대전"]
    own = [(i, i // 60, "s", f"n{i}", None, f"2027년 상반기 {teams[rng.integers(3)]} 세무사 채용 {cities[rng.integers(3)]}", "가람솔회계법인", BODY.format(rng.integers(3), rng.integers(2)), "t", 0) for i in range(300)]
    got = {r["arrival_id"]: r["original_id"] for r in ar.deduplicate(spark.createDataFrame(own, SCHEMA), ref).collect()}
    assert got == brute(own)


def test_cut_bodies_are_found(spark):
    """Bodies that are the other's opening part: their random sketches are often too far apart."""
    import random

    ref = spark.createDataFrame(REF, "ref_id long, field string, name string, name_en string, aliases string")
    teams = {"감사": 40, "세무": 40}
    own, want, i = [], [], 0
    for unit, most in teams.items():
        for n in range(1, most + 1):
            rng = random.Random(f"{unit}{n}")
            body = [f"말{rng.randrange(10**6)}" for _ in range(30)]
            title = f"2027년 상반기 {unit} {n}팀 세무사 채용 서울"
            own += [(i, 0, "s", f"n{i}", None, title, "가람솔회계법인", " ".join(body), "t", 0), (i + 1, 1, "s", f"n{i + 1}", None, title, "가람솔회계법인", " ".join(body[:11]), "t", 0)]
            want.append((i, i + 1))
            own.append((i + 2, 1, "s", f"n{i + 2}", None, title, "가람솔회계법인", " ".join(f"글{rng.randrange(10**6)}" for _ in range(30)), "t", 0))
            i += 3
    assert sorted(map(tuple, ar.deduplicate(spark.createDataFrame(own, SCHEMA), ref).collect())) == want


def test_silent_fields_and_unread_titles(spark):
    """Recall against the rule over all pairs, without the index: titles that omit fields or are outside the word list."""
    import numpy as np

    rng = np.random.default_rng(8)
    ref = spark.createDataFrame(REF, "ref_id long, field string, name string, name_en string, aliases string")
    bodies = [" ".join(f"말{rng.integers(10**6)}" for _ in range(20)) for _ in range(6)]
    own = []
    for i in range(150):
        parts = ["2027년 상반기", "감사 1팀", "세무사 채용", f"서울 {['동부', '서부'][rng.integers(2)]}"]
        if i % 3 == 0:
            parts.pop(int(rng.integers(4)))
        title = ["Gardener 2027 wanted at once", "Gardener 2028 wanted at once", "Wanted: Gardener 2027, at once"][rng.integers(3)] if i % 5 == 0 else " ".join(parts)
        own.append((i, int(i > 90), "s", f"n{i}", None, title, "가람솔회계법인" if i % 7 else None, bodies[rng.integers(6)] if i % 11 else None, "t", 0))
    df = spark.createDataFrame(own, SCHEMA)
    got = {r["arrival_id"]: r["original_id"] for r in ar.deduplicate(df, ref).collect()}
    assert got == brute(own)


@pytest.mark.parametrize("cells", [1, 40])
def test_probed_cells_hold_every_near_row(spark, monkeypatch, cells):
    """Titles half outside the word list, cells and blocks of few rows: the bounds leave out no cell that holds a repeat."""
    import random

    monkeypatch.setattr(ar, "ROWS_A_CELL", max(1, 120 // cells))
    monkeypatch.setattr(ar, "BLOCK", 5)
    ref = spark.createDataFrame(REF, "ref_id long, field string, name string, name_en string, aliases string")
    rng, own = random.Random(4), []
    for i in range(120):
        trade = rng.choice(["Gardener", "Senior Software Engineer, Platform", "마케팅 매니저", "2027년 상반기 감사 1팀 세무사", "세무 2팀 회계사"])
        body = f"Daily work number {rng.randrange(4)} for patient people. " + rng.choice(["Ask at the gate.", "Ask at extension 7 before noon.", ""])
        own.append((i, i // 30, "s", f"n{i}", None, f"{trade} {rng.choice(['서울', '부산', ''])}", rng.choice(["Acme", "가람솔회계법인", None]), body, "t", 0))
    got = {r["arrival_id"]: r["original_id"] for r in ar.deduplicate(spark.createDataFrame(own, SCHEMA), ref).collect()}
    assert got == brute(own) and len(got) > 40


def test_distance_rejects_rows_of_a_probed_cell(spark, monkeypatch):
    """All rows in one cell: it is their distance that keeps other teams and places apart, and a wider one links them."""
    monkeypatch.setattr(ar, "MOST_CELLS", 1)
    ref = spark.createDataFrame(REF, "ref_id long, field string, name string, name_en string, aliases string")
    own = [(i, i, "s", f"n{i}", None, f"2027년 상반기 감사 {n}팀 세무사 채용 {c}", "가람솔회계법인", BODY.format(5, i), "t", 0) for i, (n, c) in enumerate([(1, "서울"), (2, "서울"), (1, "부산"), (1, "서울")])]
    df = spark.createDataFrame(own, SCHEMA)
    assert sorted(map(tuple, ar.deduplicate(df, ref).collect())) == [(0, 3)]
    encoder = ar.Encoder(ar.Reference(REF))
    codes = [encoder.encode(r[5], r[6]) for r in own]
    import numpy as np

    d = ar.distances(np.array(codes), np.array(codes))
    assert d[0, 3] == 0 and min(d[0, 1], d[0, 2], d[1, 2]) > ar.NEAR


def test_hot_keys(spark):
    """A page that a third of all rows lead to, and a batch of one row."""
    ref = spark.createDataFrame(REF, "ref_id long, field string, name string, name_en string, aliases string")
    own = [(i, 0, "s", f"n{i}", "https://x.example/1" if i % 3 == 0 else f"https://x.example/p{i}", None, None, None, "t", 0) for i in range(600)]
    own.append((1000, 1, "s", "n7", "https://x.example/1?utm_source=q", None, None, None, "t", 0))
    got = {r["arrival_id"]: r["original_id"] for r in ar.deduplicate(spark.createDataFrame(own, SCHEMA), ref).collect()}
    assert got == {**{i: 0 for i in range(3, 600, 3)}, 7: 0, 1000: 0}


def test_title_without_area_and_outside_the_words(spark):
    ref = spark.createDataFrame(REF, "ref_id long, field string, name string, name_en string, aliases string")
    t, firm, garden = "2027년 상반기 감사 1팀 세무사 채용 서울", "가람솔회계법인", "Gardener wanted at once, season {}"
    b, c = BODY.format(5, 11), "Roses and lawns of the office park need daily care by someone patient. Ask at extension 77."
    own = [(1, t + " 동부", firm, b), (2, t, firm, b), (3, t + " 서부", firm, b), (4, garden.format(1), firm, c), (5, garden.format(1) + "!", firm, c + " Again."), (6, garden.format(2), firm, c), (7, "채용", firm, "전혀 다른 글이며 겹치는 말이 없습니다")]
    rows = [(i, 0, "s", f"n{i}", None, title, company, body, "t", 0) for i, title, company, body in own]
    assert sorted(map(tuple, ar.deduplicate(spark.createDataFrame(rows, SCHEMA), ref).collect())) == [(1, 2), (4, 5)]


def test_memory_of_cells_is_bounded():
    """A full Arrow batch against very many cells is held in slices, and the cells found are those of the whole."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    codes = rng.integers(1, 40, (10_000, len(ar.PARTS)))
    codes[::7, 2] = 0
    centroids = rng.standard_normal((2048, ar.CODE * len(ar.PARTS))).astype(np.float32)
    tracemalloc.start()
    cell, away = ar.nearest(codes, centroids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6  # all at once they are 10,000 x 2,048 x 6 numbers, 983 MB
    some = slice(4000, 4100)
    by_part = np.stack([ar.part_distances(codes[some], centroids, f) for f in range(len(ar.PARTS))])
    assert (cell[some] == (by_part**2).sum(0).argmin(1)).all() and np.allclose(away[some], by_part[:, np.arange(100), cell[some]].T)


def test_queries_of_other_cells_are_split(spark, monkeypatch):
    """A row that states little is met by very many queries from other cells, BLOCK or so at a time."""
    whole, most = ar.search, 40

    def search(q, x):
        if len(q) > most * 2 or len(x) > most * 2:
            raise ValueError(f"{len(q)} queries meet {len(x)} rows")
        return whole(q, x)

    monkeypatch.setattr(ar, "BLOCK", most)
    monkeypatch.setattr(ar, "search", search)
    t = "[인천 동부] 2027년도 1차 감사 {}팀 세무사 모집 (선임급 상근)"
    ref = spark.createDataFrame(REF, "ref_id long, field string, name string, name_en string, aliases string")
    bare = [(1, 0, "a", "n1", "", "세무사 모집", "가람솔회계법인", BODY.format(1, 1), "t", 0)]
    full = [(i, 0, "a", f"n{i}", "", t.format(i % 50 + 1), "가람솔회계법인", BODY.format(i, i) + " x" * i, "t", 0) for i in range(2, 400)]
    df = spark.createDataFrame(bare + full, SCHEMA)
    got = sorted(map(tuple, ar.deduplicate(df, ref).collect()))
    monkeypatch.setattr(ar, "BLOCK", 4096)
    monkeypatch.setattr(ar, "search", whole)
    assert got == sorted(map(tuple, ar.deduplicate(df, ref).collect())) and got
