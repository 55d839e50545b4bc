from __future__ import annotations

import random

import pytest

from sievework.llm import canonical_values as cv
from sievework.llm import title_copies as tc

ENTRIES = [
    (1, "company", "가람솔회계법인", "Garamsol Accounting", None), (2, "company", "나루미테크", "Narumi Tech", None), (3, "company", "다온별세무법인", "Daonbyeol Tax", ""),
    (4, "emp_type", "정규직", "Full-time", "상근;정규사원"), (5, "emp_type", "인턴", "Intern", "인턴십"), (6, "category", "신입", "Entry level", None),
    (7, "category", "경력", "Experienced", None), (8, "category", "신입·경력", "Entry or experienced", "신입경력"), (9, "category", "경력무관", "Any experience", "무관"),
]


def lev(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_automaton_finds_all_entries_within_distance(most):
    rng = random.Random(most)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    trie = cv.Trie()
    for i, w in enumerate(words):
        trie.add(w, i)
    for _ in range(60):
        q = "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))
        assert trie.within(q, most) == {i: lev(q, w) for i, w in enumerate(words) if lev(q, w) <= most}


@pytest.mark.parametrize(
    ("field", "value", "want"),
    [
        ("company", "(주)가람솔회계법인", 1), ("company", "가람솔 회계법인 부산본부", 1), ("company", "Garamsol Acounting", 1), ("company", "가람솔회계", 1), ("company", "가람솔", 1),
        ("company", "가람설회계법인", 1), ("company", "가람솔회계계법인", 1), ("company", "바두리회계법인", 0), ("company", "<b>나루미테크</b>", 2), ("company", "비공개", 0),
        ("company", "NARUMI-TECH Co., Ltd.", 2), ("company", "나 루 미 테 크", 2), ("emp_type", "정규직(수습 3개월)", 4), ("emp_type", "FULLTIME", 4), ("emp_type", "하계 인턴", 5), ("emp_type", "협의", 0),
        ("category", "신입/경력", 8), ("category", "경력 무관", 9), ("category", "신입 채용", 6), ("category", "경력(2~5년)", 7), ("category", "x" * 5000, 0),
    ],
)
def test_readings(field, value, want):
    assert cv.Reference(ENTRIES).search(field, value)[0] == want


def test_found_rows(spark):
    ref = spark.createDataFrame(ENTRIES, "ref_id long, field string, name string, name_en string, aliases string")
    rows = [(1, "가람솔회계법인", "정규직 ", None, "clash"), (2, "가람솔 회계법인", "", " 　", None), (2, "없는곳", None, "무관", None)]
    df = spark.createDataFrame(rows, "posting_id long, company string, emp_type string, category string, name string")
    got = sorted(map(tuple, cv.found(df, ref).collect()))
    assert got == [(1, "emp_type", 4), (2, "category", 9), (2, "company", 0), (2, "company", 1)]
    assert cv.found(df.where("posting_id > 5"), ref).collect() == []
    assert {r[2] for r in cv.found(df, ref.where("ref_id > 99")).collect()} == {0}
    assert [tuple(r) for r in cv.unmatched(df.where("company != '가람솔 회계법인'"), ref).collect()] == [("company", "없는곳", 1)]


def test_canonical_titles():
    same = ["[서울] 2027 채용 (신입)", "【서울】 2027  채용 （신입）!!", "(신입) 2027채용 / 서울", "서울, 신입, 2027 채용", "“[서울] 2027 채용 [신입]”"]
    assert len({tc.canonical(t) for t in same}) == 1
    assert tc.canonical("[서울] 2028 채용 (신입)") != tc.canonical(same[0])
    assert tc.canonical(" -- ★") == tc.canonical(None) == tc.canonical("") == b""
    assert tc.canonical("A B") == tc.canonical("ab​") == tc.canonical("Ａ＿ｂ")


@pytest.mark.parametrize("limit", [2, 5, 1000])
def test_groups_against_brute_force(spark, limit):
    rng = random.Random(limit)
    titles = [rng.choice(["Aa b", "aab", "x", "prefix " + "y" * rng.randint(0, 9), "", None, "long " * 300 + rng.choice("uv")]) for _ in range(400)]
    p = spark.createDataFrame([(i, t, "z") for i, t in enumerate(titles)], "posting_id long, title string, id string").repartition(3)
    a = spark.createDataFrame([(i, t) for i, t in enumerate(titles[:50])], "article_id long, title string")
    first, want = {}, set()
    for kind, own in (("posting", titles), ("article", titles[:50])):
        for i, t in enumerate(own):
            key = (kind, tc.canonical(t))
            if key[1]:
                if key in first:
                    want.add((kind, first[key], i))
                else:
                    first[key] = i
    assert {tuple(r) for r in tc.found(p, a, limit).collect()} == want
    counts = tc.counts(p, a, limit).collect()
    assert sum(r["copies"] for r in counts) == len(want) + len(first) and len(counts) == len(first)


def test_no_titles(spark):
    p = spark.createDataFrame([], "posting_id long, title string")
    a = spark.createDataFrame([(1, None)], "article_id long, title string")
    assert tc.found(p, a).collect() == [] and tc.counts(p, a).collect() == []


VALUES = ["경력·신입", "신입 또는 경력", "경력무관(신입 가능)", "인턴(정규직 전환)", "정규 사원", "하계인턴십", "가람솔", "가람설회게법인", "나루미 테크 가람솔회계법인", "Daonbyeol", "없음", "무관", "신입경력무관"]


@pytest.mark.parametrize("size", [1, 3, 10, 100])
def test_answers_do_not_depend_on_blocks(spark, size):
    """An alias inside a word, ties and readings of different length: each block ranks as the whole list does."""
    whole = cv.Reference(ENTRIES)
    values = [(f, v) for f in cv.FIELDS for v in VALUES]
    want = {(f, v): whole.search(f, v) for f, v in values}
    ref = spark.createDataFrame(ENTRIES, "ref_id long, field string, name string, name_en string, aliases string")
    df = spark.createDataFrame(values, "field string, value string")
    got = {(r["field"], r["value"]): (r["ref_id"], r["edits"]) for r in cv.matched(df, ref, size).collect()}
    assert got == want and len({x for x, _ in want.values()}) > 5


def test_all_entries_within_the_distance(spark):
    near = [(1, "company", "가람솔회계법인", None, None), (2, "company", "가람술회계법인", None, None), (3, "company", "나루미테크", None, None)]
    ref = spark.createDataFrame(near, "ref_id long, field string, name string, name_en string, aliases string")
    df = spark.createDataFrame([(1, "가람설회계법인", None, None), (2, "바두리", None, None)], "posting_id long, company string, emp_type string, category string")
    assert sorted(map(tuple, cv.entries(df, ref).collect())) == [("company", "가람설회계법인", 1, 1), ("company", "가람설회계법인", 2, 1)]
    for value in VALUES:
        own = cv.Reference(ENTRIES).within("company", value)
        for reading in cv.readings(value):
            letters = cv.jamo(reading)
            for entry, name in ((1, "가람솔회계법인"), (2, "나루미테크")):
                if (e := lev(letters, cv.jamo(name))) <= cv.distance_for(len(letters)):
                    assert own[entry] <= e


def test_aliases_are_data(spark):
    ref = spark.createDataFrame(ENTRIES, "ref_id long, field string, name string, name_en string, aliases string")
    more = spark.createDataFrame([("emp_type", "정규직", "perm"), ("emp_type", "정규직", "staff;payroll"), ("company", "정규직", "x")], "field string, name string, alias string")
    wide = cv.with_aliases(ref, more)
    assert wide.columns == ref.columns and wide.count() == ref.count()
    df = spark.createDataFrame([(1, None, "payroll", None)], "posting_id long, company string, emp_type string, category string")
    assert [r["ref_id"] for r in cv.found(df, wide).collect()] == [4] and [r["ref_id"] for r in cv.found(df, ref).collect()] == [0]
