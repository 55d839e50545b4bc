from __future__ import annotations

import random

import numpy as np
import pytest

from sievework.llm import leakage as lk
from sievework.llm import mixture as mx
from sievework.llm import sentences as st


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Kim met Mr. Lee at 3 p.m. on Monday. It cost 3.5 million. See Fig. 2.", ["Dr. Kim met Mr. Lee at 3 p.m. on Monday.", "It cost 3.5 million.", "See Fig. 2."]),
        ('She said, "We count. We sign," and left. Done!', ['She said, "We count. We sign," and left.', "Done!"]),
        ("감사를 늘렸다! 과연 끝날까?다음 날 알린다.", ["감사를 늘렸다!", "과연 끝날까?", "다음 날 알린다."]),
        ("접수는 2027. 2. 18.까지 한다. 결과는 ver. 4.3에 나온다.", ["접수는 2027. 2. 18.까지 한다.", "결과는 ver. 4.3에 나온다."]),
        ('그는 "먼저 고친다. 늦으면 비싸다."고 말했다. 그러나 미뤘다… 끝났다.', ['그는 "먼저 고친다. 늦으면 비싸다."고 말했다.', "그러나 미뤘다…", "끝났다."]),
        ("좋습니다^^ 연락이 없어요ㅠㅠ 들었음 ㅎㅎ 그래요~ 네.", ["좋습니다^^", "연락이 없어요ㅠㅠ", "들었음 ㅎㅎ", "그래요~", "네."]),
        ("「急ぐ。来月だ。」と述べた。終わるのか？計（68件。速報）は未定である。", ["「急ぐ。来月だ。」と述べた。", "終わるのか？", "計（68件。速報）は未定である。"]),
        ("另有说明……能完成吗？完了！", ["另有说明……", "能完成吗？", "完了！"]),
        ("Am 5. März kostet es ca. 3.924,50 Euro, d. h. mehr. Gilt Nr. 34 auch für die Firma?", ["Am 5. März kostet es ca. 3.924,50 Euro, d. h. mehr.", "Gilt Nr. 34 auch für die Firma?"]),
        ("प्रो. समिति ने 8 सुझाव दिए। क्या यह पूरी होगी?", ["प्रो. समिति ने 8 सुझाव दिए।", "क्या यह पूरी होगी?"]),
        ("การยื่นภาษีต้องเสร็จภายใน 9 วัน สำนักงานใหญ่ยังไม่ตอบ", ["การยื่นภาษีต้องเสร็จภายใน 9 วัน", "สำนักงานใหญ่ยังไม่ตอบ"]),
        ("Heading\n1) first. second\r\n- item\n\nText here.", ["Heading", "1) first. second", "- item", "Text here."]),
        ("Heading of it\n\nThe committee moved the long tax filings to one\na.m. on Monday, and the second half of the audit\nwork to Dec. 9. Fees rose again. The rest of the\ntext ends here.", ["Heading of it", "The committee moved the long tax filings to one\na.m. on Monday, and the second half of the audit\nwork to Dec. 9.", "Fees rose again.", "The rest of the\ntext ends here."]),
        ("", []), (None, []), (" \n　", []), ("...", ["..."]),
    ],
)
def test_units(text, want):
    assert [text[a:b] for a, b in st.units(text)] == want


def test_units_cover_all_text(spark):
    rng = random.Random(9)
    for _ in range(150):
        text = "".join(rng.choice("aB 다。.?!\n\r\"'“”(（ 5ㅋ~^…ก।") for _ in range(rng.randint(0, 60)))
        spans, covered = st.units(text), [False] * len(text)
        for a, b in spans:
            assert a < b and not text[a].isspace() and not text[b - 1].isspace()
            for i in range(a, b):
                assert not covered[i]
                covered[i] = True
        assert all(c or ch.isspace() for c, ch in zip(covered, text))
    df = spark.createDataFrame([(1, "We go. I do.", 0), (2, None, 1), (3, "", 2)], "doc_id long, text string, start_pos int")
    assert [tuple(r) for r in st.found(df).collect()] == [(1, 0, 6), (1, 7, 12)]


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(20):
        docs = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(4)]
        text = "\x00".join(docs) + "\x00"
        codes = np.searchsorted(np.unique(lk._points(text)), lk._points(text))
        sa = lk.suffix_array(codes, lk._pack(codes, 2, lk.KEY))
        assert sorted(sa.tolist()) == list(range(len(text)))
        ends = [text[i : text.index("\x00", i)] for i in sa.tolist()]
        assert ends == sorted(ends)


def test_matches_against_brute_force():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(6))
    docs = ["".join(word() for _ in range(20)) for _ in range(6)]
    items = [(1, docs[0][10:60]), (2, docs[3][:40] + word()), (3, "".join(word() for _ in range(5)))]
    own = lk.Items(items)
    got = {tuple(x) for x in zip(*(v.tolist() for v in lk.shard_matches(docs, own)))}
    want, least = set(), lk.LEAST["latin"]
    for j, (_, t) in enumerate(items):
        for d, doc in enumerate(docs):
            for a in range(len(t)):
                for p in range(len(doc)):
                    if a and p and t[a - 1] == doc[p - 1]:
                        continue
                    n = 0
                    while a + n < len(t) and p + n < len(doc) and t[a + n] == doc[p + n]:
                        n += 1
                    if n >= least:
                        want.add((d, j, a, p, n))
    assert got == want


def test_leaks(spark):
    item = "The zigzag furnace neatly pledges its jagged ferryman, while a amber drover hoists each gatehouse."
    docs = [(1, f"Intro text. {item.upper()} End."), (2, "Intro. The zigzag furnace neatly pledges its jagged ferryman. More."), (3, "The zigzag furnace of ours is a stock phrase."), (4, None), (5, ""), (6, item.replace("neatly", "gladly").replace(", while", " — inserted words here — while")), (6, "x" * 100)]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(9, "en", item), (10, "en", None), (11, "en", "...")], "item_id long, lang string, text string")
    assert sorted(map(tuple, lk.found(d, e).collect())) == [(1, 9), (2, 9), (6, 9)]
    assert sorted(r["doc_id"] for r in lk.clean(d, e).collect()) == [3, 4, 5]
    assert lk.found(d, e.where("item_id > 99")).collect() == [] and lk.found(d.where("doc_id > 99"), e).collect() == []


@pytest.mark.parametrize("letters", [3000, 5000, 40_000, 300_000])
def test_wide_alphabets(letters):
    """Longest matches by hand, with keys of 5, 4, 3 and 3 letters."""
    rng = random.Random(letters)
    wide = "".join(chr(c) for c in range(0x3400, 0x3400 + letters) if not 0xD800 <= c < 0xE000)
    items = lk.Items([(i, "".join(chr(rng.randrange(0x4E00, 0x4E00 + 2500)) for _ in range(30))) for i in range(5)])
    texts = items.text.split("\x00")
    docs = [wide + texts[0][3:25] + "a", "b" + texts[1], wide[:50] + texts[2][:6], texts[3][:9] + "c" + texts[3][9:]]
    got = sorted(zip(*(x.tolist() for x in lk.shard_matches(docs, items))))
    assert got == [(0, 0, 3, len(wide), 22), (1, 1, 0, 1, 30), (3, 3, 0, 0, 9), (3, 3, 9, 10, 21)]


def test_plan_and_positions(spark):
    supply, targets = {"a": 1000, "b": 100, "z": 5}, {"a": (0.5, 1), "b": (0.3, 4), "c": (0.2, 9)}
    held = mx.plan(supply, targets)
    assert held["a"] / sum(held.values()) == pytest.approx(0.5 / 0.8) and held["b"] == pytest.approx(400) and "c" not in held
    capped = mx.plan(supply, targets, total=2000)
    assert capped == {"a": 1000, "b": 400} and mx.plan({}, targets) == {}
    slope = mx.slopes({"a": 0.6, "b": 0.4}, {"a": 1, "b": 3})
    assert sum({"a": 0.6, "b": 0.4}[s] * v for s, v in slope.items()) == pytest.approx(0)
    rows = spark.createDataFrame([(float(x), 100.0, v) for x in (0, 25, 50, 100) for v in (-0.4, 0.0, 0.3)], "x double, d double, s double")
    for r in rows.withColumn("t", mx.position(rows.x, rows.d, rows.s)).collect():
        assert r["t"] + r["s"] * (r["t"] ** 2 - r["t"]) == pytest.approx(r["x"] / 100)


def test_mixture(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["audit", "tax", "deal"]) for _ in range(20)), "a" if i % 10 else "b") for i in range(400)] + [(900, "", "a"), (901, None, "b"), (902, "text", None), (903, "text", "other")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.7, 1), ("b", 0.2, 5), ("c", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mx.mixture(d, t).collect()
    assert [r["at_token"] for r in mixed] == sorted(r["at_token"] for r in mixed)
    assert len({(r["doc_id"], r["epoch"]) for r in mixed}) == len(mixed)
    report = {r["source"]: r for r in mx.shares(spark.createDataFrame(mixed), t).collect()}
    assert report["a"]["share"] == pytest.approx(7 / 9, abs=0.02) and report["b"]["share"] == pytest.approx(2 / 9, abs=0.02)
    assert report["b"]["repeats"] <= 5 and report["c"]["tokens"] == 0
    assert mx.mixture(d.where("doc_id < 0"), t).collect() == []


def _corpus(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_long_documents_and_item_blocks(spark, monkeypatch):
    """A document cut into overlapping pieces and items in several blocks give what whole ones give."""
    rng = random.Random(9)
    words = [f"word{i:03d}" for i in range(400)]
    items = [(k, _corpus(rng, words, 30)) for k in range(6)]
    texts = [(1, _corpus(rng, words, 300) + " " + items[0][1] + " " + _corpus(rng, words, 500) + " " + items[3][1] + " " + _corpus(rng, words, 300)), (2, items[1][1]), (3, _corpus(rng, words, 50)), (4, items[4][1][: len(items[4][1]) // 2] + " inserted here " + items[4][1][len(items[4][1]) // 2 :])]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, lk.matches(d, e).collect()))
    assert [(r[0], r[1]) for r in want] == [(1, 0), (1, 3), (2, 1), (4, 4)]
    assert sorted(map(tuple, lk.matches(d, e, shard_chars=1000).collect())) == want
    monkeypatch.setattr(lk, "BLOCK_CHARS", 500)
    assert sorted(map(tuple, lk.matches(d, e).collect())) == want
    assert sorted(map(tuple, lk.matches(d, e, shard_chars=1000).collect())) == want


def test_six_thousand_letters():
    rng = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(6000)]
    items = [(k, "".join(rng.choice(letters) for _ in range(60))) for k in range(3)]
    docs = ["".join(letters), "".join(rng.choice(letters) for _ in range(500)) + items[1][1] + "".join(rng.choice(letters) for _ in range(500))]
    got = sorted(zip(*(x.tolist() for x in lk.shard_matches(docs, lk.Items(items)))))
    assert got == [(1, 1, 0, 500, 60)]


def test_chain_against_all_pairs():
    def plain(matches):
        matches = sorted(set(matches), key=lambda m: (m[1], m[0], m[2]))
        best = []
        for a, d, n in matches:
            most = n
            for k, (pa, pd, pn) in enumerate(matches[: len(best)]):
                skip = max(0, pa + pn - a, pd + pn - d)
                if skip < n and d - pd - pn <= lk.APART and pa <= a:
                    most = max(most, best[k] + n - skip)
            best.append(most)
        return max(best, default=0)

    rng = random.Random(6)
    for _ in range(60):
        matches = [(rng.randrange(300), rng.randrange(3000), rng.randrange(5, 60)) for _ in range(rng.randrange(0, 40))]
        assert lk.chain(matches) == plain(matches)


def test_short_matches_that_hold_most_of_an_item_count(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(30)]
    item = "".join(words)
    changed = "".join(w if i % 3 else "zz" + w[2:] for i, w in enumerate(words))  # every match is short
    d = spark.createDataFrame([(1, changed), (2, item[:70])], "doc_id long, text string")
    e = spark.createDataFrame([(5, item)], "item_id long, text string")
    row = lk.matches(d, e).collect()
    assert [(r["doc_id"], r["item_id"]) for r in row] == [(1, 5)] and row[0]["longest"] < lk.LEAST["latin"] * 2


def test_shares_meet_targets_within_a_document(spark):
    """Each source's tokens are within its largest document of its target share of the total, no source repeated too often."""
    rng = random.Random(12)
    docs = [(i, " ".join(rng.choice(["tax", "audit", "fee"]) for _ in range(rng.randrange(1, 60))), "abcd"[min(3, i % 7)]) for i in range(400)]
    targets = [("a", 0.5, 4), ("b", 0.3, 2), ("c", 0.15, 3), ("d", 0.05, 1), ("none", 0.0, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    sizes = {r["source"]: r["m"] for r in mx.token_counts(d).groupBy("source").agg({"tokens": "max"}).withColumnRenamed("max(tokens)", "m").collect()}
    mixed = mx.mixture(d, t)
    got = {r["source"]: r for r in mx.shares(mixed, t).collect()}
    total = sum(r["tokens"] for r in got.values())
    for source, share, repeats in targets[:4]:
        assert abs(got[source]["tokens"] - share * total) <= 2 * max(sizes.values()) and got[source]["repeats"] <= repeats
    assert total > 0 and any(got[s]["repeats"] == r for s, _, r in targets[:4])  # the total can't be larger
