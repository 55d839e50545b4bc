from __future__ import annotations

from sievework.queries import QUERIES


def fixture(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_dates_of_every_posting(spark, tmp_path):
    rows = [(1, "2027.1.2 to 2027-02-30", "2027-01-05", None), (2, None, "2027년 6월 9일", "2027/6/1"), (3, "none", "", None), (4, "", "2026-06-02", ""), (5, None, "2026-06-01", None), (6, None, "2026-05-31", None)]
    sf = fixture(spark, tmp_path, "postings", rows, "posting_id long, body_excerpt string, deadline string, posted_date string")
    got = {r["posting_id"]: r["dates"] for r in QUERIES["all_dates"](spark, sf).collect()}
    assert got == {1: "2027-01-02,2027-01-05", 2: "2027-06-09,2027-06-01", 3: "", 4: "2026-06-02", 5: "2026-06-01", 6: "2026-05-31"}
    got = {r["posting_id"]: r["label"] for r in QUERIES["dday_label"](spark, sf).collect()}
    assert got == {1: "D-218", 2: "always", 3: "always", 4: "D-1", 5: "today", 6: "closed"}


def test_mail_dates_of_every_article(spark, tmp_path):
    rows = [(1, "Tue, 19 May 2026 02:20:53 GMT"), (2, "Tue, 19 May 2026 02:20:53 +0900"), (3, "Tue, 19 May 2026 02:20:53 -0330"), (4, "2026-05-19"), (5, None)]
    sf = fixture(spark, tmp_path, "articles", rows, "article_id long, published_at string")
    got = {r["article_id"]: r["utc"] for r in QUERIES["rfc822"](spark, sf).collect()}
    assert got == {1: "2026-05-19T02:20:53", 2: "2026-05-18T17:20:53", 3: "2026-05-19T05:50:53", 4: "", 5: ""}


def test_newness_of_every_row(spark, tmp_path):
    rows = [("a", "2026-05-03T00:00:00", None), ("b", "2026-04-30 00:00:01", ""), ("c", "2026-05-03T05:00:00.250 ", "2026-05-01"), ("d", "2026-05-03T23:59:59.750", "2026-05-02"), ("e", None, "2026-05-04"), ("f", "2026-05-04T00:00:00", "2026-02-30")]
    sf = fixture(spark, tmp_path, "state_snapshots", [(u, "2026-05-04", f, p) for u, f, p in rows], "uid string, snapshot_date string, first_seen string, posted_date string")
    got = {r["uid"]: (r["is_new"], r["fresh"]) for r in QUERIES["newness"](spark, sf).collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (False, True), "d": (True, True), "e": (False, False), "f": (True, True)}


def test_set_algebra_of_every_article(spark, tmp_path):
    rows = [(1, "가나 다라 마바", "다라 사아"), (9, "[가나] 다라", "다라"), (77, None, "가나"), (1000, None, None)]
    sf = fixture(spark, tmp_path, "articles", rows, "article_id long, title string, summary string")
    got = {r["article_id"]: (r["both"], r["either"]) for r in QUERIES["set_algebra"](spark, sf).collect()}
    assert got == {1: (1, 4), 9: (1, 1), 77: (0, 1), 1000: (0, 0)}


def test_every_article_has_its_representative(spark, tmp_path):
    rows = [(5, "가나 다라 마바", "k"), (6, "[속보] 마바, 다라 가나", "k"), (7, "다라 가나 마바", "m"), (8, "다른 제목", "k"), (9, None, "k"), (10, "가나 다라 마바", None)]
    sf = fixture(spark, tmp_path, "articles", rows, "article_id long, title string, category string")
    got = {r["article_id"]: r["id"] for r in QUERIES["token_overlap_members"](spark, sf).collect()}
    assert got == {5: 5, 6: 5, 7: 7, 8: 8, 9: 9}
    got = {r["article_id"]: r["id"] for r in QUERIES["near_title_members"](spark, sf).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 8, 10: 5}


def test_grace_by_own_last_seen(spark, tmp_path):
    rows = [(1, "2026-04-13", 1, "a", "2026-04-25"), (2, "2026-04-13", 1, "b", "2026-04-30"), (3, "2026-04-27", 2, "b", "2026-04-26"), (4, "2026-04-27", 2, "c", "2026-04-25"), (5, "2026-05-04", 3, "d", "2026-05-04")]
    schema = "snap_row_id long, snapshot_date string, delivered_at long, uid string, last_seen string, deadline string, posted_date string, first_seen string"
    sf = fixture(spark, tmp_path, "state_snapshots", [(*r, "", "", "2026-04-01T00:00:00") for r in rows], schema)
    assert [r["uid"] for r in QUERIES["carry_forward"](spark, sf).collect()] == ["b"]
    assert sorted(map(tuple, QUERIES["kept_and_carried"](spark, sf).collect())) == [("b", "carried"), ("d", "run")]
    got = {r["uid"]: r["last_seen"] for r in QUERIES["state_upsert"](spark, sf).collect()}
    assert got == {"a": "2026-04-25", "b": "2026-04-26", "c": "2026-04-25", "d": "2026-06-01"}
