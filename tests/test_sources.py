from __future__ import annotations

import json

from pyspark.sql import types as T

from sievework.schema import POSTING
from sievework.sources import datasource, readers, sinks

FEED = "<rss><channel><item><title>Headline - Paper</title><link>https://x.example/1</link><pubDate>d</pubDate><source>Paper</source></item><item><title></title><link>l</link></item><item><title>Second</title><link>https://x.example/2</link></item></channel></rss>"
PAGE = "<html><title> A  page </title><a href='/posts/1?x=1'>A long enough title</a><a href='/posts/1'>Another long title</a><a href='/about'>About this whole site</a><table><tr><td>1</td><td>two</td></tr><tr><td>3</td></tr></table>"


def test_rss(spark):
    feeds = spark.createDataFrame([("s", 0, FEED), ("t", 1, "no xml"), ("u", 2, None)], "source string, o int, xml string")
    got = readers.rss_items(feeds, "xml", "o").orderBy("source", "item_ord").collect()
    assert [(r["source"], r["title"]) for r in got] == [("s", "Headline"), ("s", "Second")]
    assert readers.rss_items(feeds, "xml", "o", limit=1).count() == 1


def test_html(spark):
    pages = spark.createDataFrame([("s", 0, PAGE), ("t", 1, None)], "source string, o int, html string")
    got = readers.link_rows(pages, "html", "o", r"/posts/", base="https://x.example").collect()
    assert [(r["url"], r["title"]) for r in got] == [("https://x.example/posts/1", "A long enough title")]
    assert [tuple(r)[3:] for r in readers.table_rows(pages, "html", "o", ["a", "b"], 2).collect()] == [("1", "two")]


def test_api_and_paging(spark):
    item = T.StructType([T.StructField("id", T.StringType())])
    pages = spark.createDataFrame([("s", 1, '{"list": [{"id": "a"}, {"id": "b"}]}'), ("s", 2, '{"list": []}'), ("s", 3, '{"list": [{"id": "c"}]}'), ("t", 1, "broken")], "source string, page int, body string")
    assert [r["id"] for r in readers.api_pages(pages, "body", item, "list").orderBy("item_ord").collect()] == ["a", "b"]
    rows = spark.createDataFrame([("s", 1, 0, "a"), ("s", 2, 0, "a"), ("s", 3, 0, "z")], "source string, page int, row_ord int, id string")
    assert [r["id"] for r in readers.new_until_known(rows, "id").collect()] == ["a"]


def test_json_and_postings(spark, tmp_path):
    path = tmp_path / "manual.json"
    path.write_text(json.dumps({"postings": [{"source": "m", "title": " A  b ", "url": "https://x.example/1"}]}))
    rows = readers.postings(readers.json_rows(spark, str(path), POSTING, "postings"))
    got = rows.first()
    assert (got["title"], len(got["native_id"]), got["uid"]) == ("A b", 16, "m:" + got["native_id"])
    assert readers.json_rows(spark, str(tmp_path / "none.json"), POSTING, "postings").count() == 0
    assert readers.merge_config({"a": {"b": [1], "c": 2}}, {"a": {"b": [3]}}) == {"a": {"b": [3], "c": 2}}


def test_descriptors(spark):
    datasource.register(spark)
    d = [{"source": "a", "loader": "inline", "documents": [["k", "v"]]}, {"source": "b", "loader": "file", "path": "/nowhere"}]
    got = spark.read.format("descriptors").option("descriptors", json.dumps(d)).load().orderBy("source_ord").collect()
    assert (got[0]["body"], got[0]["error"]) == ("v", None)
    assert got[1]["body"] is None and got[1]["error"].startswith("FileNotFoundError")


def test_versioned_guard(spark, tmp_path):
    table = sinks.Versioned(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([("a",)], "x string")
    assert table.read(rows.schema).count() == 0
    assert table.write(rows)
    assert not table.write(rows.where("x = 'b'"))
    assert [r["x"] for r in table.read(rows.schema).collect()] == ["a"]
    assert table.write(rows.where("x = 'b'"), guard=False)
    assert table.read(rows.schema).count() == 0


def test_documents(spark):
    df = spark.createDataFrame([(2, "b|c"), (1, "a")], "o int, name string")
    doc = json.loads(sinks.json_document(df, "items", ["o"], 10).first()["document"])
    assert (doc["count"], doc["items"][0]["name"]) == (2, "a")
    assert "b/c" in sinks.markdown(df, ["o", "name"], ["o"])
    assert json.loads(sinks.status('{"a": "1", "b": "2"}', {"b": "3"}, "now")) == {"a": "1", "b": "3", "last_run": "now"}


def test_subscribers(spark):
    schema = "endpoint string, p256dh string, auth string, scope string, created string"
    old = spark.createDataFrame([("https://e.example/1", "k", "a", "all", "1")], schema)
    new = spark.createDataFrame([("https://e.example/1", "k2", "a", "odd", "2"), ("http://e.example/2", "k", "a", "all", "2")], schema)
    got = sinks.upsert_subscribers(old, new, ["all", "some"]).collect()
    assert [(r["p256dh"], r["scope"]) for r in got] == [("k2", "all")]


def test_release(spark):
    from sievework import session

    kept, session._PATHS[:] = session._PATHS[:], []
    df = session.written(spark.range(3), "gone")
    assert df.count() == 3
    path = session._PATHS[0].removeprefix("file://")
    session.release(spark)
    assert not __import__("os").path.exists(path)
    session._PATHS[:] = kept
