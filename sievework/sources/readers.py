"""Sources: text of feeds, pages and APIs to rows. Fetching is the caller's; a reader takes a column of raw documents.

A document that can't be read gives no rows; it never fails the others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.scalars import ellipsis, iso_dates, native_id, page_url, squeeze, strip_source_tail, text, uid
from sievework.operators.dedup import first_by, greedy_keys
from sievework.operators.ranking import cap
from sievework.schema import POSTING, SUBSCRIBER

ITEM = "struct<title:string,link:string,pubDate:string,source:string,description:string>"


def json_rows(spark: SparkSession, path: str, schema: T.StructType, field: str | None = None) -> DataFrame:
    """Rows of a JSON document (a list, or the list under ``field``); a missing or corrupt file is empty."""
    try:
        raw = spark.read.text(path, wholetext=True)
        raw.schema  # noqa: B018 - resolves the path
    except Exception:  # noqa: BLE001 - no such file
        return spark.createDataFrame([], schema)
    rows = T.ArrayType(schema)
    if field:
        body = F.from_json("value", T.StructType([T.StructField(field, rows)]))[field]
    else:
        body = F.from_json("value", rows)
    return raw.select(F.explode(body).alias("r")).where("r is not null").select("r.*")


def subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """Subscribers from ``{"subscriptions": [...]}`` or a bare list, those with an endpoint; the file is read once."""
    try:
        raw = spark.read.text(path, wholetext=True)
        raw.schema  # noqa: B018 - resolves the path
    except Exception:  # noqa: BLE001 - no such file
        return spark.createDataFrame([], SUBSCRIBER)
    rows = T.ArrayType(SUBSCRIBER)
    body = F.when(F.ltrim("value").startswith("["), F.from_json("value", rows)).otherwise(F.from_json("value", T.StructType([T.StructField("subscriptions", rows)]))["subscriptions"])
    each = raw.select(F.explode(body).alias("r")).where("r is not null").select("r.*")
    return each.where(text(F.col("endpoint")) != "")


def keyed_values(pages: DataFrame, prefix: str) -> DataFrame:
    """key and value of a key-value listing read page by page: pages (page, cursor, keys, values, complete) up to the first
    complete one, keys of one prefix; the last value of a key counts."""
    end = pages.agg(F.min(F.when(F.col("complete"), F.col("page"))).alias("end"))
    each = pages.join(F.broadcast(end)).where(F.col("end").isNull() | (F.col("page") <= F.col("end")))  # one row
    pairs = each.select("page", F.explode(F.arrays_zip("keys", "values")).alias("p")).where(F.col("p.keys").startswith(prefix))
    return pairs.groupBy(F.col("p.keys").alias("key")).agg(F.max_by(F.col("p.values"), "page").alias("value"))


def rss_items(feeds: DataFrame, xml: str, order: str, limit: int = 75) -> DataFrame:
    """Items of RSS documents in feed order, at most ``limit`` a feed; without title or link they don't count.

    feeds: source, order column, xml text. A title's trailing ``- source`` is cut.
    """
    parsed = F.from_xml(F.col(xml), "channel struct<item:array<" + ITEM + ">>", {"mode": "PERMISSIVE"})
    each = feeds.select(*[c for c in feeds.columns if c != xml], F.posexplode(parsed["channel"]["item"]).alias("item_ord", "i"))
    rows = each.where((text(F.col("i.title")) != "") & (text(F.col("i.link")) != ""))
    rows = rows.select(*[c for c in feeds.columns if c != xml], "item_ord", squeeze(strip_source_tail(F.col("i.title"), text(F.col("i.source")))).alias("title"), F.col("i.link").alias("url"), F.col("i.pubDate").alias("published_at"), F.col("i.source").alias("source_label"), squeeze(F.col("i.description")).alias("summary"))
    return cap(rows, ["source"], [F.col(order), F.col("item_ord")], limit)


def feed_pools(spark: SparkSession, queries: Mapping[str, str | Sequence[str]], prefix: str, limit: int) -> DataFrame:
    """Descriptors of feeds: each category's pools in order, the second and later ones with a suffix to their source."""
    rows = []
    for category, pools in queries.items():
        for k, q in enumerate([pools] if isinstance(pools, str) else pools):
            rows.append((len(rows), category, k, f"{prefix}{category}" + (f"_{k + 1}" if k else ""), q, limit))
    return spark.createDataFrame(rows, "source_ord int, category string, pool int, source string, query string, limit int")


def registry(spark: SparkSession, sources: Sequence[Mapping]) -> DataFrame:
    """Sources in their fixed order with what each is read by (pattern, skip set, parameters) as one JSON descriptor."""
    return spark.createDataFrame([(i, s["source"], json.dumps(dict(s), ensure_ascii=False, sort_keys=True)) for i, s in enumerate(sources)], "source_ord int, source string, descriptor string")


def script_id(c: Column, call: str) -> Column:
    """The first argument of a script call in an attribute, null if there is none."""
    return F.nullif(F.regexp_extract(text(c), re.escape(call) + r"\(\s*'?([^',)\s]+)", 1), F.lit(""))


def first_and_last_date(c: Column) -> tuple[Column, Column]:
    """Posted day and deadline of a text: its first and its last date; a single one is both, none empty."""
    dates = iso_dates(c)
    return text(F.try_element_at(dates, F.lit(1))), text(F.try_element_at(dates, F.lit(-1)))


def labelled_values(cells: Column, labels: Sequence[str]) -> Column:
    """Values of a page's label/value table as a map: of each row of cells the one after a label."""
    pairs = F.flatten(F.transform(cells, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda i: F.struct(F.try_element_at(r, i).alias("key"), F.try_element_at(r, i + 1).alias("value")))))
    known = F.filter(pairs, lambda p: p["key"].isin(*labels) & p["value"].isNotNull())
    return F.aggregate(known, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[str, str]] = []
        self.href: str | None = None
        self.words: list[str] = []
        self.title: list[str] = []
        self.in_title = False
        self.cells: list[list[str]] = []
        self.cell: list[str] | None = None
        self.call = ""
        self.calls: list[tuple[str, str, int]] = []  # script call and text of a link, and the table row it stands in

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            own = dict(attrs)
            self.href, self.words = own.get("href") or "", []
            self.call = own.get("onclick") or ""
        elif tag == "title":
            self.in_title = True
        elif tag == "tr":
            self.cells.append([])
        elif tag in ("td", "th") and self.cells:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.href is not None:
            self.rows.append((self.href, " ".join("".join(self.words).split())))
            if self.call:
                self.calls.append((self.call, self.rows[-1][1], len(self.cells) - 1))
            self.href = None
        elif tag == "title":
            self.in_title = False
        elif tag in ("td", "th") and self.cell is not None:
            self.cells[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.words.append(data)
        if self.in_title:
            self.title.append(data)
        if self.cell is not None:
            self.cell.append(data)


def parse_html(html: str | None) -> tuple[str, list[tuple[str, str]], list[list[str]]]:
    """Title, links (href, text) and table rows of a page."""
    parser = _Links()
    try:
        parser.feed(html or "")
    except Exception:  # noqa: BLE001 - what was read so far counts
        pass
    return " ".join("".join(parser.title).split()), parser.rows, [r for r in parser.cells if r]


def html_pages(pages: DataFrame, html: str) -> DataFrame:
    """Adds title, links and cells to pages."""
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType([*kept, T.StructField("page_title", T.StringType()), T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())]))), T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType())))])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parse_html(h) for h in b[html]]
            yield b.drop(columns=[html]).assign(page_title=[g[0] for g in got], links=[[{"href": h, "text": t} for h, t in g[1]] for g in got], cells=[g[2] for g in got])

    return pages.mapInPandas(read, schema)


def call_rows(pages: DataFrame, html: str, order: str, call: str) -> DataFrame:
    """Rows of a list page whose links are script calls: source, native_id (the call's argument), title, cells and text of
    the table row, in page order; links without an id are left out."""
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType([*kept, T.StructField("rows", T.ArrayType(T.StructType([T.StructField("call", T.StringType()), T.StructField("title", T.StringType()), T.StructField("cells", T.ArrayType(T.StringType()))])))])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for h in b[html]:
                parser = _Links()
                try:
                    parser.feed(h or "")
                except Exception:  # noqa: BLE001 - what was read so far counts
                    pass
                got.append([{"call": c, "title": t, "cells": parser.cells[i] if 0 <= i < len(parser.cells) else []} for c, t, i in parser.calls])
            yield b.drop(columns=[html]).assign(rows=got)

    each = pages.mapInPandas(read, schema).select("source", F.col(order).alias("page_ord"), F.posexplode("rows").alias("row_ord", "r"))
    rows = each.select("source", "page_ord", "row_ord", script_id(F.col("r.call"), call).alias("native_id"), squeeze(F.col("r.title")).alias("title"), F.col("r.cells").alias("cells"), F.array_join("r.cells", " ").alias("line"))
    return rows.where("native_id is not null")


def link_rows(pages: DataFrame, html: str, order: str, pattern: str, base: str = "", least: int = 7, most: int = 80, limit: int = 12) -> DataFrame:
    """Links of article pages: href without query by pattern, title long enough, cut with an ellipsis; kept greedily by
    url and title, capped a source."""
    each = html_pages(pages, html).select("source", F.col(order).alias("page_ord"), F.posexplode("links").alias("link_ord", "l"))
    rows = each.select("source", (F.col("page_ord") * 100000 + F.col("link_ord")).alias("ord"), page_url(F.col("l.href"), base or None).alias("url"), squeeze(F.col("l.text")).alias("title"))
    rows = rows.where(F.col("url").rlike(pattern) & (F.length("title") >= least)).withColumn("title", ellipsis(F.col("title"), most))
    keyed = rows.withColumns({"url_key": F.concat_ws("|", "source", "url"), "title_key": F.concat_ws("|", "source", "title")})
    return cap(greedy_keys(keyed, ["url_key", "title_key"], "ord"), ["source"], [F.col("ord")], limit).drop("url_key", "title_key")


def table_rows(pages: DataFrame, html: str, order: str, columns: Sequence[str], least: int) -> DataFrame:
    """Rows of a page's tables with at least ``least`` cells, named by position."""
    each = html_pages(pages, html).select("source", F.col(order).alias("page_ord"), F.posexplode("cells").alias("row_ord", "c")).where(F.size("c") >= least)
    return each.select("source", "page_ord", "row_ord", *[F.try_element_at("c", F.lit(i + 1)).alias(n) for i, n in enumerate(columns)])


def api_pages(pages: DataFrame, body: str, item: T.StructType, items: str, drop: Column | None = None, total: str | None = None, require: str | None = None) -> DataFrame:
    """Items of JSON API pages up to the first page of a source that is empty or unreadable, or the last by ``total`` (a
    JSON path to the number of pages, 1 where it is missing); ``require`` names a field without which an item is left out."""
    from pyspark.sql import Window

    if total is not None:
        pages = pages.where(F.col("page") <= F.coalesce(F.get_json_object(F.col(body), total).try_cast("int"), F.lit(1)))
    parsed = pages.withColumn("_items", F.from_json(F.col(body), T.StructType([T.StructField(items, T.ArrayType(item))]))[items])
    stopped = F.max(F.when(F.coalesce(F.size("_items"), F.lit(0)) <= 0, 1).otherwise(0)).over(Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    rows = parsed.withColumn("_stop", stopped).where("_stop = 0").select("source", "page", F.posexplode("_items").alias("item_ord", "i")).select("source", "page", "item_ord", "i.*")
    if require is not None:
        rows = rows.where(F.col(require).isNotNull())
    return rows if drop is None else rows.where(~F.coalesce(drop, F.lit(False)))


def new_until_known(pages: DataFrame, key: str) -> DataFrame:
    """Rows of numbered pages, first of each id, up to the first page that brings no new id."""
    first = first_by(pages.withColumn("_o", F.struct("page", "row_ord")), ["source", key], "_o").drop("_o")
    news = pages.select("source", "page").distinct().join(first.groupBy("source", "page").agg(F.count("*").alias("n")), ["source", "page"], "left")
    stop = news.groupBy("source").agg(F.min(F.when(F.coalesce("n", F.lit(0)) == 0, F.col("page"))).alias("stop"))
    return first.join(stop, "source").where(F.col("stop").isNull() | (F.col("page") < F.col("stop"))).drop("stop")


def with_cache(rows: DataFrame, cache: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Known values of rows from a cache of the same id; ``need`` marks rows that still miss one."""
    from sievework.operators.joining import hydrate

    full = hydrate(rows, cache, key, fields)
    need = F.lit(False)
    for f in fields:
        need = need | (F.col(f) == "")
    return full.withColumn("need", need)


def postings(raw: DataFrame) -> DataFrame:
    """Raw rows in the posting schema: missing text empty, texts squeezed, native id and uid derived."""
    have = set(raw.columns)
    rows = raw.select(*[(F.col(c) if c in have else F.lit("")).cast("string").alias(c) for c in POSTING.fieldNames()], *[c for c in raw.columns if c not in POSTING.fieldNames()])
    rows = rows.withColumns({c: squeeze(F.col(c)) for c in ("title", "company", "deadline", "posted_date", "body_excerpt", "category")})
    rows = rows.withColumns({c: text(F.col(c)) for c in ("source", "source_label", "url", "location", "emp_type")})
    rows = rows.withColumn("native_id", native_id(F.col("native_id"), F.col("url")))
    return rows.withColumn("uid", uid(F.col("source"), F.col("native_id")))


def union_sources(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union of sources in their order with ``source_ord``."""
    out = None
    for i, (_, df) in enumerate(parts):
        own = df.withColumn("source_ord", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def source_report(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """source, rows found and whether the source gave any, zero for those that failed."""
    n = rows.groupBy("source").agg(F.count("*").alias("n"))
    return sources.select("source").join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("ok"))


def merge_config(base: dict, over: dict) -> dict:
    """Maps merge by key; lists and scalars of ``over`` replace whole."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
