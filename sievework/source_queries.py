"""Queries of readers and sinks: documents built from the test tables, read back by the library, each with its SQL twin."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import scalars as s
from sievework.queries import _DAY, _WS, query
from sievework.session import new_path, table
from sievework.sources import datasource, readers, sinks


def _escaped(c: str) -> F.Column:
    """A text as HTML and XML write it."""
    out = s.text(F.col(c))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"


@query(
    "with a as (select source, article_id, title, url, coalesce(source_label,'') l, floor(article_id / 100)::int feed from articles), "
    "k as (select *, row_number() over (partition by source order by feed, article_id) n from a where coalesce(title,'') <> '' and coalesce(url,'') <> ''), "
    "t as (select source, url, trim(title || ' - ' || l) t, trim(l) l from k where n <= 75) "
    f"select source, url, {_squeezed("case when l <> '' and ends_with(t, '- ' || l) then trim(substr(t, 1, length(t) - length(l) - 2)) else t end")} as title from t"
)
def rss_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of feeds, 75 a source, without the source's name at the end of titles; a feed holds a hundred ids of a source."""
    a = table(spark, sf_dir, "articles").withColumn("feed", F.floor(F.col("article_id") / 100).cast("int"))
    item = F.concat(F.lit("<item><title>"), _escaped("title"), F.when(s.text(F.col("title")) != "", F.concat(F.lit(" - "), _escaped("source_label"))).otherwise(""), F.lit("</title><link>"), _escaped("url"), F.lit("</link><source>"), _escaped("source_label"), F.lit("</source></item>"))
    feeds = a.groupBy("source", "feed").agg(F.array_sort(F.collect_list(F.struct("article_id", item.alias("x")))).alias("items"))  # at most a hundred
    xml = F.concat(F.lit("<channel>"), F.array_join(F.transform("items", lambda i: i["x"]), ""), F.lit("</channel>"))
    feeds = feeds.select("source", "feed", F.concat(F.lit("<rss>"), xml, F.lit("</rss>")).alias("xml"))
    return readers.rss_items(feeds, "xml", "feed", 75).select("source", "url", "title")


_LINE = f"{_squeezed("coalesce(company,'')")} || ' ' || {_squeezed("coalesce(title,'')")} || ' ' || {_squeezed("coalesce(posted_date,'')")}"


def _first(group: int) -> str:
    return f"regexp_extract(x, '{_DAY}', {group})"


@query(
    f"with p as (select posting_id, {_squeezed("coalesce(title,'')")} as title, {_squeezed("coalesce(company,'')")} as company, translate({_LINE}, '０１２３４５６７８９', '0123456789') x from postings), "
    f"q as (select *, case when {_first(1)} <> '' then {_first(1)} || '-' || lpad({_first(2)},2,'0') || '-' || lpad({_first(3)},2,'0') else '' end d from p) "
    "select posting_id::varchar as native_id, title, company, case when try_cast(d as date) is not null then d else '' end as posted from q"
)
def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of list pages whose links are script calls: id, title, firm and the first date of the row's text."""
    p = table(spark, sf_dir, "postings")
    row = F.concat(F.lit("<tr><td>"), _escaped("company"), F.lit("</td><td><a href='#' onclick=\"goView('"), F.col("posting_id").cast("string"), F.lit("', 1)\">"), _escaped("title"), F.lit("</a></td><td>"), _escaped("posted_date"), F.lit("</td></tr>"))
    pages = p.groupBy(F.floor(F.col("posting_id") / 50).cast("int").alias("page")).agg(F.array_join(F.collect_list(row), "").alias("rows"))  # at most fifty
    pages = pages.select(F.lit("board").alias("source"), "page", F.concat(F.lit("<table>"), F.col("rows"), F.lit("</table><a onclick=\"other(1)\">x</a>")).alias("html"))
    got = readers.call_rows(pages, "html", "page", "goView")
    return got.select("native_id", "title", F.try_element_at("cells", F.lit(1)).alias("company"), s.iso_date(F.col("line")).alias("posted"))


@query(
    "with p as (select *, ((row_number() over (partition by source order by posting_id) - 1) // 100 + 1)::int page, (count(*) over (partition by source) + 99) // 100 pages from postings) "
    "select source, page, posting_id as id from p where page <= greatest(pages - 1, 1) and coalesce(category,'') <> '경력' and nullif(native_id,'') is not null"
)
def api_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a paged API up to the last page it names, without those that lack a native id or are of a dropped category."""
    p = table(spark, sf_dir, "postings")
    n = F.row_number().over(Window.partitionBy("source").orderBy("posting_id"))
    total = p.groupBy("source").agg(F.greatest(F.ceil(F.count("*") / F.lit(100)) - 1, F.lit(1)).alias("pages"))  # the last page isn't named
    numbered = p.withColumn("page", F.floor((n - 1) / 100 + 1).cast("int")).join(total, "source")
    item = F.struct(F.col("posting_id").alias("id"), F.nullif(F.col("native_id"), F.lit("")).alias("native"), F.col("category"))
    bodies = numbered.groupBy("source", "page", "pages").agg(F.to_json(F.struct(F.collect_list(item).alias("list"), F.struct(F.col("pages").alias("totalPages")).alias("pagination"))).alias("body"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("native", T.StringType()), T.StructField("category", T.StringType())])
    got = readers.api_pages(bodies.select("source", "page", "body"), "body", schema, "list", F.col("category") == "경력", "$.pagination.totalPages", "native")
    return got.select("source", "page", "id")


_PAGED = "p as (select source, coalesce(nullif(native_id,''), 'none') id, posting_id, ((row_number() over (partition by source order by posting_id) - 1) // 5)::int page, company from postings)"


@query(
    f"with {_PAGED}, f as (select *, row_number() over (partition by source, id order by page, posting_id) k from p), g as (select source, page, count(*) filter (where k = 1) n from f group by 1, 2), "
    "st as (select source, min(page) filter (where n = 0) stop from g group by 1), c as (select native_id id, max(company) company from arrivals where native_id <> '' and company <> '' group by 1) "
    "select f.posting_id, coalesce(nullif(f.company,''), c.company, '') as company, coalesce(nullif(f.company,''), c.company, '') = '' as need from f join st using (source) left join c on c.id = f.id where k = 1 and (stop is null or page < stop)"
)
def paged_until_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered pages up to the first without a new id, each id once, blanks filled from a cache; ``need`` still lacks one."""
    p = table(spark, sf_dir, "postings")
    n = F.row_number().over(Window.partitionBy("source").orderBy("posting_id"))
    pages = p.select("source", F.coalesce(F.nullif(F.col("native_id"), F.lit("")), F.lit("none")).alias("id"), F.floor((n - 1) / 5).cast("int").alias("page"), F.col("posting_id").alias("row_ord"), "company")
    cache = table(spark, sf_dir, "arrivals").where("native_id <> '' and company <> ''").groupBy(F.col("native_id").alias("id")).agg(F.max("company").alias("company"))
    got = readers.with_cache(readers.new_until_known(pages, "id"), cache, "id", ["company"])
    return got.select(F.col("row_ord").alias("posting_id"), "company", "need")


@query("select 'n:' || native_id as key, arg_max(url, arrival_id) as value from (select native_id, batch_no, max(arrival_id) arrival_id, arg_max(coalesce(url,''), arrival_id) url from arrivals where batch_no <= 5 and native_id is not null group by 1, 2) group by native_id having true".replace("arg_max(url, arrival_id)", "arg_max(url, batch_no)"))
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key-value listing read page by page up to the complete one, keys of one prefix, the last value of each."""
    a = table(spark, sf_dir, "arrivals").where("native_id is not null").groupBy("batch_no", "native_id").agg(F.max_by(s.text(F.col("url")), "arrival_id").alias("url"))
    one = a.select(F.col("batch_no").alias("page"), F.array(F.concat(F.lit("n:"), "native_id"), F.concat(F.lit("x:"), "native_id")).alias("keys"), F.array("url", "url").alias("values"), (F.col("batch_no") == 5).alias("complete"))
    return readers.keyed_values(one, "n:")


@query(
    "with r as (select 'https://s/' || s_suppkey e, 'k' || s_suppkey p, 'a' a, case when s_nationkey < 12 then 'deal' else 'other' end scope, '2026-01-01' c, 0 t from supplier union all "
    "select case when c_custkey > 20 then 'http://' else 'https://' end || 's/' || c_custkey, case when c_custkey > 10 then 'n' || c_custkey end, 'b', 'tax', '2026-02-01', 1 from customer) "
    "select sha256(e) as id, arg_max(e, t) as endpoint, arg_max(p, t) as p256dh, arg_max(case when scope in ('deal','tax') then scope else 'all' end, t) as scope from r where starts_with(e, 'https://') and p is not null group by e"
)
def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers by the hash of their endpoint, the last write wins, invalid ones and unknown scopes aside."""
    old = table(spark, sf_dir, "supplier").select(F.concat(F.lit("https://s/"), "s_suppkey").alias("endpoint"), F.concat(F.lit("k"), "s_suppkey").alias("p256dh"), F.lit("a").alias("auth"), F.when(F.col("s_nationkey") < 12, "deal").otherwise("other").alias("scope"), F.lit("2026-01-01").alias("created"))
    c = F.col("c_custkey")
    new = table(spark, sf_dir, "customer").select(F.concat(F.when(c > 20, "http://").otherwise("https://"), F.lit("s/"), c).alias("endpoint"), F.when(c > 10, F.concat(F.lit("n"), c)).alias("p256dh"), F.lit("b").alias("auth"), F.lit("tax").alias("scope"), F.lit("2026-02-01").alias("created"))
    return sinks.upsert_subscribers(old, new, ["deal", "tax"]).select("id", "endpoint", "p256dh", "scope")


@query("select s_suppkey::varchar as endpoint, s_name as name from supplier where s_suppkey not in (select l_suppkey from lineitem where l_returnflag = 'R' and l_quantity > 49)")
def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers without the endpoints that a delivery found gone."""
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").cast("string").alias("endpoint")).distinct()
    return sinks.prune(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("endpoint"), F.col("s_name").alias("name")), gone)


@query("select uid, max(last_seen) as last_seen from state_snapshots where uid is not null group by uid")
def versioned_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state written as a version, then an empty one that is refused, read back."""
    kept = sinks.Versioned(spark, new_path(spark, "versions"))
    state = table(spark, sf_dir, "state_snapshots").where("uid is not null").groupBy("uid").agg(F.max("last_seen").alias("last_seen"))
    kept.write(state)
    kept.write(state.limit(0))
    return kept.read(state.schema)


@query("select source, kind, trust_rank from sources")
def manual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a JSON file of listed records, as a page writes it, read back."""
    rows = table(spark, sf_dir, "sources").select("trust_rank", "source", "kind")
    path = new_path(spark, "manual")
    sinks.json_document(rows, "items", ["trust_rank"], 1000).write.text(path)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("trust_rank", T.IntegerType())])
    return readers.json_rows(spark, path, schema, "items")


@query("select '| source | kind |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || source || ' | ' || kind || ' |', chr(10) order by trust_rank) || chr(10) as report from sources")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as a table in Markdown."""
    rows = table(spark, sf_dir, "sources").select("source", "kind", "trust_rank")
    return spark.createDataFrame([(sinks.markdown(rows, ["source", "kind"], ["trust_rank"]),)], "report string")


@query(
    "select * from (values ('status', '{\"jobs\": \"t1\", \"last_run\": \"t2\", \"news\": \"t2\"}'), ('heartbeat', '{\"jobs\": \"t1\", \"last_run\": \"t3\"}'), "
    "('feed', '{\"digest\": \"d\", \"generated_at\": \"t2\", \"new_items\": [1]}'), ('config', '{\"a\": {\"b\": 2, \"c\": 3}, \"l\": [9]}')) v(name, document)"
)
def small_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial updates of small documents: a run's status, a heartbeat, a feed with parts kept, a layered configuration."""
    first = sinks.status(None, {"jobs": "t1"}, "t1")
    feed = sinks.feed(sinks.feed(None, "t1", new_items=[1]), "t2", digest="d")
    config = json.dumps(readers.merge_config({"a": {"b": 1, "c": 3}, "l": [1, 2]}, {"a": {"b": 2}, "l": [9]}), sort_keys=True)
    rows = [("status", sinks.status(first, {"news": "t2"}, "t2")), ("heartbeat", sinks.status(first, {}, "t3")), ("feed", feed), ("config", config)]
    return spark.createDataFrame(rows, "name string, document string")


@query("select (trust_rank - 1)::int as source_ord, source, case when kind = 'insight' then null else source_label end as body, case when kind = 'insight' then 'KeyError: ''documents''' end as error from sources")
def descriptor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data source of descriptors, one partition each; a source that fails gives its error and no others'."""
    datasource.register(spark)
    rows = table(spark, sf_dir, "sources").orderBy("trust_rank").select("source", "source_label", "kind").collect()  # one row a source
    known = [{"source": r["source"], "loader": "inline", **({} if r["kind"] == "insight" else {"documents": [["k", r["source_label"]]]})} for r in rows]
    return spark.read.format("descriptors").option("descriptors", json.dumps(known)).load().select("source_ord", "source", "body", "error")


@query("select (row_number() over (order by trust_rank) - 1)::int as source_ord, source, '{\"pattern\": \"' || kind || '\", \"source\": \"' || source || '\"}' as descriptor from sources")
def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in their fixed order with what each is read by."""
    rows = table(spark, sf_dir, "sources").orderBy("trust_rank").select("source", "kind").collect()  # one row a source
    return readers.registry(spark, [{"source": r["source"], "pattern": r["kind"]} for r in rows])
