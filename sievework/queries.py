"""Queries of the core: (spark, sf_dir) -> DataFrame, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import scalars as s
from sievework.operators import dedup, facets, joining, monitor, ranking, rules, snapshots, state, timestamps, vectors
from sievework.plans import pipelines
from sievework.session import new_path, table, written
from sievework.sources import readers, sinks
from sievework.streaming import state_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changes(table(spark, sf_dir, "state_snapshots"))


@query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.found(*(table(spark, sf_dir, t) for t in ("postings", "articles", "sources")))


# --- the reference's operators, each with its SQL twin over the same tables ---

AS_OF = "2026-06-01"


def _sig_sql(c: str) -> str:
    return f"list_distinct(regexp_extract_all(regexp_replace(regexp_replace(lower(coalesce({c},'')), '\\[[^\\]]*\\]', ' ', 'g'), '\\s[-|][^-|]*$', ''), '[0-9a-z가-힣]{{2,}}'))"


_WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x0b\x1c-\x1f]+"


def _any_sql(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query(f"select posting_id, trim(regexp_replace(coalesce(title,''), '{_WS}', ' ', 'g')) as title, coalesce(nullif(native_id,''), substr(sha256(coalesce(url,'')),1,16)) as native_id, source || ':' || coalesce(nullif(native_id,''), substr(sha256(coalesce(url,'')),1,16)) as uid from postings")
def normalise_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squeezed titles, derived ids."""
    p = table(spark, sf_dir, "postings")
    native = s.native_id(F.col("native_id"), F.col("url"))
    return p.select("posting_id", s.squeeze(F.col("title")).alias("title"), native.alias("native_id"), s.uid(F.col("source"), native).alias("uid"))


@query(
    "with p as (select posting_id, regexp_extract(coalesce(deadline,''), '(\\d{4})\\s*[-./년]\\s*(\\d{1,2})\\s*[-./월]\\s*(\\d{1,2})', ['y','m','d']) as r from postings), "
    "q as (select posting_id, r.y || '-' || lpad(r.m,2,'0') || '-' || lpad(r.d,2,'0') as iso from p where r.y <> '') "
    f"select posting_id, iso, date_diff('day', date '{AS_OF}', try_cast(iso as date))::int as dday, iso >= '{AS_OF}' as open from q where try_cast(iso as date) is not null"
)
def deadline_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First date of a deadline, days left, openness."""
    iso = s.iso_date(F.col("deadline"))
    p = table(spark, sf_dir, "postings").select("posting_id", iso.alias("iso")).where("iso <> ''")
    return p.select("posting_id", "iso", s.days_left(F.col("iso"), F.lit(AS_OF)).alias("dday"), s.is_open(F.col("iso"), F.lit(AS_OF)).alias("open"))


@query("select doc_id, (length(text) + length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')))::bigint as bytes2, (length(text) + 2 * length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')))::bigint as bytes3, length(text)::bigint as points from documents where text is not null")
def byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of texts by code points and by bytes of two encodings."""
    d, t = table(spark, sf_dir, "documents").where("text is not null"), F.col("text")
    return d.select("doc_id", s.byte_count(t, 2).cast("long").alias("bytes2"), s.byte_count(t, 3).cast("long").alias("bytes3"), F.length(t).cast("long").alias("points"))


@query("select posting_id, case when length(title) > 40 then rtrim(substr(title,1,39), ' ') || '…' else title end as title, regexp_replace(coalesce(url,''), '[?#].*$', '') as page from postings where title is not null")
def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles cut with an ellipsis, URLs without query and fragment."""
    p = table(spark, sf_dir, "postings").where("title is not null")
    return p.select("posting_id", s.ellipsis(F.col("title"), 40).alias("title"), s.page_url(F.col("url")).alias("page"))


@query(f"select article_id, list_sort({_sig_sql('title')})::varchar[] as tokens from articles")
def title_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sets of titles."""
    return table(spark, sf_dir, "articles").select("article_id", F.array_sort(s.title_signature(F.col("title"))).alias("tokens"))


_LABELS = {"deal": ["m&a", "딜자문"], "tax": ["세무", "tax"], "audit": ["감사", "audit"]}
_CASE = "case " + " ".join(f"when {_any_sql('t', w)} then '{k}'" for k, w in _LABELS.items()) + " else 'other' end"


@query(f"select posting_id, {_CASE} as label from (select posting_id, lower(coalesce(title,'') || ' ' || coalesce(category,'')) t from postings)")
def first_label_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First label of ordered keyword rules."""
    t = s.haystack(F.col("title"), F.col("category"))
    return table(spark, sf_dir, "postings").select("posting_id", rules.first_label(t, _LABELS, "other").alias("label"))


@query(
    "with p as (select posting_id, source, lower(coalesce(title,'')) t, lower(coalesce(title,'') || ' ' || coalesce(company,'') || ' ' || coalesce(body_excerpt,'') || ' ' || coalesce(category,'')) b from postings), "
    "q as (select *, regexp_replace(b, '(무관급|시보급)[ )/·,.\\-]*(상근|6개월)', '', 'g') r from p) "
    "select posting_id from q where not contains(t,'remote') and (source = 'brd_susup' or (not (contains(b,'경력') and not regexp_matches(r, '무관급|시보급'))))"
)
def posting_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered row rules with negation-aware rescue and a bypassed source."""
    p = table(spark, sf_dir, "postings")
    body = s.haystack(F.col("title"), F.col("company"), F.col("body_excerpt"), F.col("category"))
    ok = rules.keep(F.col("title"), body, F.col("source"), noise=["remote"], bypass=["brd_susup"], exclude=["경력"], rescue=["무관급", "시보급"], negators=["상근", "6개월"])
    return p.where(ok).select("posting_id")


@query(f"select article_id from (select article_id, lower(coalesce(title,'')) t from articles) where {_any_sql('t', ['법인세', '공시'])} and {_any_sql('t', ['점검', '정비'])} and not {_any_sql('t', ['시범'])}")
def gate_and_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic gate, AND rule and noise exclusion."""
    t = F.lower(s.text(F.col("title")))
    return table(spark, sf_dir, "articles").where(rules.contains_all(t, ["법인세", "공시"], ["점검", "정비"]) & ~rules.contains_any(t, ["시범"])).select("article_id")


@query(f"select article_id from articles where coalesce(strftime(fetched_at, '%Y-%m-%d'),'') = '' or strftime(fetched_at, '%Y-%m-%d') >= strftime(date '{AS_OF}' - case when category = '세무' then 400 else 200 end * interval 1 day, '%Y-%m-%d')")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency with a window a category."""
    a = table(spark, sf_dir, "articles")
    return a.where(rules.recent(F.date_format("fetched_at", "yyyy-MM-dd"), F.col("category"), AS_OF, {"세무": 400}, 200)).select("article_id")


@query("select article_id from articles where len(list_filter(regexp_split_to_array(translate(coalesce(title,''), ',…', '  '), '\\s+'), lambda t: length(t) >= 3 and (ends_with(t,'업계') or ends_with(t,'벤처')))) > 0")
def token_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by ending and length."""
    return table(spark, sf_dir, "articles").where(rules.ends_token(F.col("title"), ["업계", "벤처"], 3)).select("article_id")


@query("select posting_id from (select posting_id, row_number() over (partition by url order by posting_id) n from postings where url <> '') where n = 1")
def first_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each url."""
    return dedup.first_by(table(spark, sf_dir, "postings").where("url <> ''"), ["url"], "posting_id").select("posting_id")


@query(
    "with recursive k as (select article_id, row_number() over (order by article_id) i, case when url <> '' then dense_rank() over (order by url) end u, case when title <> '' then dense_rank() over (order by lower(title)) end t from articles), "
    "walk(i, us, ts, kept) as (select 0::bigint, []::bigint[], []::bigint[], null::bigint union all select k.i, case when ok then list_append(w.us, k.u) else w.us end, case when ok then list_append(w.ts, k.t) else w.ts end, case when ok then k.article_id end "
    "from walk w join (select * from k) k on k.i = w.i + 1, lateral (select not (coalesce(list_contains(w.us, k.u), false) or coalesce(list_contains(w.ts, k.t), false)) ok) o) select kept as article_id from walk where kept is not null"
)
def greedy_two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy scan that drops rows whose url or title was kept before."""
    p = table(spark, sf_dir, "articles").select("article_id", "url", F.lower("title").alias("title"))
    return dedup.greedy_keys(p, ["url", "title"], "article_id").select("article_id")


def _near_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles").withColumn("signature", F.array_sort(s.title_signature(F.col("title")))).where(F.size("signature") > 0)
    return a.groupBy("signature").agg(F.min("article_id").alias("id"))


@query(
    "with r as (select list_sort(" + _sig_sql("title") + ") sig, min(article_id) id from articles group by 1 having len(sig) > 0), t as (select id, len(sig) n, unnest(sig) tok from r) select a.id as lo, b.id as hi, count(*) as shared from t a join t b on a.tok = b.tok and a.id < b.id group by a.id, b.id, a.n, b.n having count(*) >= 0.8 * (a.n + b.n - count(*))"
)
def near_title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representatives of equal token sets with Jaccard of at least 0.8."""
    return dedup.prefix_pairs(_near_articles(spark, sf_dir), "id", "signature", 0.8).select("lo", "hi", F.col("shared").cast("long").alias("shared"))


@query(
    "with v as (select vec_id, label, embedding from embeddings), e as (select a.vec_id lo, b.vec_id hi from v a join v b on a.vec_id < b.vec_id and a.label = b.label where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.25) select lo, hi from e"
)
def cosine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one label whose vectors reach a cosine, compared in blocks of rows."""
    v = table(spark, sf_dir, "embeddings")
    return vectors.block_edges(v, "vec_id", "embedding", "label", 0.25).select("lo", "hi")


@query(
    "with recursive v as (select vec_id, label, embedding from embeddings), e as (select a.vec_id lo, b.vec_id hi from v a join v b on a.vec_id <> b.vec_id and a.label = b.label where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.3), "
    "r as (select vec_id id, vec_id low from v union select e.hi, r.low from r join e on e.lo = r.id) select id, min(low) as component from r group by id"
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-link merge: components of the similarity edges."""
    v = table(spark, sf_dir, "embeddings")
    return dedup.components(v.select(F.col("vec_id").alias("id")), vectors.block_edges(v, "vec_id", "embedding", "label", 0.3))


_PROTO = "p as (select label, list(x order by i) as prototype from (select label, i, avg(x) x from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings) group by 1, 2) group by 1), c as (select v.vec_id, p.label, list_cosine_similarity(v.embedding::double[], p.prototype) sim from embeddings v, p)"


@query(
    f"with {_PROTO}, b as (select vec_id, arg_max(label, sim) best, max(sim) top from c group by 1) select v.vec_id, v.label, case when b.best <> v.label and b.top - c.sim > 0.05 then b.best else v.label end as new_label from embeddings v join b using (vec_id) join c on c.vec_id = v.vec_id and c.label = v.label"
)
def category_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels reassigned where another prototype leads by a margin."""
    v = table(spark, sf_dir, "embeddings")
    scores = vectors.similarities(v, "vec_id", "embedding", vectors.prototypes(v, "label", "embedding"))
    return vectors.reassign(scores, "vec_id", v.select("vec_id", "label"), 0.05)


@query("select label, quantile_disc_p5 as p5, p50, p95 from (select label, list_sort(list(v)) l, count(*) n, l[(round_even(0.05*(n-1),0))::int+1] quantile_disc_p5, l[(round_even(0.5*(n-1),0))::int+1] p50, l[(round_even(0.95*(n-1),0))::int+1] p95 from (select event_type label, value v from events) group by label)")
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by nearest rank, half to even."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.col("value").alias("v"))
    return facets.nearest_rank(e, ["label"], "v", [5, 50, 95])


@query("select f as floor, (select count(*) from events where value < f) as below from (select unnest([5.0, 10.0, 20.0, 40.0])::double f)")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts below several floors in one pass."""
    return facets.below(table(spark, sf_dir, "events"), "value", [5.0, 10.0, 20.0, 40.0])


@query("select source, count(*) as total, count(*) filter (where coalesce(title,'') = '') as untitled, count(*) filter (where coalesce(url,'') = '') as no_url, count(*) filter (where coalesce(deadline,'') = '') as standing from postings group by 1")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that meet conditions, a source."""
    blank = lambda c: s.text(F.col(c)) == ""
    return facets.conditional(table(spark, sf_dir, "postings"), ["source"], untitled=blank("title"), no_url=blank("url"), standing=blank("deadline"))


@query("with l(place, label) as (values (0,'정규직'),(1,'계약직'),(2,'인턴'),(3,'없는 값')) select place::int as place, l.label, count(p.posting_id) as n from l left join postings p on p.emp_type = l.label group by 1, 2")
def facet_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of declared labels, zeros included."""
    return facets.facet(table(spark, sf_dir, "postings"), "emp_type", ["정규직", "계약직", "인턴", "없는 값"])


@query("select article_id from (select article_id, row_number() over (partition by category, strftime(fetched_at,'%Y-%m-%d') order by fetched_at desc, article_id) n from articles) where n <= 2")
def cap_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows of each category and day, newest first."""
    a = table(spark, sf_dir, "articles").withColumn("day", F.date_format("fetched_at", "yyyy-MM-dd"))
    return ranking.cap(a, ["category", "day"], [F.desc("fetched_at"), F.col("article_id")], 2).select("article_id")


@query("select posting_id, posted_date from postings order by posted_date desc nulls last, posting_id limit 25")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest rows."""
    return ranking.top(table(spark, sf_dir, "postings"), [F.desc_nulls_last("posted_date"), F.col("posting_id")], 25).select("posting_id", "posted_date")


@query("select source, day, n, lag(n) over (partition by source order by day) as before from (select source, strftime(scraped_at, '%Y-%m-%d') as day, count(*) as n from postings group by 1, 2)")
def previous_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's count beside the day before."""
    return ranking.previous(counts_by_day(spark, sf_dir), ["source"], "day", "n", "before")


@query(
    "with recursive d as (select strftime(fetched_at, '%Y-%m-%d') as day, list({'id': article_id, 'k': coalesce(category,'')} order by article_id) l from articles group by 1), "
    "walk(day, l, last, run, id, place) as (select day, l, null::varchar, 0, null::bigint, -1 from d union all select day, list_filter(l, lambda x: x.id <> p.id), p.k, case when p.k = last then run + 1 else 1 end, p.id, place + 1 from "
    "(select *, case when run >= 2 and l[1].k = last then coalesce(list_filter(l, lambda x: x.k <> last)[1], l[1]) else l[1] end p from walk where len(l) > 0)) "
    "select day, id as article_id, place::int as place from walk where id is not null"
)
def category_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a day's articles reordered so that no category runs long."""
    a = table(spark, sf_dir, "articles").select("article_id", F.date_format("fetched_at", "yyyy-MM-dd").alias("day"), s.text(F.col("category")).alias("category"))
    return ranking.spread(a, "day", "category", "article_id").select("day", "article_id", "place")


@query(
    "with recursive r as (select concat_ws(' ', source, strftime(fetched_at, '%Y-%m-%d')) list, row_number() over (partition by source, strftime(fetched_at, '%Y-%m-%d') order by article_id) i, length(coalesce(title,'')) n from articles), "
    "walk(list, i, n, message, size) as (select list, i, n, 0, 10 + n + 2 from r where i = 1 union all select r.list, r.i, r.n, case when w.size + r.n + 2 <= 600 then w.message else w.message + 1 end, case when w.size + r.n + 2 <= 600 then w.size else 10 end + r.n + 2 from walk w join r on r.list = w.list and r.i = w.i + 1) "
    "select list, message::int as message, count(*)::int as lines, (8 + case when message > 0 then 3 + length((message + 1)::varchar) else 0 end + sum(n + 2))::int as size from walk group by list, message"
)
def digest_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of a source and day packed into messages of bounded size."""
    a = table(spark, sf_dir, "articles").select(F.concat_ws(" ", "source", F.date_format("fetched_at", "yyyy-MM-dd")).alias("list"), "article_id", s.text(F.col("title")).alias("line"))
    return ranking.pack(a, "list", "line", ["article_id"], 600, "Articles").select("list", "message", "lines", F.length("text").alias("size"))


@query(
    "select source, day, (case when h >= 2147483648 then abs(h - 4294967296) else h end) % 7 as pick from (select source, day, list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split(day || '|' || source, ''), lambda x: ascii(x)::hugeint)), lambda h, x: (xor(h::bigint, x::bigint)::hugeint * 16777619) % 4294967296)::bigint h from (select s.source, d.day from sources s, (select unnest(['2026-1-1','2026-1-2','2026-11-30']) as day) d))"
)
def daily_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pick that changes by day and label."""
    days = F.explode(F.array(*[F.lit(d) for d in ("2026-1-1", "2026-1-2", "2026-11-30")]))
    return table(spark, sf_dir, "sources").select("source", days.alias("day")).withColumn("pick", s.daily_index(F.col("day"), F.col("source"), F.lit(7)))


_UP = "with b as (select * from state_snapshots where uid is not null), d as (select max(snapshot_date) m from b), old as (select uid, arg_max(first_seen, (delivered_at, snap_row_id)) first_seen, coalesce(arg_max(deadline, (delivered_at, snap_row_id)) filter (where deadline <> ''), '') deadline, coalesce(arg_max(posted_date, (delivered_at, snap_row_id)) filter (where posted_date <> ''), '') posted_date from b, d where snapshot_date < m group by uid), new as (select uid, coalesce(arg_max(deadline, (delivered_at, snap_row_id)) filter (where deadline <> ''), '') deadline, coalesce(arg_max(posted_date, (delivered_at, snap_row_id)) filter (where posted_date <> ''), '') posted_date from b, d where snapshot_date = m group by uid)"


@query("select uid, max(snapshot_date) as day, count(*) as rows from state_snapshots where not notified and (coalesce(deadline,'') = '' or deadline >= '2026-05-04') group by uid order by min(first_seen), uid limit 25")
def notify_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open rows not notified, oldest first: a top-k."""
    rows = table(spark, sf_dir, "state_snapshots").where(~F.col("notified") & s.is_open(F.col("deadline"), F.lit("2026-05-04")))
    per = rows.groupBy("uid").agg(F.max("snapshot_date").alias("day"), F.count("*").alias("rows"), F.min("first_seen").alias("first_seen"), F.lit(False).alias("notified"), F.lit("").alias("deadline"))
    return state.targets(per, "2026-05-04", 25, "uid").select("uid", "day", "rows")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that aren't present."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return state.remove(table(spark, sf_dir, "customer"), orders, "c_custkey").select("c_custkey")


@query("select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')")
def present_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are present."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.keep_cached(table(spark, sf_dir, "orders"), returned, "o_orderkey").select("o_orderkey")


@query("select user_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n = 1")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key by partial aggregation."""
    e = table(spark, sf_dir, "events").withColumn("ord", F.struct("ts", "event_id"))
    return joining.latest_by(e, "user_id", "ord", ["event_type", "value"])


@query("select c.c_custkey, t.scope, n.n_nationkey from customer c left join (select c_custkey, unnest(list_filter([case when c_acctbal > 5000 then 'rich' end, case when c_mktsegment = 'BUILDING' then 'build' end, 'all'], lambda x: x is not null)) as scope from customer) t using (c_custkey) left join (select n_nationkey, case n_regionkey when 0 then 'rich' when 1 then 'build' else 'none' end scope from nation) n on n.scope = t.scope")
def scope_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the subscribers whose scope takes them."""
    subscribers = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") == 0, "rich").when(F.col("n_regionkey") == 1, "build").otherwise("none").alias("scope"))
    scopes = {"rich": F.col("c_acctbal") > 5000, "build": F.col("c_mktsegment") == "BUILDING", "all": F.lit(True)}
    return joining.fan_out(table(spark, sf_dir, "customer"), subscribers, scopes, "c_custkey").select("c_custkey", "scope", "n_nationkey")


@query("select user_id, count(*) as relevant, count(*) filter (where event_type = 'view') as ok, count(*) filter (where event_type = 'error') as transient, (count(*) filter (where event_type = 'view') > 0 or count(*) filter (where event_type = 'error') = 0) as delivered from events group by 1")
def delivery_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each item counts as delivered."""
    result = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "error", "fail").otherwise("gone")
    return joining.outcome(table(spark, sf_dir, "events").withColumn("result", result), "user_id", 1)


@query(
    "with n as (select source, count(*) c from postings where scraped_at >= (select max(scraped_at) - interval 30 day from postings) group by 1), b as (select source, count(*) c from postings where scraped_at < (select max(scraped_at) - interval 30 day from postings) group by 1), j as (select coalesce(n.source,b.source) source, coalesce(n.c,0) now, coalesce(b.c,0) before from n full join b on n.source=b.source) "
    "select source, now, before, concat_ws(',', case when now = 0 and before > 0 then 'gone' end, case when before >= 3 and now > 0 and now <= before * 0.4 then 'dropped' end) as alerts from j"
)
def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of this run against the last, with alerts."""
    p = table(spark, sf_dir, "postings").select("source", "scraped_at")
    cut = p.agg((F.max("scraped_at") - F.expr("interval 30 days")).alias("cut"))
    marked = p.join(F.broadcast(cut), F.lit(True))  # one row
    count = lambda c: marked.where(c).groupBy("source").agg(F.count("*").alias("n"))
    both = joining.compare(count("scraped_at >= cut"), count("scraped_at < cut"), "source", "n")
    return monitor.drift(both).select("source", F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("before", F.lit(0)).alias("before"), F.concat_ws(",", "alerts").alias("alerts"))


@query("select source, floor(date_diff('second', max(scraped_at), timestamp '2028-06-01 00:00:00') / 60.0)::bigint as age, 260::int as threshold, date_diff('second', max(scraped_at), timestamp '2028-06-01 00:00:00') / 60.0 > 260 as stale from postings group by 1")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of each stream's last row against its threshold."""
    last = table(spark, sf_dir, "postings").groupBy("source").agg(F.max("scraped_at").alias("last"))
    return monitor.staleness(last, F.lit(120), F.lit("2028-06-01 00:00:00").cast("timestamp")).select("source", "age", "threshold", "stale")


@query("select source, count(*) as total, count(*) filter (where posted_date = '2026-05-04') as today, not (count(*) >= 8 and (count(*) filter (where posted_date = '2026-05-04') >= count(*) or count(*) filter (where posted_date = '2026-05-04') / count(*) > 0.8)) as plausible from postings group by 1")
def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of today's rows of each source."""
    return monitor.share_of_day(table(spark, sf_dir, "postings"), ["source"], F.col("posted_date"), "2026-05-04")


@query("select s.source, coalesce(p.n, 0) as held, coalesce(a.n, 0) as shown, not (coalesce(p.n,0) > 0 and coalesce(a.n,0) = 0) as ok from (select source from postings union select source from articles) s left join (select source, count(*) n from postings group by 1) p using (source) left join (select source, count(*) n from articles group by 1) a using (source)")
def shown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that hold rows but show none."""
    n = lambda t: table(spark, sf_dir, t).groupBy("source").agg(F.count("*").alias("n"))
    return monitor.shown(n("postings"), n("articles"), "source")


@query("select user_id, case when count(*) filter (where event_type = 'error') = 0 then 'ok' when count(*) filter (where event_type = 'error' and value >= 10) = 0 then 'recoverable' else 'code' end as status from events group by 1")
def failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each group's failed checks."""
    checks = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") != "error").alias("ok"), (F.col("value") < 10).alias("recoverable"))
    return monitor.failure_class(checks, ["user_id"])


@query("select p.source, count(*) as n, true as ok from postings p group by 1 union all select source, 0, false from sources where source not in (select source from postings)")
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a source, zero for those that gave none."""
    return readers.source_report(table(spark, sf_dir, "postings"), table(spark, sf_dir, "sources"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events where props like '{%'")
def json_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of JSON text."""
    e = table(spark, sf_dir, "events").withColumn("j", s.json_object(F.col("props"))).where("j is not null")
    return e.select("event_id", F.get_json_object("j", "$.k").try_cast("long").alias("k"))


@query()
def article_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, recency, dedup, near-duplicate leaders and cap."""
    out = pipelines.articles(table(spark, sf_dir, "articles"), "article_id", "2028-01-01", {**pipelines.RULES, "default_days": 2000, "days": {}})
    return out.select("article_id", "label", "day", F.coalesce(F.size("dupes"), F.lit(0)).alias("dupes"))


@query(
    "with l as (select uid, arg_max(posting_id, (scraped_at, posting_id)) posting_id from postings group by uid), "
    f"k as (select p.*, lower(trim(regexp_replace(coalesce(p.company,''), '{_WS}', ' ', 'g'))) firm, lower(regexp_replace(regexp_replace(coalesce(p.title,''), '^\\s*\\[[^\\]]*\\]', ''), '[\\s\\[\\]()·,./-]', '', 'g')) n from postings p join l using (posting_id)), "
    "o as (select * from (select *, row_number() over (partition by firm, n order by case when starts_with(source,'ats_') then 0 else 1 end, posting_id) rn from k where firm <> '' and n <> '') where rn = 1 union all select *, 1 from k where firm = '' or n = ''), "
    "j as (select *, lower(coalesce(title,'') || ' ' || coalesce(category,'')) hay, lower(coalesce(nullif(emp_type,''), coalesce(category,''))) kind, case when regexp_full_match(coalesce(deadline,''), '\\d{4}-\\d{2}-\\d{2}') then deadline else '' end d from o), "
    f"q as (select posting_id, lower(coalesce(title,'') || ' ' || coalesce(company,'')) words, case when regexp_matches(hay, 'm&a|딜자문') then 'deal' when regexp_matches(hay, '세무|tax') then 'tax' when contains(hay, '감사') or contains(hay, 'audit') then 'audit' else 'other' end as label, "
    "case when contains(kind, '인턴') then 'intern' when regexp_matches(kind, '계약|기간제') then 'contract' when regexp_matches(kind, '파트|시간제') then 'part' else 'regular' end as emp_kind, "
    f"date_diff('day', date '{AS_OF}', try_cast(nullif(d,'') as date))::int dday, d = '' or d >= '{AS_OF}' as open from j) select posting_id, label, emp_kind, dday from q where open and dday is not null and label in ('tax','audit') and contains(words, '수습')"
)
def posting_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest rows, cross-source dedup, labels and status, queried for open ones."""
    jobs = pipelines.postings(table(spark, sf_dir, "postings"), "posting_id", AS_OF)
    return pipelines.jobs_query(jobs, "posting_id", {"label": ["tax", "audit"]}, "open", "수습").select("posting_id", "label", "emp_kind", "dday")


@query("select posting_id, coalesce(company,'') || ': ' || coalesce(title,'') || ' (' || coalesce(deadline,'') || ')' as message from postings")
def message_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message template compiled to one expression."""
    p = table(spark, sf_dir, "postings")
    return p.select("posting_id", s.template("{company}: {title} ({deadline})", ["company", "title", "deadline"]).alias("message"))


@query("select posting_id, case when posting_id in (select listing_id from board_listings) then true else false end as manual, case when posting_id in (select listing_id from board_listings) then 'listed' else source end as tag from postings")
def flag_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns set where a key is listed."""
    p = table(spark, sf_dir, "postings").select("posting_id", F.lit(False).alias("manual"), F.col("source").alias("tag"))
    listed = table(spark, sf_dir, "board_listings").select(F.col("listing_id").alias("posting_id"))
    return state.mark(p, listed, "posting_id", manual=F.lit(True), tag=F.lit("listed"))


@query("select uid, count(*) as n from state_snapshots where not notified and deadline <> '' and deadline < '2026-05-04' group by uid")
def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that expired before they were notified."""
    return state.suppressed(table(spark, sf_dir, "state_snapshots"), "2026-05-04").groupBy("uid").agg(F.count("*").alias("n"))


@query(
    "with r as (select category, list_sort(" + _sig_sql("title") + ") sig, min(article_id) id from articles where category is not null group by 1, 2), t as (select category, id, unnest(sig) tok from r) select a.id as lo, b.id as hi, count(*) as shared from t a join t b on a.tok = b.tok and a.category = b.category and a.id < b.id group by 1, 2 having count(*) >= 6"
)
def token_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of titles of one category that share at least six tokens, between representatives of equal token sets."""
    a = table(spark, sf_dir, "articles").where("category is not null").withColumn("signature", F.array_sort(s.title_signature(F.col("title"))))
    return dedup.token_pairs(dedup.representatives(a, "article_id", ["category", "signature"]), "id", "signature", "category", 6)


@query("select vec_id from embeddings where vec_id not in (select vec_id from embeddings where label < 5)")
def vectors_to_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that aren't in the vector cache yet."""
    v = table(spark, sf_dir, "embeddings")
    return vectors.missing(v, v.where("label < 5"), "vec_id").select("vec_id")


@query("select posting_id, source from postings order by case source when 'ats_gadam' then 0 when 'brd_cpa' then 1 else 2 end, coalesce(nullif(deadline,''), '9999-99-99'), posting_id limit 50")
def digest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort by a list of sources, then deadline: a top-k."""
    order = [ranking.by_list(F.col("source"), ["ats_gadam", "brd_cpa"]), F.coalesce(F.nullif(F.col("deadline"), F.lit("")), F.lit("9999-99-99")), F.col("posting_id")]
    return ranking.top(table(spark, sf_dir, "postings"), order, 50).select("posting_id", "source")


@query("select vec_id, label from (select vec_id, label, row_number() over (partition by label order by vec_id desc) n from embeddings) where n <= 3")
def cap_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows of each group."""
    return ranking.cap(table(spark, sf_dir, "embeddings"), ["label"], [F.desc("vec_id")], 3).select("vec_id", "label")


@query("select event_type, case when m is null then '-' when round_even(m,0) < 60 then round_even(m,0)::bigint || ' min' else (round_even(m,0)::bigint // 60) || ' h ' || (round_even(m,0)::bigint % 60) || ' min' end as age from (select event_type, date_diff('second', max(ts), timestamp '2024-02-01 00:00:30') / 60.0 m from events group by 1)")
def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages as text, rounded half to even."""
    last = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("t"))
    age = (F.unix_timestamp(F.lit("2024-02-01 00:00:30").cast("timestamp")) - F.unix_timestamp("t")) / 60
    return last.select("event_type", s.minutes_label(age).alias("age"))


@query(f"select article_id, min(article_id) over (partition by category, sig) as id from (select article_id, category, list_sort({_sig_sql('title')}) sig from articles where category is not null)")
def token_overlap_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article of a category with the representative that stands for it in token_overlap_pairs."""
    a = table(spark, sf_dir, "articles").where("category is not null").withColumn("signature", F.array_sort(s.title_signature(F.col("title"))))
    return dedup.members(a, "article_id", ["category", "signature"])


@query(f"select article_id, min(article_id) over (partition by sig) as id from (select article_id, list_sort({_sig_sql('title')}) sig from articles) where len(sig) > 0")
def near_title_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with tokens with the representative that stands for it in near_title_pairs."""
    a = table(spark, sf_dir, "articles").withColumn("signature", F.array_sort(s.title_signature(F.col("title"))))
    return dedup.members(a.where(F.size("signature") > 0), "article_id", ["signature"])


_WIDE = "translate({}, '０１２３４５６７８９', '0123456789')"
_DAY = r"(\d{4})\s*[-./년]\s*(\d{1,2})\s*[-./월]\s*(\d{1,2})"
_ISO = f"regexp_extract(x, '{_DAY}', 1) || '-' || lpad(regexp_extract(x, '{_DAY}', 2), 2, '0') || '-' || lpad(regexp_extract(x, '{_DAY}', 3), 2, '0')"


@query(
    f"with p as (select posting_id, {_WIDE.format("coalesce(body_excerpt,'') || ' ' || coalesce(deadline,'') || ' ' || coalesce(posted_date,'')")} as t from postings), "
    f"d as (select posting_id, list_filter(list_transform(regexp_extract_all(t, '{_DAY}'), lambda x: {_ISO}), lambda y: try_cast(y as date) is not null and y >= '0001') as l from p) "
    "select posting_id, coalesce(array_to_string(l, ','), '') as dates from d"
)
def all_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dates of every posting's texts, whatever their style; empty where there is none."""
    t = F.concat_ws(" ", s.text(F.col("body_excerpt")), s.text(F.col("deadline")), s.text(F.col("posted_date")))
    return table(spark, sf_dir, "postings").select("posting_id", F.concat_ws(",", s.iso_dates(t)).alias("dates"))


_MAIL = r"^(\d{1,2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (\d{4}) (\d{2}:\d{2}:\d{2}) (GMT|UTC|[+-]\d{4})$"


@query(
    "with a as (select article_id, regexp_replace(coalesce(published_at,''), '^[A-Za-z]{3},\\s*', '') t from articles), "
    f"g as (select article_id, t, regexp_extract(t, '{_MAIL}', 5) z, try_strptime(regexp_extract(t, '{_MAIL}', 1) || ' ' || regexp_extract(t, '{_MAIL}', 2) || ' ' || regexp_extract(t, '{_MAIL}', 3) || ' ' || regexp_extract(t, '{_MAIL}', 4), '%d %b %Y %H:%M:%S') w from a) "
    "select article_id, coalesce(strftime(case when z in ('GMT','UTC') then w when z <> '' then w - (case when z[1] = '-' then -1 else 1 end) * (to_hours(try_cast(z[2:3] as int)) + to_minutes(try_cast(z[4:5] as int))) end, '%Y-%m-%dT%H:%M:%S'), '') as utc from g"
)
def rfc822(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail dates of every article in UTC, numeric offsets too; empty where the text is no mail date."""
    return table(spark, sf_dir, "articles").select("article_id", s.rfc822_utc(F.col("published_at")).alias("utc"))


@query(
    f"select posting_id, case when dday is null then 'always' when dday < 0 then 'closed' when dday = 0 then 'today' else 'D-' || dday end as label from "
    f"(select posting_id, case when regexp_full_match(coalesce(deadline,''), '\\d{{4}}-\\d{{2}}-\\d{{2}}') then date_diff('day', date '{AS_OF}', try_cast(deadline as date)) end dday from postings)"
)
def dday_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of days left of every posting; a deadline that is no yyyy-mm-dd date has no end."""
    left = s.days_left(s.text(F.col("deadline")), F.lit(AS_OF))
    return table(spark, sf_dir, "postings").select("posting_id", s.days_label(left).alias("label"))


_NOW = "2026-05-04T00:00:00"


@query(
    f"with t as (select uid, snapshot_date, posted_date, coalesce(first_seen,'') f, regexp_replace(trim(regexp_replace(coalesce(first_seen,''), '{_WS}', ' ', 'g')), '^(\\d{{4}}-\\d{{2}}-\\d{{2}}) ', '\\1T') x from state_snapshots) "
    "select uid, snapshot_date, f >= '2026-05-03T00:00:00' and coalesce(case when regexp_full_match(coalesce(posted_date,''), '\\d{4}-\\d{2}-\\d{2}') then date_diff('day', try_cast(posted_date as date), date '2026-05-04') end <= 2, true) as is_new, "
    f"coalesce(epoch_us(timestamp '{_NOW}') - epoch_us(try_cast(x as timestamp)) <= 3 * 86400000000, false) as fresh from t"
)
def newness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New within a day and posted within two, and fresh within three days, of every row."""
    now = F.lit(_NOW).cast("timestamp")
    t = table(spark, sf_dir, "state_snapshots")
    return t.select("uid", "snapshot_date", s.is_new(F.col("first_seen"), now, 24, F.col("posted_date"), 2).alias("is_new"), s.within_days(F.col("first_seen"), now, 3).alias("fresh"))


@query(
    "with k as (select *, lower(regexp_replace(regexp_replace(coalesce(title,''), '^\\s*\\[[^\\]]*\\]', ''), '[\\s\\[\\]()·,./-]', '', 'g')) n from postings), "
    "r as (select *, row_number() over (partition by company, n order by case when starts_with(source,'ats_') then 0 else 1 end, posting_id) rn, min(posting_id) over (partition by company, n) place from k where n <> '' and company <> '') "
    "select posting_id, place from r where rn = 1 union all select posting_id, posting_id as place from k where n = '' or coalesce(company,'') = ''"
)
def prefer_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-source dedup that prefers some sources and keeps the group's place; rows without firm or title are never merged."""
    p = table(spark, sf_dir, "postings").select("posting_id", "source", "company", s.compact_title(F.col("title")).alias("n"))
    return dedup.prefer(p, ["company", "n"], F.col("source").startswith("ats_"), "posting_id").select("posting_id", "place")


@query(f"select article_id, len(list_intersect(a, b))::int as both, len(list_distinct(list_concat(a, b)))::int as either from (select article_id, {_sig_sql('title')} a, {_sig_sql('summary')} b from articles)")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and union of the token sets of every article's title and summary."""
    a, b = s.title_signature(F.col("title")), s.title_signature(F.col("summary"))
    return table(spark, sf_dir, "articles").select("article_id", F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("either"))


@query(
    "with l as (select trust_rank as place, source_label as label from sources), r as (select source_label, article_id, row_number() over (partition by source_label order by article_id) n from articles where source_label is not null) "
    "select place::int as place, label, list(article_id order by article_id) filter (where article_id is not null) as ids from l left join r on r.source_label = l.label and n <= 4 group by 1, 2"
)
def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First articles of each label of the sources, empty labels kept."""
    declared = table(spark, sf_dir, "sources").select(F.col("trust_rank").alias("place"), F.col("source_label").alias("label"))
    return facets.boxes(table(spark, sf_dir, "articles"), declared, "source_label", "article_id", 4)


@query(
    "with f as (select article_id, source_label, row_number() over (partition by url order by article_id) n from articles), g as (select article_id, row_number() over (partition by source_label order by article_id) k from f where n = 1) select article_id from g where k <= 12"
)
def insights_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First article of each url, at most twelve a source label."""
    return pipelines.insights(table(spark, sf_dir, "articles"), "article_id", 12).select("article_id")


@query(
    "select article_id, case when l <> '' and ends_with(t, '- ' || l) then trim(substr(t, 1, length(t) - length(l) - 2), ' ') else t end as title from "
    "(select article_id, coalesce(source_label,'') l, coalesce(title,'') || ' - ' || coalesce(source_label,'') t from articles)"
)
def source_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as feeds give them, without the source's name at their end."""
    label = s.text(F.col("source_label"))
    given = F.concat(s.text(F.col("title")), F.lit(" - "), label)
    return table(spark, sf_dir, "articles").select("article_id", s.strip_source_tail(given, label).alias("title"))


@query(
    "with a as (select posting_id, coalesce(url,'') u, case when contains(coalesce(url,''), 'ats-') and not contains(coalesce(title,''), ' (ATS)') then coalesce(title,'') || ' (ATS)' else coalesce(title,'') end t from postings) "
    "select posting_id, case when contains(u, 'view') and not contains(t, ' (view)') then t || ' (view)' else t end as title from a"
)
def title_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixes for titles whose url matches a rule; a rule without a suffix is skipped."""
    rules_ = [("ats-", " (ATS)"), ("", " (x)"), ("view", " (view)"), ("y", "")]
    return table(spark, sf_dir, "postings").select("posting_id", s.title_suffix(s.text(F.col("title")), F.col("url"), rules_).alias("title"))


@query("select count(*) as total, count(*) filter (where regexp_matches(lower(title), '경력|remote') and not coalesce(source = 'brd_susup', false)) as leaked from postings")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows hold words a filter should have kept out, sources let through aside."""
    return monitor.leaks(table(spark, sf_dir, "postings"), F.col("title"), F.col("source"), ["경력", "remote"], ["brd_susup"])


@query("select source, strftime(scraped_at, '%Y-%m-%d') as day, count(*) as n from postings group by 1, 2")
def counts_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by source and day."""
    return facets.count_by(table(spark, sf_dir, "postings"), "source", F.date_format("scraped_at", "yyyy-MM-dd").alias("day"))


@query(
    "with k as (select uid, arg_max(company, (scraped_at, posting_id)) filter (where coalesce(company,'') <> '') company, arg_max(deadline, (scraped_at, posting_id)) filter (where coalesce(deadline,'') <> '') deadline from postings group by uid) "
    "select posting_id, coalesce(nullif(p.company,''), k.company, '') as company, coalesce(nullif(p.deadline,''), k.deadline, '') as deadline from postings p left join k using (uid)"
)
def hydrate_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank firms and deadlines filled from what the same uid last stated."""
    p = table(spark, sf_dir, "postings")
    known = state.last_stated(p.withColumn("ord", F.struct("scraped_at", "posting_id")), "uid", "ord", ["company", "deadline"])
    return joining.hydrate(p, known, "uid", ["company", "deadline"]).select("posting_id", "company", "deadline")


@query("select 'posting' as kind, posting_id as id, source, 0::int as source_ord from postings union all select 'article', article_id, source, 1::int from articles")
def union_all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of sources with their order."""
    of = lambda t, kind, key: table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "source")
    return readers.union_sources([("p", of("postings", "posting", "posting_id")), ("a", of("articles", "article", "article_id"))])


_UP = _UP.replace("select uid, arg_max(first_seen", "select uid, arg_max(last_seen, (delivered_at, snap_row_id)) last_seen, arg_max(first_seen", 1)
_GRACE = "(deadline = '' or deadline >= '2026-05-04') and last_seen >= '2026-04-26' and uid not in (select uid from new)"


def _state_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The state before the last delivery, with first_seen and last_seen as each uid's latest row gives them, and that delivery."""
    rows = table(spark, sf_dir, "state_snapshots").where("uid is not null").withColumn("ord", F.struct("delivered_at", "snap_row_id"))
    both = rows.join(F.broadcast(rows.agg(F.max("snapshot_date").alias("m"))), F.lit(True))  # one row
    before = both.where("snapshot_date < m")
    old = state.last_stated(before, "uid", "ord", ["deadline", "posted_date"])
    seen = joining.latest_by(before, "uid", "ord", ["first_seen", "last_seen"])
    return old.join(seen, "uid").withColumn("notified", F.lit(True)), both.where("snapshot_date = m").select("uid", "deadline", "posted_date", "ord")


@query(
    _UP + f", j as (select coalesce(o.uid, n.uid) uid, o.uid is null unseen, n.uid is not null present, o.first_seen, o.last_seen, o.deadline od, n.deadline nd, o.posted_date op, n.posted_date np from old o full join new n on o.uid = n.uid), k as (select *, unseen or (present and np <> '' and coalesce(first_seen,'') <> '' and substr(first_seen,1,10) < np and np <= '{AS_OF}') fresh from j) "
    f"select uid, coalesce(nullif(nd,''), od, '') as deadline, coalesce(nullif(np,''), op, '') as posted_date, case when fresh then '{AS_OF}T08:00:00' else first_seen end as first_seen, case when present then '{AS_OF}' else last_seen end as last_seen, not fresh as notified, fresh and present as is_new from k"
)
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed upsert with field-wise merge and republish detection; absent rows keep their own last_seen."""
    old, batch = _state_and_batch(spark, sf_dir)
    return state.upsert(old, batch, "uid", "ord", ["deadline", "posted_date"], f"{AS_OF}T08:00:00")


@query(_UP + f" select uid from old where {_GRACE}")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open rows missing from this run, last seen within the grace."""
    old, batch = _state_and_batch(spark, sf_dir)
    return state.carry_forward(old, batch, "uid", "2026-05-04", 8).select("uid")


@query(_UP + f" select uid, 'run' as kind from new union all select uid, 'carried' from old where {_GRACE}")
def kept_and_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the run and those carried forward within the grace."""
    old, batch = _state_and_batch(spark, sf_dir)
    own = batch.select("uid").distinct().withColumn("kind", F.lit("run"))
    return own.unionByName(state.carry_forward(old, batch, "uid", "2026-05-04", 8).select("uid", F.lit("carried").alias("kind")))


@query(_UP + " select uid, deadline from old where deadline = '' or deadline >= '2026-05-04'")
def expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state without rows whose deadline has passed."""
    old, _ = _state_and_batch(spark, sf_dir)
    return state.unexpired(old, "2026-05-04").select("uid", "deadline")


@query("select '{\"count\":' || count(*) || ',\"sources\":[' || string_agg('{\"trust_rank\":' || trust_rank || ',\"source\":\"' || source || '\",\"kind\":\"' || kind || '\"}', ',' order by trust_rank) || ']}' as document from sources")
def json_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document of a page of rows."""
    return sinks.json_document(table(spark, sf_dir, "sources").select("trust_rank", "source", "kind"), "sources", ["trust_rank"], 100)


@query(
    "with b as (select listing_id as posting_id, trim(coalesce(title,''), ' ') t, trim(coalesce(company,''), ' ') c from board_listings), "
    "x as (select *, regexp_replace(c, '\\s+', '', 'g') firm, regexp_matches(t, '^\\[[^\\]]*\\]') bracket, regexp_replace(regexp_extract(t, '^\\[([^\\]]*)\\]', 1), '\\s+', '', 'g') inner_ from b), "
    "y as (select *, case when bracket and (contains(inner_, firm) or contains(firm, inner_)) then regexp_replace(t, '^\\[[^\\]]*\\]\\s*', '') when not bracket and starts_with(regexp_replace(t, '\\s+', '', 'g'), firm) then regexp_replace(substr(t, length(c) + 1), '^[\\s\\-–·:|]+', '') else t end rest from x) "
    "select posting_id, case when firm = '' or trim(rest, ' ') = '' then t else trim(rest, ' ') end as title from y"
)
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without the company in front, bracketed or plain."""
    b = table(spark, sf_dir, "board_listings")
    return b.select(F.col("listing_id").alias("posting_id"), s.display_title(s.text(F.col("title")), F.col("company")).alias("title"))


_SEEN_VECTORS = "(select vec_id, label, case when label <> 7 then embedding end embedding from embeddings)"


@query(
    f"with {_PROTO.replace('from embeddings v', f'from {_SEEN_VECTORS} v').replace(', p)', ', p where v.embedding is not null)')}, g as (select vec_id, arg_max(label, sim) as label, max(sim) s from c group by 1) "
    "select vec_id, label, round(s, 6) as similarity from g where s >= 0.2 union all select vec_id, null, null from embeddings where label = 7"
)
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose best prototype reaches a floor, with that prototype; rows whose vector is missing (label 7) are kept."""
    v = table(spark, sf_dir, "embeddings")
    held = v.withColumn("embedding", F.when(F.col("label") != 7, F.col("embedding")))
    scores = vectors.similarities(held, "vec_id", "embedding", vectors.prototypes(v, "label", "embedding"))
    return vectors.gate(scores, "vec_id", 0.2, held).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


_ISSUE = "count(*) >= 0.8 * (a.n + b.n - count(*)) or (count(*) >= 4 and count(*) >= 0.8 * least(a.n, b.n))"


@query("with r as (select list_sort(" + _sig_sql("title") + ") sig, min(article_id) id from articles group by 1 having len(sig) > 0), t as (select id, len(sig) n, unnest(sig) tok from r) select a.id as lo, b.id as hi, count(*) as shared from t a join t b on a.tok = b.tok and a.id < b.id group by a.id, b.id, a.n, b.n having " + _ISSUE)
def same_issue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representatives of equal token sets that are near or hold most of the shorter one's tokens; members in near_title_members."""
    return dedup.same_issue_pairs(_near_articles(spark, sf_dir), "id", "signature", 0.8, 0.8, 4).select("lo", "hi", F.col("shared").cast("long").alias("shared"))


@query(
    "with recursive r as (select list_sort(" + _sig_sql("title") + ") sig, min(article_id) id from articles group by 1 having len(sig) > 0), t as (select id, len(sig) n, unnest(sig) tok from r), "
    "e as (select a.id lo, b.id hi from t a join t b on a.tok = b.tok and a.id < b.id group by a.id, b.id, a.n, b.n having " + _ISSUE + "), "
    "nodes as (select id, row_number() over (order by id) k from r), adj as (select hi, list(lo order by lo) los from e group by hi), "
    "walk(k, leads) as (select 0::bigint, []::bigint[] union all select n.k, case when len(list_intersect(coalesce(a.los, []), w.leads)) > 0 then w.leads else list_append(w.leads, n.id) end from walk w join nodes n on n.k = w.k + 1 left join adj a on a.hi = n.id), "
    "leaders as (select unnest(leads) id from walk where k = (select max(k) from walk)), "
    "led as (select n.id, case when n.id in (select id from leaders) then n.id else (select min(lo) from e where e.hi = n.id and lo in (select id from leaders)) end leader from nodes n) "
    "select a.article_id, coalesce(l.leader, a.article_id) as leader from (select article_id, list_sort(" + _sig_sql("title") + ") sig from articles) a left join r on r.sig = a.sig left join led l on l.id = r.id"
)
def near_title_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with its greedy leader of one issue."""
    a = table(spark, sf_dir, "articles").withColumn("signature", s.title_signature(F.col("title")))
    return dedup.token_leaders(a, "article_id", "signature", 0.8, 0.8, 4).select(F.col("id").alias("article_id"), "leader")


@query(
    "with recursive a as (select article_id id, category, " + _sig_sql("title") + " sig, embedding v from articles left join embeddings on vec_id = article_id), t as (select id, category, v, unnest(sig) tok from a where category is not null), "
    "e as (select x.id lo, y.id hi from t x join t y on x.tok = y.tok and x.category = y.category and x.id < y.id and x.v is not null and y.v is not null group by x.id, y.id having count(*) >= 2 and list_cosine_similarity(any_value(x.v)::double[], any_value(y.v)::double[]) >= 0.2), "
    "both_ as (select lo, hi from e union all select hi, lo from e), c as (select id, id low from a union select b.hi, c.low from c join both_ b on b.lo = c.id), m as (select id, min(low) low from c group by id) "
    "select low as article_id, array_to_string(list(id order by id) filter (where id <> low), ',') as absorbed from m group by low"
)
def refined_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles merged by category, shared tokens and vectors, with the ids they absorbed in order."""
    a = table(spark, sf_dir, "articles").select("article_id", "category", s.title_signature(F.col("title")).alias("signature"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), "embedding")
    out = vectors.refine(a, "article_id", "category", "signature", v, "embedding", 0.2, 2, ["category"])
    return out.select("article_id", F.when(F.col("dupes").isNotNull(), F.concat_ws(",", F.transform("dupes", lambda d: d["article_id"].cast("string")))).alias("absorbed"))


_GATE = rules.ArticleRules(sources=["Quayside"], noise=["공모"], topics=["법인세", "공시", "배당", "연결재무", "가업승계"], endings=["업계", "벤처"], actions=["철회", "연기"], pairs=[(["심사"], ["착수", "요구"])], kept=["최종"], always=[(["점검"], ["공개"])], scoped={"거래": ["정비"], "세무": ["개편"]}, abroad=["해외"], abroad_sources=["southern"], abroad_names=["남미", "중동"], home=["수도권", "법인세"])


@query(
    "with a as (select article_id, coalesce(title,'') t, lower(coalesce(title,'')) lo, coalesce(source_label,'') l, coalesce(category,'') c, "
    "len(list_filter(regexp_split_to_array(translate(coalesce(title,''), ',…', '  '), '\\s+'), lambda x: length(x) >= 3 and (ends_with(x,'업계') or ends_with(x,'벤처')))) > 0 place from articles) "
    "select article_id from a where not contains(l, 'Quayside') and not contains(t, '공모') and regexp_matches(lo, '법인세|공시|배당|연결재무|가업승계') "
    "and not (not contains(t, '최종') and ((place and regexp_matches(t, '철회|연기')) or (contains(t, '심사') and regexp_matches(t, '착수|요구')))) "
    "and not (contains(t, '점검') and contains(t, '공개')) and not (c = '거래' and contains(t, '정비')) and not (c = '세무' and contains(t, '개편')) "
    "and not (c = '해외' and (contains(lower(l), 'southern') or (regexp_matches(lo, '남미|중동') and not regexp_matches(lo, '수도권|법인세'))))"
)
def article_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of an article gate: sources, noise, topics, acting places, word pairs, one category's noise, what is abroad."""
    a = table(spark, sf_dir, "articles")
    return a.where(rules.article_gate(F.col("title"), F.col("source_label"), F.col("category"), _GATE)).select("article_id")


_FIRM = "lower(coalesce(company,'') || ' ' || coalesce(title,''))"
_KIND = "case when coalesce(emp_type,'') = '' then coalesce(category,'') else emp_type end"
_JOBS_SQL = (
    "with sn as (select uid, arg_max(first_seen, (delivered_at, snap_row_id)) first_seen from state_snapshots group by uid), "
    f"j as (select p.*, coalesce(sn.first_seen,'') fs, {_FIRM} named, lower(coalesce(title,'') || ' ' || coalesce(body_excerpt,'')) body, {_KIND} kind from postings p left join sn using (uid)), "
    "k as (select posting_id, title, company, posted_date, source, fs as first_seen, case when source = 'ats_gadam' then 'gadam' when source = 'ats_bosol' then 'bosol' when regexp_matches(named, '회계법인|accounting') then 'accounting' when regexp_matches(named, '세무법인|세무회계') then 'tax firm' when contains(named, '감사반') then 'local' else 'other' end firm, "
    "case when contains(body, '수습') then 'trainee' when regexp_matches(body, '회계사|세무사|cpa|cta') then 'licensed' else 'any' end qualification, "
    "case when contains(lower(kind), '인턴') then 'intern' when regexp_matches(lower(kind), '계약|기간제') then 'contract' when regexp_matches(lower(kind), '파트|시간제') then 'part' else 'regular' end emp_kind, kind as emp_type, "
    f"case when coalesce(deadline,'') = '' or deadline >= '{AS_OF}' then 'open' else 'closed' end status, case when regexp_full_match(coalesce(deadline,''), '\\d{{4}}-\\d{{2}}-\\d{{2}}') then date_diff('day', date '{AS_OF}', try_cast(deadline as date))::int end dday, "
    "fs >= '2026-04-30T00:00:00' and coalesce(case when regexp_full_match(coalesce(posted_date,''), '\\d{4}-\\d{2}-\\d{2}') then date_diff('day', try_cast(posted_date as date), date '2026-05-01') end <= 2, true) is_new from j) "
)


def _job_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = table(spark, sf_dir, "state_snapshots").where("uid is not null").withColumn("ord", F.struct("delivered_at", "snap_row_id"))
    return pipelines.job_items(table(spark, sf_dir, "postings"), joining.latest_by(snaps, "uid", "ord", ["first_seen"]), "uid", AS_OF, F.lit("2026-05-01T00:00:00").cast("timestamp"))


@query(_JOBS_SQL + "select posting_id, firm, qualification, emp_kind, emp_type, status, dday, first_seen, is_new from k")
def job_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each job card shows."""
    return _job_items(spark, sf_dir).select("posting_id", "firm", "qualification", "emp_kind", "emp_type", "status", "dday", "first_seen", "is_new")


@query(_JOBS_SQL + "select posting_id, row_number() over (order by case when status = 'open' then 0 else 1 end, coalesce(dday, 1000000), posting_id)::int as place, dday from k qualify place <= 100")
def jobs_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open first, soonest first: a top-k of the sort."""
    jobs = _job_items(spark, sf_dir)
    return ranking.placed(jobs, pipelines.sort_jobs(jobs, "posting_id"), 100).select("posting_id", "place", "dday")


@query(_JOBS_SQL + "select posting_id from k where firm in ('accounting','gadam') and qualification = 'trainee' and status = 'open' and dday is not null and contains(lower(coalesce(title,'') || ' ' || coalesce(company,'')), '세무')")
def open_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets, open with a deadline, and a keyword in title or company."""
    return pipelines.jobs_query(_job_items(spark, sf_dir), "posting_id", {"firm": ["accounting", "gadam"], "qualification": ["trainee"], "emp_kind": []}, "open", " 세무 ").select("posting_id")


@query(_JOBS_SQL + "select posting_id from k where status = 'open' and dday is null and is_new")
def standing_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ones without a deadline."""
    return pipelines.jobs_query(_job_items(spark, sf_dir), "posting_id", {}, "standing", only_new=True).select("posting_id")


@query(_JOBS_SQL + "select posting_id, row_number() over (order by coalesce(nullif(posted_date,''), substr(first_seen,1,10)) desc, first_seen desc, posting_id)::int as place from k where status = 'closed' qualify place <= 200")
def posted_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed ones by the day they were posted or first seen, newest first: a top-k of the sort."""
    jobs = pipelines.jobs_query(_job_items(spark, sf_dir), "posting_id", {}, "closed", sort="posted").limit(200)
    return jobs.select("posting_id", (F.row_number().over(Window.orderBy(*pipelines.posted_order(jobs, "posting_id")))).alias("place"))


@query(_JOBS_SQL + ", l(place, label) as (values (0,'accounting'),(1,'tax firm'),(2,'gadam'),(3,'nobody')) select place::int as place, l.label, count(k.posting_id) as n from l left join k on k.firm = l.label and k.status = 'open' and k.dday is not null group by 1, 2")
def open_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of declared firms among the open ones, zeros included."""
    return facets.facet(pipelines.jobs_query(_job_items(spark, sf_dir), "posting_id", {}, "open"), "firm", ["accounting", "tax firm", "gadam", "nobody"])


@query("select posting_id, source_label || ' ' || coalesce(title,'') || ' / ' || coalesce(nullif(company,''),'-') || ' / ' || coalesce(nullif(deadline,''),'always') || case when coalesce(body_excerpt,'') <> '' then chr(10) || '--' || chr(10) || body_excerpt else '' end as message from (select posting_id, coalesce(source_label,'') source_label, title, company, deadline, body_excerpt from postings)")
def message_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with fallbacks and the excerpt under a divider."""
    fallbacks = {"source_label": "", "title": "", "company": "-", "deadline": "always"}
    return table(spark, sf_dir, "postings").select("posting_id", s.message("{source_label} {title} / {company} / {deadline}", fallbacks, F.col("body_excerpt"), "--").alias("message"))


@query("with p as (select posting_id, coalesce(nullif(title,''),'New posting') || ' ' || coalesce(nullif(company,''),'') t, coalesce(nullif(source_label,''),'Jobs') || ' · ' || coalesce(nullif(deadline,''),'always') || ' ' || coalesce(body_excerpt,'') b, coalesce(uid,'') u from postings) select posting_id, substr(t,1,40) as title, substr(b,1,80) as body, case when u = '' then t else u end as tag from p")
def push_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications with fallbacks, cut to their sizes."""
    fallbacks = {"title": "New posting", "company": "", "source_label": "Jobs", "deadline": "always", "body_excerpt": ""}
    each = s.payload("{title} {company}", "{source_label} · {deadline} {body_excerpt}", fallbacks, F.col("uid"), 40, 80)
    return table(spark, sf_dir, "postings").select("posting_id", each.alias("p")).select("posting_id", "p.*")


@query("select posting_id, coalesce(nullif(deadline,''),'always') as deadline from postings")
def deadline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines with a text for those that have none."""
    return table(spark, sf_dir, "postings").select("posting_id", s.stated(F.col("deadline"), "always").alias("deadline"))


@query("select * from (values (0,'deal',0,'feed_deal','a',20),(1,'tax',0,'feed_tax','b',20),(2,'tax',1,'feed_tax_2','c',20),(3,'tax',2,'feed_tax_3','d',20)) v(source_ord, category, pool, source, query, \"limit\")")
def feed_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of categories with one or several query pools."""
    return readers.feed_pools(spark, {"deal": "a", "tax": ["b", "c", "d"]}, "feed_", 20)


@query(
    f"with s as (select source, trust_rank::bigint place, (select count(*) from postings p where p.source = s.source) n from sources s), t as (select count(*) a, count(*) filter (where coalesce(deadline,'') = '' or deadline >= '{AS_OF}') o from postings) "
    "select place, '- ' || source || ': ' || case when n = 0 then 'failed no rows' else n::varchar end as line from s union all select 2147483648, 'passed ' || a || ' (open ' || o || ', closed ' || (a - o) || ')' from t"
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run prints: a line a source, then totals."""
    p = table(spark, sf_dir, "postings")
    found = readers.source_report(p, table(spark, sf_dir, "sources")).join(table(spark, sf_dir, "sources").select("source", F.col("trust_rank").alias("source_ord")), "source")
    return monitor.run_report(found.withColumn("error", F.when(~F.col("ok"), "no rows")), p.select(F.when(s.is_open(F.col("deadline"), F.lit(AS_OF)), "open").otherwise("closed").alias("status")))


@query(
    "with n as (select source, count(*) c from postings group by 1), a as (select source, count(*) c from articles group by 1) "
    "select source, now, before, outside, concat_ws(',', case when now = 0 and before > 0 then 'gone' end, case when before >= 3 and now > 0 and now <= before * 0.4 then 'dropped' end, case when outside >= greatest(now * 1.5, now + 3) then 'outside' end) as alerts from "
    "(select s.source, coalesce(n.c,0) now, coalesce(n.c,0) + trust_rank before, coalesce(a.c,0) + 2 * trust_rank outside from sources s left join n using (source) left join a using (source))"
)
def drift_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run against the last and against a count from outside."""
    n = lambda t, c: facets.count_by(table(spark, sf_dir, t), "source", name=c)
    each = table(spark, sf_dir, "sources").select("source", "trust_rank").join(n("postings", "p"), "source", "left").join(n("articles", "a"), "source", "left")
    now, outside = F.coalesce("p", F.lit(0)), F.coalesce("a", F.lit(0)) + 2 * F.col("trust_rank")
    counts = each.select("source", now.alias("now"), (now + F.col("trust_rank")).alias("before"), outside.alias("outside"))
    return monitor.drift(counts).select("source", "now", "before", "outside", F.concat_ws(",", "alerts").alias("alerts"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; times without a zone are UTC, as the session is."""
    stream = spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, t in stream.dtypes if t == "timestamp_ntz"})


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives over all its input, read to the end."""
    out = new_path(spark, "streamed")
    run = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(out))
    run.option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("select user_id, min(ts) as first, max(ts) as last, count(*) as n from events group by 1")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last and number of events of each user by a keyed streaming aggregate, read to the end of the input."""
    got = _drained(spark, state_stream.running(_stream(spark, sf_dir, "events"), "user_id", "ts"), "update")
    last = joining.latest_by(got, "user_id", "_batch", ["first", "last", "n"])
    return last.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type and day by a windowed streaming count with a watermark, the latest state of each window."""
    got = _drained(spark, state_stream.windowed_counts(_stream(spark, sf_dir, "events"), ["event_type"], "ts", "1 day", "30 days"), "update")
    return got.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "_batch").alias("n"))


@query("select distinct user_id from events")
def stream_seen_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as they are first met in a stream, each once within the watermark."""
    return _drained(spark, state_stream.first_seen(_stream(spark, sf_dir, "events"), "user_id", "ts", "365 days"), "append").select("user_id")


@query(
    "with o as (select uid, coalesce(arg_max(deadline, (delivered_at, snap_row_id)) filter (where coalesce(deadline,'') <> ''), '') deadline, coalesce(arg_max(posted_date, (delivered_at, snap_row_id)) filter (where coalesce(posted_date,'') <> ''), '') posted_date from state_snapshots where uid is not null group by uid) "
    f"select uid, deadline, posted_date, '{AS_OF}T08:00:00' as first_seen, '{AS_OF}' as last_seen, false as notified from o where deadline = '' or deadline >= '{AS_OF}'"
)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polling run over a stream: each batch merged into the versioned state, closed rows dropped."""
    stream = _stream(spark, sf_dir, "state_snapshots").where("uid is not null").withColumn("ord", F.struct("delivered_at", "snap_row_id"))
    schema = "uid string, deadline string, posted_date string, first_seen string, last_seen string, notified boolean"
    kept = sinks.Versioned(spark, new_path(spark, "state"))
    run = state_stream.run_upsert(stream, kept, schema, "uid", "ord", ["deadline", "posted_date"], lambda n: f"{AS_OF}T08:00:00", new_path(spark, "poll"))
    run.awaitTermination()
    return kept.read(schema)
