"""Whole runs: articles, postings, and the interactive query over the output. Rules are data and the clock a parameter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.scalars import compact_title, days_left, haystack, is_new, is_open, squeeze, stated, text, title_signature
from sievework.operators.dedup import greedy_keys, merge_duplicates, prefer, token_leaders
from sievework.operators.ranking import cap
from sievework.operators.rules import contains_any, fallback_label, first_label, recent
from sievework.session import written

# Neutral sample rules over the test tables' vocabulary.
RULES: dict = {
    "labels": {"deal": ["m&a", "딜자문"], "tax": ["세무", "tax"], "audit": ["감사", "audit"]},
    "kinds": {"intern": ["인턴"], "contract": ["계약", "기간제"], "part": ["파트", "시간제"]},
    "noise": ["공모", "광고"],
    "topics": ["법인세", "감사보수", "공시", "내부회계", "지분", "배당"],
    "days": {"deal": 75, "tax": 75},
    "default_days": 120,
    "cap_per_day": 8,
    "jaccard": 0.8,
    "overlap": 0.8,
    "least_shared": 4,
    "firm_by_source": {"ats_gadam": "gadam", "ats_bosol": "bosol"},
    "firms": {"accounting": ["회계법인", "accounting"], "tax firm": ["세무법인", "세무회계"]},
    "local": "local",
    "local_words": ["감사반"],
    "other": "other",
    "qualifications": {"trainee": ["수습"], "licensed": ["회계사", "세무사", "cpa", "cta"]},
    "new_hours": 24,
    "new_posted_days": 2,
}


def articles(rows: DataFrame, order: str, as_of: str, rules: Mapping = RULES) -> DataFrame:
    """Topic gate, recency, greedy url and title dedup, near-duplicate leaders with their copies, newest first, cap a day."""
    clean = rows.withColumns({"title": squeeze(F.col("title")), "day": F.to_date("fetched_at").cast("string")})
    label = first_label(F.lower(F.col("title")), rules["labels"], "other")
    gated = clean.withColumn("label", label).where(contains_any(F.lower(F.col("title")), rules["topics"]) & ~contains_any(F.col("title"), rules["noise"]))
    gated = gated.where(recent(F.col("day"), F.col("label"), as_of, rules["days"], rules["default_days"]))
    keyed = gated.withColumn("title_key", F.lower("title"))
    kept = written(greedy_keys(keyed, ["url", "title_key"], order).drop("title_key"), "articles")
    led = token_leaders(kept.withColumn("signature", title_signature(F.col("title"))), order, "signature", rules["jaccard"], rules["overlap"], rules["least_shared"])
    merged = merge_duplicates(kept, led, order, ["title", "url", "source_label"])
    return cap(merged, ["label", "day"], [F.desc("fetched_at"), F.col(order)], rules["cap_per_day"])


def postings(rows: DataFrame, order: str, as_of: str, rules: Mapping = RULES) -> DataFrame:
    """Latest row of each uid, cross-source dedup by firm and title, labels, status and days left."""
    latest = rows.groupBy("uid").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "uid"]), F.struct("scraped_at", order)).alias("r")).select("uid", "r.*")
    keyed = latest.withColumns({"firm_key": F.lower(squeeze(F.col("company"))), "title_key": compact_title(F.col("title"))})
    one = prefer(keyed, ["firm_key", "title_key"], F.col("source").startswith("ats_"), order)
    day = F.when(text(F.col("deadline")).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("deadline")).otherwise("")
    labelled = one.withColumns(
        {
            "label": first_label(haystack(F.col("title"), F.col("category")), rules["labels"], "other"),
            "emp_kind": first_label(F.lower(F.concat_ws(" ", F.coalesce(F.nullif(text(F.col("emp_type")), F.lit("")), text(F.col("category"))))), rules["kinds"], "regular"),
            "day": day,
        }
    )
    return labelled.withColumns({"dday": days_left(F.col("day"), F.lit(as_of)), "status": F.when(is_open(F.col("day"), F.lit(as_of)), "open").otherwise("closed")}).drop("firm_key", "title_key")


def job_items(rows: DataFrame, seen: DataFrame, key: str, as_of: str, now: Column, rules: Mapping = RULES) -> DataFrame:
    """What a job card shows: firm, qualification, kind, status, days left, first_seen of the state, newness, and the
    category where no kind of employment is stated. seen: key and first_seen, one row a key."""
    known = seen.select(F.col(key).alias("_k"), F.col("first_seen").alias("_f"))
    j = rows.join(known, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("first_seen", text(F.col("_f"))).drop("_f")
    named = haystack(F.col("company"), F.col("title"))
    kind = stated(F.col("emp_type"), "")
    own = {
        "firm": fallback_label(text(F.col("source")), named, rules["firm_by_source"], rules["firms"], rules["local"], rules["local_words"], rules["other"]),
        "qualification": first_label(haystack(F.col("title"), F.col("body_excerpt")), rules["qualifications"], "any"),
        "emp_kind": first_label(F.lower(F.concat_ws(" ", F.when(kind == "", text(F.col("category"))).otherwise(kind))), rules["kinds"], "regular"),
        "emp_type": F.when(kind == "", text(F.col("category"))).otherwise(kind),
        "status": F.when(is_open(F.col("deadline"), F.lit(as_of)), "open").otherwise("closed"),
        "dday": days_left(F.col("deadline"), F.lit(as_of)),
        "is_new": is_new(F.col("first_seen"), now, rules["new_hours"], F.col("posted_date"), rules["new_posted_days"]),
    }
    return j.withColumns(own)


def sort_jobs(df: DataFrame, order: str) -> list[Column]:
    """Open first, soonest deadline first, no deadline last, then the order column."""
    return [F.when(F.col("status") == "open", 0).otherwise(1), F.coalesce("dday", F.lit(1_000_000)), F.col(order)]


def posted_order(df: DataFrame, order: str) -> list[Column]:
    """Newest first by the posted day, else the day first seen; then newest first seen."""
    seen = text(F.col("first_seen")) if "first_seen" in df.columns else F.lit("")
    posted = F.coalesce(F.nullif(text(F.col("posted_date")), F.lit("")), F.substring(seen, 1, 10))
    return [posted.desc(), seen.desc(), F.col(order)]


def jobs_query(jobs: DataFrame, order: str, facets: Mapping[str, Sequence[str]] | None = None, status: str | None = None, keyword: str = "", sort: str = "deadline", only_new: bool = False) -> DataFrame:
    """Facets (any of the values, all facets), status (open: with a deadline; standing: without; closed), keyword in title or company, sort.

    posted: by the posted day, else the day first seen, newest first, then first seen, newest first. ``only_new`` keeps
    what is new.
    """
    out = jobs
    for column, values in (facets or {}).items():
        if values:
            out = out.where(F.col(column).isin(*values))
    if status == "open":
        out = out.where((F.col("status") == "open") & F.col("dday").isNotNull())
    elif status == "standing":
        out = out.where((F.col("status") == "open") & F.col("dday").isNull())
    elif status == "closed":
        out = out.where(F.col("status") == "closed")
    if keyword.strip():
        out = out.where(F.contains(haystack(F.col("title"), F.col("company")), F.lit(keyword.strip().lower())))
    if only_new:
        out = out.where(F.col("is_new"))
    keys = sort_jobs(jobs, order) if sort == "deadline" else posted_order(jobs, order)
    return out.orderBy(*keys)


def insights(rows: DataFrame, order: str, per_label: int) -> DataFrame:
    """First row of each url in order, capped a source label."""
    w = Window.partitionBy("url").orderBy(order)
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return cap(first, ["source_label"], [F.col(order)], per_label)
