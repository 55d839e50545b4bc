"""Best representative of each duplicate group, field by field.

Each usable value of a row becomes a candidate of its group and field with its rank keys; a window over group and field
orders them and keeps the first. ``row_number() = 1`` lets Spark rank inside each map task first, so a group that holds
a third of all rows sends one candidate a task and field.

Defined results: rows without cluster id belong to no group; groups of one row have no result; an unlisted or null source
ranks after all listed ones; null scrape times come last; a null, blank or unusable value is no candidate; equal rows are
told apart by the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.timestamps import interpret, plain_day

LAST = 2147483647
CUT_MARKS = r"(?:\s*(?:…|\.\.\.|\[…\]|\(더보기\)|\(more\)|\[\+?\d+ chars\]))+\s*$"


def text_amount(body: Column) -> Column:
    """Characters of a body that are text: without tags, entities of blanks, blanks and marks of cutting at its end."""
    plain = F.regexp_replace(F.coalesce(body, F.lit("")), r"<[^>]*>|<[^>]*$|&nbsp;|&#160;", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, CUT_MARKS, ""), r"(?U)[\s​]+", "")
    return F.when(plain.rlike(r"[\p{L}\p{N}]"), F.length(plain))


def usable_url(url: Column) -> Column:
    return url.rlike(r"(?i)^\s*https?://(?:[^/?#@\s]*@)?[\p{L}\p{N}\[][^/?#\s]*")


def survivors(sightings: DataFrame, sources: DataFrame) -> DataFrame:
    """cluster_id, field and sighting_id of the row whose value survives, for source, url, deadline and body_excerpt."""
    known = sources.groupBy(F.col("source").alias("_s")).agg(F.min("trust_rank").alias("rank"), F.first("zone").alias("zone"))
    rows = sightings.where(F.col("cluster_id").isNotNull()).select("cluster_id", "sighting_id", "source", "url", F.when(~plain_day(F.col("deadline")), F.col("deadline")).alias("text"), plain_day(F.col("deadline")).alias("plain"), "body_excerpt", "scraped_at")
    rows = interpret(rows.join(known, F.col("source") == F.col("_s"), "left").drop("_s").withColumn("rank", F.coalesce("rank", F.lit(LAST))))
    late = -F.unix_micros("scraped_at")
    late = F.coalesce(late, F.lit(9223372036854775807))
    trust = F.col("rank").cast("long")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""

    def candidate(field: str, usable: Column, key: Column) -> Column:
        return F.when(usable, F.struct(F.lit(field).alias("field"), key.alias("key")))

    candidates = F.array_compact(
        F.array(
            candidate("source", ~blank(F.col("source")), trust),
            candidate("url", usable_url(F.col("url")), trust),
            candidate("deadline", F.col("plain") | (F.size("all") > 0), F.lit(0).cast("long")),
            candidate("body_excerpt", text_amount(F.col("body_excerpt")).isNotNull(), -text_amount(F.col("body_excerpt")).cast("long")),
        )
    )
    each = rows.select("cluster_id", "sighting_id", late.alias("late"), F.explode(candidates).alias("c")).select("cluster_id", "sighting_id", "late", "c.*")
    order = Window.partitionBy("cluster_id", "field").orderBy("key", "late", "sighting_id")
    best = each.withColumn("place", F.row_number().over(order)).where("place = 1")
    several = sightings.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("n")).where("n >= 2")
    return best.join(several, "cluster_id", "left_semi").select("cluster_id", "field", "sighting_id")


def surviving_rows(sightings: DataFrame, sources: DataFrame) -> DataFrame:
    """One surviving posting a cluster, each field from its best row (null where no row has a usable value)."""
    chosen = survivors(sightings, sources)
    values = chosen.join(sightings.select("sighting_id", "source", "url", "deadline", "body_excerpt"), "sighting_id")
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col(f))).alias(f)
    return values.groupBy("cluster_id").agg(*map(pick, ["source", "url", "deadline", "body_excerpt"]))
