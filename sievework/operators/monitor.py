"""Data-quality checks: staleness, drift, plausibility and shown against held counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staleness(last: DataFrame, expected_minutes: Column, now: Column, factor: int = 2, slack: int = 20) -> DataFrame:
    """age, threshold and whether a stream is stale: unknown age or older than expected times factor plus slack."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("last")) / 60
    limit = expected_minutes * factor + slack
    return last.withColumns({"age": F.floor(age), "threshold": limit, "stale": F.coalesce(age > limit, F.lit(True))})


def drift(counts: DataFrame, drop: float = 0.6, least: int = 3, ratio: float = 1.5) -> DataFrame:
    """alerts of each source's ``now`` against ``before`` (and ``outside``): gone, dropped, fewer than outside."""
    now, before = F.coalesce("now", F.lit(0)), F.coalesce("before", F.lit(0))
    outside = F.col("outside") if "outside" in counts.columns else F.lit(None).cast("long")
    alerts = F.array_compact(
        F.array(
            F.when((now == 0) & (before > 0), F.lit("gone")),
            F.when((before >= least) & (now > 0) & (now <= before * (1 - drop)), F.lit("dropped")),
            F.when(outside >= F.greatest(now * ratio, now + 3), F.lit("outside")),
        )
    )
    return counts.withColumn("alerts", alerts)


def share_of_day(df: DataFrame, keys: list[str], day: Column, today: str, least: int = 8, most: float = 0.8) -> DataFrame:
    """total, rows of today, and whether their share is plausible."""
    n = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(day == today).alias("today"))
    bad = (F.col("total") >= least) & ((F.col("today") >= F.col("total")) | (F.col("today") / F.col("total") > most))
    return n.withColumn("plausible", ~bad)


def leaks(df: DataFrame, title: Column, source: Column, words: list[str], bypass: list[str]) -> DataFrame:
    """total and leaked: rows whose title holds, as plain text, a word that the filter keeps out; sources let through don't count."""
    from sievework.operators.rules import contains_any

    let = F.coalesce(source.isin(*bypass), F.lit(False)) if bypass else F.lit(False)
    return df.agg(F.count("*").alias("total"), F.count_if(contains_any(F.lower(title), words) & ~let).alias("leaked"))


def run_report(report: DataFrame, shown: DataFrame) -> DataFrame:
    """One line a source in its order and a last one of totals: what a run prints. report: source_ord, source, n, error;
    shown: status of what is shown."""
    line = F.concat(F.lit("- "), F.col("source"), F.lit(": "), F.when(F.col("error").isNull(), F.col("n").cast("string")).otherwise(F.concat(F.lit("failed "), F.col("error"))))
    lines = report.select(F.col("source_ord").cast("long").alias("place"), line.alias("line"))
    n = shown.agg(F.count("*").alias("all"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") == "closed").alias("closed"))
    total = n.select(F.lit(2**31).cast("long").alias("place"), F.format_string("passed %d (open %d, closed %d)", "all", "open", "closed").alias("line"))
    return lines.unionByName(total)


def shown(held: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Streams that hold rows of which none is shown fail."""
    both = held.select(key, F.col("n").alias("held")).join(seen.select(key, F.col("n").alias("shown")), key, "full_outer")
    return both.select(key, F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("shown", F.lit(0)).alias("shown")).withColumn("ok", ~((F.col("held") > 0) & (F.col("shown") == 0)))


def failure_class(checks: DataFrame, keys: list[str]) -> DataFrame:
    """ok, recoverable (all failed checks are) or code."""
    bad = F.col("ok") == F.lit(False)
    return checks.groupBy(*keys).agg(
        F.when(F.count_if(bad) == 0, "ok").when(F.count_if(bad & ~F.col("recoverable")) == 0, "recoverable").otherwise("code").alias("status")
    )
