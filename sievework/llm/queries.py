"""Queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import arrivals, canonical_values, leakage, linkage, mixture, sentences, survivors, title_copies
from sievework.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "sightings"), table(spark, sf_dir, "sources"))


@query
def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.surviving_rows(table(spark, sf_dir, "sightings"), table(spark, sf_dir, "sources"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_copies.found(table(spark, sf_dir, "postings"), table(spark, sf_dir, "articles"))


@query
def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_copies.counts(table(spark, sf_dir, "postings"), table(spark, sf_dir, "articles"))


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.found(table(spark, sf_dir, "documents"))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with the letters held, the longest verbatim match and its place."""
    return leakage.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = leakage.clean(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return clean.select("doc_id", "source", "n_chars")


# Further names of entries, beside the reference's own aliases: data of this deployment.
ALIASES = [
    ("emp_type", "정규직", "정규;fulltime"), ("emp_type", "계약직", "fixedterm"), ("emp_type", "인턴", "internship"), ("emp_type", "파트타임", "parttime"),
    ("emp_type", "프리랜서", "freelancer;프리"), ("emp_type", "파견직", "파견근로"), ("emp_type", "수습", "실무수습"),
    ("category", "신입", "entry;entrylevel;newgrad"), ("category", "경력", "experiencedhire"), ("category", "경력무관", "경력사항무관"),
    ("category", "신입·경력", "경력신입;신입및경력;경력및신입;entryexperienced;experiencedentry"),
]


def ref_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_values.with_aliases(table(spark, sf_dir, "ref_values"), spark.createDataFrame(ALIASES, "field string, name string, alias string"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_values.found(table(spark, sf_dir, "postings"), ref_values(spark, sf_dir))


@query
def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_values.unmatched(table(spark, sf_dir, "postings"), ref_values(spark, sf_dir))


@query
def p2_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries within the distance of each typed value."""
    return canonical_values.entries(table(spark, sf_dir, "postings"), ref_values(spark, sf_dir))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.found(*(table(spark, sf_dir, t) for t in ("board_listings", "firm_listings", "ref_values")))


@query
def p4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link(*(table(spark, sf_dir, t) for t in ("board_listings", "firm_listings", "ref_values")))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals.deduplicate(table(spark, sf_dir, "arrivals"), table(spark, sf_dir, "ref_values"))


@query
def p7_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals.accepted(table(spark, sf_dir, "arrivals"), table(spark, sf_dir, "ref_values"))


@query
def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixture.shares(mixture.mixture(table(spark, sf_dir, "documents"), targets), targets)
