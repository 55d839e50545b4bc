"""Row types."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


POSTING = _strings("source source_label title company deadline posted_date url body_excerpt category location emp_type native_id")
ARTICLE = _strings("source source_label title url published published_at summary category")
DUPES = T.ArrayType(_strings("title url source_label published"))
STATE = T.StructType([*POSTING.fields, T.StructField("uid", T.StringType()), *_strings("first_seen last_seen notified_date").fields, T.StructField("notified", T.BooleanType()), T.StructField("manual", T.BooleanType())])
REPORT = T.StructType([T.StructField("source_ord", T.IntegerType()), *_strings("source label error").fields, T.StructField("ok", T.BooleanType()), T.StructField("n", T.LongType())])
SUBSCRIBER = _strings("endpoint p256dh auth scope created")
