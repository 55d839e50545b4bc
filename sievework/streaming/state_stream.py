"""Incremental runs: a keyed state fed by a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.operators.state import carry_forward, unexpired, upsert
from sievework.session import written
from sievework.sources.sinks import Versioned


def first_seen(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """First occurrence of each key within the watermark, as a stream."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, keys: Sequence[str], at: str, width: str, delay: str) -> DataFrame:
    """Rows of each key and time window; late rows count up to the delay."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def running(stream: DataFrame, key: str, at: str) -> DataFrame:
    """first, last and n of each key, updated with every batch: a streaming aggregate, so its state lives in the JVM."""
    return stream.groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def run_upsert(
    stream: DataFrame,
    table: Versioned,
    schema: object,
    key: str,
    order: str,
    fields: Sequence[str],
    clock: Callable[[int], str],
    checkpoint: str,
    deliver: Callable[[DataFrame], None] | None = None,
    grace_days: int = 2,
) -> StreamingQuery:
    """Merge every batch into the versioned state: upsert, deliver what is new and open, drop what is closed or unseen
    beyond the grace; all input, then stop. A batch that comes again after a failure merges to the same state."""

    def merge(batch: DataFrame, number: int) -> None:
        now = clock(number)
        merged = written(upsert(table.read(schema), batch, key, order, fields, now), "merged")
        if deliver is not None:
            deliver(unexpired(merged.where("is_new"), now[:10]))
        kept = unexpired(merged.drop("is_new"), now[:10])
        since = F.date_sub(F.lit(now[:10]).cast("date"), grace_days).cast("string")
        table.write(kept.where(F.coalesce(F.col("last_seen") >= since, F.lit(True))), guard=True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def restored(state: DataFrame, batch: DataFrame, key: str, today: str, grace_days: int = 2) -> DataFrame:
    """What a run shows: its own rows and those carried forward."""
    return batch.select(key).unionByName(carry_forward(state, batch, key, today, grace_days).select(key))
