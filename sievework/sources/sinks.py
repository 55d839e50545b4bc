"""Sinks: versioned tables behind a pointer, guarded overwrite, JSON documents and reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


KEEP = object()  # leaves a part of a feed document as it is


class Versioned:
    """A table kept as numbered version folders; a reader sees the last whole version.

    A version counts once its marker ``DONE-<number>`` exists, which is created in one step and never replaced, so there
    is no moment without a version and two writers can't both take a number. A marker whose folder is gone or unreadable
    is passed over for the one before; without any the table is empty. The last ``keep`` versions stay.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), max(2, keep)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of whole versions, the latest first."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return sorted((int(n[5:]) for n in names if n.startswith("DONE-") and n[5:].isdigit() and f"v-{n[5:]}" in names), reverse=True)

    def read(self, schema: object) -> DataFrame:
        """The latest readable version, empty before the first."""
        for number in self.versions():
            df = self.spark.read.schema(schema).parquet(f"{self.path}/v-{number}")
            try:
                df.limit(1).count()
            except Exception:  # noqa: BLE001 - a corrupt version is passed over
                continue
            return df
        return self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, guard: bool = True) -> bool:
        """Write a version and mark it. With ``guard`` an empty one doesn't replace one that has rows."""
        number = (self.versions() or [0])[0] + 1
        while self._fs.exists(self._path(f"{self.path}/v-{number}")):
            number += 1  # left by a writer that broke off
        folder = f"{self.path}/v-{number}"
        df.write.parquet(folder)
        fresh = self.spark.read.schema(df.schema).parquet(folder)
        if guard and not fresh.limit(1).count() and self.read(df.schema).limit(1).count():
            self._fs.delete(self._path(folder), True)
            return False
        self._fs.create(self._path(f"{self.path}/DONE-{number}"), False).close()
        for old in self.versions()[self.keep :]:
            self._fs.delete(self._path(f"{self.path}/DONE-{old}"), False)
            self._fs.delete(self._path(f"{self.path}/v-{old}"), True)
        return True


def json_document(df: DataFrame, name: str, order: Sequence[str], most: int) -> DataFrame:
    """One row with a JSON document of the first ``most`` rows: a page for display, so its size is a parameter."""
    page = df.orderBy(*order).limit(most)
    body = page.agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order]))).alias(name))
    return body.select(F.to_json(F.struct(F.size(name).alias("count"), name)).alias("document"))


def status(old: str | None, ran: dict[str, str], now: str) -> str:
    """The status document after a run: last_run always (a heartbeat, also of a run that did nothing), of the streams
    those that ran."""
    kept = json.loads(old) if old else {}
    return json.dumps({**kept, **ran, "last_run": now}, ensure_ascii=False, sort_keys=True)


def feed(old: str | None, now: str, new_items: list | None = None, digest: object = KEEP) -> str:
    """A feed document after a run: parts that aren't given (``new_items`` none, ``digest`` ``KEEP``) stay as they were; a
    missing or corrupt document starts empty."""
    try:
        kept = json.loads(old) if old else {}
    except ValueError:
        kept = {}
    kept = kept if isinstance(kept, dict) else {}
    out = {"new_items": [], "digest": None, **kept, "generated_at": now}
    if new_items is not None:
        out["new_items"] = new_items
    if digest is not KEEP:
        out["digest"] = digest
    return json.dumps(out, ensure_ascii=False, sort_keys=True)


def markdown(df: DataFrame, columns: Sequence[str], order: Sequence[str], most: int = 1000) -> str:
    """A report of checks, a table of at most ``most`` lines; bars in cells become slashes."""
    lines = [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]
    for r in df.select(*columns).orderBy(*order).limit(most).collect():
        lines.append("| " + " | ".join("" if v is None else str(v).replace("|", "/") for v in r) + " |")
    return "\n".join(lines) + "\n"


def keep_cached(cache: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """A cache without the keys that aren't current any more."""
    return cache.join(current.select(key), key, "left_semi")


def prune(subscribers: DataFrame, gone: DataFrame) -> DataFrame:
    return subscribers.join(gone.select("endpoint"), "endpoint", "left_anti")


def upsert_subscribers(old: DataFrame, new: DataFrame, scopes: Sequence[str], default: str = "all") -> DataFrame:
    """Subscribers by the hash of their endpoint, the last write wins; unknown scopes become the default, invalid rows go."""
    valid = F.col("endpoint").startswith("https://") & (F.length("endpoint") < 1024) & F.col("p256dh").isNotNull() & F.col("auth").isNotNull()
    rows = old.withColumn("_t", F.lit(0)).unionByName(new.withColumn("_t", F.lit(1)), allowMissingColumns=True).where(valid)
    rows = rows.withColumn("scope", F.when(F.col("scope").isin(*scopes), F.col("scope")).otherwise(default))
    last = rows.groupBy(F.sha2("endpoint", 256).alias("id")).agg(F.max_by(F.struct("endpoint", "p256dh", "auth", "scope", "created"), F.struct("_t", F.coalesce("created", F.lit("")))).alias("r"))
    return last.select("id", "r.*")
