"""Titles that differ only in how they are written, collapsed and counted.

A title's canonical bytes are its segments (cut at separating punctuation), each reduced to letters, digits and marks in
one case and presentation, in sorted order. Every task counts its own rows first. Recursive radix partitioning then
finds buckets: the histogram of leading bytes is taken, buckets with more than ``limit`` partial counts are split by
further bytes (skipping what all their keys share) until each fits, and every bucket is counted in a byte trie whose
terminal nodes hold count and smallest id.

Defined results: null titles and titles without letter or digit have no group; equal rows are copies of each other; a
bucket whose keys are all one key is never split, it holds at most one partial count a task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.joining import lookup
from sievework.session import task_count, written

LIMIT = 20000
FIRST_BYTES = 4
MORE_BYTES = 3
_CUTS = re.compile(r"[/|,·…\-‐-―()\[\]{}【】<>《》〈〉「」『』:;~]+")
_KEEP = ("L", "N", "M")


class _Letters(dict):
    """Translation table that drops every character but letters, digits and marks; it fills itself."""

    def __missing__(self, code: int) -> int | None:
        self[code] = code if unicodedata.category(chr(code))[0] in _KEEP else None
        return self[code]


_LETTERS = _Letters()


def canonical(title: str | None) -> bytes:
    """Canonical bytes of a title, empty for a title without letter or digit."""
    if not title:
        return b""
    flat = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", title).casefold())
    parts = [p.translate(_LETTERS) for p in _CUTS.split(flat.replace("・", "·"))]
    return "\x1f".join(sorted(p for p in parts if p)).encode()


def with_canonical(rows: DataFrame) -> DataFrame:
    """kind, id and canon of rows of kind, id and title; rows without canonical bytes are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column("kind").to_pylist()
            canon = [canonical(t) for t in b.column("title").to_pylist()]
            keys = [k[:1].encode() + b"\x1e" + c if c else None for k, c in zip(kinds, canon)]
            out = pa.record_batch({"kind": b.column("kind"), "id": b.column("id"), "canon": pa.array(keys, pa.binary())})
            yield out.filter(out.column("canon").is_valid())

    return rows.mapInArrow(read, "kind string, id long, canon binary")


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _bucket(key: bytes, split: dict[bytes, int]) -> bytes:
    """The bucket of a key under a directory of split buckets (their prefix -> the number of bytes of their parts)."""
    p = key[:FIRST_BYTES]
    while p in split:
        longer = key[: split[p]]
        if longer == p:
            return p + b"$"  # the key ends here: a bucket of this one key
        p = longer
    return p


def directory(partial: DataFrame, limit: int = LIMIT) -> dict[bytes, int]:
    """Split buckets, found level by level. Each holds more than ``limit`` partial counts, so there are few."""
    split: dict[bytes, int] = {}
    fresh: set[bytes] | None = None
    while fresh is None or fresh:
        known, watch, lengths = dict(split), fresh, {len(w) for w in fresh or ()}

        def count(batches: Iterator[pa.RecordBatch], known: dict = known, watch: set | None = watch, lengths: set = lengths) -> Iterator[pa.RecordBatch]:
            seen: dict[bytes, list] = {}
            for b in batches:
                for key in b.column("canon").to_pylist():
                    p = _bucket(key, known)
                    if watch is not None and not any(p[:n] in watch for n in lengths):
                        continue
                    s = seen.get(p)
                    if s is None:
                        seen[p] = [1, key, key]
                    else:
                        s[0] += 1
                        s[1], s[2] = min(s[1], key), max(s[2], key)
            if seen:
                yield pa.record_batch({"prefix": pa.array(list(seen), pa.binary()), "n": [s[0] for s in seen.values()], "lo": pa.array([s[1] for s in seen.values()], pa.binary()), "hi": pa.array([s[2] for s in seen.values()], pa.binary())})

        sums = partial.select("canon").mapInArrow(count, "prefix binary, n long, lo binary, hi binary").groupBy("prefix").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        over = sums.where((F.col("n") > limit) & (F.col("lo") != F.col("hi"))).collect()  # at most partial counts / limit rows
        fresh = set()
        for r in over:
            p = bytes(r["prefix"])
            split[p] = max(len(p), _shared(bytes(r["lo"]), bytes(r["hi"]))) + MORE_BYTES
            fresh.add(p)
    return split


class Trie:
    """Byte trie in steps of eight bytes; terminal nodes count rows and keep the smallest id."""

    STEP = 8

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, n: int, smallest: int) -> None:
        node = self.root
        for i in range(0, len(key), self.STEP):
            node = node.setdefault(key[i : i + self.STEP], {})
        end = node.get(None)
        if end is None:
            node[None] = [n, smallest]
        else:
            end[0] += n
            end[1] = min(end[1], smallest)

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        todo = [(b"", self.root)]
        while todo:
            key, node = todo.pop()
            for step, below in node.items():
                if step is None:
                    yield key, below[0], below[1]
                else:
                    todo.append((key + step, below))


def groups(rows: DataFrame, limit: int = LIMIT, tasks: int | None = None) -> DataFrame:
    """canon, n and keeper of every group of rows of canon and id."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, list[int]] = {}
        for b in batches:
            for key, i in zip(b.column("canon").to_pylist(), b.column("id").to_pylist()):
                s = own.get(key)
                if s is None:
                    own[key] = [1, i]
                else:
                    s[0] += 1
                    s[1] = min(s[1], i)
            if len(own) > 500_000:
                yield flush(own)
                own = {}
        if own:
            yield flush(own)

    def flush(own: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.record_batch({"canon": pa.array(list(own), pa.binary()), "n": [s[0] for s in own.values()], "id": [s[1] for s in own.values()]})

    partial = written(rows.select("canon", "id").mapInArrow(tally, "canon binary, n long, id long"), "title-tallies")
    split = directory(partial, limit)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("bucket", pa.array([_bucket(k, split) for k in b.column("canon").to_pylist()], pa.binary()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie = None, Trie()
        for b in batches:
            for bucket, key, n, i in zip(*(b.column(c).to_pylist() for c in ("bucket", "canon", "n", "id"))):
                if bucket != at:
                    yield from out(trie)
                    at, trie = bucket, Trie()
                trie.add(key, n, i)
        yield from out(trie)

    def out(trie: Trie) -> Iterator[pa.RecordBatch]:
        found = list(trie.items())
        if found:
            yield pa.record_batch({"canon": pa.array([f[0] for f in found], pa.binary()), "n": [f[1] for f in found], "keeper": [f[2] for f in found]})

    placed = partial.mapInArrow(place, "canon binary, n long, id long, bucket binary")
    placed = placed.repartition(tasks or task_count(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(count, "canon binary, n long, keeper long")


def titles(postings: DataFrame, articles: DataFrame) -> DataFrame:
    of = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "title")
    return of(postings, "posting", "posting_id").unionByName(of(articles, "article", "article_id"))


def found(postings: DataFrame, articles: DataFrame, limit: int = LIMIT) -> DataFrame:
    """record_kind, keeper_id and copy_id of every title copy."""
    rows = written(with_canonical(titles(postings, articles)), "titles")
    several = written(groups(rows, limit).where("n > 1"), "title-groups")
    joined = lookup(rows, several, "canon", ["keeper"], "n")  # a title of millions of copies isn't one task
    return joined.where(F.col("id") != F.col("keeper")).select(
        F.col("kind").alias("record_kind"), F.col("keeper").alias("keeper_id"), F.col("id").alias("copy_id")
    )


def counts(postings: DataFrame, articles: DataFrame, limit: int = LIMIT) -> DataFrame:
    """record_kind, keeper_id and copies of every title, each once."""
    rows = with_canonical(titles(postings, articles))
    kind = F.when(F.substring("canon", 1, 1) == F.lit(b"p"), "posting").otherwise("article")
    return groups(rows, limit).select(kind.alias("record_kind"), F.col("keeper").alias("keeper_id"), F.col("n").alias("copies"))
