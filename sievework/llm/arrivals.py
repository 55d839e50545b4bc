"""New batches against all history: an inverted-file index of content vectors with exact search.

A posting's vector is made of weighted codes of its firm, season, team, role, city and area; it is kept as the codes of its
parts, from which it is exact. Centroids are fitted on a bounded sample of the starting history (``SAMPLE``); the first row
of every exact copy is stored in the cell of its nearest centroid, parted by which fields it states, with its whole title
and body. The distance of two rows is that of the parts both state. A new row probes every cell that can hold a row within
``NEAR``: by the triangle inequality in each part, from its distance to the centroid and the cell's radius there, so no cell
that could hold a nearer row is left out. Within the probed cells distances are computed exactly, rows within ``NEAR`` are
reranked by their whole texts, and the batch is appended to the cells. Equal native ids of a source, equal pages and exact
copies are looked up in a persisted index of keys, parted by hash. Every batch reads only the cells and the parts of the key
index that it touches; chains of repeats are resolved to the earliest arrival.

Defined results: blank native ids and urls are no keys; a field that a row doesn't state (firm, season, team, role, city,
area) neither agrees nor disagrees. Where all but the area are stated on both sides and a body is missing, the fields
decide. With another field silent, the titles' numbers must not differ and the bodies be the same, or where one is missing
a firm stated and the titles' letters equal; with fewer than ``FEW`` fields stated on both sides the titles must be near
too. A row that states less than those it is near to is linked to the earliest and to those that agree with that one.
Exact copies are collapsed to their first row before the search, however many they are; a hot cell is searched in blocks of
about ``BLOCK`` rows, parted by the codes so that a row that states all the cell's fields meets one block. A row that
states few fields is held against all rows that agree in those.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from urllib.parse import parse_qsl, urlencode, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.canonical_values import Reference, all_entries
from sievework.llm.leakage import letters
from sievework.llm.linkage import TitleReader, firm_key
from sievework.operators.joining import lookup
from sievework.session import new_path, written

PARTS = [("firm", 48.0), ("season", 12.0), ("team", 4.0), ("role", 2.5), ("city", 2.5), ("area", 2.5)]  # falling weights part the cells
COMPARED = [f for f, _ in PARTS]
CODE = 32  # numbers of a part; codes of two values are hardly ever nearer than 0.8 of their weight
NEAR = 0.5  # greatest distance of two rows of one job, over the parts both state
SAME_BODY = 0.6  # least cosine of two bodies' words
CONTAINED = 0.8  # or least share of the shorter body's words in the other: a body that was cut
FEW = 3
SLACK = 1e-3  # of distances, for rounding
SAMPLE = 20_000  # rows the centroids are fitted on
ROWS_A_CELL = 300
MOST_CELLS = 4096
BLOCK = 4096
AT_ONCE = 1 << 20  # distances of rows to cells that are held at once, for each part of the vector
MOST_SENT = 200_000  # probes of a batch, 32 bytes each, that are sent to all tasks to filter the cells
SHARES = 64  # parts of the key index; its files are sorted by them, so that a lookup skips the others
# Parameters of a url that don't choose the page.
NOISE = re.compile(r"^(?:utm_\w+|ref|page|from|src|fbclid|gclid|session\w*|sid)$", re.I)


def page_key(url: str | None) -> str | None:
    """What page a url leads to: host without www. or m., path, and the parameters that choose it in order."""
    text = (url or "").strip()
    if not re.match(r"(?i)https?://[^/?#\s]", text):
        return None
    try:
        parts = urlsplit(text)
        host = re.sub(r"^(?:www|m|mobile)\.", "", (parts.hostname or "").lower())
    except ValueError:
        return None
    path, query = parts.path.rstrip("/"), parts.query
    if not query and "&" in path:
        path, _, query = path.partition("&")
    keep = sorted((k, v) for k, v in parse_qsl(query.replace("?", "&"), keep_blank_values=True) if not NOISE.match(k))
    return f"{host}{path.rstrip('/')}?{urlencode(keep)}" if host else None


def _seed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") >> 1


def words(text: str) -> frozenset[str]:
    return frozenset(re.findall(r"\w+", text))


def same_words(a: frozenset[str], b: frozenset[str]) -> bool:
    shared = len(a & b)
    return shared > 0 and (shared * shared >= SAME_BODY * SAME_BODY * len(a) * len(b) or shared >= CONTAINED * min(len(a), len(b)))


@lru_cache(100_000)
def unit(code: int) -> np.ndarray:
    """The vector of length 1 that stands for a code, 0 for silence."""
    u = np.random.default_rng(code).standard_normal(CODE) if code else np.zeros(CODE)
    return u / max(float(np.linalg.norm(u)), 1e-300)


def units(codes: np.ndarray, f: int) -> np.ndarray:
    """The weighted code vectors of a part; zero where it is silent."""
    return PARTS[f][1] * np.stack([unit(k) for k in codes.tolist()]) if len(codes) else np.zeros((0, CODE))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows (codes, one a line) to rows, over the parts both state."""
    total = np.zeros((len(a), len(b)))
    for f in range(len(PARTS)):
        (x, at), (y, to) = np.unique(a[:, f], return_inverse=True), np.unique(b[:, f], return_inverse=True)
        d = _distances(units(x, f), units(y, f)) ** 2
        d[x == 0] = 0
        d[:, y == 0] = 0
        d[x[:, None] == y[None, :]] = 0
        total += d[at.ravel()][:, to.ravel()]
    return np.sqrt(total)


class Texts:
    """A row's title and body with what is compared of them, read once."""

    def __init__(self, title: str, body: str):
        self.body, self.title = letters(body), letters(title)
        self.words, self.title_words = words(body), words(title)
        self.numbers = frozenset(re.findall(r"\d+", title))

    def same_body(self, other: Texts) -> bool:
        """Whether two bodies are one with small edits, or one is a part of the other."""
        return same_words(self.words, other.words) or bool(self.body and other.body) and (self.body in other.body or other.body in self.body)


def same_texts(both: Sequence[bool], q: Texts, x: Texts) -> bool:
    """Whether whole titles and bodies of two rows within ``NEAR`` are one job's; ``both``: the fields stated on both sides."""
    bodies = bool(q.body and x.body)
    if all(both[:-1]):
        return not bodies or q.same_body(x)
    if not (q.numbers <= x.numbers or x.numbers <= q.numbers):
        return False
    if not bodies:
        return both[0] and bool(q.title) and q.title == x.title
    if sum(both) < FEW and q.title_words and x.title_words and not same_words(q.title_words, x.title_words):
        return False
    return q.same_body(x)


def same_job(q: tuple, x: tuple) -> bool:
    """Whether two rows (codes, title, body) are one job registered again: within ``NEAR``, and their texts agree."""
    if float(distances(np.array([q[0]], dtype=np.int64), np.array([x[0]], dtype=np.int64))[0, 0]) > NEAR:
        return False
    return same_texts([a != 0 and b != 0 for a, b in zip(q[0], x[0])], Texts(*q[1:]), Texts(*x[1:]))


def fold(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").casefold()


class Encoder:
    """Codes of the fields of postings; what was read is kept, values repeat."""

    def __init__(self, reference: Reference, keep: int = 200_000):
        self.reference, self.reader, self.keep = reference, TitleReader(keep), keep
        self.codes: dict[str, int] = {}
        self.firms: dict[str, str | None] = {}

    def fields(self, title: str | None, company: str | None) -> dict[str, str | None]:
        got: dict[str, str | None] = dict(self.reader.read(title))
        key = company if company and company.strip() else f"\x00{title}"
        if key not in self.firms:
            if len(self.firms) > self.keep:
                self.firms.clear()
            self.firms[key] = firm_key(self.reference, company, title)
        got["firm"] = self.firms[key]
        return got

    def encode(self, title: str | None, company: str | None) -> list[int]:
        """The code of each field, 0 where it is silent."""
        got, out = self.fields(title, company), []
        for f in COMPARED:
            text = f"{f}={got[f]}" if got.get(f) else ""
            code = self.codes.get(text)
            if code is None:
                code = _seed(text) if text else 0
                if len(self.codes) < self.keep:
                    self.codes[text] = code
            out.append(code)
        return out


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(entries: list[tuple]) -> Encoder:
    """The encoder of a reference list, kept in this worker for the batches to come."""
    key = hash(tuple(entries))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Reference(entries))
    return _ENCODERS[key]


def exact_key(codes: Sequence[int], title: str, body: str) -> int | None:
    """Key of exact copies: stated fields and body, and the title where a field is silent; null where nothing tells."""
    if all(codes[:-1]):
        return _seed(f"{codes}\x1f{body}")
    return _seed(f"{codes}\x1f{title}\x1f{body}") if body or (codes[0] and title) else None


def part_distances(codes: np.ndarray, centroids: np.ndarray, f: int) -> np.ndarray:
    """Distances of rows to centroids in a part of the vector; 0 where the row is silent."""
    own, at = np.unique(codes[:, f], return_inverse=True)
    d = _distances(units(own, f), centroids[:, f * CODE : (f + 1) * CODE].astype(np.float64))
    d[own == 0] = 0
    return d[at.ravel()]


def nearest(codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its distance by part; rows in slices, as many as ``AT_ONCE`` lets."""
    cell, away = np.zeros(len(codes), dtype=np.int64), np.zeros((len(codes), len(PARTS)))
    for at in slices(len(codes), len(centroids)):
        by_part = np.stack([part_distances(codes[at], centroids, f) for f in range(len(PARTS))])
        cell[at] = (by_part**2).sum(0).argmin(1)
        away[at] = by_part[:, np.arange(by_part.shape[1]), cell[at]].T
    return cell, away


def slices(rows: int, columns: int, most: int = 1024) -> list[slice]:
    """Slices of rows that hold at most ``AT_ONCE`` numbers each."""
    step = max(1, min(most, AT_ONCE // max(columns, 1)))
    return [slice(k, k + step) for k in range(0, rows, step)]


ROW = "arrival_id long, batch_no int, keys array<string>, codes array<long>, title string, text string, mask int, cell int, away array<double>, hash long"
HELD = "arrival_id long, batch_no int, codes array<long>, title string, text string, mask int, cell int, away array<double>, hash long, batch int"
KEY = "key string, n long, batch_no int, first_id long, fresh boolean, share int, batch int"


class Cells:
    """The persisted index: cells of rows that state the same fields and the keys seen, one written part a batch."""

    def __init__(self, reference: DataFrame, path: str | None = None):
        self.spark = reference.sparkSession
        self.entries = all_entries(reference)
        self.path = path or new_path(self.spark, "cells")
        self.centroids: np.ndarray | None = None
        self.batches: list[int] = []
        # of each cell and mask of stated fields: rows, most rows of equal codes, radius by part; at most MOST_CELLS a mask
        self.cells: dict[tuple[int, int], tuple[int, int, list[float]]] = {}

    def fit(self, rows: DataFrame, expected: int) -> None:
        """Centroids by k-means on at most SAMPLE rows of the starting history, fitted in one task."""
        entries, cells = self.entries, int(min(MOST_CELLS, max(1, expected // ROWS_A_CELL)))

        def kmeans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, found = encoder_of(entries), []
            for b in batches:
                found += [encoder.encode(*r) for r in zip(*(b.column(c).to_pylist() for c in ("title", "company")))]
            if found:
                codes = np.array(found, dtype=np.int64)
                parts = []
                for f in range(len(PARTS)):
                    own, at = np.unique(codes[:, f], return_inverse=True)
                    parts.append(units(own, f)[at.ravel()])
                vectors = np.concatenate(parts, axis=1).astype(np.float32)
                yield pa.record_batch([pa.array(list(_kmeans(vectors, cells)), pa.list_(pa.float32()))], names=["c"])

        sample = rows.select("title", "company").orderBy(F.xxhash64("arrival_id")).limit(SAMPLE)
        got = sample.coalesce(1).mapInArrow(kmeans, "c array<float>").collect()  # at most MOST_CELLS rows
        self.centroids = np.array([r["c"] for r in got] or [[0.0] * (CODE * len(PARTS))], dtype=np.float32)

    def take(self, batch: DataFrame, number: int, size: int) -> DataFrame:
        """Take in a batch: encode its rows, look up and append their keys, search the cells, append to them.

        Gives arrival_id and first_id of the links found; ``codes`` see ``agreeing``.
        """
        self._encode(batch, number)
        links = self._keys(number, size)
        return links.unionByName(self._near(number))

    def _encode(self, batch: DataFrame, number: int) -> None:
        centroids, entries = self.centroids, self.entries

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = encoder_of(entries)
            for b in batches:
                col = lambda c: b.column(c).to_pylist()  # noqa: E731, B023
                if not b.num_rows:
                    continue
                codes = np.array([encoder.encode(*r) for r in zip(col("title"), col("company"))], dtype=np.int64)
                cell, away = nearest(codes, centroids)
                titles, texts = [fold(x) for x in col("title")], [fold(x) for x in col("body_excerpt")]
                keys = []
                for own, source, native, url, title, text in zip(codes.tolist(), col("source"), col("native_id"), col("url"), titles, texts):
                    page, exact = page_key(url), exact_key(own, letters(title), letters(text))
                    login = f"n\x1f{source}\x1f{native.strip()}" if native and native.strip() and source else None
                    keys.append([k for k in (f"p\x1f{page}" if page else None, login, f"e\x1f{exact}" if exact is not None else None) if k])
                lists = lambda m: pa.FixedSizeListArray.from_arrays(m.ravel(), m.shape[1])
                mask = ((codes != 0) << np.arange(len(COMPARED))).sum(1)
                yield pa.record_batch(
                    [b.column("arrival_id"), b.column("batch_no"), pa.array(keys, pa.list_(pa.string())), lists(codes).cast(pa.list_(pa.int64())), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(mask, pa.int32()), pa.array(cell, pa.int32()), lists(away).cast(pa.list_(pa.float64())), pa.array([content(c) for c in codes.tolist()], pa.int64())],
                    names=["arrival_id", "batch_no", "keys", "codes", "title", "text", "mask", "cell", "away", "hash"],
                )

        batch.select("arrival_id", "batch_no", "source", "native_id", "url", "title", "company", "body_excerpt").mapInArrow(encode, ROW).write.parquet(f"{self.path}/part={number}")

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of the index, one folder a batch."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _keys(self, number: int, size: int) -> DataFrame:
        """Links of rows to the first row of each of their keys; keys not seen before are appended to the index."""
        rows = self.spark.read.schema(ROW).parquet(f"{self.path}/part={number}")
        each = rows.select("arrival_id", "batch_no", F.explode("keys").alias("key"))
        share = F.pmod(F.xxhash64("key"), F.lit(SHARES)).cast("int").alias("share")
        own = each.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("batch_no", "arrival_id")).alias("f")).select("key", share, "n", F.col("f.batch_no").alias("batch_no"), F.col("f.arrival_id").alias("own_id"))
        if self.batches:
            known = self._table("keys", KEY).where("fresh").select("share", "key", F.col("first_id").alias("known_id"))
            if size < SHARES:  # a small batch touches few parts: only those are read
                known = known.where(F.col("share").isin([r["share"] for r in each.select(share).distinct().collect()]))  # at most SHARES
            own = own.join(known, ["share", "key"], "left")
        else:
            own = own.withColumn("known_id", F.lit(None).cast("long"))
        firsts = own.select("key", "n", "batch_no", F.coalesce("known_id", "own_id").alias("first_id"), F.col("known_id").isNull().alias("fresh"), "share")
        firsts.repartition(F.col("share")).sortWithinPartitions("share", "key").write.parquet(f"{self.path}/keys/batch={number}")
        firsts = self._table("keys", KEY).where(F.col("batch") == number)
        shared = firsts.where("n > 1 or not fresh")
        linked = lookup(each, shared, "key", ["first_id"], "n", at_most=3 * size).where(F.col("arrival_id") != F.col("first_id"))
        return linked.select("arrival_id", "first_id", F.lit(None).cast("array<long>").alias("codes"))

    def _near(self, number: int) -> DataFrame:
        """Links by content; of rows that state less than the other (arrival_id), with the other's codes."""
        rows = self.spark.read.schema(ROW).parquet(f"{self.path}/part={number}")
        first = self._table("keys", KEY).where(F.col("batch") == number).where("fresh and startswith(key, 'e')").select(F.col("first_id").alias("arrival_id"))
        fresh = rows.join(first, "arrival_id", "left_semi").select("arrival_id", "batch_no", "codes", "title", "text", "mask", "cell", "away", "hash")
        fresh.repartition(F.col("cell")).sortWithinPartitions("cell").write.parquet(f"{self.path}/held/batch={number}")
        self.batches.append(number)
        queries = self._table("held", HELD).where(F.col("batch") == number)
        far = [F.max(F.col("away")[f]).alias(f"r{f}") for f in range(len(PARTS))]
        asked = {}
        equal = queries.groupBy("cell", "mask", "codes").agg(F.count("*").alias("same"), *far)
        far = [F.max(f"r{f}").alias(f"r{f}") for f in range(len(PARTS))]
        for r in equal.groupBy("cell", "mask").agg(F.sum("same").alias("n"), F.max("same").alias("same"), *far).collect():  # one row a cell and mask
            key = (r["cell"], r["mask"])
            n, same, radius = self.cells.get(key, (0, 0, [0.0] * len(PARTS)))
            self.cells[key] = (n + r["n"], same + r["same"], [max(x, r[f"r{f}"]) for f, x in enumerate(radius)])
            asked[key] = (r["n"], r["same"])
        if not asked:
            return self.spark.createDataFrame([], "arrival_id long, first_id long, codes array<long>")
        live = sorted(self.cells)
        cell_of, mask_of = (np.array([k[i] for k in live], dtype=np.int32) for i in (0, 1))
        reach = np.array([self.cells[k][2] for k in live]).reshape(len(live), len(PARTS)) + SLACK
        blocks = np.array([-(-self.cells[k][0] // BLOCK) for k in live], dtype=np.int64)
        salts = np.array([-(-self.cells[k][1] // BLOCK) for k in live], dtype=np.int64)
        plain = max(map(int, blocks)) == max(map(int, salts)) == 1
        centroids = self.centroids
        bits = (mask_of[:, None] >> np.arange(len(PARTS))) & 1  # stated by the rows of a cell

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for part in slices(whole.num_rows, len(centroids)):
                    b = whole.slice(part.start, part.stop - part.start)
                    codes = np.array(b.column("codes").to_pylist(), dtype=np.int64)
                    pairs = []
                    by_part = [np.maximum(part_distances(codes, centroids, f), 0) for f in range(len(PARTS))]
                    for firm in np.unique(codes[:, 0]).tolist():  # the firm's part weighs most and leaves few cells
                        own = np.flatnonzero(codes[:, 0] == firm)
                        first = np.maximum(by_part[0][own[0], cell_of] - reach[:, 0], 0)
                        cols = np.flatnonzero((first <= NEAR) | (bits[:, 0] == 0) | (firm == 0))
                        for rows in (own[at] for at in slices(len(own), len(cols))):
                            # the square of the least distance a row of the cell can have
                            least = np.tile(np.where((bits[cols, 0] == 1) & (firm != 0), first[cols] ** 2, 0), (len(rows), 1))
                            for f in range(1, len(PARTS)):
                                over = np.maximum(by_part[f][rows][:, cell_of[cols]] - reach[cols, f], 0)
                                least += np.where((codes[rows, f] != 0)[:, None] & (bits[cols, f] == 1)[None, :], over**2, 0)
                            x, y = np.nonzero(least <= NEAR**2)
                            pairs.append((rows[x], cols[y]))
                    i, j = (np.concatenate([p[k] for p in pairs]).astype(np.int64) for k in (0, 1)) if pairs else (np.zeros(0, dtype=np.int64),) * 2
                    whole_mask = np.all((codes[i] != 0) | (bits[j] == 0), axis=1)
                    hashes = [content(c) if w else None for c, w in zip((codes[i] * bits[j]).tolist(), whole_mask.tolist())]
                    at, block, salt = [], [], []
                    for k, c in enumerate(j.tolist()):
                        if plain:
                            break
                        for x in range(blocks[c]) if hashes[k] is None else [hashes[k] % int(blocks[c])]:
                            for y in range(salts[c]):
                                at.append(k)
                                block.append(x)
                                salt.append(y)
                    if plain:
                        at, block = slice(None), np.zeros(len(i), dtype=np.int32)
                        salt = block
                    out = b.take(pa.array(i[at]))
                    cols = {n: out.column(n) for n in ("arrival_id", "batch_no", "codes", "title", "text")}
                    yield pa.record_batch({**cols, "cell": pa.array(cell_of[j[at]]), "mask": pa.array(mask_of[j[at]]), "block": pa.array(block, pa.int32()), "salt": pa.array(salt, pa.int32()), "hash": pa.array([hashes[k] for k in (range(len(i)) if plain else at)], pa.int64())})

        row = ["arrival_id", "batch_no", "codes", "title", "text"]
        keys = ["cell", "mask", "block", "salt", "turn"]
        probes = queries.select(*row).mapInArrow(probe, "arrival_id long, batch_no int, codes array<long>, title string, text string, cell int, mask int, block int, salt int, hash long")
        probes = written(probes, "probes")
        met = probes.groupBy("cell", "mask", "block", "salt").agg(F.count("*").alias("n")).groupBy("cell", "mask").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()  # one row a cell and mask
        # whatever cells they come from, about BLOCK queries meet a block at a time
        turns = {(r["cell"], r["mask"]): -(-r["most"] // BLOCK) for r in met}
        if several := [(*k, t) for k, t in turns.items() if t > 1]:
            split = F.broadcast(self.spark.createDataFrame(several, "cell int, mask int, turns int"))
            probes = probes.join(split, ["cell", "mask"], "left").withColumn("turn", F.pmod(F.xxhash64("arrival_id"), F.coalesce("turns", F.lit(1))).cast("int")).drop("turns")
        else:
            probes = probes.withColumn("turn", F.lit(0))
        held = self._table("held", HELD)
        if sum(n for n, _ in asked.values()) < len(live):  # a small batch touches few cells: only those are read
            touched = sorted({r["cell"] for r in met})  # at most MOST_CELLS
            held = held.where(F.col("cell").isin(touched))  # files are sorted by cell: pushed down, other pages are skipped
        wanted = probes.select(F.col("cell").alias("_c"), F.col("mask").alias("_m"), F.col("hash").alias("_h")).distinct()
        if sum(r["n"] for r in met) <= MOST_SENT:  # rows that no query can be near to stay where they are
            can = (F.col("cell") == F.col("_c")) & (F.col("mask") == F.col("_m")) & (F.col("_h").isNull() | (F.col("hash") == F.col("_h")))
            held = held.join(F.broadcast(wanted), can, "left_semi")
        many = {k: (int(b), int(y), t) for k, b, y in zip(live, blocks, salts) if (t := turns.get(k, 1)) > 1 or b > 1 or y > 1}

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = list(zip(b.column("cell").to_pylist(), b.column("mask").to_pylist()))
                block, salt, copies = np.zeros((3, len(own)), dtype=np.int32)
                copies += 1
                for k, key in enumerate(own):
                    if key in many:
                        block[k] = b.column("hash")[k].as_py() % many[key][0]
                        salt[k] = b.column("arrival_id")[k].as_py() % many[key][1]
                        copies[k] = many[key][2]
                at = np.repeat(np.arange(len(own)), copies)
                turn = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                out = b.take(pa.array(at))
                yield pa.record_batch({**{n: out.column(n) for n in [*row, "cell", "mask"]}, "block": pa.array(block[at]), "salt": pa.array(salt[at]), "turn": pa.array(turn.astype(np.int32))})

        placed = held.select(*row, "cell", "mask", "hash").mapInArrow(settle, "arrival_id long, batch_no int, codes array<long>, title string, text string, cell int, mask int, block int, salt int, turn int")
        return probes.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(search, "arrival_id long, first_id long, codes array<long>")


def content(codes: Sequence[int]) -> int:
    """Hash of a row's codes."""
    return _seed(str(list(codes)))


def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
    """Links of queries to earlier rows of a cell: exact distances, then whole texts."""
    got: list[tuple[int, int, list[int] | None]] = []
    if not q.empty and not x.empty:
        qc, xc = (np.array(d.codes.tolist(), dtype=np.int64) for d in (q, x))
        qk, xk = (list(zip(d.batch_no.tolist(), d.arrival_id.tolist())) for d in (q, x))
        texts: dict[tuple[int, int], Texts] = {}

        def read(key: tuple[int, int], d: pd.DataFrame, k: int) -> Texts:
            if key not in texts:
                texts[key] = Texts(d.title.iat[k], d.text.iat[k])
            return texts[key]

        links = Links()
        for start in range(0, len(qc), 256):
            for i, j in np.argwhere(distances(qc[start : start + 256], xc) <= NEAR).tolist():
                a, b = qk[start + i], xk[j]
                if b >= a:
                    continue
                own, other = qc[start + i], xc[j]
                equal = bool((own == other).all())
                if equal and links.root(a[1]) == links.root(b[1]):
                    continue
                if not same_texts([u != 0 and v != 0 for u, v in zip(own, other)], read(a, q, start + i), read(b, x, j)):
                    continue
                if equal:
                    links.join(a[1], b[1])
                else:
                    (less, _), (more, codes) = ((a, own), (b, other)) if (own != 0).sum() <= (other != 0).sum() else ((b, other), (a, own))
                    got.append((less[1], more[1], codes.tolist()))
        got += [(i, r, None) for i, r in links.edges()]
    return pd.DataFrame({"arrival_id": pd.Series([g[0] for g in got], dtype="int64"), "first_id": pd.Series([g[1] for g in got], dtype="int64"), "codes": pd.Series([g[2] for g in got], dtype="object")})


def agreeing(links: DataFrame) -> DataFrame:
    """Links without those of a row that states less to rows at odds with the earliest it is near to."""
    other = links.where("codes is not null").distinct()
    first = other.groupBy("arrival_id").agg(F.min_by("codes", "first_id").alias("lead"))
    fits = F.forall(F.arrays_zip("codes", "lead"), lambda p: (p["codes"] == 0) | (p["lead"] == 0) | (p["codes"] == p["lead"]))
    kept = other.join(first, "arrival_id").where(fits)
    return links.where("codes is null").select("arrival_id", "first_id").unionByName(kept.select("arrival_id", "first_id"))


class Links:
    """Sets of ids linked by any number of pairs."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, i: int) -> int:
        while (j := self.up.get(i, i)) != i:
            self.up[i] = i = self.up.get(j, j)
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(i, r) for i in self.up if (r := self.root(i)) != i]


def _kmeans(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """k-means on the rows of x, distances in slices."""
    c = _spread_start(x, min(k, len(x)), np.random.default_rng(5))
    for _ in range(rounds):
        near = np.concatenate([_distances(x[i : i + 1024], c).argmin(1) for i in range(0, len(x), 1024)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def _spread_start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Starting centroids drawn with the square of their distance to those drawn before."""
    norms = (x * x).sum(1)
    picked = [int(rng.integers(len(x)))]
    near = np.full(len(x), np.inf)
    while len(picked) < k:
        p = x[picked[-1]]
        near = np.minimum(near, np.maximum(norms + float(p @ p) - 2 * (x @ p), 0))
        total = float(near.sum())
        if total <= 1e-6:
            break
        picked.append(int(np.searchsorted(np.cumsum(near), rng.random() * total).clip(0, len(x) - 1)))
    return x[picked]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def resolve(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """arrival_id and original_id: the smallest id each row is linked to over any number of links.

    Labels double their reach every round; a graph that isn't done after ``rounds`` raises.
    """
    both = edges.select(F.col("arrival_id").alias("a"), F.col("first_id").alias("b")).where("a != b").distinct()
    links = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "labels")
    for _ in range(rounds):
        heard = links.join(labels.select(F.col("a").alias("b"), F.col("low").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        jump = labels.select(F.col("a").alias("low"), F.col("low").alias("j"))
        new = labels.join(heard, "a").join(jump, "low", "left").select("a", F.least("low", "l", F.coalesce("j", "low")).alias("low"), (F.least("l", F.coalesce("j", "low")) < F.col("low")).alias("moved"))
        new = written(new, "labels")
        labels = new.select("a", "low")
        if not new.where("moved").limit(1).count():
            return labels.where("a != low").select(F.col("low").alias("original_id"), F.col("a").alias("arrival_id"))
    raise RuntimeError(f"links not resolved after {rounds} rounds")


def deduplicate(arrivals: DataFrame, reference: DataFrame, path: str | None = None) -> DataFrame:
    """original_id and arrival_id of every repeat.

    Batches are taken in by their number, each checked against the persisted cells and keys of all before and of itself,
    then part of them. Rows without a batch number are never taken in.
    """
    cells = Cells(reference, path)
    dated = arrivals.where(F.col("batch_no").isNotNull())
    sizes = {r["batch_no"]: r["count"] for r in dated.groupBy("batch_no").count().collect()}  # one row a batch
    if not sizes:
        return arrivals.select(F.col("arrival_id").alias("original_id"), "arrival_id").limit(0)
    numbers = sorted(sizes)
    cells.fit(dated.where(F.col("batch_no") == numbers[0]), sum(sizes.values()))
    edges = [written(cells.take(dated.where(F.col("batch_no") == n), n, sizes[n]), f"links-{n}") for n in numbers]
    return resolve(agreeing(reduce(DataFrame.unionByName, edges)))


def accepted(arrivals: DataFrame, reference: DataFrame) -> DataFrame:
    """Every arrival with its original and the first_seen kept from it, batch by batch; new postings are their own original."""
    repeats = deduplicate(arrivals, reference)
    own = arrivals.select("arrival_id", "batch_no", F.col("first_seen").alias("own_seen")).join(repeats, "arrival_id", "left")
    own = own.withColumn("original_id", F.coalesce("original_id", "arrival_id"))
    seen = arrivals.select(F.col("arrival_id").alias("original_id"), "first_seen")
    return own.join(seen, "original_id").select("arrival_id", "batch_no", "original_id", (F.col("original_id") == F.col("arrival_id")).alias("is_new"), "first_seen")
