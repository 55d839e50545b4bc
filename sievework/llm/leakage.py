"""Evaluation texts inside a training corpus, by suffix arrays over shards of the corpus.

Texts are read as letters, digits and marks in one case. Every shard of documents gets a suffix array (prefix doubling on
packed keys). Every suffix of every test item is looked up by binary search; its verbatim matches that can't be extended
to the left are extended to the right as far as they go. Matches of one document and item are chained in the item's order
and close together; a chain that holds ``share`` of the item is a leak, if its longest match is longer than stock phrases
are or it holds ``WHOLE`` of the item.

Defined results: null and empty texts hold nothing; items without letters leak nowhere; repeated documents and items are
reported each on its own. A document longer than a shard is searched in pieces that overlap by the longest item, so that
every match lies whole in a piece, and chained over all of them. Items are shipped to the tasks in blocks of at most
``BLOCK_CHARS``, so their number is not bounded; where there are several blocks, the shards and their suffix arrays are
written once and every block searches them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.title_copies import _LETTERS
from sievework.session import task_count, written

SHARE = 0.4
SHARD_CHARS = 1_000_000
BLOCK_CHARS = 4_000_000
APART = 400  # letters between two matches of one chain
ANCHOR = 1.5  # a chain's longest match, in least matches: stock phrases that many texts share are shorter
WHOLE = 0.7  # share of the item that counts however short the matches are
KEY = 5  # letters of a packed key, fewer where the alphabet is wide
LEAST = {"cjk": 7, "hangul": 9, "other": 12, "latin": 14}  # letters of a verbatim match that counts


def letters(text: str | None) -> str:
    """The letters, digits and marks of a text in one case and presentation."""
    import unicodedata

    return unicodedata.normalize("NFKC", text or "").casefold().translate(_LETTERS)


def least_match(text: str) -> int:
    """Least length of a match that counts, by the script of most of the item."""
    n = {"latin": 0, "hangul": 0, "cjk": 0, "other": 0}
    for c in text:
        o = ord(c)
        n["latin" if o < 0x250 else "hangul" if 0xAC00 <= o <= 0xD7A3 else "cjk" if 0x3040 <= o <= 0x9FFF else "other"] += 1
    return LEAST[max(n, key=n.get)]


def suffix_array(codes: np.ndarray, keys: np.ndarray, packed: int = KEY) -> np.ndarray:
    """Positions of all suffixes in order. Separators differ from each other, so no order runs over a document's end."""
    n = len(codes)
    order = np.argsort(keys, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    group = np.flatnonzero(new)[np.cumsum(new) - 1]  # of each place in order: where its group begins
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    step = packed
    while True:
        single = np.ones(n, dtype=bool)
        single[:-1] = new[1:]
        tied = np.flatnonzero(~(new & single))
        if not len(tied):
            return order
        at = order[tied]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        inner = np.lexsort((after, rank[at]))
        order[tied] = at = at[inner]
        after = after[inner]
        own = rank[at]
        fresh = np.ones(len(tied), dtype=bool)
        fresh[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        new[tied] = fresh
        group = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[order] = group
        step *= 2


def _pack(codes: np.ndarray, bits: int, packed: int) -> np.ndarray:
    keys = np.zeros(len(codes), dtype=np.int64)
    padded = np.concatenate([codes, np.zeros(packed, dtype=np.int64)])
    for i in range(packed):
        keys = (keys << bits) | padded[i : i + len(codes)]
    return keys


def _bisect(values: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, offset: int, right: bool) -> np.ndarray:
    """In each range [lo, hi) of the suffix array, the first place whose letter at ``offset`` isn't below ``want``."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        at = np.minimum(sa[np.minimum(mid, len(sa) - 1)] + offset, len(values) - 1)
        below = values[at] <= want if right else values[at] < want
        lo = np.where(open_ & below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


class Items:
    """Test items as one array of letters with every suffix that can begin a match."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        texts = [letters(t) for _, t in items]
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        least = [least_match(t) for t in texts]
        self.text = "\x00".join(texts) + "\x00"
        self.points = _points(self.text)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1]
        self.owner = np.repeat(np.arange(len(texts)), self.sizes + 1)
        self.least = np.array(least, dtype=np.int64)
        place = np.arange(len(self.text)) - self.starts[self.owner] if len(texts) else np.zeros(0, dtype=np.int64)
        self.at = np.flatnonzero(place + self.least[self.owner] <= self.sizes[self.owner]) if len(texts) else np.zeros(0, dtype=np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)


class Shard:
    """Texts with their suffix array."""

    def __init__(self, texts: list[str], order: np.ndarray | None = None):
        self.sizes = np.array([len(d) for d in texts], dtype=np.int64)
        self.raw = _points("\x00".join(texts) + "\x00")
        self.letters = np.unique(self.raw)
        self.bits = max(1, int(len(self.letters) + 1).bit_length())
        self.packed = min(KEY, 62 // self.bits)  # at least 2: a code point has 21 bits
        self.codes = np.searchsorted(self.letters, self.raw)
        self.keys = _pack(self.codes, self.bits, self.packed)
        self.order = suffix_array(self.codes, self.keys, self.packed) if order is None else order.astype(np.int64)

    def matches(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text's index, item's index, start in item, start in text, length) of the longest verbatim matches."""
        sa, codes, packed = self.order, self.codes, self.packed
        ends = np.cumsum(self.sizes + 1) - 1
        place = np.minimum(np.searchsorted(self.letters, items.points), len(self.letters) - 1)
        want = np.where(self.letters[place] == items.points, place, -1)  # -1: a letter the shard doesn't hold
        known = np.concatenate([np.cumsum(want < 0), np.zeros(packed, dtype=np.int64)])
        at = items.at
        before = np.where(at > 0, known[np.maximum(at - 1, 0)], 0)
        at = at[known[at + packed - 1] == before]  # the first letters are all known
        sorted_keys = self.keys[sa]
        wanted = _pack(np.maximum(want, 0), self.bits, packed)[at]
        lo, hi = np.searchsorted(sorted_keys, wanted, "left"), np.searchsorted(sorted_keys, wanted, "right")
        keep = lo < hi
        at, lo, hi = at[keep], lo[keep], hi[keep]
        least = items.least[items.owner[at]]
        for offset in range(packed, int(least.max()) if len(least) else 0):
            on = np.flatnonzero(offset < least)
            letter = want[at[on] + offset]
            a = _bisect(codes, sa, lo[on], hi[on], letter, offset, right=False)
            b = _bisect(codes, sa, lo[on], hi[on], letter, offset, right=True)
            lo[on], hi[on] = a, b
            keep = lo < hi
            at, lo, hi, least = at[keep], lo[keep], hi[keep], least[keep]
        n = hi - lo
        i = np.repeat(at, n)
        p = sa[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] if len(n) else np.zeros(0, dtype=np.int64)
        first = (i == items.starts[items.owner[i]]) | (p == 0)
        left = ~first & (want[np.maximum(i - 1, 0)] == codes[np.maximum(p - 1, 0)]) & (codes[np.maximum(p - 1, 0)] != 0)
        i, p = i[~left], p[~left]
        length = np.zeros(len(i), dtype=np.int64)
        on = np.arange(len(i))
        while len(on):
            a, b = want[np.minimum(i[on] + length[on], len(want) - 1)], codes[np.minimum(p[on] + length[on], len(codes) - 1)]
            on = on[(a == b) & (a != 0)]
            length[on] += 1
        doc = np.searchsorted(ends, p)
        starts = ends - self.sizes
        owner = items.owner[i]
        return doc, owner, i - items.starts[owner], p - starts[doc], length


def shard_matches(docs: list[str], items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return Shard(docs).matches(items)


def chain(matches: list[tuple[int, int, int]]) -> int:
    """Most letters of the item held by matches (start in item, start in document, length) in its order, close together.

    Matches are taken by their place in the document; one can only follow another that ends within ``APART`` letters of
    its start, so each is held against those of a stretch of the text, not against all.
    """
    matches = sorted(set(matches), key=lambda m: (m[1], m[0], m[2]))
    best: list[int] = []
    top, low, longest = 0, 0, max((m[2] for m in matches), default=0)
    for a, d, n in matches:
        while matches[low][1] + longest < d - APART:
            low += 1
        most = n
        for k in range(low, len(best)):
            pa_, pd, pn = matches[k]
            ea, ed = pa_ + pn, pd + pn
            skip = max(0, ea - a, ed - d)
            if best[k] + n - skip > most and skip < n and d - ed <= APART and pa_ <= a:
                most = best[k] + n - skip
        best.append(most)
        top = max(top, most)
    return top


Piece = tuple[int, str, int, bool]  # document's id, letters, where they begin in the document, whether they are its last


def _pieces(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[list[Piece]]:
    """Shards of whole documents; a longer one is a run of shards of its own that overlap."""
    held: list[Piece] = []
    total = 0
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            own = letters(t)
            if not own:
                continue
            if held and total + len(own) > size:
                yield held
                held, total = [], 0
            if len(own) > size:
                step = max(size - overlap, 1)
                for at in range(0, len(own), step):
                    last = at + size >= len(own)
                    yield [(i, own[at : at + size], at, last)]
                    if last:
                        break
                continue
            held.append((i, own, 0, True))
            total += len(own)
    if held:
        yield held


def _leaks(shards: Iterator[tuple[list[Piece], Shard]], own: Items) -> Iterator[tuple]:
    """(doc_id, item_id, held, size, longest, place) of the documents that end in each shard."""
    by: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
    for pieces, shard in shards:
        for d, j, a, p, n in zip(*(x.tolist() for x in shard.matches(own))):
            by[d if pieces[d][3] and pieces[d][2] == 0 else -1, j].append((a, p + pieces[d][2], n))
        if not pieces[-1][3]:
            continue  # a long document goes on
        for (d, j), found in by.items():
            a, p, n = max(found, key=lambda m: (m[2], -m[0], -m[1]))
            held = chain(found)
            if n >= own.least[j] * ANCHOR or held >= WHOLE * own.sizes[j]:
                yield pieces[d][0], int(own.ids[j]), held, int(own.sizes[j]), n, p
        by.clear()


FOUND = "doc_id long, item_id long, held int, size int, longest int, place int"
SHARDS = "ids array<long>, texts array<string>, starts array<long>, lasts array<boolean>, suffixes array<int>"


def _rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in FOUND.split(", ")]
    rows: list[tuple] = []
    for r in found:
        rows.append(r)
        if len(rows) == 10_000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            rows = []
    yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)], names=names)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The test items, a stated query set, in blocks of bounded size."""
    block, size = [], 0
    for r in items.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id").toLocalIterator():
        if block and size + len(r["text"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def matches(documents: DataFrame, items: DataFrame, share: float = SHARE, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, item_id, held (letters of the item in the best chain), size (letters of the item), longest (letters of the
    longest verbatim match) and place (where that begins among the document's letters)."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull()).repartition(max(task_count(spark), 1))
    blocks = _blocks(items)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        return spark.createDataFrame([], FOUND)
    overlap = int(items.agg(F.coalesce(F.max(F.length("text")), F.lit(0))).first()[0]) * 2  # letters of one character: hardly ever more than two
    if following is None:
        own = Items(block)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _rows(_leaks(((p, Shard([x[1] for x in p])) for p in _pieces(batches, max(shard_chars, 2 * overlap), overlap)), own))

        return docs.mapInArrow(search, FOUND).where(F.col("held") >= share * F.col("size"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(held, schema=pa.schema([("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("lasts", pa.list_(pa.bool_())), ("suffixes", pa.list_(pa.int32()))]))

        for p in _pieces(batches, max(shard_chars, 2 * overlap), overlap):
            held.append({"ids": [x[0] for x in p], "texts": [x[1] for x in p], "starts": [x[2] for x in p], "lasts": [x[3] for x in p], "suffixes": Shard([x[1] for x in p]).order.astype(np.int32)})
            if p[-1][3]:  # the pieces of one document stay in one batch
                yield row()
                held = []

    shards, out = written(docs.mapInArrow(build, SHARDS).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "shards"), None
    placed = shards.repartition("_part").sortWithinPartitions("_part", "_place").drop("_part", "_place")
    while block is not None:
        own = Items(block)

        def look(batches: Iterator[pa.RecordBatch], own: Items = own) -> Iterator[pa.RecordBatch]:
            def shards() -> Iterator[tuple[list[Piece], Shard]]:
                for b in batches:
                    for r in b.to_pylist():
                        yield list(zip(r["ids"], r["texts"], r["starts"], r["lasts"])), Shard(r["texts"], np.array(r["suffixes"]))

            yield from _rows(_leaks(shards(), own))

        part = placed.mapInArrow(look, FOUND)
        out = part if out is None else out.unionByName(part)
        block, following = following, next(blocks, None)
    return out.where(F.col("held") >= share * F.col("size"))


def found(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    return matches(documents, items, share).select("doc_id", "item_id")


def clean(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents without those that hold a test item."""
    return documents.join(written(found(documents, items, share), "leaks"), "doc_id", "left_anti")
