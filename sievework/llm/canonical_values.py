"""Freely typed values mapped to the entries of a reference list.

The reference is a trie over letters (Hangul syllables as their jamo), one per field. Every entry has a path for its name,
its foreign name and its aliases, and paths derived by rule (a firm's name without its legal suffix, a trade name without
its last syllable). A value is read whole, then in parts (brackets, separators, leading and trailing words), and each
reading walks the trie as a Levenshtein automaton with transpositions that returns all entries within a distance that
depends on its length. The entry at least distance of the longest reading is the one meant; none: 0.

An answer's rank (exact before near before inside a word, then reading, edits and id) is compared over all blocks of the
reference, so the result doesn't depend on their size. ``within`` gives all entries within the distance. Aliases are data:
the reference's own column and, if given, a table of further ones (``with_aliases``).

Defined results: null and blank values are no case; a value that is exactly a name isn't either; equal values get equal
entries; among entries at the same distance the smallest id is taken; an empty reference leaves every value unmatched.
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

BLOCK_ENTRIES = 50_000  # entries in one trie; a longer reference is searched in blocks
FIELDS = ("company", "emp_type", "category")
# Legal forms of firm names, and tails of theirs with their short forms.
LEGAL = re.compile(r"\((?:주|유|재|사)\)|㈜|주식회사|유한회사|유한책임회사|\bco\.?,? ?ltd\.?|\b(?:inc|llc|ltd|corp|gmbh)\b\.?", re.I)
SUFFIXES = ["회계법인", "세무법인", "세무회계", "자산운용", "감사반", "캐피탈", "홀딩스", "테크", "산업", "물산"]
SHORT = {"회계법인": ["회계"], "세무법인": ["세무"], "세무회계": ["세무", "회계"], "자산운용": ["운용", "자산"]}
MARKUP = re.compile(r"<[^<>]*>|&(?:nbsp|amp|quot|lt|gt);")
PARTS = re.compile(r"[()\[\]{}【】『』「」“”\"'/|,;:·~]|\s-\s|-")
_INSIDE = 2  # least syllables of an alias found inside a word


def distance_for(n: int) -> int:
    """Greatest distance at which a reading of n letters still means an entry."""
    return 0 if n < 4 else 1 if n < 32 else 2


def flat(text: str) -> str:
    """Letters and digits of a text in one case and presentation."""
    text = unicodedata.normalize("NFKC", MARKUP.sub(" ", text)).casefold()
    return "".join(c for c in text if c.isalnum())


def jamo(text: str) -> str:
    return unicodedata.normalize("NFD", text)


class Trie:
    """Paths of letters; a terminal node holds (entry, whether it may be met at a distance)."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, path: str, entry: int, near: bool = True) -> None:
        node = self.root
        for c in path:
            node = node.setdefault(c, {})
        node.setdefault("", {})
        node[""][entry] = max(near, node[""].get(entry, False))

    def within(self, word: str, most: int) -> dict[int, int]:
        """All entries with a path within ``most`` edits of the word, and the least number of edits."""
        found: dict[int, int] = {}
        n = len(word)
        todo = [(self.root, 0, 0)]
        seen: dict[tuple[int, int], int] = {}
        while todo:
            node, i, e = todo.pop()
            key = (id(node), i)
            if seen.get(key, 99) <= e:
                continue
            seen[key] = e
            if i == n:
                for entry, near in node.get("", {}).items():
                    if (near or not e) and found.get(entry, 99) > e:
                        found[entry] = e
            elif word[i] in node:
                todo.append((node[word[i]], i + 1, e))
            if e < most:
                if i < n:
                    todo.append((node, i + 1, e + 1))
                for c, below in node.items():
                    if c:
                        todo.append((below, i, e + 1))
                        if i < n and c != word[i]:
                            todo.append((below, i + 1, e + 1))
                            if i + 1 < n and c == word[i + 1] and word[i] in below:
                                todo.append((below[word[i]], i + 2, e + 1))
        return found


class Reference:
    """The tries of a list of entries (ref_id, field, name, name_en, aliases)."""

    def __init__(self, entries: list[tuple[int, str, str | None, str | None, str | None]]):
        self.tries: dict[str, Trie] = {}
        self.inside: dict[str, dict[str, int]] = {}
        for ref, field, name, name_en, aliases in sorted(entries):
            trie = self.tries.setdefault(field, Trie())
            inside = self.inside.setdefault(field, {})
            given = [x for x in (name, name_en, *(aliases or "").split(";")) if x and x.strip()]
            for path in map(flat, given):
                short = field != "company" and len(path) <= 2 and path != flat(name or "")
                trie.add(jamo(path), ref, near=not short)
            if field == "company":
                own = flat(name or "")
                for suffix in SUFFIXES:
                    if own.endswith(suffix) and len(own) > len(suffix):
                        stem = own[: -len(suffix)]
                        trie.add(jamo(stem), ref, near=False)
                        for tail in SHORT.get(suffix, []):
                            trie.add(jamo(stem + tail), ref, near=False)
                        break
            else:
                tails = [name[:-1]] if name and name.endswith("직") else []
                for path in map(flat, tails):
                    trie.add(jamo(path), ref, near=len(path) > 2)
                for path in map(flat, [*given, *tails]):
                    if len(path) >= _INSIDE and (path not in inside or ref < inside[path]):
                        inside[path] = ref

    def ranked(self, field: str, value: str) -> tuple[tuple[int, int, int, int], int, int]:
        """(rank, entry, edits) of a value: the lower rank over several references is the answer of all of them together.

        Rank: 0, number of the first reading that is an entry's path, 0, entry; 1, edits, letters of the reading (less is
        more), entry; 2, place and letters of an alias inside the value, entry; 3 if none is meant.
        """
        trie = self.tries.get(field)
        best: tuple[tuple[int, int, int, int], int, int] = ((3, 0, 0, 0), 0, -1)
        if trie is None:
            return best
        for k, reading in enumerate(readings(value)):
            letters = jamo(reading)
            for entry, e in trie.within(letters, distance_for(len(letters))).items():
                best = min(best, ((0, k, 0, entry) if e == 0 else (1, e, -len(reading), entry), entry, e))
            if reading != (single := re.sub(r"([가-힣])\1", r"\1", reading)):
                for entry in trie.within(jamo(single), 0):
                    best = min(best, ((1, 1, -len(reading), entry), entry, 1))
            if best[0][0] == 0:
                return best
        if best[0][0] == 3:
            whole = flat(value)
            for path, entry in self.inside.get(field, {}).items():
                at = whole.find(path)
                if at >= 0:
                    best = min(best, ((2, at, -len(path), entry), entry, 0))
        return best

    def search(self, field: str, value: str) -> tuple[int, int]:
        """(entry, edits) of a value, (0, -1) if none is meant."""
        return self.ranked(field, value)[1:]

    def within(self, field: str, value: str) -> dict[int, int]:
        """All entries within the distance of any reading of a value, with the least edits."""
        out: dict[int, int] = {}
        trie = self.tries.get(field)
        for reading in readings(value) if trie is not None else []:
            letters = jamo(reading)
            for entry, e in trie.within(letters, distance_for(len(letters))).items():
                out[entry] = min(e, out.get(entry, e))
        return out


def readings(value: str) -> list[str]:
    """The whole value, then its parts, then leading and trailing words of each, without repeats."""
    plain = LEGAL.sub(" ", unicodedata.normalize("NFKC", MARKUP.sub(" ", LEGAL.sub(" ", value))))
    out = [flat(value), flat(plain)]
    parts = [p for p in PARTS.split(plain) if p.strip()]
    out += [flat(p) for p in parts]
    for p in [plain, *parts]:
        words = p.split()
        for k in range(len(words) - 1, 0, -1):
            out.append(flat(" ".join(words[:k])))
        for k in range(1, len(words)):
            out.append(flat(" ".join(words[k:])))
    return [x for x in dict.fromkeys(out) if x]


def _blocks(reference: DataFrame, size: int = BLOCK_ENTRIES) -> Iterator[list[tuple]]:
    block: list[tuple] = []
    for r in reference.select("ref_id", "field", "name", "name_en", "aliases").toLocalIterator():
        block.append(tuple(r))
        if len(block) == size:
            yield block
            block = []
    yield block


def all_entries(reference: DataFrame, most: int = 1_000_000) -> list[tuple]:
    """The whole reference for operators that keep it in one trie; more entries than ``most`` raise, none are dropped."""
    out = [x for block in _blocks(reference) for x in block]
    if len(out) > most:
        raise ValueError(f"the reference has {len(out)} entries, more than {most} for one trie")
    return out


def with_aliases(reference: DataFrame, more: DataFrame) -> DataFrame:
    """The reference with further aliases (field, name, alias) added to its own."""
    added = more.groupBy(F.col("field").alias("_f"), F.col("name").alias("_n")).agg(F.concat_ws(";", F.array_sort(F.collect_set("alias"))).alias("_more"))
    joined = reference.join(added, (F.col("field") == F.col("_f")) & (F.col("name") == F.col("_n")), "left")
    whole = F.concat_ws(";", F.nullif(F.col("aliases"), F.lit("")), F.col("_more"))
    return joined.withColumn("aliases", F.nullif(whole, F.lit(""))).select(*reference.columns)


def matched(values: DataFrame, reference: DataFrame, block_entries: int | None = None) -> DataFrame:
    """The rows of ``values`` (field, value and others) with ref_id and edits."""
    every, blocks, kept = None, 0, [f"{c} {t}" for c, t in values.dtypes]
    for block in _blocks(reference, block_entries or BLOCK_ENTRIES):
        if not block and every is not None:
            break
        own = Reference(block)

        def search(batches: Iterator[pa.RecordBatch], own: Reference = own) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [own.ranked(f, v) for f, v in zip(b.column("field").to_pylist(), b.column("value").to_pylist())]
                rank = pa.array([list(g[0]) for g in got], pa.list_(pa.int64()))
                yield pa.record_batch([*b.columns, rank, pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int32())], names=[*b.schema.names, "rank", "ref_id", "edits"])

        part = values.mapInArrow(search, ", ".join([*kept, "rank array<long>", "ref_id long", "edits int"]))
        every, blocks = part if every is None else every.unionByName(part), blocks + 1
    if blocks == 1:  # nothing to compare
        return every.drop("rank")
    return every.groupBy(*values.columns).agg(F.min_by(F.struct("ref_id", "edits"), "rank").alias("m")).select(*values.columns, "m.*")


def cases(postings: DataFrame, reference: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """posting_id, field and value of every typed value that is not blank and not exactly a name."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    typed = postings.select("posting_id", each.alias("v")).select("posting_id", "v.*").where(F.regexp_replace("value", r"(?U)[\s​]+", "") != "")
    names = reference.select(F.col("field").alias("_f"), F.col("name").alias("_n")).where(F.col("_n").isNotNull())
    return typed.join(names, (F.col("field") == F.col("_f")) & (F.col("value") == F.col("_n")), "left_anti")


def answers(typed: DataFrame, reference: DataFrame, block_entries: int | None = None) -> DataFrame:
    """field, value, n (cases that have it), ref_id and edits of the distinct values."""
    distinct = typed.groupBy("field", "value").agg(F.count("*").alias("n")).repartition(task_count(typed.sparkSession))
    return matched(distinct, reference, block_entries)


def found(postings: DataFrame, reference: DataFrame, fields: tuple[str, ...] = FIELDS, block_entries: int | None = None) -> DataFrame:
    """posting_id, field and ref_id of every case."""
    typed = cases(postings, reference, fields).withColumn("_key", F.concat_ws("\x1f", "field", "value"))
    known = written(answers(typed, reference, block_entries).withColumn("_key", F.concat_ws("\x1f", "field", "value")), "answers")
    return lookup(typed, known, "_key", ["ref_id"], "n").select("posting_id", "field", "ref_id")


def unmatched(postings: DataFrame, reference: DataFrame) -> DataFrame:
    """field, value and postings of every typed value that means no entry."""
    return answers(cases(postings, reference), reference).where("ref_id = 0").select("field", "value", F.col("n").alias("postings"))


def entries(postings: DataFrame, reference: DataFrame) -> DataFrame:
    """field, value, ref_id and edits of all entries within the distance of each distinct typed value."""
    distinct = cases(postings, reference).select("field", "value").distinct().repartition(task_count(postings.sparkSession))
    every = None
    for block in _blocks(reference, BLOCK_ENTRIES):
        own = Reference(block)

        def search(batches: Iterator[pa.RecordBatch], own: Reference = own) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(f, v, *x) for f, v in zip(b.column("field").to_pylist(), b.column("value").to_pylist()) for x in own.within(f, v).items()]
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int64(), pa.int32()])], names=["field", "value", "ref_id", "edits"])

        part = distinct.mapInArrow(search, "field string, value string, ref_id long, edits int")
        every = part if every is None else every.unionByName(part)
    return every
