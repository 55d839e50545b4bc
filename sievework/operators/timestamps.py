"""Mixed timestamp formats and zones to one unambiguous form.

Each text gets the array of all its valid interpretations (JVM side, built-in expressions only). A source's records in
their order form a chain; Viterbi picks one interpretation per record, at least cost: reading against the source's date
order weighs most, then format switches and backward time jumps between neighbours. A chain of any length is cut into
the sorted partitions of a range shuffle; each partition gives the (min, +) transfer matrix between the states of its
first and its last record, the matrices of the at most two cut pieces a partition has are composed on the driver, and a
second pass decodes every partition between the states so fixed. That equals one Viterbi run over the whole chain.

Defined results: null, blank and unreadable texts have no interpretation and no row; a null or unlisted source has no
date order (all orders weigh the same) and ``default_zone``; ties in the order are broken by record id; the cheapest
path with the first listed interpretation wins among equals; repeated rows are decided each on its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import cut, task_count

# Month names as they are written, and zone abbreviations with their offset from UTC in seconds.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "KST": 32400, "JST": 32400, "BST": 3600, "EST": -18000, "EDT": -14400, "CST": -21600,
    "CDT": -18000, "MST": -25200, "MDT": -21600, "PST": -28800, "PDT": -25200, "CET": 3600, "CEST": 7200,
    "AEST": 36000, "AEDT": 39600, "SGT": 28800, "HKT": 28800, "IST": 19800,
}
ORDERS = ["ymd", "dmy", "mdy"]

SEP = "\u0001"
_WIDE = "０１２３４５６７８９．／－：，　 〜～–−"
_PLAIN = "0123456789./-:,  ~~--"
_SHAPE = (
    r"^(?:(\d{4}) ?[-./년] ?(\d{1,2}) ?[-./월] ?(\d{1,2}) ?[.일]?"  # 1-3 year first
    r"|(\d{1,2})([-./])(\d{1,2})\5(\d{4}|\d{1,2})\.?"  # 4-7 numbers whose order is open
    r"|(\d{1,2})[ -]([A-Za-z]{3,9})\.?[ -](\d{4})"  # 8-10 day, month name, year
    r"|([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})"  # 11-13 month name, day, year
    r"|(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2}))?)"  # 14-19 compact
    r"(?:[T,]? ?(오전|오후)? ?(\d{1,2})(?::|시 ?)(\d{1,2})?분?(?::(\d{2})(?:[.,]\d+)?)?"  # 20-23
    r" ?(?:([AaPp])\.?[Mm]\.?)? ?([+-]\d{2}:?\d{2}|[A-Z]{1,5})?)?$"  # 24, 25
)
_GROUPS = 25


def _clean(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.translate(text, _WIDE, _PLAIN), r"(?U)\s+", " "))
    t = F.regexp_replace(
        t,
        r"^~ ?| ?까지$| ?\((?:[월화수목금토일]|Mon|Tue|Wed|Thu|Fri|Sat|Sun)(?:요일)?\)|^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? ",
        "",
    )
    return F.regexp_replace(t, r",? at ", " ")


def interpret(df: DataFrame, default_zone: str = "UTC") -> DataFrame:
    """Add ``all``, the valid interpretations of column text as ``array<struct<fmt int, ep bigint, day boolean>>``.

    ``ep`` is the UTC second, for a date without time the second of its midnight; ``fmt`` the date order read (3: none
    was open). Columns zone is the zone of the source. Each step is a projection of its own, so that the patterns run
    once a row.
    """
    part = lambda i: F.col("_g")[i - 1]
    has = lambda i: part(i) != ""
    number = lambda i: F.when(has(i), part(i).cast("int"))
    month = lambda i: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(i), 1, 3))).cast("int"), F.lit(0))
    whole = lambda i: number(i) + F.when(F.length(part(i)) == 2, 2000).when(F.length(part(i)) == 4, 0)

    def date(y: Column, m: Column, d: Column) -> Column:
        return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), F.format_string("%04d-%02d-%02d", y, m, d)).try_cast("date")

    df = df.withColumn("_t", _clean(F.col("text")))
    df = df.withColumn("_g", F.split(F.regexp_replace("_t", _SHAPE, SEP.join(f"${i}" for i in range(1, _GROUPS + 1))), SEP))
    df = df.withColumn("_g", F.when(F.size("_g") == _GROUPS, F.col("_g")))
    h0 = F.coalesce(number(21), number(17))
    half = F.when((part(20) == "오전") | (F.lower(part(24)) == "a"), 0).when((part(20) == "오후") | (F.lower(part(24)) == "p"), 12)
    named = F.create_map(*[x for k, v in ZONES.items() for x in (F.lit(k), F.lit(v))])
    mark = part(25)
    df = df.withColumns(
        {
            "_d0": F.when(has(4) & (F.length(part(4)) == 2) & (F.length(part(7)) <= 2), date(number(4) + 2000, number(6), number(7))),
            "_d1": F.when(has(4), date(whole(7), number(6), number(4))),
            "_d2": F.when(has(4), date(whole(7), number(4), number(6))),
            "_d3": F.when(has(1), date(number(1), number(2), number(3)))
            .when(has(8), date(number(10), month(9), number(8)))
            .when(has(11), date(number(13), month(11), number(12)))
            .when(has(14), date(number(14), number(15), number(16))),
            "_h": F.when(half.isNotNull(), F.when(h0.between(1, 12), h0 % 12 + half).when(h0 == 0, half).when((half == 12) & (h0 < 24), h0)).otherwise(h0),
            "_m": F.coalesce(number(22), number(18), F.lit(0)),
            "_s": F.coalesce(number(23), number(19), F.lit(0)),
            "_timed": has(21) | has(17),
            "_mark": mark,
            "_offset": F.when(
                mark.rlike(r"^[+-]"),
                (F.substring(mark, 2, 2).cast("int") * 3600 + F.regexp_extract(mark, r"(\d{2})$", 1).cast("int") * 60)
                * F.when(mark.startswith("-"), -1).otherwise(1),
            ).when(mark != "", F.try_element_at(named, mark)),
            "_zone": F.coalesce(F.col("zone"), F.lit(default_zone)),
        }
    )
    h, mi, s = F.col("_h"), F.col("_m"), F.col("_s")
    df = df.withColumn(
        "_second",
        F.when((h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)) | ((h == 24) & (mi == 0) & (s == 0)), h * 3600 + mi * 60 + s),
    )
    zero = F.lit("1970-01-01").cast("date")
    df = df.withColumns({f"_l{k}": F.datediff(f"_d{k}", zero).cast("long") * 86400 + F.when(F.col("_timed"), F.col("_second")).otherwise(0) for k in range(4)})
    silent = F.col("_timed") & (F.col("_mark") == "")
    df = df.withColumns({f"_u{k}": F.when(silent, F.to_utc_timestamp(F.timestamp_seconds(f"_l{k}"), F.col("_zone"))) for k in range(4)})

    def ep(k: int) -> Column:
        wall, utc = F.col(f"_l{k}"), F.col(f"_u{k}")
        there = F.when(F.unix_seconds(F.from_utc_timestamp(utc, F.col("_zone"))) == wall, F.unix_seconds(utc))
        return F.when(~F.col("_timed"), wall).when(silent, there).otherwise(wall - F.col("_offset"))

    digits = F.when(F.col("_t").rlike(r"^(?:\d{10}|\d{13})$"), F.substring("_t", 1, 10).cast("long"))
    df = df.withColumns({**{f"_e{k}": ep(k) for k in range(3)}, "_e3": F.coalesce(digits, ep(3))})
    day = F.coalesce(~F.col("_timed"), F.lit(False))
    every = F.array(*[F.when(F.col(f"_e{k}").isNotNull(), F.struct(F.lit(k).alias("fmt"), F.col(f"_e{k}").alias("ep"), day.alias("day"))) for k in range(4)])
    return df.withColumn("all", F.array_compact(every)).drop(*[c for c in df.columns if c.startswith("_")])


def plain_day(c: Column) -> Column:
    """Whether a text is a real date written yyyy-mm-dd: nothing is left to interpret."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(), F.lit(False))


def plain_second(c: Column) -> Column:
    """Whether a text is a real time written yyyy-mm-ddThh:mm:ss, without a zone."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$") & c.try_cast("timestamp_ntz").isNotNull(), F.lit(False))


def normal_form(ep: Column, day: Column) -> Column:
    """``yyyy-mm-dd`` of a date, ``yyyy-mm-ddThh:mm:ssZ`` of an instant; the session's zone has no part in it."""
    on = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ep / 86400).cast("int"))
    rest = F.pmod(ep, F.lit(86400))
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.concat(on.cast("string"), F.when(day, "").otherwise(clock))


AGAINST_ORDER, SWITCH, BACK = 8, 1, 1


class _Chain:
    """Rows of one chain inside one partition as flat arrays; costs and Viterbi over the rows with a choice."""

    def __init__(self, starts: np.ndarray, packed: np.ndarray):
        self.starts, self.packed = starts, packed
        self.n = len(starts) - 1

    def states(self, i: int) -> list[tuple[int, int, int]]:
        """(fmt, ep, own cost) of each interpretation of row i."""
        return [((int(p) >> 3) & 3, int(p) >> 5, AGAINST_ORDER * ((int(p) >> 2) & 1)) for p in self.packed[self.starts[i] : self.starts[i + 1]]]


def _step(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    return b[2] + SWITCH * (a[0] != b[0]) + BACK * (b[1] < a[1])


def _decode(chain: _Chain, picked: np.ndarray, first: int | None = None, last: int | None = None) -> None:
    """Fill ``picked`` with the index of the chosen interpretation; first and last fix the states at the ends.

    A row with one interpretation separates the chain, so only runs of rows with a choice are walked.
    """
    sizes = np.diff(chain.starts)
    picked[:] = 0
    if first is not None:
        picked[0] = first
    if last is not None and (chain.n > 1 or first is None):
        picked[-1] = last
    choice = np.flatnonzero(sizes > 1)
    fixed = {0} if first is not None else set()
    if last is not None:
        fixed.add(chain.n - 1)
    todo = [i for i in choice if int(i) not in fixed]
    i = 0
    while i < len(todo):
        j = i
        while j + 1 < len(todo) and todo[j + 1] == todo[j] + 1:
            j += 1
        lo, hi = int(todo[i]), int(todo[j])
        before = chain.states(lo - 1)[picked[lo - 1]] if lo else None
        after = chain.states(hi + 1)[picked[hi + 1]] if hi + 1 < chain.n else None
        best, back = [s[2] if before is None else _step(before, s) for s in chain.states(lo)], []
        old = chain.states(lo)
        for k in range(lo + 1, hi + 1):
            new = chain.states(k)
            came = [min(range(len(old)), key=lambda x, s=s: (best[x] + _step(old[x], s), x)) for s in new]
            best = [best[x] + _step(old[x], s) for x, s in zip(came, new)]
            back.append(came)
            old = new
        if after is not None:
            best = [b + _step(s, after) for b, s in zip(best, old)]
        at = min(range(len(best)), key=lambda x: (best[x], x))
        for k in range(hi, lo - 1, -1):
            picked[k] = at
            if k > lo:
                at = back[k - lo - 1][at]
        i = j + 1


def _transfer(chain: _Chain) -> tuple[list, list, list[list[float]]]:
    """States of the first and last row, and the least cost between each two of them (own cost of the first included).

    Between two rows with one interpretation each the cost is the same on every path and left out.
    """
    sizes = np.diff(chain.starts)
    choice = np.flatnonzero(sizes > 1)
    steps = np.unique(np.clip(np.concatenate([[0, chain.n - 1], choice - 1, choice, choice + 1]), 0, chain.n - 1))
    first, last = chain.states(0), chain.states(chain.n - 1)
    if not len(choice):
        return first, last, [[0]]
    cost = []
    for f in range(len(first)):
        best, old = [s[2] if x == f else float("inf") for x, s in enumerate(first)], first
        for k in steps[1:]:
            new = chain.states(int(k))
            best = [min(b + _step(o, s) for b, o in zip(best, old)) for s in new]
            old = new
        cost.append(best)
    return first, last, cost


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """The chains of a sorted partition, each as one table; a chain inside a partition is bounded by the partition."""
    key, held = None, []
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column("packed")), 0))
        if not batch.num_rows:
            continue
        kinds, sources = batch.column("kind"), batch.column("source")
        codes = pc.dictionary_encode(pc.binary_join_element_wise(kinds, pc.fill_null(pc.binary_join_element_wise("=", sources, ""), "-"), SEP))
        marks = np.asarray(codes.indices)
        cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            own = codes.dictionary[int(marks[lo])].as_py()
            if key is not None and own != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def _chain(rows: pa.Table) -> _Chain:
    lists = rows.column("packed").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    starts = np.asarray(lists.offsets)
    return _Chain(starts - starts[0], np.asarray(lists.flatten()))


def choose(values: DataFrame, sources: DataFrame, default_zone: str = "UTC", tasks: int | None = None) -> DataFrame:
    """One interpretation for every readable value.

    ``values``: kind S (names record kind and field), id L, source S, ord (any order), text S; ``sources``: source,
    zone, date_order. Gives kind, id, fmt, normal and ``same`` (the text was in that form already).
    """
    spark = values.sparkSession
    known = sources.select(F.col("source").alias("_s"), "zone", "date_order").dropDuplicates(["_s"])
    joined = values.join(known, values["source"] == known["_s"], "left").select("kind", "id", "source", "ord", "text", "zone", "date_order")
    tasks = tasks or task_count(spark)
    keys = ["kind", "source", "ord", "id"]
    # the keys don't depend on the reading: rows are ranged and sorted raw, so that the sample of the range shuffle reads no text
    placed = joined.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    read = interpret(placed, default_zone)  # a filter on its result would be pushed down and repeat all its steps
    place = F.array_position(F.array(*map(F.lit, ORDERS)), F.col("date_order")) - 1

    def pack(x: Column) -> Column:
        against = (x["fmt"] < 3) & (place >= 0) & (x["fmt"] != place)
        same = normal_form(x["ep"], x["day"]) == F.col("text")
        flag = lambda c: F.when(c, 1).otherwise(0)
        return x["ep"] * 32 + x["fmt"] * 8 + flag(against) * 4 + flag(same) * 2 + flag(x["day"])

    held = cut(read.select("kind", "source", "id", F.transform("all", pack).alias("packed")))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        found, number = [], 0
        for key, rows in _pieces(batches):
            piece = (part, number, key, *_transfer(_chain(rows)))
            found = [found[0], piece] if found else [piece]  # the first and the last piece only
            number += 1
        for p in found:
            yield pa.RecordBatch.from_pylist([{"part": p[0], "number": p[1], "key": p[2], "ends": json.dumps(p[3:])}])

    pieces = held.mapInArrow(ends, "part long, number long, key string, ends string").collect()  # two rows a partition at most
    fixed = _compose([(r["part"], r["number"], r["key"], r["ends"]) for r in pieces])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, (_, rows) in enumerate(_pieces(batches)):
            chain = _chain(rows)
            picked = np.zeros(chain.n, dtype=np.int64)
            _decode(chain, picked, *fixed.get((part, number), (None, None)))
            chosen = chain.packed[chain.starts[:-1] + picked]
            out = pa.table({"kind": rows.column("kind"), "id": rows.column("id"), "chosen": pa.array(chosen)})
            yield from out.to_batches(max_chunksize=20000)

    done = held.mapInArrow(decide, "kind string, id long, chosen long")
    c = F.col("chosen")
    ep, day = F.shiftright(c, 5), c.bitwiseAND(1) == 1
    return done.select("kind", "id", F.shiftright(c, 3).bitwiseAND(3).cast("int").alias("fmt"), normal_form(ep, day).alias("normal"), (c.bitwiseAND(2) == 2).alias("same"))


def _compose(pieces: list[tuple[int, int, str, str]]) -> dict[tuple[int, int], tuple[int | None, int | None]]:
    """States at the ends of the pieces of chains that run over several partitions."""
    pieces = sorted(pieces)
    runs: list[list[tuple]] = []
    for part, number, key, ends in pieces:
        item = (part, number, key, *json.loads(ends))
        if runs and runs[-1][-1][2] == key:
            runs[-1].append(item)
        else:
            runs.append([item])
    out: dict[tuple[int, int], tuple[int | None, int | None]] = {}
    for run in runs:
        if len(run) < 2:
            continue
        best, trail = None, []  # best[l]: least cost up to the last state l of the piece so far
        old: list = []
        for _, _, _, first, last, cost in run:
            if best is None:
                enter = [(0, -1)] * len(first)
            else:
                enter = [min((best[x] + _step(old[x], s) - s[2], x) for x in range(len(old))) for s in first]
            went = [min((enter[f][0] + cost[f][x], f) for f in range(len(first))) for x in range(len(last))]
            trail.append((enter, [f for _, f in went]))
            best, old = [c for c, _ in went], last
        at = min(range(len(best)), key=lambda x: (best[x], x))
        for (part, number, *_), (enter, came) in zip(reversed(run), reversed(trail)):
            f = came[at]
            out[part, number] = (f, at)
            at = enter[f][1]
    return out


def found(postings: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Every readable deadline, posted_date and published_at that is not yet in normal form, with that form."""

    def melt(df: DataFrame, kind: str, key: str, at: str, fields: list[str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(f"{kind}{SEP}{f}").alias("kind"), F.col(f).alias("text")) for f in fields]))
        return df.select(F.col(key).alias("id"), "source", F.col(at).alias("ord"), each.alias("v")).select("v.kind", "id", "source", "ord", "v.text")

    values = melt(postings, "posting", "posting_id", "scraped_at", ["deadline", "posted_date"]).unionByName(
        melt(articles, "article", "article_id", "fetched_at", ["published_at"])
    )
    chosen = choose(values.where(F.col("text").rlike(r"\d")), sources)
    kind = F.split("kind", SEP)
    return chosen.where(~F.col("same")).select(
        kind[0].alias("record_kind"), F.col("id").alias("record_id"), kind[1].alias("field"), "normal"
    )
