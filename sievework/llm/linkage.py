"""Matching job openings across two listings without a key: probabilistic record linkage.

Titles are read into season, team, role, place and terms, firms into entries of the reference list. Rows that read the
same are collapsed to one profile with its number of rows. Four blocking passes, each on three of firm, season, team and
role, propose pairs of profiles, so one field misread or silent loses no pair; where both sides state a deadline a block is
cut into windows of ``WINDOW`` days, so a firm that holds a third of all rows falls into many small blocks. Pairs are
compared field by field in levels (disagree, near, agree, silent). Expectation-maximisation over the counts of the
comparison patterns estimates how often the levels occur among matches and among non-matches, which are a mixture: chance
pairs of each pass (its own fields agree by construction) and, for every field, siblings that differ in that field. The
posterior of the match class is the confidence, and it alone decides. Pairs are compared where they meet; of
many profiles once to count their patterns and once to keep those the threshold takes, so that what is only proposed is
never written.

Defined results: a field a title doesn't state is silent, it neither agrees nor disagrees; rows without title and firm
match nothing; unreadable deadlines are silent; several board rows may match one firm row; repeated rows match each.
A pair that agrees in fewer than three of firm, season, team and role isn't proposed, nor one more than two windows apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.canonical_values import LEGAL, Reference, Trie, all_entries, distance_for, flat, jamo
from sievework.operators.timestamps import interpret
from sievework.session import written

# The words of titles by field, each with the value it stands for.
WORDS = {
    "kind": {"상반기": "h1", "하반기": "h2", "수시": "any", "1차": "r1", "2차": "r2"},
    "unit": {"감사": "audit", "세무": "tax", "딜자문": "deal", "ma": "ma", "forensic": "forensic", "포렌식": "forensic", "위험자문": "risk", "디지털감사": "digital", "품질관리": "quality"},
    "role": {
        "세무사": "cta", "cta": "cta", "공인회계사": "cpa", "회계사": "cpa", "cpa": "cpa", "자금": "treasury", "재무분석가": "analyst",
        "내부통제": "control", "공시": "disclosure", "가치평가": "valuation", "연결결산": "consolidation", "data": "data", "데이터": "data",
        "auditor": "data", "오디터": "data", "junior": "junior", "jr": "junior", "주니어": "junior", "associate": "junior", "assoc": "junior",
        "어소시에이트": "junior", "tax": "taxan", "택스": "taxan", "애널리스트": "taxan", "analyst": "taxan",
    },
    "city": {"서울": "seoul", "seoul": "seoul", "부산": "busan", "busan": "busan", "대구": "daegu", "daegu": "daegu", "인천": "incheon", "incheon": "incheon", "광주": "gwangju", "gwangju": "gwangju", "대전": "daejeon", "daejeon": "daejeon", "세종": "sejong", "sejong": "sejong", "판교": "pangyo", "pangyo": "pangyo", "remote": "remote", "재택": "remote", "원격": "remote"},
    "area": {"동부": "east", "서부": "west", "남부": "south", "북부": "north", "역앞": "station", "본사": "main"},
    "grade": {"주니어급": "junior", "선임급": "senior", "전임급": "full", "시보급": "trainee", "무관급": "any", "entry급": "entry"},
    "mode": {"상근": "regular", "6개월": "6m", "12개월": "12m", "주4일": "4d", "야간조": "night"},
}
EXPERT = ["전문가", "전문인력", "스페셜리스트", "specialist"]  # of tax: the licensed one
FIELDS = ["firm", "season", "team", "role", "city", "area", "grade", "mode"]
NAMES = [*FIELDS, "deadline"]
MAX_APART = 7
WINDOW = 28  # days of a block
TOGETHER = 200_000  # profiles above which the passes run one after the other and twice, for less disk
LEAST_CONFIDENCE = 0.9
MOST_ERRORS = 0.01  # bound of the share of matches in which a stated field disagrees, by misreading
PRIOR = 2.0  # pairs that the starting values weigh as
DISAGREE, NEAR, AGREE, SILENT = range(4)
_TOKEN = re.compile(r"[^\W_]+")
_YEAR = re.compile(r"(?<!\d)(?:20|['’‘`])(\d{2})(?!\d)")
_NUMBER = re.compile(r"(?<!\d)(\d{1,2}) ?([가-힣]{1,2})(?![가-힣])")


def near(a: str, b: str) -> bool:
    """Whether two words of letters are at most one letter apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i:] or a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


class TitleReader:
    """Reads titles by a trie of the words of all fields; tokens are kept, they repeat."""

    def __init__(self, keep: int = 200_000):
        self.words = [(f, v) for f, own in WORDS.items() for v in own.values()]
        self.trie, k = Trie(), 0
        for own in WORDS.values():
            for word in own:
                self.trie.add(jamo(word), k)
                k += 1
        self.known: dict[str, tuple[str, str] | None] = {}
        self.keep = keep

    def token(self, t: str) -> tuple[str, str] | None:
        if t in self.known:
            return self.known[t]
        letters = jamo(t)
        short = t.isascii() and len(t) < 5 or t[0].isdigit()
        hits = self.trie.within(letters, 0) or ({} if short else self.trie.within(letters, min(1, distance_for(len(letters)))))
        out = self.words[min(hits, key=lambda k: (hits[k], k))] if hits else None
        if len(self.known) < self.keep:
            self.known[t] = out
        return out

    def read(self, title: str | None, location: str | None = None) -> dict[str, str]:
        text = unicodedata.normalize("NFKC", title or "").casefold().replace("m&a", "ma")
        out: dict[str, str] = {}
        year = _YEAR.search(text)
        text = re.sub(r"\d차 충원", " ", text)
        number = ""
        for m in _NUMBER.finditer(text):
            tail = jamo(m[2])
            if near(tail, jamo("본부")):
                number = m[1] + "b"
            elif len(m[2]) == 1 and near(tail, jamo("팀")):
                number = m[1] + "t"
            elif m[1] in "12" and len(m[2]) == 1 and m[2] != "차" and near(tail, jamo("차")):
                out["kind"] = "r" + m[1]
        if any(near(jamo(t), jamo("센터")) for t in _TOKEN.findall(text)):
            number = number or "c"
        trainee = False
        tokens = _TOKEN.findall(text)
        for t, after in zip(tokens, [*tokens[1:], ""]):
            if t == "수습" or near(jamo(t), jamo("수습")) and self.token(after) == ("role", "cpa"):
                trainee = True
                continue
            hit = self.token(t)
            if hit == ("role", "taxan") and any(near(jamo(after), jamo(w)) for w in EXPERT):
                hit = ("role", "cta")
            if hit and (hit[0] not in out or hit[0] == "mode"):
                out[hit[0]] = hit[1]
        if trainee:
            out["role"] = "trainee"
        if "city" not in out:
            for t in _TOKEN.findall(unicodedata.normalize("NFKC", location or "").casefold()):
                hit = self.token(t)
                if hit and hit[0] in ("city", "area"):
                    out.setdefault(hit[0], hit[1])
        got = {k: out[k] for k in ("role", "city", "area", "grade", "mode") if k in out}
        if year and "kind" in out:
            got["season"] = year[1] + out["kind"]
        if "unit" in out and number:
            got["team"] = out["unit"] + number
        return got


def firm_key(reference: Reference, company: str | None, title: str | None = None) -> str | None:
    """The firm's entry, else its own letters; where the company is missing, an entry the title opens with."""
    if company and company.strip():
        ref, _ = reference.search("company", company)
        if ref:
            return f"#{ref}"
        return flat(LEGAL.sub(" ", company)) or None
    first = re.split(r"[\])】:,/|]| - ", re.sub(r"^[^\[(【\w]*", "", title or ""), maxsplit=1)[0].strip("[(【 ★")
    ref, _ = reference.search("company", first) if first else (0, -1)
    return f"#{ref}" if ref else None


def read_rows(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """id, the comparison fields (null: silent) and the deadline's day number of every listing."""
    own = Reference(all_entries(reference))
    schema = "id long, day int, " + ", ".join(f"{f} string" for f in FIELDS)
    dated = interpret(rows.select(F.col("listing_id").alias("id"), "title", "company", "location", F.col("deadline").alias("text"), F.lit("UTC").alias("zone")))
    day = F.floor(F.try_element_at("all", F.lit(1))["ep"] / 86400).cast("int")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, firms = TitleReader(), {}
        for b in batches:
            out: dict[str, list] = {f: [] for f in FIELDS}
            for title, company, location in zip(*(b.column(c).to_pylist() for c in ("title", "company", "location"))):
                got = reader.read(title, location)
                key = company if company and company.strip() else f"\x00{title}"
                if key not in firms:
                    if len(firms) > 200_000:
                        firms.clear()
                    firms[key] = firm_key(own, company, title)
                got["firm"] = firms[key]
                for f in FIELDS:
                    out[f].append(got.get(f))
            yield pa.record_batch([b.column("id"), b.column("day"), *[pa.array(out[f], pa.string()) for f in FIELDS]], names=["id", "day", *FIELDS])

    return dated.select("id", "title", "company", "location", day.alias("day")).mapInArrow(read, schema)


PASSES = [  # fields that must agree in a blocking pass
    ["firm", "season", "team"],
    ["firm", "season", "role"],
    ["firm", "team", "role"],
    ["season", "team", "role"],
]


def profiles(rows: DataFrame) -> DataFrame:
    """Each combination of fields and day once, with its number of rows ``n`` and the smallest id as ``id``."""
    return rows.groupBy(*FIELDS, "day").agg(F.count("*").alias("n"), F.min("id").alias("id"))


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profiles of both listings with columns of their own names."""
    return tuple(p.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("day").alias(f"day_{x}"), *[F.col(f).alias(f"{f}_{x}") for f in FIELDS]) for p, x in ((a, "a"), (b, "b")))


def _all(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, columns)


def proposed(left: DataFrame, right: DataFrame, i: int) -> DataFrame:
    """Pairs of profiles with the columns of both that blocking pass ``i`` proposes and none before it, each once.

    Both sides are sorted whatever they are taken to hold: small files may hold more rows than the driver could broadcast.
    """
    sides = []
    for rows, x in ((left, "a"), (right, "b")):
        day, own = F.col(f"day_{x}"), [F.col(f"{f}_{x}") for f in PASSES[i]]
        window = F.floor(day / WINDOW)
        # a dated row meets the windows beside its own and the rows without a day; a row without a day meets all
        if x == "a":
            when = F.when(day.isNull(), F.array(F.lit("any"))).otherwise(F.array(window.cast("string"), F.lit("dated")))
        else:
            near = F.array(*[(window + k).cast("string") for k in (-1, 0, 1)])
            when = F.when(day.isNull(), F.array(F.lit("any"), F.lit("dated"))).otherwise(F.concat(near, F.array(F.lit("any"))))
        sides.append(rows.where(_all([c.isNotNull() for c in own])).select("*", F.xxhash64(*own).alias("key"), F.explode(when).alias("when")))
    agree = [_all([F.coalesce(F.col(f"{f}_a") == F.col(f"{f}_b"), F.lit(False)) for f in fields]) for fields in PASSES[: i + 1]]
    return sides[0].hint("merge").join(sides[1].hint("merge"), ["key", "when"]).where(_all([agree[i], *[~x for x in agree[:i]]])).drop("key", "when")


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of profiles (a, b) proposed by any blocking pass, each once."""
    sides = _sides(a, b)
    return reduce(DataFrame.unionByName, [proposed(*sides, i).select("a", "b") for i in range(len(PASSES))])


def compare(f: str) -> Column:
    """Level of a field of two rows (columns f_a and f_b)."""
    a, b = F.col(f"{f}_a"), F.col(f"{f}_b")
    if f == "deadline":
        a, b = F.col("day_a"), F.col("day_b")
        near = F.abs(a - b) <= MAX_APART
    elif f == "firm":  # names that aren't in the reference
        near = ~a.startswith("#") & ~b.startswith("#") & (F.levenshtein(a, b) * 4 <= F.least(F.length(a), F.length(b)))
    elif f == "season":
        near = F.substring(a, 1, 2) == F.substring(b, 1, 2)
    elif f == "team":
        near = F.regexp_replace(a, r"\d.*$|c$", "") == F.regexp_replace(b, r"\d.*$|c$", "")
    else:
        near = F.lit(False)
    return F.when(a.isNull() | b.isNull(), SILENT).when(a == b, AGREE).when(near, NEAR).otherwise(DISAGREE)


class Mixture:
    """The match class, a chance class a pass and a sibling class a field, fitted to counts of patterns by EM.

    A pattern holds the level of every field. Silence is as likely in every class and left out; a pass's class explains
    only pairs that agree in its fields, a field's sibling class only pairs that differ in it.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, chance: np.ndarray, rounds: int = 200):
        n = len(NAMES)
        names = ["match", *[f"pass {i}" for i in range(len(PASSES))], *[f"sibling {f}" for f in NAMES]]
        p = np.tile(np.array([0.02, 0.03, 0.95]), (len(names), n, 1))  # (class, field, level)
        fixed = np.zeros((len(names), n, 3), dtype=bool)  # levels a class can't have
        p[0, :] = (0.005, 0.005, 0.99)
        p[0, -1] = (0.005, 0.4, 0.595)
        for i, fields in enumerate(PASSES):
            p[1 + i] = np.stack([0.8 * (1 - chance), 0.2 * (1 - chance), chance], axis=1)
            for f in fields:
                fixed[1 + i, NAMES.index(f), :AGREE] = True
        for f in range(n):
            k = 1 + len(PASSES) + f
            fixed[k, f, AGREE] = True
            if NAMES[f] == "deadline":
                fixed[k, f, NEAR] = True
        p = np.where(fixed, 0.0, p)
        p /= p.sum(2, keepdims=True)
        share = np.array([0.3, *[0.4 / len(PASSES)] * len(PASSES), *[0.3 / n] * n])
        possible = np.ones((len(names), len(patterns)), dtype=bool)
        for f in range(n):
            possible[1 + len(PASSES) + f] = patterns[:, f] != SILENT
        for i, fields in enumerate(PASSES):
            possible[1 + i] = np.all([patterns[:, NAMES.index(f)] == AGREE for f in fields], axis=0)
        self.names = names
        start, first = p.copy(), share.copy()  # priors that weigh as few pairs, for small inputs
        for _ in range(rounds):
            like = np.where(possible, share[:, None], 0.0)
            for f in range(n):
                level = patterns[:, f]
                like *= np.where(level == SILENT, 1.0, p[:, f, :][:, np.minimum(level, AGREE)])
            post = like / np.maximum(like.sum(0), 1e-300)
            w = post * counts
            old, share = share, (w.sum(1) + PRIOR * first) / (w.sum() + PRIOR)
            for f in range(n):
                seen = np.stack([w[:, patterns[:, f] == x].sum(1) for x in range(3)], axis=1) + PRIOR * start[:, f]
                seen = np.where(fixed[:, f], 0.0, seen)
                own = seen / seen.sum(1, keepdims=True)
                top = MOST_ERRORS if NAMES[f] == "deadline" else MOST_ERRORS / 2
                held = np.minimum(own[0], [top, 1.0 if NAMES[f] == "deadline" else top, 1.0])
                held[AGREE] += 1 - held.sum()
                p[:, f] = own
                p[0, f] = held
            if np.abs(share - old).max() < 1e-9:
                break
        self.share, self.levels, self.posterior = share, p, post[0]


def _expanded(scored: DataFrame, a: DataFrame, pa_: DataFrame, b: DataFrame, pb: DataFrame) -> DataFrame:
    """Pairs of profiles to pairs of rows."""
    for side, rows, own in (("a", a, pa_), ("b", b, pb)):
        same = reduce(lambda x, y: x & y, [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*FIELDS, "day"]])
        member = rows.alias("r").hint("merge").join(own.alias("p").hint("merge"), same).select(F.col("p.id").alias(side), F.col("r.id").alias(f"row_{side}"))
        scored = scored.hint("merge").join(member.hint("merge"), side)
    return scored.select(F.col("row_a").alias("a"), F.col("row_b").alias("b"), "confidence")


def link(board: DataFrame, firm: DataFrame, reference: DataFrame, least: float | None = None) -> DataFrame:
    """listing_a, listing_b (smaller id first) and confidence of the proposed pairs, those below ``least`` left out."""
    a, b = written(read_rows(board, reference), "board"), written(read_rows(firm, reference), "firm")
    pa_, pb = written(profiles(a), "board-profiles"), written(profiles(b), "firm-profiles")
    sides = _sides(pa_, pb)
    code = reduce(lambda x, y: x + y, [compare(f).cast("long") * 4**i for i, f in enumerate(NAMES)]).alias("code")
    alone = pa_.count() + pb.count() > TOGETHER
    steps = [[i] for i in range(len(PASSES))] if alone else [[*range(len(PASSES))]]
    pairs = [reduce(DataFrame.unionByName, [proposed(*sides, i).select("a", "b", code, (F.col("n_a") * F.col("n_b")).alias("n")) for i in step]) for step in steps]
    if not alone:
        pairs = [written(p, "compared") for p in pairs]
    counts = [written(p.groupBy("code").agg(F.sum("n").alias("n")), "patterns") for p in pairs]
    grouped = reduce(DataFrame.unionByName, counts).groupBy("code").agg(F.sum("n").alias("n")).collect()  # at most 4^9 patterns
    if not grouped:
        return pa_.select(F.col("id").alias("listing_a"), F.col("id").alias("listing_b"), F.lit(0.0).alias("confidence")).limit(0)
    codes = np.array([r["code"] for r in grouped], dtype=np.int64)
    patterns = (codes[:, None] >> (2 * np.arange(len(NAMES)))) & 3
    fitted = Mixture(patterns, np.array([r["n"] for r in grouped], dtype=float), chance_agreement(pa_, pb))
    known = [(int(c), float(x)) for c, x in zip(codes, fitted.posterior) if least is None or x >= least]
    table = a.sparkSession.createDataFrame(known or [(-1, 0.0)], "code long, confidence double")  # at most 4^9 rows
    scored = reduce(DataFrame.unionByName, [written(p.join(F.broadcast(table), "code").select("a", "b", "confidence"), "scored") for p in pairs])
    return _expanded(scored, a, pa_, b, pb).select(F.least("a", "b").alias("listing_a"), F.greatest("a", "b").alias("listing_b"), "confidence")


def chance_agreement(a: DataFrame, b: DataFrame) -> np.ndarray:
    """How often two rows agree in each field by chance, from the values of all rows in one pass; where EM starts."""
    each = lambda d, side: d.select(F.lit(side).alias("side"), "n", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("v")) for i, f in enumerate(FIELDS)])).alias("x"))
    rows = each(a, 0).unionByName(each(b, 1)).where("x.v is not null")
    on = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).cast("double")
    values = rows.groupBy("x.f", "x.v").agg(on(0).alias("na"), on(1).alias("nb"))
    met = {r["f"]: r for r in values.groupBy("f").agg(F.sum(F.col("na") * F.col("nb")).alias("met"), (F.sum("na") * F.sum("nb")).alias("all")).collect()}  # one row a field
    own = [met[i]["met"] / met[i]["all"] if i in met and met[i]["all"] else 0.1 for i in range(len(FIELDS))]
    return np.clip(np.array([*own, 0.1]), 1e-4, 0.9)


def found(board: DataFrame, firm: DataFrame, reference: DataFrame) -> DataFrame:
    """listing_a and listing_b of the pairs whose confidence that they are one opening is at least ``LEAST_CONFIDENCE``."""
    return link(board, firm, reference, LEAST_CONFIDENCE).select("listing_a", "listing_b")
