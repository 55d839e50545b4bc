"""Sentence units of every document, by a linear-chain model over its characters and Viterbi decoding.

Each character is tagged as boundary or inside. Characters that can't be a boundary are passed over, so the chain runs over
events: closing marks with their tail, closing quotation marks after one, blanks beside letters of scripts that are written
without closing marks (Thai, Lao, Khmer, Myanmar), and every joint between letters of a long Chinese or Japanese line
without any mark. The state is the tag of the last event and the quotation that is open. Scores of tags come from features
of the context, scores of transitions from the last tag and the distance; all weights are learned by a structured averaged
perceptron (``train``) that starts from zero, on joined lines of texts that put a sentence on each line: as they are, in
lower case, and for scripts without closing marks with all punctuation stripped. ``sentence_weights.json`` holds them.

A line end closes a unit, except in texts wrapped to a line width, where only an empty line does. A line with a list mark
is one unit. Defined results: null, empty and blank texts have no rows; every other character lies in one unit; positions
are code points; repeated documents are split each on its own; lang is not read.
"""

from __future__ import annotations

import json
import pkgutil
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Abbreviations by what may follow them.
NEVER_LAST = set(
    "st mt dr mr mrs ms prof fig figs sec secs no nos vol vols pp p vs e.g i.e approx rev ver ca z b d h bzw nr str "
    "प्रो डॉ श्री gen col rep sen cf al inc ltd co corp dept est jan feb mar apr jun jul aug sep sept oct nov dec".split()
)
SELDOM_LAST = set("a.m p.m u.s u.k usw etc".split())
GERMAN = set("der die das den dem und ist auf für mit auch mehr sagt im".split())
LIST_MARK = re.compile(r"(?:\(?\d{1,3}[.)]|[가나다라마바사아자차카타파하][.)]|[Ⅰ-Ⅻ]+\.|[•·※▶○●◦‣*–-])(?=\s)")
SPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"  # scripts whose sentences end at blanks: Thai, Lao, Myanmar, Khmer
WIDE = "。！？।॥｡؟۔።။།༎។៕։"  # closing marks that need no blank after them
EVENT = re.compile(
    rf"(?P<end>(?:[.!?…{WIDE}]+[~^ㅋㅎㅠㅜ]*|(?<=[가-힣)])[~^ㅋㅎㅠㅜ]+(?:[.!?…]+)?)(?: ?[ㅋㅎㅠㅜ]{{2,}})?|(?<=[가-힣]) [ㅋㅎㅠㅜ]{{2,}})"
    r"|(?P<open>[“‘„「『（(【《〈])|(?P<close>[”’」』）)】》〉])|(?P<both>\")"
    rf"|(?P<gap>(?<=[{SPACED}])[ \u00a0\t]+(?=\S)|(?<=[^\s])[ \u00a0\t]+(?=[{SPACED}]))"
)
JOINT = re.compile(r"(?<=[\u3040-\u30ff\u3400-\u9fff\u3005])(?=[\u3040-\u30ff\u3400-\u9fff])")
MARKS = re.compile(rf"[.!?…,，、;；:：{WIDE}]")
LONG = 60  # letters of a line without any mark that may hold several sentences
PAIR = {"“": "”", "‘": "’", "„": "“", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "《": "》", "〈": "〉", '"': '"'}
STRIP = re.compile(rf"[.!?…,、，;；:：{WIDE}]")
LINE = re.compile(r"\r\n|[\n\r  \u0085\u000b\u000c]")
_WORD = re.compile(r"[^\s\d.\"“„‘「(（&]+(?:\.[^\s\d.]+)*$")
WEIGHTS = json.loads(pkgutil.get_data("sievework.llm", "sentence_weights.json") or b"{}")


@lru_cache(20_000)
def _kind(ch: str) -> str:
    """Class of a character; empty: the text's end."""
    if not ch:
        return "edge"
    o = ord(ch)
    if ch.isspace():
        return "blank"
    if ch.isdigit():
        return "digit"
    if 0xAC00 <= o <= 0xD7A3 or 0x3130 <= o <= 0x318F:
        return "hangul"
    if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or o == 0x3005:
        return "cjk"
    if 0x0E00 <= o <= 0x0EFF or 0x1000 <= o <= 0x109F or 0x1780 <= o <= 0x17FF:
        return "spaced"
    if 0x0900 <= o <= 0x097F:
        return "deva"
    if ch.isalpha():
        return "upper" if ch.isupper() else "lower" if ch.islower() else "letter"
    return "open" if ch in PAIR else "mark"


Context = tuple[str, ...]


def context(text: str, start: int, lo: int, hi: int, german: bool) -> Context:
    """What a boundary after the event text[lo:hi] of the block that begins at ``start`` is judged by."""
    before, mark = text[lo - 1] if lo > start else "", text[lo:hi].strip()
    k = hi
    while k < len(text) and text[k].isspace():
        k += 1
    nxt, prev = _kind(text[k] if k < len(text) else ""), _kind(before)
    if not mark:
        return "gap", prev, nxt
    gap = "blank" if k > hi else "joined"
    if mark in CLOSERS:
        return "quote", mark, prev, gap, nxt
    sort = "stop" if mark == "." else "dots" if mark[0] in "….." and set(mark) <= {".", "…"} else "wide" if mark[0] in WIDE else "ask" if mark[0] in "?!" else "tail"
    word = ""
    if sort == "stop":
        m = _WORD.search(text, max(start, lo - 12), lo)
        own = m.group().lower().rstrip(".") if m else ""
        word = "never" if own in NEVER_LAST else "seldom" if own in SELDOM_LAST else "initial" if len(own) == 1 and before.isupper() else "german" if german else "few" if len(own) < 4 else "word"
    return sort, prev, gap, nxt, word


def features(c: Context) -> list[str]:
    """Features of the tag boundary in a context; without any the tag inside scores 0."""
    if c[0] == "unmatched":
        return ["unmatched", f"unmatched {c[1]}"]
    if c[0] == "gap":
        return ["gap", f"gap {c[1]} {c[2]}"]
    if c[0] == "quote":
        return ["quote", f"quote {c[3]} {c[4]}", f"quote {c[1]} {c[3]} {c[4]}"]
    if c[0] == "joint":
        return [f"joint {c[1]}|", f"joint |{c[2]}", f"joint {c[1][-1:]}|{c[2][:1]}", f"joint {c[1][-1:]}|", f"joint |{c[2][:1]}", "joint"]
    sort, prev, gap, nxt, word = c
    out = [sort, f"{sort} {gap}", f"{sort} {gap} {nxt}", f"{sort} {prev} {gap}"]
    if word:
        out += [f"stop {word}", f"stop {word} {nxt}", f"stop {word} {gap}", f"stop {prev} {word} {gap} {nxt}"]
    return out


def steps_of(last: str, sort: str, distance: int) -> list[str]:
    """Features of the transition from the last event's tag to a boundary, over some letters; the tag inside scores 0."""
    return [f"{last}>B", f"{last}>B {'near' if distance < 4 else 'far'}"]


class Scorer:
    """Weights with the scores of contexts and transitions met so far, which repeat."""

    def __init__(self, weights: dict[str, float], keep: int = 200_000):
        self.weights, self.keep = weights, keep
        self.known: dict[Context, float] = {}
        self.steps: dict[tuple[str, str, bool], float] = {}

    def boundary(self, c: Context) -> float:
        got = self.known.get(c)
        if got is None:
            got = sum(self.weights.get(f, 0.0) for f in features(c))
            if len(self.known) < self.keep:
                self.known[c] = got
        return got

    def step(self, last: str, sort: str, distance: int) -> float:
        key = (last, sort, distance < 4)
        got = self.steps.get(key)
        if got is None:
            got = self.steps[key] = sum(self.weights.get(f, 0.0) for f in steps_of(last, sort, distance))
        return got


CLOSERS = "”’」』）)】》〉\""
UNMATCHED = -6.0  # of a quotation mark without its other half, before learning


def _joints(text: str, start: int, stop: int) -> list[tuple[int, int, str]]:
    """Joints of a long line of Chinese or Japanese letters without any mark."""
    if stop - start < LONG or MARKS.search(text, start, stop):
        return []
    return [(m.start(), m.start(), "joint") for m in JOINT.finditer(text, start + 1, stop)]


_IN, _END = (None, "I"), (None, "B")


def _put(paths: dict, key: tuple, value: float, trail: tuple | None) -> None:
    old = paths.get(key)
    if old is None or value > old[0]:
        paths[key] = (value, trail)


def decode(text: str, start: int, stop: int, scorer: Scorer, want: set[int] | None = None, stripped: bool = False) -> tuple[list[int], list[tuple]]:
    """Boundaries inside text[start:stop] on the best path, whose end is one by itself, and the path's steps.

    With ``want`` only paths whose boundaries are these positions, as far as events stand there. ``stripped``: every joint
    of letters is an event.
    """
    block = text[:stop]
    words = set(re.findall(r"[a-zäöüß]+", block[start:].lower()))
    german = len(GERMAN & words) >= 2 and not re.search(r"[가-힣]", block[start:])
    events: list[tuple[int, int, str]] = [(*m.span(), m.lastgroup) for m in EVENT.finditer(block, start)]
    joints = [(m.start(), m.start(), "joint") for m in JOINT.finditer(block, start + 1)] if stripped else _joints(block, start, stop)
    if joints:
        events = sorted(events + joints)
    # paths: (quotation's closing mark or None, last tag) -> (score, trail)
    paths: dict[tuple[str | None, str], tuple[float, tuple | None]] = {(None, "B"): (0.0, None)}
    at = start
    for lo, hi, kind in events:
        new: dict[tuple[str | None, str], tuple[float, tuple | None]] = {}

        if kind in ("end", "gap", "joint"):
            if kind == "end" and len(paths) <= 2 and all(k[0] is None for k in paths):
                while hi < stop and block[hi] == "'":
                    hi += 1
            if kind == "joint":
                c, place = ("joint", block[max(start, lo - 2) : lo], block[lo : lo + 2]), lo
            else:
                c, place = context(block, start, lo, hi, german), lo if kind == "gap" else hi
            score, distance = scorer.boundary(c), lo - at
            for key, (value, trail) in paths.items():
                if key[0] is not None or place >= stop:  # the block's end is a boundary by itself
                    _put(new, key, value, trail)
                else:
                    if want is None or place not in want:
                        _put(new, _IN, value, (None, c, key[1], distance, trail))
                    if want is None or place in want:
                        _put(new, _END, value + score + scorer.step(key[1], c[0], distance), (place, c, key[1], distance, trail))
            at = hi
        else:
            mark = block[lo:hi]
            apostrophe = mark == "’" and lo > start and block[lo - 1].isalpha() and hi < stop and block[hi].isalpha() and _kind(block[hi]) in ("lower", "upper")
            loose = UNMATCHED + scorer.boundary(("unmatched", mark))
            for key, (value, trail) in paths.items():
                if apostrophe:
                    _put(new, key, value, trail)
                    continue
                _put(new, key, value + loose, (None, ("unmatched", mark), key[1], 0, trail))
                if key[0] == mark:  # closes
                    if hi < stop and (block[lo - 1] in ".!?…" or block[lo - 1] in WIDE):
                        c, distance = context(block, start, lo, hi, german), lo - at
                        if want is None or hi not in want:
                            _put(new, _IN, value, (None, c, key[1], distance, trail))
                        if want is None or hi in want:
                            _put(new, _END, value + scorer.boundary(c) + scorer.step(key[1], c[0], distance), (hi, c, key[1], distance, trail))
                    else:
                        _put(new, (None, key[1]), value, trail)
                elif key[0] is None and mark in PAIR:
                    _put(new, (PAIR[mark], key[1]), value, trail)
                elif key[0] is not None and mark in PAIR and kind != "both":
                    _put(new, key, value - 0.5, trail)  # a bracket inside a quotation
        paths = new or paths
    ends = []
    for (mark, last), (value, trail) in paths.items():
        if mark is None:
            ends.append((value, trail))
        else:  # a quotation that is never closed
            ends.append((value + UNMATCHED + scorer.boundary(("unmatched", mark)), (None, ("unmatched", mark), last, 0, trail)))
    _, trail = max(ends, key=lambda x: x[0])
    out, steps = [], []
    while trail is not None:
        place, c, last, distance, before = trail
        if place is not None:
            out.append(place)
        steps.append((c, last, "B" if place is not None else "U" if c[0] == "unmatched" else "I", distance))
        trail = before
    return out[::-1], steps[::-1]


WIDEST = 90  # letters of the widest line that a text is wrapped to
_CLOSED = ".!?…\"”~^ㅋㅎㅠㅜ" + WIDE
_ENDED = re.compile(rf"[.!?…{WIDE}][\"”’」』)]*(?:\s|$)")
_OPEN_END = re.compile(r"(?:\d|\b(?:No|Vol|pp|ver|Inc|Mt|St|Dr|Sec|Fig|ca|Nr))\.$")


def is_wrapped(lines: list[str]) -> bool:
    """Whether line ends come from a line width: many lines stop inside a sentence, most at nearly the same length, and no
    line is much longer.

    List lines don't count. A script that doesn't put blanks between words isn't wrapped at blanks; a text without any
    closing mark shows no sentence that a line end could cut.
    """
    own = [x.strip() for x in lines]
    pairs = [(a, b) for a, b in zip(own, own[1:]) if a and b and not LIST_MARK.match(a) and not LIST_MARK.match(b)]
    if not pairs or sum(a.count(" ") for a, _ in pairs) < 3 * len(pairs):
        return False
    prose = [x for x in own if x and not LIST_MARK.match(x)]
    sizes = sorted(len(a) for a, _ in pairs)
    width = sizes[int(0.9 * (len(sizes) - 1))]
    if width > WIDEST or sum(len(x) > 1.35 * width for x in prose) > 0.2 * len(prose) or not any(_ENDED.search(x) for x in prose):
        return False
    cut = sum(a[-1] not in _CLOSED or bool(_OPEN_END.search(a)) and not b[0].isupper() for a, b in pairs)
    return cut >= 0.4 * len(pairs) and sum(n >= 0.7 * width for n in sizes) >= 0.6 * len(pairs)


def blocks(text: str) -> list[tuple[int, int]]:
    """Lines, in a wrapped text paragraphs, as (start, end)."""
    spans, at = [], 0
    for m in LINE.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    if not is_wrapped([text[a:b] for a, b in spans]):
        return [s for s in spans if text[s[0] : s[1]].strip()]
    out: list[tuple[int, int]] = []
    held: tuple[int, int] | None = None
    for a, b in spans:
        if not text[a:b].strip():
            held = None
        elif held is None:
            out.append((a, b))
            held = (a, b)
        else:
            out[-1] = (out[-1][0], b)
    return out


def units(text: str | None, scorer: Scorer | None = None) -> list[tuple[int, int]]:
    """The sentence units of a text as (start, end) without outer blanks."""
    if not text or not text.strip():
        return []
    scorer = scorer or Scorer(WEIGHTS)
    out = []
    for a, b in blocks(text):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        cuts = [] if LIST_MARK.match(text, a, b) else decode(text, a, b, scorer)[0]
        for p in [*cuts, b]:
            while a < p and text[a].isspace():
                a += 1
            q = p
            while q > a and text[q - 1].isspace():
                q -= 1
            if q > a:
                out.append((a, q))
            a = p
    return out


def script(line: str) -> str:
    """The script of most of a line's letters."""
    kinds = [_kind(c) for c in line]
    return max(("spaced", "cjk", "deva", "hangul", "lower"), key=kinds.count)


def joined(lines: list[str], kind: str, strip: bool, lower: bool, tight: bool = False) -> tuple[str, set[int]]:
    """Lines of one sentence each as one text with the positions of their ends, but the last."""
    parts = [STRIP.sub("", x).strip() if strip else x for x in lines]
    parts = [x.lower() if lower else x for x in parts if x]
    glue = "" if kind == "cjk" or tight else " "
    text, want = "", set()
    for x in parts[:-1]:
        text += x
        want.add(len(text))
        text += glue
    return text + (parts[-1] if parts else ""), want


def samples(lines: list[str], size: int, rng: random.Random) -> list[tuple[str, set[int], bool]]:
    """Joined texts to learn from: of spaced scripts stripped, of Chinese and Japanese as they are and stripped, of others
    as they are and a few in lower case, a few without a blank between."""
    by: dict[tuple[str, bool, bool], list[str]] = defaultdict(list)  # lines of one language are joined
    for line in lines:
        by[script(line), bool(re.search("[가-힣\u3040-\u30ff]", line)), len(GERMAN & set(line.lower().split())) > 0].append(line)
    out = []
    for (kind, _, _), own in sorted(by.items()):
        rng.shuffle(own)
        for i in range(0, len(own) - size + 1, size):
            some = own[i : i + size]
            if kind == "spaced":
                out.append((*joined(some, kind, True, False), False))
            elif kind == "cjk":
                out += [(*joined(some, kind, False, False), False), (*joined(some, kind, True, False), True)]
            else:
                out.append((*joined(some, kind, False, rng.random() < 0.05, rng.random() < 0.1), False))
    rng.shuffle(out)
    return out


def train(lines: list[str], rounds: int = 12, size: int = 4, seed: int = 7) -> dict[str, float]:
    """Structured averaged perceptron from zero weights on joined lines of one sentence each.

    Each text is decoded freely and with its known boundaries; the features of the second path are raised, those of the
    first lowered, where they differ.
    """
    rng = random.Random(seed)
    w: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    steps = 0
    for _ in range(rounds):
        for text, want, stripped in samples(list(lines), size, rng):
            steps += 1
            scorer = Scorer(w)
            got, path = decode(text, 0, len(text), scorer, stripped=stripped)
            _, gold = decode(text, 0, len(text), scorer, want, stripped)
            if path == gold:
                continue
            for sign, own in ((1.0, gold), (-1.0, path)):
                for c, last, tag, distance in own:
                    for f in [*steps_of(last, c[0], distance), *features(c)] if tag == "B" else features(c) if tag == "U" else []:
                        w[f] += sign
                        total[f] += sign * steps
    mean = {k: v - total[k] / max(1, steps) for k, v in w.items()}
    return {k: round(v, 3) for k, v in sorted(mean.items()) if abs(v) >= 0.05}


def accuracy(lines: list[str], weights: dict[str, float], size: int = 4, seed: int = 11) -> dict[str, tuple[float, float]]:
    """Share of known boundaries found and of found ones that are known, by script and kind of text."""
    scorer, hits = Scorer(weights), defaultdict(lambda: [0, 0, 0])
    for text, want, stripped in samples(list(lines), size, random.Random(seed)):
        got = set(decode(text, 0, len(text), scorer, stripped=stripped)[0])
        h = hits[script(text) + (" stripped" if stripped or script(text) == "spaced" else "")]
        h[0] += len(got & want)
        h[1] += len(want)
        h[2] += len(got)
    return {k: (h[0] / max(1, h[1]), h[0] / max(1, h[2])) for k, h in sorted(hits.items())}


def found(documents: DataFrame) -> DataFrame:
    """doc_id, start_pos and end_pos of every sentence unit."""
    weights = WEIGHTS

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for b in batches:
            ids, starts, ends = [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = units(text, scorer)
                ids += [i] * len(own)
                starts += [x[0] for x in own]
                ends += [x[1] for x in own]
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "start_pos": pa.array(starts, pa.int32()), "end_pos": pa.array(ends, pa.int32())})

    return documents.select("doc_id", "text").mapInArrow(split, "doc_id long, start_pos int, end_pos int")
