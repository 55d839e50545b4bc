"""python -m sievework.llm.train_sentences DOCUMENTS.parquet: train the sentence model and write its weights.

Training lines are lines of texts that aren't wrapped, that end with a closing mark (in scripts without such marks: that
hold no blank between their letters) and hold no other place that surely ends a sentence: a closing mark before a blank
and a letter that isn't small, unless an abbreviation, an initial or a number stands before a stop. At most ``LINES``
lines, of texts in the order of a hash of their id; texts in every fifth place of that hash are held out and only measured.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from pathlib import Path

import pyarrow.parquet as pq

from sievework.llm import sentences as s

LINES = 20_000
_ENDS = re.compile(rf"(?:[.!?…]+[~^ㅋㅎㅠㅜ]*|(?<=[가-힣]) ?[~^ㅋㅎㅠㅜ]+)[\"”’」』)]*\s+(?=[^\sa-z])|(?:[{s.WIDE}]|…{{2,}})(?=[^”’」』）)…])")
_BEFORE = re.compile(r"([^\s(\"“‘]*)$")


def place(i: int) -> int:
    return int.from_bytes(hashlib.blake2b(str(i).encode(), digest_size=4).digest(), "big")


def several(line: str) -> bool:
    """Whether a place inside a line surely ends a sentence."""
    german = len(s.GERMAN & set(re.findall(r"[a-zäöüß]+", line.lower()))) >= 2
    for m in _ENDS.finditer(line):
        word = _BEFORE.search(line, 0, m.start()).group(1).lower()
        quoted = line.count("「", 0, m.start()) + line.count("“", 0, m.start()) > line.count("」", 0, m.start()) + line.count("”", 0, m.start()) or line.count('"', 0, m.start()) % 2 == 1 and not m.group().rstrip().endswith('"')
        if quoted:
            continue
        if m.group().strip() != "." or not (word in s.NEVER_LAST or len(word) == 1 or word[-1:].isdigit() and (german or line[m.end()].isdigit())):
            return True
    return False


def lines_of(text: str) -> list[str]:
    """The lines of a text that hold one sentence each."""
    own = [x.strip() for x in s.LINE.split(text)]
    if s.is_wrapped(own):
        return []
    out = []
    for x in own:
        if len(x) <= 8 or s.LIST_MARK.match(x):
            continue
        if s.script(x) == "spaced":
            if not re.search(rf"(?<=[{s.SPACED}])\s+(?=[{s.SPACED}])", x):
                out.append(x)
        elif x[-1] in s._CLOSED and not several(x):
            out.append(x)
    return out


def main(path: str) -> None:
    table = pq.read_table(path, columns=["doc_id", "text"])
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()), key=lambda r: place(r[0]))
    train: list[str] = []
    held: list[str] = []
    for i, text in rows:
        own = lines_of(text) if text else []
        if place(i) % 5 == 0:
            held += own
        elif len(train) < LINES:
            train += own
    train, held = sorted(set(train)), sorted(set(held) - set(train))
    weights = s.train(train)
    (Path(s.__file__).parent / "sentence_weights.json").write_text(json.dumps(weights, ensure_ascii=False, indent=0) + "\n")
    print(len(train), "lines,", len(held), "held out,", len(weights), "weights")
    for kind, (recall, precision) in s.accuracy(held, weights).items():
        print(f"{kind}: {recall:.4f} of the ends found, {precision:.4f} of those found are ends")


if __name__ == "__main__":
    main(sys.argv[1])
