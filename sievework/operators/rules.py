"""Keyword rules as boolean and label expressions: lower-cased substring containment, never word boundaries."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.scalars import text


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether a text holds any of the words; an empty list holds nowhere."""
    return reduce(lambda a, b: a | b, [F.contains(text(c), F.lit(w)) for w in words], F.lit(False))


def contains_all(c: Column, *lists: Sequence[str]) -> Column:
    """Whether a text holds a word of every list."""
    return reduce(lambda a, b: a & b, [contains_any(c, words) for words in lists], F.lit(True))


def first_label(c: Column, labels: Mapping[str, Sequence[str]], default: str) -> Column:
    """The first label, in the order given, any of whose words a text holds."""
    out = None
    for label, words in labels.items():
        hit = contains_any(c, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


def unnegated(c: Column, words: Sequence[str], negators: Sequence[str], skip: str = " )/·,.-") -> Column:
    """Whether some occurrence of a word isn't followed, after the skipped characters, by a negator."""
    if not words:
        return F.lit(False)
    own = "|".join(map(re.escape, words))
    if not negators:
        return text(c).rlike(f"(?:{own})")
    chars = "".join("\\" + x if x in "\\]^-" else x for x in skip)
    return text(c).rlike(f"(?:{own})(?![{chars}]*+(?:{'|'.join(map(re.escape, negators))}))")


def keep(
    title: Column,
    body: Column,
    source: Column,
    noise: Sequence[str] = (),
    bypass: Sequence[str] = (),
    hard: Sequence[str] = (),
    exclude: Sequence[str] = (),
    rescue: Sequence[str] = (),
    negators: Sequence[str] = (),
    include: Sequence[str] = (),
) -> Column:
    """Row predicate of ordered rules: noise in the title drops, even where a source is let through; a bypassed source
    passes; hard words in the title drop unless an un-negated rescue word is there; excluded words anywhere drop unless
    rescued; include words, if any are given, must occur."""
    t, b = F.lower(text(title)), F.lower(text(body))
    passed = ~(contains_any(t, hard) & ~unnegated(t, rescue, negators)) & ~(contains_any(b, exclude) & ~unnegated(b, rescue, negators))
    if include:
        passed = passed & contains_any(b, include)
    return ~contains_any(t, noise) & (text(source).isin(*bypass) | passed if bypass else passed)


def recent(day: Column, category: Column, as_of: str, days: Mapping[str, int], default: int) -> Column:
    """A blank day passes; others must not be before the category's cutoff."""
    cutoff = lambda n: F.date_sub(F.lit(as_of).cast("date"), n).cast("string")
    own = None
    for label, n in days.items():
        own = F.when(category == label, cutoff(n)) if own is None else own.when(category == label, cutoff(n))
    limit = cutoff(default) if own is None else own.otherwise(cutoff(default))
    return (text(day) == "") | (text(day) >= limit)


@dataclass(frozen=True)
class ArticleRules:
    """Word lists of ``article_gate``; an empty list switches its rule off."""

    sources: Sequence[str] = ()  # parts of source labels that are left out
    noise: Sequence[str] = ()  # words that leave a title out
    topics: Sequence[str] = ()  # lower-case words of which a title must hold one
    endings: Sequence[str] = ()  # with ``actions``: titles about places that act
    actions: Sequence[str] = ()
    least: int = 3  # letters of such a place
    pairs: Sequence[tuple[Sequence[str], Sequence[str]]] = ()  # lists whose words together leave a title out
    kept: Sequence[str] = ()  # words that keep a title in spite of endings and the first of ``pairs``
    always: Sequence[tuple[Sequence[str], Sequence[str]]] = ()  # pairs without such an exception
    scoped: Mapping[str, Sequence[str]] = field(default_factory=dict)  # noise of one category only
    abroad: Sequence[str] = ()  # categories in which what is abroad is left out:
    abroad_sources: Sequence[str] = ()  # every title of these sources (lower case),
    abroad_names: Sequence[str] = ()  # titles with these names (lower case),
    home: Sequence[str] = ()  # unless they hold one of these words (lower case)


def article_gate(title: Column, source: Column, category: Column, rules: ArticleRules) -> Column:
    """Row predicate over articles as one expression, so that Catalyst runs it in the scan's stage."""
    t, low, label, kind = text(title), F.lower(text(title)), text(source), text(category)
    out = contains_any(label, rules.sources) | contains_any(t, rules.noise)
    if rules.topics:
        out = out | ~contains_any(low, rules.topics)
    act = reduce(lambda a, b: a | b, [contains_all(t, *p) for p in rules.pairs], F.lit(False))
    if rules.endings and rules.actions:
        act = act | (ends_token(t, rules.endings, rules.least) & contains_any(t, rules.actions))
    out = out | (act & ~contains_any(t, rules.kept))
    out = reduce(lambda a, b: a | b, [contains_all(t, *p) for p in rules.always], out)
    out = reduce(lambda a, b: a | b, [(kind == c) & contains_any(t, words) for c, words in rules.scoped.items()], out)
    if rules.abroad:
        foreign = contains_any(F.lower(label), rules.abroad_sources) | (contains_any(low, rules.abroad_names) & ~contains_any(low, rules.home))
        out = out | (kind.isin(*rules.abroad) & foreign)
    return ~out


def fallback_label(source: Column, c: Column, by_source: Mapping[str, str], labels: Mapping[str, Sequence[str]], local: str, words: Sequence[str], other: str) -> Column:
    """The source's own label; where that is ``local`` or the source isn't listed: the first label whose words a text
    holds, else ``local`` if it holds one of ``words``, else ``other``."""
    own = None
    for s, label in by_source.items():
        own = F.when(source == s, label) if own is None else own.when(source == s, label)
    own = F.lit(local) if own is None else F.coalesce(own, F.lit(local))
    return F.when(own != local, own).otherwise(first_label(c, {**labels, local: [*labels.get(local, ()), *words]}, other))


def ends_token(c: Column, endings: Sequence[str], least: int) -> Column:
    """Whether a token (commas and ellipses part tokens too) of a least length has one of the endings."""
    tokens = F.split(F.translate(text(c), ",…", "  "), r"\s+")
    return F.exists(tokens, lambda t: (F.length(t) >= least) & reduce(lambda a, b: a | b, [t.endswith(e) for e in endings]))
