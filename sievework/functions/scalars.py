"""Scalar functions as Column expressions: text, dates, ids, URLs, vectors. All are pure; the clock is a parameter.

Missing text is the empty string; null counts as empty where a function takes text, unless its docstring says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date pattern, the tokens of a title signature, the digits of full width.
DATE = r"(?U)(\d{4})\s*[-./년]\s*(\d{1,2})\s*[-./월]\s*(\d{1,2})"
SIGNATURE_TOKEN = "[0-9a-z가-힣]{2,}"
WIDE_DIGITS = "０１２３４５６７８９"


def text(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of any Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def native_id(given: Column, url: Column) -> Column:
    """The given id, else 16 hex digits of the URL's SHA-256."""
    return F.coalesce(F.nullif(text(given), F.lit("")), F.substring(F.sha2(text(url), 256), 1, 16))


def uid(source: Column, native: Column) -> Column:
    return F.concat(source, F.lit(":"), native)


def haystack(*columns: Column) -> Column:
    """Lower-cased columns joined by blanks, empty ones kept."""
    return F.lower(F.concat_ws(" ", *map(text, columns)))


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))


def iso_date(c: Column) -> Column:
    """The first date in a text as yyyy-mm-dd; empty if there is none or it isn't in the calendar (later ones aren't tried)."""
    plain = F.translate(text(c), WIDE_DIGITS, "0123456789")
    part = [F.regexp_extract(plain, DATE, i) for i in (1, 2, 3)]
    iso = _iso(*part)
    return F.when((part[0] != "") & iso.try_cast("date").isNotNull(), iso).otherwise("")


def iso_dates(c: Column) -> Column:
    """All dates in a text in order, those not in the calendar left out."""
    found = F.regexp_extract_all(F.translate(text(c), WIDE_DIGITS, "0123456789"), F.lit(DATE), F.lit(0))
    plain = F.transform(found, lambda x: _iso(*[F.regexp_extract(x, DATE, i) for i in (1, 2, 3)]))
    return F.filter(plain, lambda x: x.try_cast("date").isNotNull())


def days_left(deadline: Column, today: Column) -> Column:
    """Days to a yyyy-mm-dd deadline, null if it is empty or another text."""
    return F.when(deadline.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.datediff(deadline.try_cast("date"), today.cast("date")))


def is_open(deadline: Column, today: Column) -> Column:
    """An empty deadline is open; others compare as text."""
    return (text(deadline) == "") | (text(deadline) >= today)


def days_label(left: Column, closed: Column | None = None) -> Column:
    label = F.when(left.isNull(), "always").when(left < 0, "closed").when(left == 0, "today").otherwise(F.concat(F.lit("D-"), left.cast("string")))
    return label if closed is None else F.when(closed, "closed").otherwise(label)


def rfc822_utc(c: Column) -> Column:
    """``Tue, 19 May 2026 02:20:53 GMT`` or with a numeric offset as yyyy-mm-ddTHH:MM:SS in UTC, else empty."""
    t = F.regexp_replace(text(c), r"^[A-Za-z]{3},\s*", "")
    month = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    shape = rf"^(\d{{1,2}}) {month} (\d{{4}}) (\d{{2}}:\d{{2}}:\d{{2}}) (GMT|UTC|[+-]\d{{4}})$"
    p = [F.regexp_extract(t, shape, i) for i in range(1, 6)]
    number = F.array_position(F.array(*[F.lit(m) for m in month.strip("()").split("|")]), p[1])
    zone = F.when(p[4].isin("GMT", "UTC"), "+00:00").otherwise(F.concat(F.substring(p[4], 1, 3), F.lit(":"), F.substring(p[4], 4, 2)))
    whole = F.concat(p[2], F.lit("-"), F.lpad(number.cast("string"), 2, "0"), F.lit("-"), F.lpad(p[0], 2, "0"), F.lit("T"), p[3], zone)
    instant = F.when(p[0] != "", whole).try_cast("timestamp")
    return F.coalesce(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def byte_count(c: Column, wide: int) -> Column:
    """One for each ASCII character, ``wide`` for each other code point."""
    return F.length(c) + (wide - 1) * F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))


def ellipsis(c: Column, most: int) -> Column:
    """Texts longer than ``most`` cut by one more, without trailing blanks, with an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def page_url(c: Column, base: str | None = None) -> Column:
    """Without query and fragment; with ``base``, absolute."""
    plain = F.regexp_replace(text(c), r"[?#].*$", "")
    return plain if base is None else F.when(plain.startswith("/"), F.concat(F.lit(base), plain)).otherwise(plain)


def json_object(c: Column) -> Column:
    """From the first to the last brace of a text, null if there is no pair."""
    return F.nullif(F.regexp_extract(text(c), r"(?s)\{.*\}", 0), F.lit(""))


def minutes_label(c: Column) -> Column:
    """Minutes, rounded half to even, as ``N min`` or ``H h M min``; null as ``-``."""
    m = F.bround(c, 0).cast("long")
    return F.when(c.isNull(), "-").when(m < 60, F.concat(m, F.lit(" min"))).otherwise(F.concat(F.floor(m / 60), F.lit(" h "), m % 60, F.lit(" min")))


def title_signature(c: Column) -> Column:
    """Distinct tokens of two letters or more, without bracketed parts and a trailing source name, in first order."""
    t = F.regexp_replace(F.lower(text(c)), r"\[[^\]]*\]", " ")
    t = F.regexp_replace(t, r"\s[-|][^-|]*$", "")
    return F.array_distinct(F.regexp_extract_all(t, F.lit(SIGNATURE_TOKEN), F.lit(0)))


def strip_source_tail(title: Column, source: Column) -> Column:
    """A title without its trailing ``- source``; a blank source strips nothing."""
    tail = F.concat(F.lit("- "), source)
    return F.when((source != "") & title.endswith(tail), F.trim(F.substring(title, F.lit(1), F.length(title) - F.length(tail)))).otherwise(title)


def display_title(title: Column, company: Column) -> Column:
    """Without a leading ``[company]`` that names the company or is named by it, or without the company's name in front;
    never empty."""
    t, own = F.trim(title), F.trim(text(company))
    bracket = t.rlike(r"^\[[^\]]*\]")
    inner = F.regexp_replace(F.regexp_extract(t, r"^\[([^\]]*)\]", 1), r"\s+", "")
    firm = F.regexp_replace(own, r"\s+", "")
    named = bracket & (F.contains(inner, firm) | F.contains(firm, inner))
    plain = ~bracket & F.startswith(F.regexp_replace(t, r"\s+", ""), firm)
    rest = F.when(named, F.regexp_replace(t, r"^\[[^\]]*\]\s*", "")).when(plain, F.regexp_replace(F.substring(t, F.length(own) + 1, F.length(t)), r"^[\s\-–·:|]+", "")).otherwise(t)
    return F.when((firm == "") | (F.trim(rest) == ""), t).otherwise(F.trim(rest))


def stated(c: Column, otherwise: str) -> Column:
    """The text, or another where it is empty."""
    return F.coalesce(F.nullif(text(c), F.lit("")), F.lit(otherwise))


def title_suffix(title: Column, url: Column, suffixes: Sequence[tuple[str, str]]) -> Column:
    """A title with the suffix of each (part of a url, suffix) that fits and isn't there yet; incomplete pairs are skipped."""
    out = title
    for part, suffix in suffixes:
        if part and suffix:
            out = F.when(F.contains(text(url), F.lit(part)) & ~out.contains(suffix), F.concat(out, F.lit(suffix))).otherwise(out)
    return out


def message(pattern: str, fallbacks: Mapping[str, str], excerpt: Column, divider: str) -> Column:
    """A message of a pattern whose empty fields show a fallback, with the excerpt under a divider if there is one."""
    body = template(pattern, list(fallbacks), {f: stated(F.col(f).cast("string"), x) for f, x in fallbacks.items()})
    return F.concat(body, F.when(text(excerpt) != "", F.concat(F.lit(f"\n{divider}\n"), excerpt)).otherwise(""))


def payload(title: str, body: str, fallbacks: Mapping[str, str], tag: Column, most_title: int = 120, most_body: int = 200) -> Column:
    """title, body and tag of a notification: patterns with fallbacks, cut to their sizes; a blank tag is the title."""
    values = {f: stated(F.col(f).cast("string"), x) for f, x in fallbacks.items()}
    t, b = template(title, list(fallbacks), values), template(body, list(fallbacks), values)
    return F.struct(F.substring(t, 1, most_title).alias("title"), F.substring(b, 1, most_body).alias("body"), F.coalesce(F.nullif(text(tag), F.lit("")), t).alias("tag"))


def is_new(first_seen: Column, now: Column, hours: int, posted: Column, most_days: int) -> Column:
    """Seen first within some hours before now (texts of one form compare as text) and not posted longer ago than some days.

    A blank or unreadable posted day doesn't count against it.
    """
    since = F.date_format(now - F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd'T'HH:mm:ss")
    age = F.datediff(F.to_date(now), F.when(text(posted).rlike(r"^\d{4}-\d{2}-\d{2}$"), posted).try_cast("date"))
    return (text(first_seen) >= since) & F.coalesce(age <= most_days, F.lit(True))


def within_days(first_seen: Column, now: Column, days: int) -> Column:
    """Whether a time is at most some days before now; unreadable ones aren't. A blank may stand for the T."""
    seen = F.regexp_replace(squeeze(first_seen), r"^(\d{4}-\d{2}-\d{2}) ", "$1T").try_cast("timestamp")
    return F.coalesce(F.unix_micros(now) - F.unix_micros(seen) <= days * 86_400_000_000, F.lit(False))


def compact_title(c: Column) -> Column:
    """Key of a title: without one leading bracket, blanks and separators, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text(c), r"^\s*\[[^\]]*\]", ""), r"[\s\[\]()·,./-]", ""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length; 0 if a norm is 0 or a vector is missing."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    bottom = norm(a) * norm(b)
    return F.when(bottom > 0, dot / bottom).otherwise(0.0)


def daily_index(day: Column, label: Column, n: Column) -> Column:
    """A pick that changes by day: 32-bit FNV-1a of ``day|label``, signed, its absolute value modulo n."""
    codes = F.transform(F.filter(F.split(F.concat_ws("|", day, label), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    step = lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), step)
    return F.abs(F.when(h >= 2147483648, h - 4294967296).otherwise(h)) % n


def template(pattern: str, fields: Sequence[str], values: Mapping[str, Column] | None = None) -> Column:
    """``{name}`` placeholders of a fixed pattern compiled to one expression; unknown names stay as written."""
    value = lambda f: values[f] if values else F.col(f).cast("string")
    parts = [value(m[1:-1]) if m.startswith("{") and m[1:-1] in fields else F.lit(m) for m in re.split(r"(\{\w+\})", pattern) if m]
    return F.concat(*[text(p) for p in parts])
