"""Scalar expressions: clocks, snapping, labels, digests, names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """LONG microseconds since the epoch of a zone-less timestamp, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def clock(pts: Column, num: Column, den: Column, start: Column) -> Column:
    """Container-relative seconds of a rational time stamp."""
    return pts * num / den - start


def snapped(x: Column, width: float, slack: float = 1e-9) -> Column:
    """x / width, exactly whole where it is within ``slack`` of a whole number."""
    q = x / F.lit(width)
    return F.when(F.abs(q - F.rint(q)) <= slack, F.rint(q)).otherwise(q)


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose substring the text has."""
    out = None
    for part, label in rules:
        out = F.when(text.contains(part), label) if out is None else out.when(text.contains(part), label)
    return out.otherwise(default)


def item_digest(*parts: Column | str) -> Column:
    """The first 20 hex digits of the SHA-256 of the parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]), 256), 1, 20)


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the row's JSON with keys in order; nulls are written, so a missing value counts."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


#: Names whose values are secret.
SECRET_NAMES = ("api_key", "api-key", "apikey", "token", "secret", "password", "authorization")


def redacted(text: Column, mark: str = "[redacted]") -> Column:
    """``text`` with secrets masked: values of ``SECRET_NAMES`` after ``=`` or ``:``, what follows ``bearer``, and ``sk-`` keys.

    The text is cut once into words and what stands between them (blanks, quotes, commas, closing braces), which alternate; a word is
    judged by itself and the two words before it. The parts are bound, so a text is cut once however many words it has.
    """
    name = rf"(?i)\b(?:{'|'.join(SECRET_NAMES)})"
    parts = F.regexp_extract_all(text, F.lit(r"[^\s\x22',}]+|[\s\x22',}]+"), F.lit(0))

    def judged(parts: Column, word: Column, i: Column) -> Column:
        before, earlier = (F.coalesce(F.get(parts, i - back), F.lit("")) for back in (2, 4))
        between = word.rlike(r"^[\s\x22',}]")
        is_bearer = lambda w: w.rlike(r"(?i)\bbearer$")
        named = before.rlike(name + "[:=]$") | (before.rlike("^[:=]$") & earlier.rlike(name + "$"))
        separator = word.rlike("^[:=]$")
        inline = F.regexp_replace(F.regexp_replace(word, name + "[:=](?=.)(?!(?i:bearer)$).+$", "\u0001$0"), "\u0001([^:=]*[:=]).+$", f"$1{mark}")
        return F.when(between | separator, word).when(is_bearer(before) | (named & ~is_bearer(word)), F.lit(mark)).otherwise(F.regexp_replace(inline, r"\bsk-[A-Za-z0-9_-]{8,}", mark))

    masked = F.transform(F.array(parts), lambda held: F.array_join(F.transform(held, lambda word, i: judged(held, word, i)), ""))[0]
    return F.when(text.isNotNull(), masked)


def even_indices(n: Column, k: int) -> Column:
    """Array of min(n, k) whole places spread evenly over 0 .. n - 1, both ends included, half-even rounded."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(max(1, k - 1))).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(spread)


def padded_indices(n: Column, k: int) -> Column:
    """k places: 0 .. n - 1 with the last repeated when there are fewer, else evenly spaced."""
    return F.when(n >= k, even_indices(n, k)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.least(i, n.cast("int") - 1)))


def padded_span(start: Column, end: Column, before: float, after: float, low: Column, high: Column) -> Column:
    """Struct (start, end) of a span with room on either side, cut to lie in [low, high]."""
    return F.struct(F.greatest(low, start - before).alias("start"), F.least(high, end + after).alias("end"))


def clamped_span(center: Column, length: Column, low: Column, high: Column) -> Column:
    """Struct (start, end) of a span of ``length`` round ``center``, moved and cut to lie in [low, high]."""
    start = F.greatest(low, F.least(center - length / 2, high - length))
    return F.struct(start.alias("start"), F.least(start + length, high).alias("end"))


def mapped_time(t: Column, source_start: Column, output_start: Column, rate: Column) -> Column:
    return output_start + (t - source_start) / rate


def source_name(name: Column) -> Column:
    """Struct (date, part) of names like ``Y.M.D.N``; null where the form, the date or the part (from 1) is not valid."""
    form = r"^(\d{4})\.(\d{1,2})\.(\d{1,2})\.(\d+)$"
    got = lambda i: F.regexp_extract(name, form, i)
    date = F.try_to_date(F.concat_ws("-", got(1), F.lpad(got(2), 2, "0"), F.lpad(got(3), 2, "0")), "yyyy-MM-dd")
    part = F.try_to_number(got(4), F.lit("999999999")).cast("int")
    ok = name.rlike(form) & date.isNotNull() & (part >= 1)
    return F.when(ok, F.struct(date.alias("date"), part.alias("part")))


def level_or_floor(value: Column, floor: Column) -> Column:
    """A level given as text; ``-Inf`` is one below the lowest finite level."""
    return F.when(value == "-Inf", floor - 1).otherwise(F.try_to_number(value, F.lit("S9999.999999")).cast("double"))


def allowed_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, v: k.isin(keys))


def rank_label(rank: Column, total: int) -> Column:
    return F.when(rank == 1, "Top 1").otherwise(F.format_string(f"No. %d of {total}", rank))


def wrapped_lines(title: Column, width: int) -> Column:
    """Greedy lines of at most ``width`` characters; a longer word is a line of its own."""
    def add(lines, w):
        last = F.element_at(lines, -1)
        fits = F.length(last) + 1 + F.length(w) <= width
        return F.when(F.size(lines) == 0, F.array(w)).when(fits, F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat_ws(" ", last, w)))).otherwise(F.concat(lines, F.array(w)))

    return F.aggregate(F.array_remove(F.split(F.trim(title), r"\s+"), ""), F.array().cast("array<string>"), lambda acc, w: F.when(F.size(acc) > 0, add(acc, w)).otherwise(F.array(w)))


#: What clings to the character before it: marks, joiners and skin tones; after a joiner any character does.
_ATTACHED = r"[\p{M}\u200c\u200d\x{1F3FB}-\x{1F3FF}]"


def text_units(text: Column) -> Column:
    """Array of a text's units: characters with the marks and joined characters that follow them."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(.(?:{_ATTACHED}|(?<=\u200d).)*)"), F.lit(1))


def normalized_text(text: Column) -> Column:
    """Composed characters (NFC), line ends as line feeds and all other white space as blanks. ASCII texts stay within the JVM."""

    @F.pandas_udf("string")
    def composed(t: pd.Series) -> pd.Series:
        return t.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    whole = F.when(text.rlike(r"[^\x00-\x7f]"), composed(text)).otherwise(text)
    return F.regexp_replace(F.regexp_replace(whole, r"\r\n?", "\n"), r"[\s\p{Z}\x1c-\x1f\x85&&[^\n]]", " ")


def title_lines(title: Column, most: int = 9, marks: tuple[str, str] = ("，", "！")) -> Column:
    """One or two lines: cut at the first comma or exclamation mark within (the latter stays), else in the middle of more than ``most`` units."""
    comma, cry = marks
    inner = F.substring(title, F.lit(1), F.length(title) - 1)
    units = text_units(title)
    half = F.floor(F.size(units) / 2).cast("int")
    head, tail = (lambda m: F.substring_index(title, m, 1)), (lambda m: F.substring(title, F.locate(m, title) + 1, F.length(title)))
    halves = F.array(F.array_join(F.slice(units, F.lit(1), half), ""), F.array_join(F.slice(units, half + 1, F.size(units)), ""))
    return (
        F.when(inner.contains(comma), F.array(head(comma), tail(comma))).when(inner.contains(cry), F.array(F.concat(head(cry), F.lit(cry)), tail(cry)))
        .when(F.size(units) > most, halves).otherwise(F.array(title))
    )


def safe_counters(counts: Column, allowed: list[str]) -> Column:
    """The allowed counters of a map that are known and not negative."""
    return F.map_filter(counts, lambda k, v: k.isin(allowed) & F.coalesce(v >= 0, F.lit(False)))
