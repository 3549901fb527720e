"""Numbers, links and lists out of the texts that sources deliver."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rooms by the words of one source, living room included (fixed values).
ROOM_WORDS = {"ONE": 0, "TWO": 1, "THREE": 2, "FOUR": 3, "FIVE": 4, "MORE": 5}


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def rooms(text: Column, whole_word: bool = False) -> Column:
    """The number of a typology such as T2."""
    return _found(text, r"[Tt](\d+)" + (r"\b" if whole_word else "")).try_cast("int")


def rooms_of_word(word: Column, table: dict[str, int] | None = None) -> Column:
    return F.create_map(*(F.lit(x) for pair in (table or ROOM_WORDS).items() for x in pair))[word]


def room_range(low: Column, high: Column, most: int = 10) -> Column:
    """All room counts from the lesser to the greater bound, kept within 0 and ``most``."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(most))
    return F.sequence(F.least(clamp(low), clamp(high)), F.greatest(clamp(low), clamp(high)))


def size_m2(text: Column) -> Column:
    """The number before m; a comma is a decimal point, and so is a dot."""
    return F.replace(_found(text, r"(\d+(?:[.,]\d+)?)\s*m"), F.lit(","), F.lit(".")).try_cast("decimal(8,2)")


def size_m2_grouped(text: Column) -> Column:
    """The number before m where dots group thousands; must be over 0."""
    digits = F.replace(F.replace(_found(text, r"([\d.,]+)\s*m"), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    value = digits.try_cast("decimal(8,2)")
    return F.when(value > 0, value)


def price_digits(text: Column) -> Column:
    """All digits as one number (entities must be decoded before)."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("decimal(10,2)")


def price_decimal(text: Column) -> Column:
    """Dots group thousands, a comma is the decimal point."""
    kept = F.regexp_replace(text, "[^0-9.,]", "")
    return F.nullif(F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")), F.lit("")).try_cast("decimal(10,2)")


def int_group(text: Column, pattern: str) -> Column:
    return _found(text, pattern).try_cast("int")


def canonical_url(url: Column) -> Column:
    """Scheme, host and path, and of the query only ``id``."""
    base = _found(url, r"^([^?#]*)")
    number = _found(url, r"[?&]id=([^&#]*)")
    return F.when(number.isNotNull(), F.concat(base, F.lit("?id="), number)).otherwise(base)


def unwrap_tracking(url: Column, parameter: str = "l") -> Column:
    """The target of a tracking link, else the link itself if it is one."""
    plain = F.replace(url, F.lit("&amp;"), F.lit("&"))
    target = _found(plain, rf"[?&]{parameter}=([^&#]*)")
    return F.coalesce(F.try_url_decode(target), F.when(plain.startswith("http"), plain))


def absolute_url(url: Column, host: str, fallback: Column | None = None) -> Column:
    link = F.when(url.startswith("http"), url).when(url.startswith("/"), F.concat(F.lit(host), url)).when(url != "", F.concat(F.lit(host + "/"), url))
    return F.coalesce(link, fallback) if fallback is not None else link


def gallery_urls(urls: Column, token: str = "{rule}", value: str = "gallery") -> Column:
    return F.transform(urls, lambda u: F.replace(u, F.lit(token), F.lit(value)))


def first_of_srcset(text: Column) -> Column:
    return _found(text, r"^\s*([^\s,]+)")


def json_list(text: Column) -> Column:
    """A JSON list of strings; null, blank, bad JSON and lists with other values give an empty list."""
    strings = F.from_json(text, "array<string>")
    # possessive: the engine takes long lists in a loop and never goes back
    one = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+'
    plain = text.rlike(rf"^\s*+\[\s*+(?:{one}(?:,\s*+{one})*+)?\]\s*+$")
    return F.coalesce(F.when(plain, strings), F.array().cast("array<string>"))


def json_text(strings: Column) -> Column:
    """A list of strings as JSON; null counts as empty."""
    return F.to_json(F.coalesce(strings, F.array().cast("array<string>")))


def photo_count(text: Column) -> Column:
    return F.size(json_list(text))


def seconds_between(begin: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", begin, end).cast("int")


def total_pages(total: Column, size: Column) -> Column:
    return F.when(size > 0, F.ceil(total / size)).otherwise(0).cast("long")


@F.pandas_udf(T.StringType())
def unescape_entities(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references decoded; the one step for which no column function exists."""
    for part in texts:
        yield part.map(html.unescape, na_action="ignore")


def html_to_text(markup: Column) -> Column:
    """Text of a fragment: line breaks kept, tags dropped, entities decoded, line ends collapsed."""
    out = F.regexp_replace(markup, r"(?i)<\s*(br|/p|/div|/li)\s*/?>", "\n")
    out = unescape_entities(F.regexp_replace(out, r"<[^>]*>", ""))
    return F.regexp_replace(F.regexp_replace(out, r"\n\s*\n+", "\n"), r"(?U)^\s+|\s+$", "")


def room_words(low: Column, high: Column, table: dict[str, int] | None = None) -> Column:
    """The words of a range of room counts; an upper bound that is not positive is open, the last word stands for it and more."""
    words = sorted((n, w) for w, n in (table or ROOM_WORDS).items())
    most = words[-1][0] - 1
    named = F.create_map(*(F.lit(x) for pair in words for x in pair))
    counts = room_range(low, F.when(high <= 0, most).otherwise(high), most)
    return F.concat(F.transform(counts, lambda n: named[n]), F.when(high > most, F.array(F.lit(words[-1][1]))).otherwise(F.array().cast("array<string>")))


def room_list(low: Column, high: Column, most: int = 6) -> Column:
    """A range of room counts as a list with commas; null where it leaves nothing out."""
    counts = room_range(low, F.when(high <= 0, most).otherwise(high), most)
    return F.when(~((low <= 0) & (high >= most)), F.array_join(F.transform(counts, lambda n: n.cast("string")), ","))
