"""Normal forms of place names, and the hash that buckets equal listings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import is_blank

#: English names of districts (fixed values); keys in lower case.
DISTRICT_ALIASES = {"lisbon": "Lisboa", "oporto": "Porto", "evora": "Évora", "setubal": "Setúbal", "santarem": "Santarém", "braganca": "Bragança"}
#: Words that parish names differ by (fixed values).
CONNECTORS = r"\b(de|do|da|dos|das)\b"


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks and their bare letters, from Unicode's decompositions."""
    found = []
    for point in range(0xC0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) > 1 and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
            found.append((chr(point), parts[0]))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


_MARKED, _BARE = _fold_table()


def fold_accents(text: Column) -> Column:
    """Letters without their marks, composed or not."""
    return F.translate(F.regexp_replace(text, "[̀-ͯ]", ""), _MARKED, _BARE)


def normalize_location(text: Column) -> Column:
    """Trimmed, lower case, single spaces, no marks; null and blank give the empty string."""
    out = F.regexp_replace(F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), " +", " ")
    return F.when(is_blank(text), F.lit("")).otherwise(fold_accents(out))


def normalize_location_loose(text: Column) -> Column:
    """The same with every run of white space as one space (for photo blocks)."""
    out = F.regexp_replace(F.lower(fold_accents(text)), r"(?U)\s+", " ")
    return F.coalesce(F.regexp_replace(out, r"^ | $", ""), F.lit(""))


def parish_key(text: Column) -> Column:
    out = F.regexp_replace(F.lower(fold_accents(text)), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, CONNECTORS, " "), r"\s+", " "))


def parish_parts(text: Column) -> Column:
    """Names that a merged parish may go by: its parts, the whole, and each without parentheses."""
    parts = F.array_append(F.split(text, r",| e | - "), text)
    bare = F.transform(parts, lambda x: F.regexp_replace(x, r"\s*\([^)]*\)", ""))
    keys = F.transform(F.array_union(parts, bare), parish_key)
    return F.array_distinct(F.filter(keys, lambda x: x != ""))


def split_location(text: Column) -> tuple[Column, Column]:
    """(first part, rest) of a flat place; blank and Unknown give nulls."""
    known = ~is_blank(text) & (F.lower(F.trim(text)) != "unknown")
    parts = F.split(text, ",", 2)
    trim = lambda x: F.nullif(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit(""))
    return F.when(known, trim(parts[0])), F.when(known, trim(F.get(parts, 1)))


def district_name(text: Column) -> Column:
    """A district's own name for an English one; anything else as it is."""
    table = F.create_map(*(F.lit(x) for pair in DISTRICT_ALIASES.items() for x in pair))
    return F.coalesce(table[F.lower(F.trim(text))], text)


def district_slug(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """A source's own slug, else the normalised name with hyphens."""
    plain = F.replace(normalize_location(text), F.lit(" "), F.lit("-"))
    if not aliases:
        return plain
    return F.coalesce(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))[F.lower(F.trim(text))], plain)


def full_place(*parts: Column, fallback: Column) -> Column:
    """Parts that are not empty, joined by commas; the fallback if none is."""
    joined = F.concat_ws(", ", *(F.nullif(p, F.lit("")) for p in parts))
    return F.coalesce(F.nullif(joined, F.lit("")), fallback)


def price_bucket(price: Column) -> Column:
    """Multiples of 2500, halves to even."""
    return (F.bround(F.coalesce(price, F.lit(0)).cast("decimal(12,2)") / 2500, 0) * 2500).cast("long")


def dedup_hash(location: Column, price: Column, beds: Column, size: Column) -> Column:
    """16 hexadecimal digits of place, price bucket, beds and rounded size."""
    room = F.coalesce(F.bround(size.cast("decimal(10,2)"), 0).cast("long").cast("string"), F.lit("?"))
    key = F.concat_ws("|", normalize_location(location), price_bucket(price).cast("string"), F.coalesce(beds, F.lit(0)).cast("string"), room)
    return F.substring(F.sha2(key, 256), 1, 16)
