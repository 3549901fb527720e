"""What every source parser ends with: one schema, extracted facts, a cleaned text, the hash."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import clean_description
from ..functions.extract import extract_all, stems
from ..functions.normalize import dedup_hash
from ..operators.geo import in_districts, in_range
from ..schema import CANDIDATE


#: What of the settings each source's candidates are held to (fixed values).
GUARDS = {"Idealista": ("price", "beds"), "CustoJusto": ("price", "beds"), "CasaSapo": ("price", "beds"), "Santander": ("price", "district"), "CaixaImobiliario": ("district",), "ImoVirtual": ("district",)}


class SourceParser(Protocol):
    """Landed payloads (batch, seq, payload) to candidates (batch, seq and ``CANDIDATE`` with its hash)."""

    def __call__(self, landed: DataFrame) -> DataFrame: ...


def filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def place(district: Column, part: Column) -> Column:
    """"district, part", or whichever is there."""
    return F.when(filled(part).isNull(), district).otherwise(F.concat_ws(", ", district, part))


def finish(rows: DataFrame, source: str, text: Column | None = None, flags: dict[str, Column] | None = None) -> DataFrame:
    """Columns of ``rows`` named as in ``CANDIDATE`` stay, others of it are extracted from the text or null.

    flags: a source's own columns that count when true.
    """
    text = F.col("description") if text is None else text
    rows = rows.withColumn("__text", F.coalesce(text, F.lit("")))
    rows = rows.withColumn("__stems", stems(F.col("__text")))  # by one scan, once for all facts
    found = extract_all(F.col("__text"), F.col("__stems"))
    out = {}
    for field in CANDIDATE.fields:
        name = field.name
        if name == "source":
            value = F.lit(source)
        elif name == "description":
            value = clean_description(F.coalesce(F.col("description"), F.lit("")))
        elif flags and name in flags:
            value = F.when(flags[name], F.lit(True)).otherwise(found[name])
        elif name in rows.columns and name in found:
            value = F.coalesce(F.col(name), found[name])
        elif name in rows.columns:
            value = F.col(name)
        else:
            value = found.get(name, F.lit(None))
        out[name] = value.cast(field.dataType)
    rows = rows.withColumns(out)
    key = dedup_hash(F.col("location_string"), F.col("price"), F.col("beds"), F.col("size_m2"))
    return rows.select("batch", "seq", *[f.name for f in CANDIDATE.fields], key.alias("dedup_hash"))


def guarded(rows: DataFrame, settings: dict) -> DataFrame:
    """Candidates within the settings' bounds (price_min, price_max, rooms_min, rooms_max, districts), as far as they hold for the source.

    A price or a number of rooms that isn't known passes.
    """
    held = lambda kind: F.col("source").isin(*(s for s, kinds in GUARDS.items() if kind in kinds))
    nothing = F.lit(None).cast("int")
    price = in_range(F.col("price"), nothing, price_min=settings.get("price_min"), price_max=settings.get("price_max"))
    beds = in_range(nothing, F.col("beds"), rooms_min=settings.get("rooms_min"), rooms_max=settings.get("rooms_max"))
    place = in_districts(F.col("location_string"), settings.get("districts") or [])
    return rows.where((~held("price") | price) & (~held("beds") | beds) & (~held("district") | F.coalesce(place, F.lit(False))))


def numbered(rows: DataFrame) -> DataFrame:
    """``seq`` within a page from its position; pages are small."""
    return rows.withColumn("seq", F.col("position").cast("long")).drop("position")


def pages_until_empty(pages: DataFrame, count: Column) -> DataFrame:
    """Pages of each feed up to the first one without rows (running minimum over page numbers)."""
    order = Window.partitionBy("feed").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("__least", F.min(count).over(order)).where("__least > 0").drop("__least")


def first_encounter(rows: DataFrame, key: str) -> DataFrame:
    """The first row of a key within a feed, by page and position."""
    rank = F.struct("page", "position")
    rest = [c for c in rows.columns if c not in ("feed", key)]
    return rows.groupBy("feed", key).agg(F.min_by(F.struct(*rest), rank).alias("r")).select("feed", key, "r.*")


def merge_detail(rows: DataFrame, detail: DataFrame, stored: DataFrame) -> DataFrame:
    """Fresh detail before what is stored, that before the search page's preview; by url.

    detail and stored have url, description, lat, lng, energy_rating and photos; empty values don't count.
    """
    def renamed(table: DataFrame, prefix: str) -> DataFrame:
        return table.select("url", *(F.col(c).alias(f"{prefix}{c}") for c in ("description", "lat", "lng", "energy_rating", "photos")))

    joined = rows.join(renamed(detail, "__d_"), "url", "left").join(renamed(stored, "__s_"), "url", "left")
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    best = {c: F.coalesce(filled(F.col(f"__d_{c}")), filled(F.col(f"__s_{c}")), F.col(c)) for c in ("description", "energy_rating")}
    best |= {c: F.coalesce(f"__d_{c}", f"__s_{c}", c) for c in ("lat", "lng")}
    best["photos"] = F.coalesce(full("__d_photos"), full("__s_photos"), F.col("photos"))
    return joined.withColumns(best).select(*rows.columns)


def needs_detail(rows: DataFrame, stored: DataFrame, photo_cap: int = 1) -> DataFrame:
    """Rows of which the store lacks a full text, coordinates or more photos than a preview has."""
    known = stored.where((F.length("description") > 0) & F.col("lat").isNotNull() & (F.size("photos") > photo_cap)).select("url")
    return rows.join(known, "url", "left_anti")
