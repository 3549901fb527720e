"""Listings that a person entered: one row each, through the same matching as all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import construction_status, fact, is_blank, orientation, orientation_source
from ..functions.normalize import dedup_hash
from ..schema import CANDIDATE

#: The source of an entry that names none, and the facts that are looked for in its text.
SOURCE = "Idealista"
FACTS = ("open_plan_kitchen", "elevator", "parking")
ENTERED = ("price", "location_string", "beds", "baths", "size_m2", "photos")


def parse(entries: DataFrame) -> DataFrame:
    """Candidates of entries (batch, seq, url, source, description and ``ENTERED``).

    Entries without a url are left out.  The text stays as it was entered, and the place is
    not split.
    """
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    text = F.coalesce("description", F.lit(""))
    sun = orientation(text)
    found = {
        "url": trimmed(F.col("url")), "source": F.when(is_blank(F.col("source")), F.lit(SOURCE)).otherwise(trimmed(F.col("source"))), "description": text,
        "sun_orientation": sun, "orientation_source": orientation_source(sun), "construction_status": construction_status(text),
        "photos": F.coalesce("photos", F.array().cast("array<string>")), **{name: fact(text, name) for name in FACTS}, **{name: F.col(name) for name in ENTERED if name != "photos"},
    }
    rows = entries.where(~is_blank(F.col("url")))
    key = dedup_hash(F.col("location_string"), F.col("price"), F.col("beds"), F.col("size_m2"))
    return rows.select("batch", "seq", *(found.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANDIDATE.fields), key.alias("dedup_hash"))
