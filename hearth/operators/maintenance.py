"""Bulk upkeep: extraction over the backlog, backfills, queues and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_description
from ..functions.extract import extract_all, fact, stems
from ..functions.normalize import split_location


def backlog(rows: DataFrame) -> Column:
    """Not enriched yet, with a text."""
    return F.col("ai_enriched_at").isNull() & F.col("description").isNotNull() & (F.col("description") != "")


def reprocess(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Backlog rows cleaned and extracted anew, other rows as they are; (rows, counts of processed and skipped)."""
    due = backlog(rows)
    text = clean_description(F.col("description"))
    changes = {c: F.when(F.col("__due"), v).otherwise(F.col(c)) for c, v in extract_all(F.col("__text"), F.col("__stems")).items() if c in rows.columns}
    marked = rows.withColumn("__due", due).withColumn("__text", F.when(F.col("__due"), text)).withColumn("__stems", stems(F.col("__text")))
    out = marked.withColumns(changes | {"description": F.when(F.col("__due"), F.col("__text")).otherwise(F.col("description"))}).select(*rows.columns)
    counts = rows.agg(F.count_if(due).alias("processed"), F.count_if(~due).alias("skipped"))
    return out, counts


def backfill_license(rows: DataFrame) -> DataFrame:
    """The usage licence where it isn't known and a text may tell."""
    return rows.withColumn("has_usage_license", F.coalesce("has_usage_license", fact(F.col("description"), "has_usage_license")))


def backfill_places(rows: DataFrame) -> DataFrame:
    """District and municipality from the flat place where the district isn't known."""
    first, second = split_location(F.col("location_string"))
    empty = F.col("distrito").isNull()
    return rows.withColumns({"concelho": F.when(empty, F.coalesce(second, F.col("concelho"))).otherwise(F.col("concelho")), "distrito": F.coalesce("distrito", first)})


def enrichment_queue(rows: DataFrame, limit: int = 40) -> DataFrame:
    return rows.where(backlog(rows)).orderBy("id").limit(limit).select("id", "description")


def missing_places(rows: DataFrame, limit: int = 300) -> DataFrame:
    """Distinct places without coordinates, in their order."""
    return rows.where(F.col("lat").isNull() & F.col("location_string").isNotNull()).select("location_string").distinct().orderBy("location_string").limit(limit)


def fill_coordinates(rows: DataFrame, gazetteer: DataFrame, limit: int = 300) -> DataFrame:
    """Rows with coordinates of their place where they had none and it was looked up."""
    found = missing_places(rows, limit).join(gazetteer.select("location_string", F.col("lat").alias("__lat"), F.col("lng").alias("__lng")), "location_string")
    joined = rows.join(F.broadcast(found), "location_string", "left")  # at most ``limit`` rows
    due = F.col("lat").isNull() & F.col("__lat").isNotNull()
    return joined.withColumns({"lng": F.when(due, F.col("__lng")).otherwise(F.col("lng")), "lat": F.when(due, F.col("__lat")).otherwise(F.col("lat"))}).select(*rows.columns)


def missing_count(rows: DataFrame) -> DataFrame:
    """How many rows with a place have no coordinates; before and after a fill, the difference is what it did."""
    return rows.agg(F.count_if(F.col("lat").isNull() & F.col("location_string").isNotNull()).alias("missing"))


def centroid(rows: DataFrame, default_lat: float = 41.15, default_lng: float = -8.61) -> DataFrame:
    """The mean coordinates of rows that have them, else the default centre."""
    shown = rows.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return shown.agg(F.coalesce(F.avg("lat"), F.lit(default_lat)).alias("lat"), F.coalesce(F.avg("lng"), F.lit(default_lng)).alias("lng"))
