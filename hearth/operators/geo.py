"""Municipalities of parishes: names are looked up after conflicts are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import is_blank
from ..functions.normalize import normalize_location, parish_key, parish_parts


def parish_dimension(parishes: DataFrame) -> DataFrame:
    """(key, municipality) from (municipality, parish); keys of several municipalities are left out.

    A municipality's own name is a key too.  The table of parishes is the caller's.
    """
    own = parishes.select("municipality", parish_key(F.col("municipality")).alias("key"))
    parts = parishes.select("municipality", F.explode(parish_parts(F.col("parish"))).alias("key"))
    keys = own.unionByName(parts).where("key <> ''").groupBy("key").agg(F.min("municipality").alias("municipality"), F.max("municipality").alias("other"))
    return keys.where(F.col("municipality") == F.col("other")).select("key", "municipality")


def resolve_municipality(places: DataFrame, dimension: DataFrame, column: str = "place", result: str = "municipality") -> DataFrame:
    """Distinct places with their municipality: a direct hit, else the only candidate of their parts, else null."""
    dim = dimension.select(F.col("key").alias("__key"), F.col("municipality").alias("__hit"))
    named = places.select(column).distinct().withColumn("__own", F.when(~is_blank(F.col(column)), parish_key(F.col(column))))
    direct = named.join(dim, F.col("__own") == F.col("__key"), "left").select(column, F.col("__hit").alias("__direct"))
    votes = named.where(F.col("__own").isNotNull()).select(column, F.explode(parish_parts(F.col(column))).alias("__key")).join(dim, "__key")
    votes = votes.groupBy(column).agg(F.min("__hit").alias("__lo"), F.max("__hit").alias("__hi"))
    joined = direct.join(votes, column, "left")
    return joined.select(column, F.coalesce("__direct", F.when(F.col("__lo") == F.col("__hi"), F.col("__lo"))).alias(result))


def repair(rows: DataFrame, dimension: DataFrame, keep_parish: bool = True) -> DataFrame:
    """Rows with a parish in ``concelho`` moved: the right municipality, and the parish if ``freguesia`` is empty."""
    found = resolve_municipality(rows.select(F.col("concelho").alias("place")), dimension).where("place is not null")
    joined = rows.join(found.withColumnRenamed("place", "concelho"), "concelho", "left")
    wrong = needs_fix(F.col("municipality"), F.col("concelho"))
    parish = F.coalesce("freguesia", "concelho") if keep_parish else F.col("concelho")
    return joined.withColumns({"freguesia": F.when(wrong, parish).otherwise(F.col("freguesia")), "concelho": F.when(wrong, F.col("municipality")).otherwise(F.col("concelho"))}).select(*rows.columns)


def needs_fix(resolved: Column, stored: Column) -> Column:
    return F.coalesce(resolved.isNotNull() & (resolved != stored), F.lit(False))


def in_districts(location: Column, districts: list[str]) -> Column:
    """Whether a place names one of the districts; every place does if there are none."""
    if not districts:
        return F.lit(True)
    place = normalize_location(location)
    wanted = F.array(*(normalize_location(F.lit(d)) for d in districts))
    return F.exists(wanted, lambda d: F.contains(place, d))


def in_range(price: Column, beds: Column, price_min=None, price_max=None, rooms_min=None, rooms_max=None) -> Column:
    """The settings' bounds on a candidate; what isn't known passes."""
    out = F.lit(True)
    for value, low, high in ((price, price_min, price_max), (beds, rooms_min, rooms_max)):
        if low is not None:
            out = out & (value.isNull() | (value >= low))
        if high is not None:
            out = out & (value.isNull() | (value <= high))
    return out
