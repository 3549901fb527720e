"""A JSON interface: pages of results, with galleries fetched apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finish, numbered, place

SOURCE = "Idealista"
HOST = "https://www.idealista.pt"
#: Names as they are on the wire (fixed values).
PAGE = """total int, totalPages int, actualPage int, elementList array<struct<
  propertyCode string, thumbnail string, price double, size double, rooms int, bathrooms int, province string, municipality string, district string, neighborhood string,
  url string, description string, latitude double, longitude double,
  features struct<hasAirConditioning boolean, hasTerrace boolean>,
  contactInfo struct<commercialName string, contactName string, phone1 struct<phoneNumber string>>>>"""
LOCATIONS = "locations array<struct<locationId string, name string, subTypeText string>>"
GALLERY = "multimedia struct<images array<struct<url string>>>"


def location_ids(landed: DataFrame) -> DataFrame:
    """(feed, location_id): the district among the suggestions, else the first."""
    found = landed.select("feed", F.from_json("payload", LOCATIONS)["locations"].alias("l"))
    district = F.get(F.filter("l", lambda x: x["subTypeText"] == "Distrito"), 0)
    return found.select("feed", F.coalesce(district, F.get("l", 0))["locationId"].alias("location_id")).where("location_id is not null")


def parse(landed: DataFrame, galleries: DataFrame | None = None, district: str | None = None) -> DataFrame:
    """Candidates of landed pages; galleries (property_code, payload) replace thumbnails where they came."""
    rows = landed.select("batch", F.posexplode(F.from_json("payload", PAGE)["elementList"]).alias("position", "e")).select("batch", "position", "e.*")
    if galleries is not None:
        images = F.transform(F.from_json("payload", GALLERY)["multimedia"]["images"], lambda x: x["url"])
        rows = rows.join(galleries.select(F.col("property_code").alias("propertyCode"), images.alias("gallery")), "propertyCode", "left")
    else:
        rows = rows.withColumn("gallery", F.lit(None).cast("array<string>"))
    own = F.coalesce("province", F.lit(district)) if district else F.col("province")
    part = F.coalesce("district", "neighborhood", "municipality")
    thumbnail = F.filter(F.array("thumbnail"), lambda x: F.coalesce(x, F.lit("")) != "")
    rows = rows.select(
        "batch", "position", F.coalesce("url", F.concat(F.lit(f"{HOST}/imovel/"), "propertyCode", F.lit("/"))).alias("url"), F.col("price"), place(own, part).alias("location_string"),
        own.alias("distrito"), F.col("municipality").alias("concelho"), F.coalesce("district", "neighborhood").alias("freguesia"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"),
        F.col("rooms").alias("beds"), F.col("bathrooms").alias("baths"), F.col("size").alias("size_m2"), "description", F.when(F.size("gallery") > 0, F.col("gallery")).otherwise(thumbnail).alias("photos"),
        F.coalesce("contactInfo.commercialName", "contactInfo.contactName").alias("agent_name"), F.col("contactInfo.phone1.phoneNumber").alias("agent_phone"), F.col("propertyCode").alias("source_property_id"),
        F.col("features.hasAirConditioning").alias("__ac"), F.col("features.hasTerrace").alias("__terrace"),
    )
    return finish(numbered(rows), SOURCE, flags={"air_conditioning": F.col("__ac"), "balcony": F.col("__terrace")})
