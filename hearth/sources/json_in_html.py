"""JSON inside a script element of a page, in two shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import absolute_url, gallery_urls, html_to_text, rooms, rooms_of_word, size_m2, unescape_entities
from .common import filled, finish, numbered, place

#: The script element that both sites fill (fixed value).
SCRIPT = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'
# Names as they are on the wire (fixed values).
ADS = """props struct<pageProps struct<data struct<searchAds struct<
  pagination struct<totalItems int, totalPages int, currentPage int>,
  items array<struct<id long, slug string, roomsNumber string, areaInSquareMeters double, shortDescription string, totalPrice struct<value double>,
    location struct<address struct<city struct<name string>, province struct<name string>>>, images array<struct<medium string>>,
    advertOwner struct<name string>, agency struct<name string>>>>>>>"""
AD_DETAIL = "props struct<pageProps struct<unifiedAd struct<resolvedPhone string, description string>, ad struct<images array<struct<medium string>>>>>"
LIST = """props struct<pageProps struct<listItems array<struct<listID string, title string, body string, name string, type string, price double, url string, imageFullURL string,
  locationNames struct<district string, county string, parish string>, params struct<rooms string, size string>>>>>"""
LIST_DETAIL = """props struct<pageProps struct<adData struct<body string, location struct<lat double, lon double>, params struct<energyrating struct<name string>>,
  extraImages array<struct<yams_oid string, deleted boolean>>>>>"""


def script(html: Column) -> Column:
    return filled(F.regexp_extract(html, SCRIPT, 1))


def parse_ads(landed: DataFrame) -> DataFrame:
    """Candidates of pages whose items are advertisements with words for room counts."""
    items = F.from_json(script(F.col("payload")), ADS)["props"]["pageProps"]["data"]["searchAds"]["items"]
    rows = landed.select("batch", F.posexplode(items).alias("position", "e")).select("batch", "position", "e.*")
    city, province = F.col("location.address.city.name"), F.col("location.address.province.name")
    both = filled(province).isNotNull() & filled(city).isNotNull()
    rows = rows.select(
        "batch", "position", F.concat(F.lit("https://www.imovirtual.com/pt/anuncio/"), "slug").alias("url"), F.col("totalPrice.value").alias("price"),
        F.when(both, F.concat_ws(", ", province, city)).otherwise(F.coalesce(city, province, F.lit("Unknown"))).alias("location_string"), province.alias("distrito"), city.alias("concelho"),
        rooms_of_word(F.col("roomsNumber")).alias("beds"), F.col("areaInSquareMeters").alias("size_m2"), F.col("shortDescription").alias("description"),
        F.filter(F.transform("images", lambda x: x["medium"]), lambda x: F.coalesce(x, F.lit("")) != "").alias("photos"),
        F.coalesce("advertOwner.name", "agency.name").alias("agent_name"), F.col("id").cast("string").alias("source_property_id"),
    )
    return finish(numbered(rows), "ImoVirtual")


def ad_details(landed: DataFrame) -> DataFrame:
    """(url, description, agent_phone, photos) of landed detail pages (url, payload)."""
    page = F.from_json(script(F.col("payload")), AD_DETAIL)["props"]["pageProps"]
    rows = landed.select("url", page.alias("d"))
    return rows.select("url", html_to_text(F.col("d.unifiedAd.description")).alias("description"), F.col("d.unifiedAd.resolvedPhone").alias("agent_phone"), F.filter(F.transform("d.ad.images", lambda x: x["medium"]), lambda x: x.isNotNull()).alias("photos"))


def parse_list(landed: DataFrame, district: str | None = None) -> DataFrame:
    """Candidates of pages with a flat list; only what is for sale."""
    items = F.from_json(script(F.col("payload")), LIST)["props"]["pageProps"]["listItems"]
    rows = landed.select("batch", F.posexplode(items).alias("position", "e")).select("batch", "position", "e.*").where(F.col("type") == "sell")
    own = F.coalesce("locationNames.district", F.lit(district)) if district else F.col("locationNames.district")
    link = absolute_url(filled(F.col("url")), "https://www.custojusto.pt", F.concat(F.lit("https://www.custojusto.pt/anuncio/"), "listID"))
    rows = rows.select(
        "batch", "position", link.alias("url"), "price", place(own, F.coalesce("locationNames.parish", "locationNames.county")).alias("location_string"), own.alias("distrito"), F.col("locationNames.county").alias("concelho"),
        F.col("locationNames.parish").alias("freguesia"), rooms(F.col("params.rooms")).alias("beds"), size_m2(F.col("params.size")).alias("size_m2"), unescape_entities(F.col("body")).alias("description"),
        F.filter(F.array("imageFullURL"), lambda x: F.coalesce(x, F.lit("")) != "").alias("photos"), F.col("name").alias("agent_name"), F.col("listID").alias("source_property_id"),
    )
    return finish(numbered(rows), "CustoJusto")


def list_details(landed: DataFrame) -> DataFrame:
    """(url, description, lat, lng, energy_rating, photos) of landed detail pages (url, payload)."""
    rows = landed.select("url", F.from_json(script(F.col("payload")), LIST_DETAIL)["props"]["pageProps"]["adData"].alias("d"))
    photos = F.filter(F.transform("d.extraImages", lambda x: x["yams_oid"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return rows.select("url", unescape_entities(filled(F.col("d.body"))).alias("description"), F.col("d.location.lat").alias("lat"), F.col("d.location.lon").alias("lng"), F.col("d.params.energyrating.name").alias("energy_rating"), gallery_urls(photos).alias("photos"))
