"""Plain HTML result pages: one pass over a page finds its cards and their fields, however they are nested.

Entities are decoded before digits are kept, as an entity's number is no price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import Select, elements
from ..functions.normalize import split_location
from ..functions.parse import absolute_url, canonical_url, first_of_srcset, int_group, price_digits, rooms, size_m2, size_m2_grouped, unescape_entities, unwrap_tracking
from ..operators.geo import in_districts
from ..session import bounded_batches
from .common import filled, finish, numbered

# Tags and class names of the elements, as they are on the wire.
_IMAGES = {"source": Select("source", attrs=("srcset", "data-srcset"), text=False), "img": Select("img", attrs=("data-src",), text=False)}
ZIPPED = {
    "info": Select("div", "property-info-content", text=False, inside={
        "link": Select("a", "property-info", attrs=("href",), text=False), "type": Select("div", "property-type"), "place": Select("div", "property-location"),
        "features": Select("div", "property-features-text"), "cost": Select("div", "property-price-value"),
    }),
    "words": Select("div", "property-description"),
    "media": Select("div", "property-media", attrs=("data-uid",), text=False, inside={"slide": Select("div", "swiper-slide", text=False, inside=_IMAGES), **_IMAGES}),
}
_IMAGE = {"img": Select("img", attrs=("src",), text=False)}
PIPED = {
    "card": Select("div", "result_imovel_txt", breaks="\n", inside={
        "link": Select("a", attrs=("href",), has=("href",)), "plain": Select("span", lacks=("style",)), "styled": Select("span", has=("style",)), **_IMAGE,
    }, after={"picture": Select("div", "mod_imovel", text=False, inside=_IMAGE)}),
}
PROPS = {
    "card": Select("div", "prop", text=False, inside={
        "wrap": Select("div", "prop-imgWrap", text=False, inside={"link": Select("a", attrs=("href",), has=("href",), text=False)}), "area": Select("div", "prop-imgArea", attrs=("style",), text=False),
        "tag": Select("div", "prop-tag"), "first": Select("span", "prop-titleFirst"), "second": Select("span", "prop-titleSecond"), "words": Select("div", "prop-description"),
        "specs": Select("div", "prop-specsWrapInner", part=True), "cost": Select("div", "prop-tag-sub", part=True),
    }),
}


def text(fragment: Column) -> Column:
    plain = unescape_entities(F.regexp_replace(fragment, r"<[^>]*>", ""))
    return F.regexp_replace(plain, r"(?U)^\s+|\s+$", "")


def first(found: Column, name: str = "text") -> Column:
    """A value of the first element of a list, null if there is none."""
    return filled(F.get(found, 0)[name])


def cards(landed: DataFrame, wanted: dict[str, Select]) -> DataFrame:
    """A row for each card of each page; several lists are put together by position."""
    bounded_batches(landed.sparkSession)
    pages = landed.select("batch", elements(F.col("payload"), **wanted).alias("e"))
    rows = pages.select("batch", F.posexplode(F.arrays_zip(*(F.col(f"e.{n}").alias(n) for n in wanted))).alias("position", "b"))
    return rows.select("batch", "position", "b.*").where(F.col(next(iter(wanted))).isNotNull())


def photo_urls(media: Column) -> Column:
    """The first entry of each slide's source set, eager or lazy, else its image; distinct, in order.  Without slides all is one."""
    image = lambda s: F.coalesce(first_of_srcset(first(s["source"], "srcset")), first_of_srcset(first(s["source"], "data-srcset")), first(s["img"], "data-src"))
    urls = F.when(F.size(media["slide"]) > 0, F.transform(media["slide"], image)).otherwise(F.array(image(media)))
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull()))


def parse_zipped(landed: DataFrame) -> DataFrame:
    """Pages with three parallel lists of blocks, put together by position."""
    info, one, two = F.col("info"), *split_location(F.col("location_string"))
    rows = cards(landed, ZIPPED).withColumn("url", unwrap_tracking(first(info["link"], "href"))).where("url is not null")
    rows = rows.withColumn("location_string", F.coalesce(first(info["place"]), F.lit("Unknown")))
    rows = rows.select(
        "batch", "position", "url", "location_string", one.alias("distrito"), two.alias("concelho"), rooms(first(info["type"])).alias("beds"), size_m2(first(info["features"])).alias("size_m2"),
        price_digits(first(info["cost"])).alias("price"), F.col("words.text").alias("description"), photo_urls(F.col("media")).alias("photos"), filled(F.col("media.data-uid")).alias("source_property_id"),
    )
    return finish(numbered(rows), "CasaSapo")


def parse_piped(landed: DataFrame, districts: list[str] | None = None) -> DataFrame:
    """Pages of cards that name "district | municipality"; only those of the districts asked for.

    The picture is that of the block before a card, else the card's own.
    """
    card, body = F.col("card"), F.col("body")
    rows = cards(landed, PIPED).withColumns({"href": first(card["link"], "href"), "body": card["text"], "title": F.get(card["link"], 0)["text"]}).where("href is not null")
    words = F.get(F.filter(card["plain"]["text"], lambda s: ~F.lower(s).startswith("ref.") & (s != "")), 0)
    pair = r"([A-ZÀ-Ýa-zà-ÿ][^\n|]{1,40})\s*\|\s*([^\n]{1,40})"
    rows = rows.withColumns({"words": words, "district": F.trim(filled(F.regexp_extract(body, pair, 1))), "town": F.trim(filled(F.regexp_extract(body, pair, 2)))})
    rows = rows.withColumn("location_string", F.coalesce(F.concat(F.col("district"), F.lit(", "), F.col("town")), F.lit("Unknown"))).where(in_districts(F.col("location_string"), districts or []))
    long = F.concat_ws(" — ", "title", F.regexp_replace(F.col("words"), r"(?U)\s+", " "))
    photo = F.coalesce(first(F.get(card["picture"], 0)["img"], "src"), first(card["img"], "src"))
    rows = rows.select(
        "batch", "position", canonical_url(absolute_url(F.col("href"), "https://www.caixaimobiliario.pt")).alias("url"), price_digits(filled(F.regexp_extract(body, r"([\d.]+)\s*€", 1))).alias("price"), "location_string",
        F.col("district").alias("distrito"), F.col("town").alias("concelho"), rooms(F.col("title"), whole_word=True).alias("beds"), size_m2(first(card["styled"])).alias("size_m2"), long.alias("description"),
        F.filter(F.array(photo), lambda x: x.isNotNull()).alias("photos"), filled(F.regexp_extract(body, r"Ref\.\s*([\w/]+)", 1)).alias("source_property_id"), F.concat_ws(" — ", "title", "body").alias("__all"),
    )
    return finish(numbered(rows), "CaixaImobiliario", text=F.col("__all"))


def parse_props(landed: DataFrame) -> DataFrame:
    """One page of cards with titles in two parts."""
    card = F.col("card")
    rows = cards(landed, PROPS).withColumn("href", first(F.get(card["wrap"], 0)["link"], "href")).where("href is not null")
    rows = rows.withColumns({
        **{name: F.coalesce(first(card[name]), F.lit("")) for name in ("tag", "first", "second", "words", "specs")}, "cost": first(card["cost"]),
        "photo": filled(F.regexp_extract(first(card["area"], "style"), r"url\('([^']+)'\)", 1)),
    })
    both = F.concat("specs", "words")
    rows = rows.select(
        "batch", "position", absolute_url(F.col("href"), "https://imoveis.santander.pt").alias("url"), price_digits(F.col("cost")).alias("price"),
        F.coalesce(filled(F.concat_ws(", ", filled(F.col("first")), F.when(F.col("first") != "", filled(F.col("second"))))), F.lit("Unknown")).alias("location_string"), filled(F.col("first")).alias("distrito"), filled(F.col("second")).alias("concelho"),
        int_group(both, r"(?i)(\d+)\s*quartos?").alias("beds"), int_group(both, r"(?i)(\d+)\s*wc").alias("baths"), size_m2_grouped(F.col("specs")).alias("size_m2"),
        F.regexp_replace(F.concat_ws(" — ", "tag", "words"), r"^[ —]+|[ —]+$", "").alias("description"), F.filter(F.array(F.col("photo")), lambda x: x.isNotNull()).alias("photos"), filled(F.regexp_extract("tag", r"(?i)Ref[ª:]*\s*:?\s*(\d+)", 1)).alias("source_property_id"),
    )
    return finish(numbered(rows), "Santander")
