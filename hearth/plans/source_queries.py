"""The six sources' parsers and manual entries over payloads that are made out of the tables.

Forty listings make a page.  A payload is written here in the source's own shape; the SQL
never sees it and says what the parser has to find.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import ROOM_WORDS
from ..operators.resolve import existing
from ..operators.versions import VersionedTable
from ..schema import LISTING_HASH, PRICE_HISTORY, PROPERTY, PROPERTY_SOURCE
from ..sources import common, html_cards, json_api, json_in_html, manual
from ..storage import new_path
from ..streaming.ingest import landed, merge_batches
from .registry import query
from .tables import AS_OF, LISTINGS, PLACED, listings, number, placed
from .text_queries import _PHRASES_SQL, PHRASES, _sql_fact

#: The settings that the sources' rows are held to.
SETTINGS = {"price_min": 60000, "price_max": 350000, "rooms_min": 1, "rooms_max": 4, "districts": ["Asia", " európe"]}
_BOUNDS = {"price": "(price IS NULL OR price BETWEEN 60000 AND 350000)", "beds": "beds BETWEEN 1 AND 4", "district": "region IN ('ASIA', 'EUROPE')"}

HOMES = f"""{PLACED}, h AS (
  SELECT q.*, id // 40 AS batch, row_number() OVER (PARTITION BY id // 40 ORDER BY id) - 1 AS seq, split_part(location_string, ', ', 1) AS region, split_part(location_string, ', ', 2) AS nation,
    {_PHRASES_SQL}[id % {len(PHRASES)} + 1] AS description FROM q)"""


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.split("location_string", ", ")
    phrase = F.element_at(F.array(*(F.lit(p) for p in PHRASES)), (F.col("id") % len(PHRASES) + 1).cast("int"))
    return placed(spark, sf_dir).select("id", "price", "size_m2", "beds", "location_string", place[0].alias("region"), place[1].alias("nation"), phrase.alias("words"))


def paged(rows: DataFrame, item: Callable[[Column], Column]) -> DataFrame:
    """(batch, items): what ``item`` makes of each listing of a page, in the order of ids."""
    pages = rows.groupBy(F.floor(F.col("id") / 40).alias("batch")).agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("homes"))
    return pages.select("batch", F.transform("homes", item).alias("items"))


def markup(*parts: Column | str) -> Column:
    """Texts and columns in a row; nulls are empty."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def in_script(data: Column) -> Column:
    return F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.to_json(data), F.lit("</script></html>"))


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("batch", "seq", "url", number("price").alias("price"), "location_string", "concelho", "beds", number("size_m2").alias("size_m2"), F.array_join("photos", "|").alias("photos"), "elevator", *more)


def _sql_shown(url: str, price: str, place: str, concelho: str, size: str, photos: str, more: str = "", where: str = "true", beds: str = "beds") -> str:
    return f"""WITH {HOMES}, x AS (SELECT * REPLACE ({price} AS price) FROM h)
SELECT batch, seq, {url} AS url, CAST(price AS DOUBLE) AS price, {place} AS location_string, {concelho} AS concelho, {beds} AS beds, CAST({size} AS DOUBLE) AS size_m2, {photos} AS photos, {_sql_fact('elevator')} AS elevator{more} FROM x WHERE {where}"""


@query(
    _sql_shown(
        "CASE WHEN id % 3 = 0 THEN 'https://www.idealista.pt/imovel/' || id || '/' ELSE 'https://x/' || id END", "CASE WHEN id % 11 <> 0 THEN price END", "region || ', ' || CASE WHEN id % 2 = 0 THEN nation ELSE 'D' || (id % 9) END", "nation", "size_m2",
        "CASE WHEN id % 5 = 0 THEN 'g' || id || 'a|g' || id || 'b' ELSE 't' || id || '.jpg' END", f", CASE WHEN id % 4 = 0 THEN true ELSE {_sql_fact('balcony')} END AS balcony", f"{_BOUNDS['price']} AND {_BOUNDS['beds']}",
    )
)
def source_json_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A terrace that the interface states counts before the text; galleries replace thumbnails."""

    def item(x: Column) -> Column:
        key, code = x["id"], x["id"].cast("string")
        return F.struct(
            code.alias("propertyCode"), F.concat(F.lit("t"), code, F.lit(".jpg")).alias("thumbnail"), F.when(key % 11 != 0, x["price"].cast("double")).alias("price"), x["size_m2"].cast("double").alias("size"), x["beds"].alias("rooms"), x["region"].alias("province"), x["nation"].alias("municipality"),
            F.when(key % 2 != 0, F.concat(F.lit("D"), (key % 9).cast("string"))).alias("district"), F.when(key % 3 != 0, F.concat(F.lit("https://x/"), code)).alias("url"), x["words"].alias("description"), F.struct((key % 4 == 0).alias("hasTerrace")).alias("features"),
        )

    rows = homes(spark, sf_dir)
    pages = paged(rows, item).select("batch", F.to_json(F.struct(F.size("items").alias("total"), F.col("items").alias("elementList"))).alias("payload"))
    code = F.col("id").cast("string")
    image = lambda end: F.struct(F.concat(F.lit("g"), code, F.lit(end)).alias("url"))
    galleries = rows.where("id % 5 = 0").select(code.alias("property_code"), F.to_json(F.struct(F.struct(F.array(image("a"), image("b")).alias("images")).alias("multimedia"))).alias("payload"))
    return _shown(common.guarded(json_api.parse(pages, galleries), SETTINGS), "balcony")


@query(
    _sql_shown(
        "'https://www.imovirtual.com/pt/anuncio/s-' || id", "CASE WHEN id % 11 <> 0 THEN price END", "CASE WHEN id % 6 = 0 THEN region ELSE location_string END", "CASE WHEN id % 6 <> 0 THEN nation END", "size_m2",
        "CASE WHEN id % 4 = 0 THEN '' ELSE 'm' || id END", ", 'Agent ' || (id % 7) AS agent_name", _BOUNDS["district"],
    )
)
def source_script_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.array(*(F.lit(w) for w in ROOM_WORDS))

    def item(x: Column) -> Column:
        key, code = x["id"], x["id"].cast("string")
        address = F.struct(F.struct(F.when(key % 6 != 0, x["nation"]).alias("name")).alias("city"), F.struct(x["region"].alias("name")).alias("province"))
        return F.struct(
            key.alias("id"), F.concat(F.lit("s-"), code).alias("slug"), F.element_at(word, x["beds"] + 1).alias("roomsNumber"), x["size_m2"].cast("double").alias("areaInSquareMeters"), x["words"].alias("shortDescription"), F.struct(F.when(key % 11 != 0, x["price"].cast("double")).alias("value")).alias("totalPrice"),
            F.struct(address.alias("address")).alias("location"), F.array(F.struct(F.when(key % 4 != 0, F.concat(F.lit("m"), code)).otherwise("").alias("medium"))).alias("images"), F.struct(F.concat(F.lit("Agent "), (key % 7).cast("string")).alias("name")).alias("agency"),
        )

    ads = F.struct(F.struct(F.struct(F.struct(F.struct(F.col("items")).alias("searchAds")).alias("data")).alias("pageProps")).alias("props"))
    pages = paged(homes(spark, sf_dir), item).select("batch", in_script(ads).alias("payload"))
    return _shown(common.guarded(json_in_html.parse_ads(pages), SETTINGS), "agent_name")


@query(
    _sql_shown(
        "CASE id % 3 WHEN 0 THEN 'https://www.custojusto.pt/a/' || id WHEN 1 THEN 'https://x/' || id ELSE 'https://www.custojusto.pt/anuncio/' || id END", "CASE WHEN id % 11 <> 0 THEN price END", "region || ', ' || CASE WHEN id % 2 = 0 THEN nation ELSE 'P' || (id % 9) END", "nation", "size_m2",
        "CASE WHEN id % 4 = 0 THEN '' ELSE 'm' || id END", ", CASE WHEN id % 2 <> 0 THEN 'P' || (id % 9) END AS freguesia, 'Café & ' || description AS description", f"id % 7 <> 0 AND {_BOUNDS['price']} AND {_BOUNDS['beds']}",
    )
)
def source_script_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what is for sale; entities of the text are decoded."""

    def item(x: Column) -> Column:
        key, code = x["id"], x["id"].cast("string")
        parish = F.when(key % 2 != 0, F.concat(F.lit("P"), (key % 9).cast("string")))
        link = F.when(key % 3 == 0, F.concat(F.lit("/a/"), code)).when(key % 3 == 1, F.concat(F.lit("https://x/"), code)).otherwise("")
        size = F.when(x["size_m2"].isNotNull(), F.concat(x["size_m2"].cast("int").cast("string"), F.lit(" m2")))
        return F.struct(
            code.alias("listID"), F.concat(F.lit("Caf&eacute; &amp; "), x["words"]).alias("body"), F.when(key % 7 == 0, "rent").otherwise("sell").alias("type"), F.when(key % 11 != 0, x["price"].cast("double")).alias("price"), link.alias("url"), F.when(key % 4 != 0, F.concat(F.lit("m"), code)).otherwise("").alias("imageFullURL"),
            F.struct(x["region"].alias("district"), x["nation"].alias("county"), parish.alias("parish")).alias("locationNames"), F.struct(F.concat(F.lit("T"), x["beds"].cast("string")).alias("rooms"), size.alias("size")).alias("params"),
        )

    found = F.struct(F.struct(F.struct(F.col("items").alias("listItems")).alias("pageProps")).alias("props"))
    pages = paged(homes(spark, sf_dir), item).select("batch", in_script(found).alias("payload"))
    return _shown(common.guarded(json_in_html.parse_list(pages), SETTINGS), "freguesia", "description")


_WHOLE = "CAST(floor(price) AS BIGINT)"


def _grouped(price: Column) -> Column:
    """Whole euros with dots between thousands."""
    return F.replace(F.format_number(F.floor(price), 0), F.lit(","), F.lit("."))


@query(
    _sql_shown(
        "'https://x/' || id", f"CASE WHEN id % 11 <> 0 THEN {_WHOLE} END", "location_string", "nation", "size_m2 + 0.5", "'p' || id || '|r' || id", f", {_sql_fact('balcony')} AS balcony, region AS distrito", f"{_BOUNDS['price']} AND {_BOUNDS['beds']}"
    )
)
def source_zipped_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists of blocks, put together by position; links behind a tracker."""

    def item(x: Column) -> Column:
        key, code = x["id"], x["id"].cast("string")
        size = F.when(x["size_m2"].isNotNull(), F.concat(F.lit("Usado &middot; "), x["size_m2"].cast("int").cast("string"), F.lit(",5 m&#178;"))).otherwise("Usado")
        return markup(
            "<div class='property-info-content'><a class='property-info' href='/r?l=https%3A%2F%2Fx%2F", code, "&amp;z=1'>a</a><div class='property-type'>Apartamento T", x["beds"], "</div><div class='property-location'> ", x["location_string"], " </div><div class='property-features-text'>", size,
            "</div><div class='property-price-value'>", F.when(key % 11 != 0, _grouped(x["price"])), "&#8364;</div></div><div class='property-description'><p>", x["words"], "</p></div><div class='property-media'><div class='swiper-slide'><picture><source srcset='p", code, " 1x, q 2x'></picture></div><div class='swiper-slide'><img data-src='r", code, "'></div></div>",
        )

    pages = paged(homes(spark, sf_dir), item).select("batch", F.array_join("items", "\n").alias("payload"))
    return _shown(common.guarded(html_cards.parse_zipped(pages), SETTINGS), "balcony", "distrito")


@query(
    _sql_shown(
        "'https://www.caixaimobiliario.pt/comprar/imovel.jsp?id=' || id", _WHOLE, "location_string", "nation", "size_m2", "CASE WHEN id % 2 = 0 THEN 'i' || id ELSE '' END", ", '001/' || id AS source_property_id, 'Apartamento T' || beds || ' — ' || description AS description", _BOUNDS["district"]
    )
)
def source_piped_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    def item(x: Column) -> Column:
        key, code = x["id"], x["id"].cast("string")
        return markup(
            "<div class='result_imovel_txt'>", F.when(key % 2 == 0, F.concat(F.lit("<img src='i"), code, F.lit("'>"))), "<a href='/comprar/imovel.jsp?id=", code, "&pos=3'>Apartamento T", x["beds"], "</a><br/><b>", _grouped(x["price"]), " &euro;</b><br/>", x["region"], " | ", x["nation"],
            "<br/><span style='font-size:11px;'>", F.when(x["size_m2"].isNotNull(), F.concat(x["size_m2"].cast("int").cast("string"), F.lit(" m&sup2; de area bruta"))), "</span><span>", x["words"], "</span><span>Ref. 001/", code, "</span></div>",
        )

    pages = paged(homes(spark, sf_dir), item).select("batch", F.array_join("items", "").alias("payload"))
    return _shown(html_cards.parse_piped(pages, SETTINGS["districts"]), "source_property_id", "description")


@query(
    _sql_shown(
        "'https://imoveis.santander.pt/i/' || id", f"CASE WHEN id % 11 <> 0 THEN {_WHOLE} END", "location_string", "nation", "size_m2 + 1000.5", "'p' || id", ", CAST(id % 4 AS INTEGER) AS baths, CAST(id AS VARCHAR) AS source_property_id", f"{_BOUNDS['price']} AND {_BOUNDS['district']}"
    )
)
def source_titled_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    def item(x: Column) -> Column:
        key, code = x["id"], x["id"].cast("string")
        size = F.when(x["size_m2"].isNotNull(), F.concat(F.replace(F.format_number(x["size_m2"] + 1000, 0), F.lit(","), F.lit(".")), F.lit(",5 m2")))
        return markup(
            "<div class='prop'><div class='prop-imgWrap'><a href='/i/", code, "'><div class='prop-imgArea' style=\"background:url('p", code, "')\"></div></a></div><div class='prop-tag'>Apartamento Ref: ", code, "</div><div class='x prop-tag-sub'>", F.when(key % 11 != 0, _grouped(x["price"])),
            " &euro;</div><span class='prop-titleFirst'>", x["region"], "</span><span class='prop-titleSecond'>", x["nation"], "</span><div class='prop-description'>", x["words"], "</div><div class='a prop-specsWrapInner'>", x["beds"], " quartos ", key % 4, " wc ", size, "</div></div>",
        )

    pages = paged(homes(spark, sf_dir), item).select("batch", F.array_join("items", "").alias("payload"))
    return _shown(common.guarded(html_cards.parse_props(pages), SETTINGS), "baths", "source_property_id")


@query(
    _sql_shown(
        "'https://imoveis.santander.pt/i/' || id", f"CASE WHEN id % 11 <> 0 THEN {_WHOLE} END", "location_string", "nation", "size_m2 + 1000.5", "'p' || id", ", CAST(id AS VARCHAR) AS source_property_id, 'Apartamento Ref: ' || id || ' — antes ' || description || ' depois' AS description"
    )
)
def source_nested_titled_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that hold elements of their own kind, cards in comments and scripts, every second card never closed."""

    def item(x: Column) -> Column:
        key, code = x["id"], x["id"].cast("string")
        size = F.when(x["size_m2"].isNotNull(), F.concat(F.replace(F.format_number(x["size_m2"] + 1000, 0), F.lit(","), F.lit(".")), F.lit(",5 m2")))
        return markup(
            "<!-- <div class='prop'><div class='prop-imgWrap'><a href='/no'> --><script>var a = \"<div class='prop'><div class='prop-tag'>no</div></div>\";</script><section>", F.when(key % 3 == 0, "</b></em>"),
            "<DIV title='1 > 0' class='prop'><div class='prop-imgWrap'><div><div></div><a href=/i/", code, "><div class='prop-imgArea' style=\"background:url('p", code, "')\"></div></a></div></div><div class='prop-tag'><div>Apartamento</div> <div>Ref: ", code,
            "</div></div><div class='x prop-tag-sub'><div>", F.when(key % 11 != 0, _grouped(x["price"])), "</div> &euro;<br></div><span class='prop-titleFirst'><span>", x["region"], "</span></span><span class='prop-titleSecond'>", x["nation"],
            "</span><div class='prop-description'><div>antes</div> <div><p>", x["words"], "</div> depois</div><div class='a prop-specsWrapInner'><div>", x["beds"], " quartos</div> ", size, "</div>", F.when(key % 2 == 0, "</div></section>"),
        )

    pages = paged(homes(spark, sf_dir), item).select("batch", F.array_join("items", "").alias("payload"))
    return _shown(html_cards.parse_props(pages), "source_property_id", "description")


@query(
    _sql_shown(
        "'https://x/' || id", f"CASE WHEN id % 11 <> 0 THEN {_WHOLE} END", "location_string", "nation", "size_m2 + 0.5", "CASE WHEN id % 2 = 0 THEN 'p' || id || '|r' || id ELSE 's' || id END", ", 'u' || id AS source_property_id, 'Sala & ' || description || ' fim' AS description"
    )
)
def source_nested_zipped_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists whose blocks hold blocks; a slide inside a wrapper, or a picture without slides; numbers of the media blocks."""

    def item(x: Column) -> Column:
        key, code = x["id"], x["id"].cast("string")
        size = F.when(x["size_m2"].isNotNull(), F.concat(F.lit("<div>Usado</div> "), x["size_m2"].cast("int").cast("string"), F.lit(",5 m&#178;"))).otherwise("Usado")
        slides = markup("<div><div class='swiper-slide'><div><picture><source srcset='p", code, " 1x, q 2x'></picture></div></div><!-- <div class='swiper-slide'><img data-src='no'></div> --><div class='swiper-slide'><img data-src='r", code, "'/></div></div>")
        return markup(
            "<div class='property-info-content'><div><a class='property-info' href='/r?l=https%3A%2F%2Fx%2F", code, "&amp;z=1'><div>a</div></a></div><div class='property-type'><div>Apartamento</div> T", x["beds"], "</div><div class='property-location'><div> ", x["location_string"], "</div> </div><div class='property-features-text'>", size,
            "</div><div class='property-price-value'><div></div>", F.when(key % 11 != 0, _grouped(x["price"])), "&#8364;</div></div><div class='property-description'><div>Sala &amp; </div><div><div>", x["words"], "</div></div><!-- </div> --> fim</div><div class='property-media' data-uid='u", code, "'>",
            F.when(key % 2 == 0, slides).otherwise(markup("<div><source srcset='s", code, " 1x'></div>")), "</div>",
        )

    pages = paged(homes(spark, sf_dir), item).select("batch", F.array_join("items", "\n").alias("payload"))
    return _shown(html_cards.parse_zipped(pages), "source_property_id", "description")


@query(
    _sql_shown("'https://www.caixaimobiliario.pt/comprar/imovel.jsp?id=' || id", _WHOLE, "location_string", "nation", "size_m2", "CASE WHEN id % 3 = 0 THEN 'b' || id WHEN id % 3 = 1 THEN 'i' || id ELSE '' END", ", '001/' || id AS source_property_id, 'Apartamento T' || beds || ' — ' || description AS description")
)
def source_nested_piped_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures in the block before a card or in the card; spans in spans."""

    def item(x: Column) -> Column:
        key, code = x["id"], x["id"].cast("string")
        return markup(
            "<div>", F.when(key % 3 == 0, F.concat(F.lit("<div class='mod_imovel'><div><img src='b"), code, F.lit("'></div></div><div></div>"))), "<div class='result_imovel_txt'>", F.when(key % 3 < 2, F.concat(F.lit("<img src='i"), code, F.lit("'>"))), "<a>x</a><br><a href='/comprar/imovel.jsp?id=", code, "&pos=3'>Apartamento <span></span>T", x["beds"],
            "</a><br/><div><b>", _grouped(x["price"]), " &euro;</b></div><br/><div>", x["region"], " | ", x["nation"], "<br/></div><span style='font-size:11px;'>", F.when(x["size_m2"].isNotNull(), F.concat(F.lit("<b>"), x["size_m2"].cast("int").cast("string"), F.lit(" m&sup2;</b> de area bruta"))), "</span><span>Ref. 001/", code,
            "</span><span> ", x["words"], "</span></div></div>",
        )

    pages = paged(homes(spark, sf_dir), item).select("batch", F.array_join("items", "").alias("payload"))
    return _shown(html_cards.parse_piped(pages), "source_property_id", "description")


@query(
    f"""WITH {HOMES} SELECT 'https://x/' || id AS url, CASE WHEN id % 3 = 0 THEN 'Idealista' ELSE 'Own' END AS source, location_string, description, {_sql_fact('elevator')} AS elevator, {_sql_fact('parking')} AS parking, {_sql_fact('open_plan_kitchen')} AS open_plan_kitchen,
  CAST(NULL AS BOOLEAN) AS balcony, CAST(NULL AS VARCHAR) AS distrito, substr(sha256(strip_accents(lower(trim(location_string))) || '|' || CAST(round_even(price / 2500, 0) * 2500 AS BIGINT) || '|' || beds || '|?'), 1, 16) AS dedup_hash FROM h WHERE id % 5 <> 0"""
)
def manual_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entered by hand: no url, no candidate; a few facts only, the place as it is."""
    key = F.col("id")
    entries = homes(spark, sf_dir).select(
        F.lit(0).cast("long").alias("batch"), key.alias("seq"), F.when(key % 5 != 0, F.concat(F.lit(" https://x/"), key.cast("string"), F.lit("\n"))).when(key % 10 == 0, " ").alias("url"), F.when(key % 3 == 1, " Own ").when(key % 3 == 2, "Own").when(key % 6 == 0, "  ").alias("source"),
        "price", "location_string", "beds", F.lit(None).cast("int").alias("baths"), F.lit(None).cast("decimal(8,2)").alias("size_m2"), F.col("words").alias("description"), F.lit(None).cast("array<string>").alias("photos"),
    )
    return manual.parse(entries).select("url", "source", "location_string", "description", "elevator", "parking", "open_plan_kitchen", "balcony", "distrito", "dedup_hash")


_FEEDS = "SELECT o_orderpriority AS feed, o_orderkey // 400 AS page, o_orderkey % 400 AS position, 'L' || (o_custkey % 97) AS listing FROM orders"


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    return listings(spark, sf_dir).select(F.col("source").alias("feed"), F.floor(key / 400).alias("page"), (key % 400).alias("position"), F.concat(F.lit("L"), (F.col("custkey") % 97).cast("string")).alias("listing"))


@query(f"SELECT feed, listing, page, position FROM (SELECT *, row_number() OVER (PARTITION BY feed, listing ORDER BY page, position) AS k FROM ({_FEEDS})) WHERE k = 1")
def feed_first_encounter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.first_encounter(_feeds(spark, sf_dir), "listing").select("feed", "listing", "page", "position")


@query(f"WITH n AS (SELECT feed, page, count(*) FILTER (position % 3 = 0) AS n FROM ({_FEEDS}) GROUP BY ALL), m AS (SELECT *, min(n) OVER (PARTITION BY feed ORDER BY page) AS least FROM n) SELECT feed, page, n FROM m WHERE least > 0")
def feed_pages_until_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _feeds(spark, sf_dir).groupBy("feed", "page").agg(F.count_if(F.col("position") % 3 == 0).alias("n"))
    return common.pages_until_empty(pages, F.col("n"))


@query(
    f"""WITH {PLACED}, s AS (SELECT id, id % 3 = 0 AS d, id % 4 = 0 AS s FROM q)
SELECT id, CASE WHEN d AND id % 2 = 0 THEN 'detail' WHEN s THEN 'stored' ELSE 'preview' END AS description, CAST(CASE WHEN d AND id % 9 = 0 THEN 1 WHEN s THEN 2 END AS DOUBLE) AS lat, CASE WHEN d AND id % 6 = 0 THEN 'd' WHEN s THEN 's|t' ELSE 'p' END AS photos, NOT s AS wanting FROM s"""
)
def detail_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh details before stored ones before the preview; what the store lacks is wanting."""
    key = F.col("id")
    rows = listings(spark, sf_dir).select("id", "url", F.lit("preview").alias("description"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), F.lit(None).cast("string").alias("energy_rating"), F.array(F.lit("p")).alias("photos"))
    nothing = F.array().cast("array<string>")
    detail = rows.where("id % 3 = 0").withColumns({"description": F.when(key % 2 == 0, "detail").otherwise(""), "lat": F.when(key % 9 == 0, 1.0), "photos": F.when(key % 6 == 0, F.array(F.lit("d"))).otherwise(nothing)})
    stored = rows.where("id % 4 = 0").withColumns({"description": F.lit("stored"), "lat": F.lit(2.0), "photos": F.array(F.lit("s"), F.lit("t"))})
    wanting = common.needs_detail(rows, stored).select("id", F.lit(True).alias("wanting"))
    merged = common.merge_detail(rows, detail, stored).select("id", "description", "lat", F.array_join("photos", "|").alias("photos"))
    return merged.join(wanting, "id", "left").select("id", "description", "lat", "photos", F.coalesce("wanting", F.lit(False)).alias("wanting"))


@query(
    f"""WITH {PLACED}, a AS (SELECT id, CASE WHEN id % 2 = 0 THEN price + id % 3 * 1000 ELSE price END AS price, id % 2 = 0 AND id % 3 <> 0 AS changed, id % 4 = 2 AS linked FROM q WHERE id % 4 <> 3)
SELECT 'https://a/' || id AS url, CAST(price AS DOUBLE) AS price, CASE WHEN changed THEN 1 ELSE 0 END AS n_changes, CASE WHEN linked THEN 'https://b/' || id ELSE '' END AS links FROM a
UNION ALL SELECT 'https://b/' || id, CAST(price AS DOUBLE), 0, '' FROM q WHERE id % 4 = 3"""
)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three landings through the stream: new listings, new prices of half of them, and another source's.

    The stream begins anew for each landing and goes on where it was; the tables lie in buckets.
    """
    work, rows, key = new_path(spark, "stream"), homes(spark, sf_dir), F.col("id")
    nothing = {"baths": F.lit(None).cast("int"), "description": F.lit(""), "photos": F.lit(None).cast("array<string>")}
    of = lambda letter: {"url": F.concat(F.lit(f"https://{letter}/"), key.cast("string")), "source": F.lit(letter)}
    landings = (
        rows.where("id % 4 <> 3").withColumns(of("a")), rows.where("id % 4 <> 3 and id % 2 = 0").withColumns({**of("a"), "price": F.col("price") + key % 3 * 1000}), rows.where("id % 4 >= 2").withColumns(of("b")),
    )
    tables = [VersionedTable(spark, f"{work}/{name}", kind, by, buckets=8) for name, kind, by in (("properties", PROPERTY, "url"), ("links", PROPERTY_SOURCE, "property_id"), ("history", PRICE_HISTORY, "property_id"))]
    hashes = VersionedTable(spark, f"{work}/hashes", LISTING_HASH, "dedup_hash", buckets=8)
    for new in landings:
        entries = new.withColumns({"batch": F.floor(key / 40), "seq": key, **nothing})
        found = manual.parse(entries).withColumn("dedup_hash", F.concat(F.lit("h"), F.col("seq").cast("string")))
        found.write.mode("append").parquet(f"{work}/in")
        merge_batches(landed(spark, f"{work}/in", found.schema), *tables, lambda n: AS_OF + timedelta(days=n), f"{work}/state", hashes=hashes).awaitTermination()
    properties, links, history = (t.read() for t in tables)
    changes = history.groupBy("property_id").agg(F.count("*").alias("n_changes"))
    linked = links.groupBy("property_id").agg(F.array_join(F.array_sort(F.collect_list("url")), "|").alias("links"))
    joined = properties.withColumnRenamed("id", "property_id").join(changes, "property_id", "left").join(linked, "property_id", "left")
    return joined.select("url", number("price").alias("price"), F.coalesce("n_changes", F.lit(0)).alias("n_changes"), F.coalesce("links", F.lit("")).alias("links"))


@query(f"WITH {LISTINGS} SELECT p.id, coalesce(p.id % 3 <> 0 AND p.id % 2 = 0, false) AS known, CASE WHEN p.id % 3 <> 0 AND p.id % 2 = 0 THEN CAST(price AS DOUBLE) END AS stored_price FROM p")
def page_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of all candidates are stored, looked up in buckets that two landings and a removal wrote."""
    rows = listings(spark, sf_dir).select("id", "url", "price")
    store = VersionedTable(spark, new_path(spark, "existence"), rows.schema, "url", buckets=8)
    store.write(rows.where("id % 2 = 0 and id % 3 = 1"))
    store.append(rows.where("id % 2 = 0 and id % 3 <> 1"))
    where = store.touched(rows.where("id % 3 = 0").select("url"))
    store.write(store.read(where).where("id % 3 <> 0"), where)
    store.vacuum(keep=1)
    return existing(rows, store).select("id", "known", number("stored_price").alias("stored_price"))
