"""Detail pages, backfills, counts before and after, run records, settings, and texts for places and rooms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize, parse
from ..operators import maintenance, merge, reports
from ..operators.resolve import tally
from ..schema import APP_SETTING
from ..sources import json_in_html
from .registry import query
from .source_queries import HOMES, homes, in_script, markup
from .tables import AS_OF, LISTINGS, PLACED, listings, placed, sql_stamp, stamp
from .text_queries import _LOCATIONS, DESCRIBED, _LOCATIONS_SQL, _spots, _sql_fact, described


def _details(rows: DataFrame, page: Column) -> DataFrame:
    """(url, payload): each listing's detail page."""
    return rows.select(markup("https://x/", F.col("id")).alias("url"), in_script(F.struct(F.struct(page.alias("pageProps")).alias("props"))).alias("payload"))


@query(
    f"""WITH {HOMES} SELECT 'https://x/' || id AS url, 'Casa ' || id || chr(10) || description || ' & <b>' AS description, CASE WHEN id % 3 <> 0 THEN '+351 ' || id END AS agent_phone, CASE WHEN id % 4 = 0 THEN '' ELSE 'a' || id || '|b' || id END AS photos FROM h"""
)
def source_ads_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages of advertisements: marked-up text, telephone and pictures, of which some have no address."""
    text = markup("<p>Casa ", F.col("id"), "</p><br/>\n<br>", F.col("words"), " &amp; &lt;b&gt; ")
    picture = lambda c: F.struct(c.alias("medium"))
    some = F.array(picture(markup("a", F.col("id"))), picture(F.lit(None).cast("string")), picture(markup("b", F.col("id"))))
    page = F.struct(
        F.struct(F.when(F.col("id") % 3 != 0, markup("+351 ", F.col("id"))).alias("resolvedPhone"), text.alias("description")).alias("unifiedAd"),
        F.struct(F.when(F.col("id") % 4 != 0, some).otherwise(F.filter(some, lambda x: x["medium"].isNull())).alias("images")).alias("ad"),
    )
    found = json_in_html.ad_details(_details(homes(spark, sf_dir), page))
    return found.select("url", "description", "agent_phone", F.array_join("photos", "|").alias("photos"))


@query(
    f"""WITH {HOMES} SELECT 'https://x/' || id AS url, CASE WHEN id % 5 <> 0 THEN description || ' é' END AS description, CASE WHEN id % 3 <> 0 THEN CAST(id % 90 AS DOUBLE) END AS lat, CASE WHEN id % 3 <> 0 THEN CAST(id % 180 AS DOUBLE) / 2 END AS lng,
  CASE WHEN id % 2 = 0 THEN 'B-' END AS energy_rating, 'https://img/gallery/' || id || '|plain' AS photos FROM h"""
)
def source_list_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages of the flat list: text, coordinates, energy class, and pictures whose address is a pattern."""
    c = F.col
    at = F.struct((c("id") % 90).cast("double").alias("lat"), ((c("id") % 180).cast("double") / 2).alias("lon"))
    photo = lambda p: F.struct(p.alias("yams_oid"), F.lit(False).alias("deleted"))
    page = F.struct(F.struct(
        F.when(c("id") % 5 != 0, markup(c("words"), " &eacute;")).otherwise(F.lit("")).alias("body"), F.when(c("id") % 3 != 0, at).alias("location"),
        F.struct(F.when(c("id") % 2 == 0, F.struct(F.lit("B-").alias("name"))).alias("energyrating")).alias("params"), F.array(photo(markup("https://img/{rule}/", c("id"))), photo(F.lit("")), photo(F.lit("plain"))).alias("extraImages"),
    ).alias("adData"))
    found = json_in_html.list_details(_details(homes(spark, sf_dir), page))
    return found.select("url", "description", "lat", "lng", "energy_rating", F.array_join("photos", "|").alias("photos"))


@query(f"WITH {DESCRIBED} SELECT id, CASE WHEN id % 3 = 0 THEN id % 2 = 0 WHEN id % 5 = 0 THEN NULL ELSE {_sql_fact('has_usage_license')} END AS has_usage_license FROM d")
def backfill_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence where it isn't known; what is known stays, whatever the text says."""
    key = F.col("id")
    rows = described(spark, sf_dir).withColumns({"has_usage_license": F.when(key % 3 == 0, key % 2 == 0), "description": F.when((key % 5 != 0) | (key % 3 == 0), F.col("description"))})
    return maintenance.backfill_license(rows).select("id", "has_usage_license")


@query(
    f"""WITH x AS (SELECT doc_id AS id, {_LOCATIONS_SQL}[doc_id % {len(_LOCATIONS)} + 1] AS spot, CASE WHEN doc_id % 3 = 0 THEN 'D' END AS d, CASE WHEN doc_id % 2 = 0 THEN 'C' END AS c FROM documents)
SELECT id, coalesce(d, nullif(trim(split_part(spot, ',', 1)), '')) AS distrito, CASE WHEN d IS NULL THEN coalesce(nullif(trim(split_part(spot, ',', 2)), ''), c) ELSE c END AS concelho FROM x"""
)
def backfill_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District and municipality from the flat place where the district isn't known."""
    key = F.col("id")
    rows = _spots(spark, sf_dir).select("id", F.col("spot").alias("location_string"), F.when(key % 3 == 0, F.lit("D")).alias("distrito"), F.when(key % 2 == 0, F.lit("C")).alias("concelho"))
    return maintenance.backfill_places(rows).select("id", "distrito", "concelho")


@query(
    f"""WITH {PLACED}, m AS (SELECT location_string FROM q WHERE id % 3 = 0), z AS (SELECT DISTINCT location_string FROM m ORDER BY 1 LIMIT 10)
SELECT count(*) AS before, count(*) FILTER (location_string NOT IN (FROM z)) AS after, count(*) FILTER (location_string IN (FROM z)) AS filled FROM m"""
)
def geocode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings without coordinates before and after a pass over at most ten places, and what it did."""
    rows = placed(spark, sf_dir).withColumns({"lat": F.when(F.col("id") % 3 != 0, F.lit(1.5)), "lng": F.lit(None).cast("double")})
    gazetteer = rows.select("location_string").distinct().withColumns({"lat": F.lit(2.5), "lng": F.lit(0.5)})
    counts = {"before": rows, "after": maintenance.fill_coordinates(rows, gazetteer, 10)}
    out = None
    for name, state in counts.items():
        one = maintenance.missing_count(state).withColumnRenamed("missing", name)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.agg(F.sum("before").alias("before"), F.sum("after").alias("after")).withColumn("filled", F.col("before") - F.col("after"))


_OUTCOME = {"F": "Added", "O": "Updated", "P": "Linked"}


@query(
    f"""WITH {LISTINGS} SELECT source, '1998-01-01 00:00:00' AS started, '1998-01-01 00:02:05' AS ended, count(*) AS found, count(*) FILTER (id % 9 <> 0 AND state = 'F') AS added, count(*) FILTER (id % 9 <> 0 AND state = 'O') AS updated,
  count(*) FILTER (id % 9 <> 0 AND state = 'P') AS linked, count(*) FILTER (id % 9 = 0) AS skipped, true AS has_errors, 'late|cancelled' AS errors, 125 AS duration_seconds FROM p GROUP BY source"""
)
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit row of each source's run, from the outcomes of its listings; this one was cancelled."""
    c = F.col
    named = F.create_map(*(F.lit(x) for pair in _OUTCOME.items() for x in pair))
    rows = listings(spark, sf_dir).select("source", F.when(c("id") % 9 == 0, F.lit("Skipped")).otherwise(named[c("state")]).alias("outcome"))
    out = reports.run_record(tally(rows, "source"), c("source"), AS_OF, datetime(1998, 1, 1, 0, 2, 5), ["late", "cancelled"])
    return out.select(
        "source", stamp("run_start_time").alias("started"), stamp("run_end_time").alias("ended"), *(c(f"properties_{x}").alias(x) for x in ("found", "added", "updated", "linked", "skipped")), "has_errors", F.array_join("errors", "|").alias("errors"), "duration_seconds"
    )


@query(f"WITH {LISTINGS}, b AS (SELECT min(price) AS low, max(price) AS high FROM p WHERE beds = 3) SELECT p.id, {sql_stamp(f"TIMESTAMP '{AS_OF}'")} AS settled FROM p, b WHERE price BETWEEN low AND high AND id % 2 = 0")
def settings_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings row: defaults into an empty table, then replaced by bounds out of the listings; what they let through."""
    rows = listings(spark, sf_dir)
    defaults = spark.createDataFrame([{f.name: None for f in APP_SETTING.fields}], APP_SETTING)
    stored = merge.default_settings(defaults.limit(0), defaults)
    low, high = rows.where("beds = 3").agg(F.min("price"), F.max("price")).first()
    stored = merge.default_settings(merge.replace_settings(spark, stored.first().asDict() | {"price_min": low, "price_max": high}, APP_SETTING, AS_OF), defaults)
    settings = stored.first()
    return rows.where((F.col("id") % 2 == 0) & F.col("price").between(settings["price_min"], settings["price_max"])).select("id", stamp(F.lit(settings["updated_at"]).cast("timestamp_ntz")).alias("settled"))


_SPOT = f"x AS (SELECT doc_id AS id, {_LOCATIONS_SQL}[doc_id % {len(_LOCATIONS)} + 1] AS spot FROM documents)"
_LOOSE = "trim(regexp_replace(strip_accents(lower(chr(9) || spot || chr(10) || 'x' || chr(9) || chr(9))), '\\s+', ' ', 'g'))"


@query(
    f"""WITH {_SPOT} SELECT id, coalesce(nullif(concat_ws(', ', CASE WHEN id % 2 = 0 THEN nullif(spot, '') END, CASE WHEN id % 3 = 0 THEN 'C' || id END), ''), 'place ' || id) AS whole, {_LOOSE} AS loose,
  CASE WHEN lower(trim(spot)) = 'póvoa de varzim' THEN 'povoa' ELSE replace(regexp_replace(strip_accents(lower(trim(spot))), ' +', ' ', 'g'), ' ', '-') END AS slug FROM x"""
)
def place_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full place of its parts, the loose normal form with any white space, and a source's slug."""
    key, spot = F.col("id"), F.col("spot")
    whole = normalize.full_place(F.when(key % 2 == 0, spot), F.when(key % 3 == 0, markup("C", key)), fallback=markup("place ", key))
    loose = normalize.normalize_location_loose(markup("\t", spot, "\nx\t\t"))
    return _spots(spark, sf_dir).select("id", whole.alias("whole"), loose.alias("loose"), normalize.district_slug(spot, {"póvoa de varzim": "povoa"}).alias("slug"))


_LOW, _HIGH = "id % 9 - 1", "id // 9 % 9 - 1"


def _sql_rooms(most: int) -> str:
    clamp = lambda x: f"least(greatest({x}, 0), {most})"
    low, high = clamp(_LOW), clamp(f"CASE WHEN {_HIGH} <= 0 THEN {most} ELSE {_HIGH} END")
    return f"range(least({low}, {high}), greatest({low}, {high}) + 1)"


@query(
    f"""WITH {LISTINGS} SELECT id, array_to_string(list_transform({_sql_rooms(4)}, lambda n: ['ONE', 'TWO', 'THREE', 'FOUR', 'FIVE'][n + 1]), ',') || CASE WHEN {_HIGH} >= 5 THEN ',MORE' ELSE '' END AS words,
  CASE WHEN NOT ({_LOW} <= 0 AND {_HIGH} >= 6) THEN array_to_string({_sql_rooms(6)}, ',') END AS numbers FROM p"""
)
def room_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter strings that two sources take for a range of rooms."""
    low, high = F.col("id") % 9 - 1, F.floor(F.col("id") / 9) % 9 - 1
    return listings(spark, sf_dir).select("id", F.array_join(parse.room_words(low, high), ",").alias("words"), parse.room_list(low, high).alias("numbers"))
