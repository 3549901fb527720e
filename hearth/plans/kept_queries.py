"""Results kept beside stored tables: substring lists, counts and latest rows that follow their table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import LatestRows, SignedCounts, contacts_since, hour_of
from ..operators.substrings import SubstringIndex, containing
from ..operators.versions import VersionedTable
from ..storage import new_path
from .registry import query
from .tables import COMMS, EVENTS_AS_OF, HISTORY, LISTINGS, PLACED, TRACKED, comms, listings, number, placed, price_history, sql_stamp, stamp, tracked

_NEEDLES = ("/p/77", "9", "123", "e.com/p/5", "é", "/P/1")


@query(f"WITH {LISTINGS} SELECT needle, id FROM p, (SELECT unnest({list(_NEEDLES)}) AS needle) WHERE contains(url, needle)")
def search_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by parts of their url, from lists of trigrams that took the urls in by two batches."""
    work, rows = new_path(spark, "substrings"), listings(spark, sf_dir).select("id", "url")
    table = VersionedTable(spark, f"{work}/rows", rows.schema, "url", 16)
    table.write(rows)
    index = SubstringIndex(spark, f"{work}/index", buckets=16)
    for k in range(2):
        index.add(rows.where(F.col("id") % 3 <= k + 1).select("url"))
    out = None
    for needle in _NEEDLES:
        found = containing(table, "url", index, needle).select(F.lit(needle).alias("needle"), "id")
        out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH {PLACED} SELECT id, location_string FROM q WHERE contains(location_string, 'RICA, NATION_1')")
def search_location_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by part of their place: few places are indexed, whatever the number of listings."""
    rows = placed(spark, sf_dir).select("id", "location_string")
    index = SubstringIndex(spark, new_path(spark, "substrings"), buckets=16)
    index.add(rows.select("location_string"))
    return containing(rows, "location_string", index, "RICA, NATION_1").select("id", "location_string")


def _replaced(table: VersionedTable, rows: DataFrame) -> None:
    """Rows by their id in place of those that are stored."""
    buckets = table.touched(rows.select(table.key))
    table.write(table.read(buckets).join(rows.select(table.key), table.key, "left_anti").unionByName(rows), buckets)


@query(f"WITH {TRACKED} SELECT status, count(*) AS n FROM t WHERE id % 7 <> 0 GROUP BY status")
def status_counts_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status histogram after rows were added, changed and deleted, refreshed from what changed each time."""
    work, rows = new_path(spark, "kept"), tracked(spark, sf_dir).select("id", "status")
    table = VersionedTable(spark, f"{work}/tracked", rows.schema, "id", 16)
    counts = SignedCounts(table, f"{work}/counts", {"status": F.col("status")})
    table.write(rows.where("id % 2 = 0").withColumn("status", F.lit("New")))
    counts.refresh()
    _replaced(table, rows.where("id % 6 <> 1"))
    counts.refresh()
    table.append(rows.where("id % 6 = 1"))
    table.write(table.read().where("id % 7 <> 0"))
    counts.refresh()
    return counts.read()


@query(
    f"""WITH {COMMS} SELECT count(*) AS contacts FROM c WHERE direction = 'Outbound' AND created_at > TIMESTAMP '{EVENTS_AS_OF - timedelta(hours=13, minutes=17)}' - INTERVAL 24 HOUR"""
)
def contacts_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of a day from counts by hour; the hour that the bound cuts is counted in the table."""
    work, rows = new_path(spark, "kept"), comms(spark, sf_dir).select("id", "direction", F.col("created_at").cast("timestamp_ntz").alias("created_at"))
    table = VersionedTable(spark, f"{work}/comms", rows.schema, "id", 16)
    counts = SignedCounts(table, f"{work}/hours", {"direction": F.col("direction"), "hour": hour_of(F.col("created_at"))})
    for k in range(2):
        table.append(rows.where(F.col("id") % 2 == k))
        counts.refresh()
    return contacts_since(counts, EVENTS_AS_OF - timedelta(hours=13, minutes=17), where=F.col("direction") == "Outbound")


@query(
    f"""WITH {HISTORY}, x AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY changed_at DESC, id DESC, old_price DESC, new_price DESC) AS k FROM h WHERE property_id % 7 <> 0)
SELECT property_id, {sql_stamp('changed_at')} AS changed_at, CAST(old_price AS DOUBLE) AS old_price, CAST(new_price AS DOUBLE) AS new_price FROM x WHERE k = 1"""
)
def latest_price_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each property's last price change after two batches and a deletion; only changed buckets are decided anew."""
    work, rows = new_path(spark, "kept"), price_history(spark, sf_dir)
    table = VersionedTable(spark, f"{work}/changes", rows.schema, "property_id", 16)
    latest = LatestRows(table, f"{work}/latest", ["changed_at", "id", "old_price", "new_price"])
    for k in range(2):
        table.append(rows.where(F.col("id") % 2 == k))
        latest.refresh()
    table.write(table.read().where("property_id % 7 <> 0"))
    latest.refresh()
    return latest.read().select("property_id", stamp("changed_at").alias("changed_at"), number("old_price").alias("old_price"), number("new_price").alias("new_price"))
