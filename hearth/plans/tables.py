"""Listing tables out of the generic test tables, on Spark and in SQL alike.

Orders stand for listings, their line items for price changes, events for contacts and
runs; the place is the customer's region and nation.  Facts come from the keys' remainders.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SOURCES

#: The injected times of all queries.
AS_OF = datetime(1998, 1, 1)
EVENTS_AS_OF = datetime(2024, 1, 29)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column) -> Column:
    return c.cast("decimal(10,2)")


def tri(key: Column, n: int) -> Column:
    return F.when(key % n == 0, F.lit(True)).when(key % n == 1, F.lit(False))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    size = F.when(key % 7 != 0, (key % 180 + 20).cast("decimal(8,2)"))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.concat(F.lit("https://example.com/p/"), key.cast("string")).alias("url"), F.col("o_orderpriority").alias("source"), money(F.col("o_totalprice")).alias("price"), size.alias("size_m2"), (key % 6).cast("int").alias("beds"),
        F.col("o_orderstatus").alias("state"), tri(key, 3).alias("open_plan_kitchen"), tri(key, 4).alias("elevator"), tri(key, 5).alias("parking"), F.col("o_orderdate").alias("created_at"), F.date_add("o_orderdate", 3).cast("timestamp_ntz").alias("last_seen_at"), F.col("o_custkey").alias("custkey"),
        F.element_at(F.array(*(F.lit(x) for x in ("Sul", "Norte", "Oriente", "Not Available"))), (key % 4 + 1).cast("int")).alias("sun_orientation"),
    )


LISTINGS = """p AS (
  SELECT o_orderkey AS id, 'https://example.com/p/' || o_orderkey AS url, o_orderpriority AS source, CAST(o_totalprice AS DECIMAL(10,2)) AS price,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 180 + 20 AS DECIMAL(8,2)) END AS size_m2, CAST(o_orderkey % 6 AS INTEGER) AS beds, o_orderstatus AS state,
    CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS open_plan_kitchen, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS elevator,
    CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS parking, o_orderdate AS created_at, date_trunc('day', o_orderdate) + INTERVAL 3 DAY AS last_seen_at, o_custkey AS custkey,
    ['Sul', 'Norte', 'Oriente', 'Not Available'][o_orderkey % 4 + 1] AS sun_orientation
  FROM orders)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(custkey, location_string); Spark broadcasts nations and regions by their size."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = nation.select("n_nationkey", F.concat_ws(", ", "r_name", "n_name").alias("location_string"))
    return table(spark, sf_dir, "customer").join(named, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("custkey"), "location_string")


PLACES = """l AS (
  SELECT c_custkey AS custkey, r_name || ', ' || n_name AS location_string FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).join(places(spark, sf_dir), "custkey")


PLACED = f"{LISTINGS}, {PLACES}, q AS (SELECT p.*, location_string FROM p JOIN l USING (custkey))"


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth listing is tracked; its state from the order's."""
    status = F.when(F.col("o_orderstatus") == "F", "Rejected").when(F.col("o_orderstatus") == "O", "Interested").otherwise("Contacted")
    day = lambda n: F.date_add("o_orderdate", n).cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("property_id"), status.alias("status"), F.concat(F.lit("Agent "), (F.col("o_orderkey") % 50).cast("string")).alias("agent_name"), day(1).alias("date_added"), day(2).alias("last_updated"))


TRACKED = """t AS (
  SELECT o_orderkey AS id, o_orderkey AS property_id, CASE o_orderstatus WHEN 'F' THEN 'Rejected' WHEN 'O' THEN 'Interested' ELSE 'Contacted' END AS status,
    'Agent ' || (o_orderkey % 50) AS agent_name, date_trunc('day', o_orderdate) + INTERVAL 1 DAY AS date_added, date_trunc('day', o_orderdate) + INTERVAL 2 DAY AS last_updated
  FROM orders WHERE o_orderkey % 5 = 0)"""


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct line items as price changes; the id is their place in the order's sequence of all columns."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("property_id"), c("l_shipdate").alias("changed_at"), (c("l_linenumber") * 1_000_000 + c("l_partkey")).cast("long").alias("id"), money(c("l_extendedprice")).alias("old_price"), money(c("l_extendedprice").cast("decimal(12,2)") * (1 - c("l_discount").cast("decimal(4,2)"))).alias("new_price")
    ).distinct()


HISTORY = """h AS (
  SELECT DISTINCT l_orderkey AS property_id, l_shipdate AS changed_at, CAST(l_linenumber * 1000000 + l_partkey AS BIGINT) AS id,
    CAST(l_extendedprice AS DECIMAL(10,2)) AS old_price, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(10,2)) AS new_price
  FROM lineitem)"""


def comms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as contacts; their user's number times 5 is the tracked listing."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") * 5).alias("my_listing_id"), F.col("event_type").alias("channel"), F.when(F.col("event_id") % 3 == 0, "Inbound").otherwise("Outbound").alias("direction"), F.col("ts").alias("created_at"))


COMMS = """c AS (
  SELECT event_id AS id, user_id * 5 AS my_listing_id, event_type AS channel, CASE event_id % 3 WHEN 0 THEN 'Inbound' ELSE 'Outbound' END AS direction, ts AS created_at FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of the sources but the last one."""
    key = F.col("event_id")
    source = F.element_at(F.array(*(F.lit(s) for s in SOURCES[:-1])), (F.col("user_id") % 5 + 1).cast("int"))
    end = F.when(key % 11 != 0, F.col("ts") + F.make_dt_interval(secs=(key % 600).cast("decimal(18,6)")))
    return table(spark, sf_dir, "events").select(
        key.alias("id"), source.alias("source"), F.col("ts").alias("run_start_time"), end.alias("run_end_time"), *((key % n).cast("int").alias(f"properties_{x}") for x, n in (("found", 97), ("added", 50), ("updated", 31), ("linked", 7), ("skipped", 5))),
        (key % 13 == 0).alias("has_errors"), F.when(key % 13 == 0, F.array(F.concat(F.lit("e"), key.cast("string")))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )


RUNS = f"""r AS (
  SELECT event_id AS id, {list(SOURCES[:-1])}[user_id % 5 + 1] AS source, ts AS run_start_time, CASE WHEN event_id % 11 <> 0 THEN ts + to_seconds(event_id % 600) END AS run_end_time,
    event_id % 97 AS properties_found, event_id % 50 AS properties_added, event_id % 31 AS properties_updated, event_id % 7 AS properties_linked, event_id % 5 AS properties_skipped,
    event_id % 13 = 0 AS has_errors, CASE WHEN event_id % 13 = 0 THEN 'e' || event_id END AS error
  FROM events)"""


def stamp(c: Column | str) -> Column:
    """A time as text, equal in both engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")
