"""Search, tracking and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parse import seconds_between, total_pages
from ..operators import reports
from ..operators.search import SearchRequest, contacts_of, listing_page, matching, ordering, page_of, ratio, search
from ..schema import SOURCES, STATUSES
from .registry import query
from .tables import AS_OF, COMMS, EVENTS_AS_OF, HISTORY, LISTINGS, PLACED, RUNS, TRACKED, comms, listings, number, placed, price_history, runs, sql_stamp, stamp, table, tracked

_AT, _EVENTS_AT = f"TIMESTAMP '{AS_OF}'", f"TIMESTAMP '{EVENTS_AS_OF}'"
_BUSY = f"SELECT property_id FROM t WHERE NOT (status = 'Rejected' AND date_added < {_AT} - INTERVAL 72 HOUR)"


#: Line items of other suppliers stand for the same home at other sources.
_LINKS_SQL = "SELECT DISTINCT l_orderkey AS property_id, 'S' || (l_suppkey % 4) AS source, 'https://s/' || l_partkey AS url FROM lineitem WHERE l_linenumber <= 2"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    source, url = F.concat(F.lit("S"), (F.col("l_suppkey") % 4).cast("string")), F.concat(F.lit("https://s/"), F.col("l_partkey").cast("string"))
    nothing = {"price": F.lit(None).cast("decimal(10,2)"), "last_seen_at": F.lit(None).cast("timestamp_ntz")}
    return rows.select(F.col("l_orderkey").alias("property_id"), source.alias("source"), url.alias("url")).distinct().withColumns(nothing)


def _found(spark: SparkSession, sf_dir: str, **wanted) -> DataFrame:
    return matching(listings(spark, sf_dir), tracked(spark, sf_dir), SearchRequest(**wanted), AS_OF)


@query(
    f"""WITH {LISTINGS}, {TRACKED}, {HISTORY},
x AS (SELECT * FROM p WHERE price >= 100000 AND price <= 300000 AND id NOT IN ({_BUSY}) ORDER BY price DESC, id LIMIT 12),
n AS (SELECT property_id, count(*) AS n, max_by(old_price, (changed_at, h.id, old_price)) AS previous FROM h WHERE property_id IN (SELECT id FROM x) GROUP BY property_id)
SELECT x.id, CAST(price AS DOUBLE) AS price, source, CAST(coalesce(n, 0) AS BIGINT) AS n_changes, CAST(previous AS DOUBLE) AS previous_price FROM x LEFT JOIN n ON x.id = n.property_id"""
)
def search_price_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a price range, only what waits for a decision, dearest first, with its price changes."""
    request = SearchRequest(price_min=100000, price_max=300000, pending_only=True, sort_by="price")
    page = search(listings(spark, sf_dir), tracked(spark, sf_dir), price_history(spark, sf_dir), links(spark, sf_dir), request, AS_OF)
    return page.items.select("id", number("price").alias("price"), "source", F.greatest(F.size("price_history"), F.lit(0)).cast("long").alias("n_changes"), number("previous_price").alias("previous_price"))


@query(f"WITH {LISTINGS} SELECT id, CAST(price AS DOUBLE) AS price FROM p WHERE open_plan_kitchen IS NOT TRUE AND elevator = true")
def search_tristate_not_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, open_plan_kitchen=False, elevator=True).select("id", number("price").alias("price"))


@query(f"WITH {LISTINGS} SELECT id, elevator, parking FROM p WHERE elevator = false AND parking = true")
def search_tristate_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, elevator=False, parking=True).select("id", "elevator", "parking")


@query(f"WITH {LISTINGS} SELECT id, beds, sun_orientation, source FROM p WHERE beds = 2 AND sun_orientation = 'Oriente' AND source = '1-URGENT'")
def search_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, beds=2, orientation="Oriente", construction="All", source="1-URGENT").select("id", "beds", "sun_orientation", "source")


@query(
    f"""WITH {LISTINGS}, x AS (SELECT id, CAST(price AS DOUBLE) / CAST(size_m2 AS DOUBLE) AS v FROM p WHERE price IS NOT NULL AND size_m2 > 0)
SELECT id, CAST(floor(v * 100) AS BIGINT) AS per_m2_cents FROM x WHERE v >= 500 AND v <= 2500"""
)
def search_ratio_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, price_per_m2_min=500, price_per_m2_max=2500).select("id", F.floor(ratio(F.col("price"), F.col("size_m2")) * 100).alias("per_m2_cents"))


@query(f"WITH {LISTINGS} SELECT id, {sql_stamp('created_at')} AS created_at FROM p WHERE created_at >= {_AT} - INTERVAL 30 DAY")
def search_recent_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, added_within_days=30).select("id", stamp("created_at").alias("created_at"))


@query(f"WITH {LISTINGS}, {TRACKED} SELECT id, source FROM p WHERE id NOT IN ({_BUSY})")
def search_pending_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, pending_only=True).select("id", "source")


@query(f"WITH {PLACED} SELECT id, location_string FROM q WHERE contains(location_string, 'A, NATION_1')")
def search_location_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(placed(spark, sf_dir), tracked(spark, sf_dir), SearchRequest(location="A, NATION_1"), AS_OF).select("id", "location_string")


@query(f"WITH {LISTINGS}, n AS (SELECT count(*) AS total FROM p WHERE beds = 3 AND price <= 150000) SELECT total, CAST(ceil(total / 12.0) AS BIGINT) AS pages, CAST(0 AS BIGINT) AS pages_of_none FROM n")
def search_total_and_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _found(spark, sf_dir, beds=3, price_max=150000).agg(F.count("*").alias("total"))
    return n.select("total", total_pages(F.col("total"), F.lit(12)).alias("pages"), total_pages(F.col("total"), F.lit(0)).alias("pages_of_none"))


@query(f"WITH {LISTINGS} SELECT id, CAST(size_m2 AS DOUBLE) AS size_m2 FROM p ORDER BY size_m2 ASC NULLS FIRST, id LIMIT 20 OFFSET 40")
def search_size_ascending_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_of(_found(spark, sf_dir), ordering("size", "ASC"), 3, 20).select("id", number("size_m2").alias("size_m2"))


@query(f"WITH {LISTINGS} SELECT id, {sql_stamp('last_seen_at')} AS last_seen_at FROM p ORDER BY last_seen_at DESC, id LIMIT 12")
def search_default_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_of(_found(spark, sf_dir), ordering("location", "asc"), 0, 0).select("id", stamp("last_seen_at").alias("last_seen_at"))


@query(
    f"""WITH {LISTINGS}, {HISTORY},
g AS (SELECT property_id, count(*) AS n, string_agg(CAST(new_price * 100 AS BIGINT), ',' ORDER BY changed_at, h.id, old_price, new_price) AS prices FROM h GROUP BY property_id),
k AS (SELECT property_id, string_agg(source || '=' || url, ',' ORDER BY source, url) AS links FROM ({_LINKS_SQL}) GROUP BY property_id)
SELECT p.id, CAST(coalesce(n, 0) AS BIGINT) AS n_changes, coalesce(prices, '') AS prices, coalesce(links, '') AS links FROM p LEFT JOIN g ON p.id = g.property_id LEFT JOIN k ON p.id = k.property_id"""
)
def search_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import with_children

    rows = with_children(listings(spark, sf_dir).select("id"), price_history(spark, sf_dir), links(spark, sf_dir))
    prices = F.array_join(F.transform("price_history", lambda h: (h["new_price"] * 100).cast("long").cast("string")), ",")
    linked = F.array_join(F.transform("linked_sources", lambda x: F.concat_ws("=", x["source"], x["url"])), ",")
    return rows.select("id", F.greatest(F.size("price_history"), F.lit(0)).cast("long").alias("n_changes"), F.coalesce(prices, F.lit("")).alias("prices"), F.coalesce(linked, F.lit("")).alias("links"))


@query(
    f"""WITH {HISTORY}, x AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY changed_at DESC, id DESC, old_price DESC, new_price DESC) AS k FROM h)
SELECT property_id, {sql_stamp('changed_at')} AS changed_at, CAST(old_price AS DOUBLE) AS old_price, CAST(new_price AS DOUBLE) AS new_price,
  CASE WHEN new_price < old_price THEN 'dropped' WHEN new_price > old_price THEN 'rose' ELSE 'same' END AS change, CAST(abs(new_price - old_price) AS DOUBLE) AS delta
FROM x WHERE k = 1"""
)
def latest_price_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.display import price_change

    last = reports.latest_by(price_history(spark, sf_dir), "property_id", F.struct("changed_at", "id", "old_price", "new_price"))
    kind, delta = price_change(F.col("new_price"), F.col("old_price"))
    return last.select("property_id", stamp("changed_at").alias("changed_at"), number("old_price").alias("old_price"), number("new_price").alias("new_price"), kind.alias("change"), number(delta).alias("delta"))


@query(
    f"""WITH {TRACKED}, {COMMS}, {LISTINGS}, x AS (SELECT * FROM t WHERE status = 'Interested' ORDER BY last_updated DESC, id LIMIT 20),
g AS (SELECT my_listing_id, count(*) AS n, max(created_at) AS last FROM c GROUP BY my_listing_id),
k AS (SELECT property_id, string_agg(source || '=' || url, ',' ORDER BY source, url) AS links FROM ({_LINKS_SQL}) GROUP BY property_id)
SELECT x.id, status, coalesce(links, '') AS links, CAST(coalesce(n, 0) AS BIGINT) AS comm_history_count, {sql_stamp('last')} AS last_contacted_at, CAST(p.price AS DOUBLE) AS property_price
FROM x LEFT JOIN g ON x.id = g.my_listing_id LEFT JOIN p ON p.id = x.property_id LEFT JOIN k ON k.property_id = x.property_id"""
)
def listing_page_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = listing_page(tracked(spark, sf_dir), listings(spark, sf_dir), comms(spark, sf_dir), links(spark, sf_dir), "Interested", 1, 0)
    linked = F.array_join(F.transform("linked_sources", lambda x: F.concat_ws("=", x["source"], x["url"])), ",")
    return page.items.select("id", "status", F.coalesce(linked, F.lit("")).alias("links"), F.col("comm_history_count").cast("long").alias("comm_history_count"), stamp("last_contacted_at").alias("last_contacted_at"), number("property_price").alias("property_price"))


@query(
    f"""WITH {TRACKED}, {COMMS} SELECT t.id, CAST(count(c.id) AS BIGINT) AS n, {sql_stamp('max(created_at)')} AS last FROM t JOIN c ON c.my_listing_id = t.id GROUP BY t.id"""
)
def contact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tracked(spark, sf_dir).select(F.col("id").alias("my_listing_id"))
    return comms(spark, sf_dir).join(ids, "my_listing_id", "left_semi").groupBy(F.col("my_listing_id").alias("id")).agg(F.count("*").alias("n"), stamp(F.max("created_at")).alias("last"))


@query(f"WITH {COMMS} SELECT id, channel, {sql_stamp('created_at')} AS created_at, CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS INTEGER) AS place FROM c WHERE my_listing_id = 35")
def contacts_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing's contacts, the latest first."""
    latest = contacts_of(comms(spark, sf_dir), 35)
    return latest.select("id", "channel", stamp("created_at").alias("created_at"), F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))).alias("place"))


@query(f"WITH {COMMS} SELECT count(*) AS contacts FROM c WHERE created_at > {_EVENTS_AT} - INTERVAL 24 HOUR AND direction = 'Outbound'")
def contacts_last_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.contacts_made(comms(spark, sf_dir), EVENTS_AS_OF)


@query(
    f"""WITH {COMMS}, {TRACKED}, {PLACED}, x AS (SELECT * FROM c WHERE created_at > {_EVENTS_AT} - INTERVAL 24 HOUR AND direction = 'Outbound' ORDER BY created_at DESC, id LIMIT 5)
SELECT x.id, channel, {sql_stamp('x.created_at')} AS created_at, agent_name, location_string, CAST(price AS DOUBLE) AS price
FROM x JOIN t ON t.id = x.my_listing_id JOIN q ON q.id = t.property_id"""
)
def recent_contacts_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.recent_contacts(comms(spark, sf_dir), tracked(spark, sf_dir), placed(spark, sf_dir), EVENTS_AS_OF)
    return found.select("id", "channel", stamp("created_at").alias("created_at"), "agent_name", "location_string", number("price").alias("price"))


@query(f"WITH {LISTINGS}, {TRACKED} SELECT count(*) AS pending FROM p WHERE created_at > {_AT} - INTERVAL 24 HOUR AND id NOT IN ({_BUSY})")
def pending_new_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pending_count(listings(spark, sf_dir), tracked(spark, sf_dir), AS_OF)


@query(f"WITH {TRACKED} SELECT status, count(*) AS n FROM t GROUP BY status")
def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_histogram(tracked(spark, sf_dir))


@query(f"WITH {TRACKED} SELECT s.status, CAST(count(t.id) AS BIGINT) AS n FROM (SELECT unnest({list(STATUSES)}) AS status) s LEFT JOIN t USING (status) GROUP BY s.status")
def status_breakdown_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_histogram(tracked(spark, sf_dir), zero_filled=True).select("status", F.col("n").cast("long").alias("n"))


@query(
    f"""WITH {RUNS}, x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run_end_time DESC, id DESC) AS k FROM r WHERE run_end_time IS NOT NULL)
SELECT s.source, {sql_stamp('run_end_time')} AS last_run, CAST(properties_added AS BIGINT) AS added, has_errors FROM (SELECT unnest({list(SOURCES)}) AS source) s LEFT JOIN x ON x.source = s.source AND k = 1"""
)
def platform_status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.platform_status(runs(spark, sf_dir)).select("source", stamp("last_run").alias("last_run"), F.col("properties_added").cast("long").alias("added"), "has_errors")


@query(
    f"""WITH {RUNS} SELECT id, source, {sql_stamp('run_start_time')} AS started, CAST(date_diff('second', date_trunc('second', run_start_time), date_trunc('second', run_end_time)) AS BIGINT) AS seconds
FROM r ORDER BY run_start_time DESC, id DESC LIMIT 20"""
)
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = reports.recent_runs(runs(spark, sf_dir))
    seconds = seconds_between(F.date_trunc("second", "run_start_time").cast("timestamp_ntz"), F.date_trunc("second", "run_end_time").cast("timestamp_ntz"))
    return cut.select("id", "source", stamp("run_start_time").alias("started"), seconds.cast("long").alias("seconds"))


@query(
    f"""WITH {RUNS} SELECT source, {', '.join(f'CAST(sum(properties_{x}) AS BIGINT) AS {x}' for x in ('found', 'added', 'updated', 'linked', 'skipped'))}, bool_or(has_errors) AS has_errors,
  sha256(coalesce(string_agg(error, ',' ORDER BY id), '')) AS errors FROM r GROUP BY source"""
)
def run_report_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = reports.merge_runs(runs(spark, sf_dir), "source")
    return merged.select("source", *(F.col(f"properties_{x}").alias(x) for x in ("found", "added", "updated", "linked", "skipped")), "has_errors", F.sha2(F.array_join("errors", ","), 256).alias("errors"))


@query(f"WITH {RUNS} SELECT source, count(*) AS runs, count(*) FILTER (has_errors) AS failed, count(*) FILTER (run_end_time IS NULL) AS unfinished FROM r GROUP BY source")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("runs"), F.count_if("has_errors").alias("failed"), F.count_if(F.col("run_end_time").isNull()).alias("unfinished"))


@query(f"WITH {LISTINGS} SELECT id, price > 0 AS priced, created_at > {_AT} - INTERVAL 24 HOUR AS is_new FROM p WHERE id = 7 OR id = 4")
def lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.display import is_new
    from ..operators.search import by_id, timestamp

    rows = listings(spark, sf_dir)
    found = by_id(rows, 7).unionByName(by_id(rows, 4))
    return found.select("id", (F.col("price") > 0).alias("priced"), is_new(F.col("created_at"), timestamp(AS_OF)).alias("is_new"))


@query(f"WITH {PLACED} SELECT id AS external_id, location_string AS location FROM q")
def listing_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import view

    rows = placed(spark, sf_dir).select(F.col("id").alias("source_property_id"), "location_string", F.lit("x").alias("dedup_hash"))
    return view(rows)


@query(f"WITH {LISTINGS}, {TRACKED} SELECT id FROM p WHERE id IN (SELECT property_id FROM t WHERE status = 'Waiting' OR status = 'Contacted')")
def membership_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tracked(spark, sf_dir).where(F.col("status").isin("Waiting", "Contacted")).select(F.col("property_id").alias("id"))
    return listings(spark, sf_dir).join(ids, "id", "left_semi").select("id")


@query("SELECT doc_id AS id FROM labels UNION SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def queue_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.triage import queue_append as append
    from .tables import table

    queue = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()
    return append(queue, table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")))
