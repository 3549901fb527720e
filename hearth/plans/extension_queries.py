"""Queries of kinds that the listing service has no call for: grouping, frames, sets, windows, streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.history import as_of
from ..operators.paging import SortedPages
from ..operators.search import ordering
from ..sources.html_cards import text
from ..sources.json_in_html import script
from ..storage import new_path
from ..streaming.ingest import counts_by_window, landed, run_to_table, without_repeats
from ..streaming.seen import STORE, first_encounters
from .registry import query
from .tables import HISTORY, LISTINGS, listings, number, price_history, sql_stamp, stamp, table


@query(
    f"""WITH {LISTINGS}, {HISTORY}, g AS (SELECT property_id, changed_at, max(new_price) AS new_price FROM h GROUP BY property_id, changed_at)
SELECT p.id, {sql_stamp('p.created_at + INTERVAL 60 DAY')} AS at, CAST(g.new_price AS DOUBLE) AS price FROM p ASOF LEFT JOIN g ON p.id = g.property_id AND p.created_at + INTERVAL 60 DAY >= g.changed_at"""
)
def asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = listings(spark, sf_dir).select("id", (F.col("created_at") + F.expr("INTERVAL '60' DAY")).alias("at"))
    prices = price_history(spark, sf_dir).select(F.col("property_id").alias("id"), "changed_at", "new_price")
    return as_of(events, prices, "id", "at", "changed_at", "new_price").select("id", stamp("at").alias("at"), number("new_price").alias("price"))


_GROUPED = "coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@query(f"SELECT {_GROUPED} ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_orders(spark, sf_dir).rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")))


@query(f"SELECT {_GROUPED} CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_orders(spark, sf_dir).cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")))


@query(f"SELECT {_GROUPED} GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def grouping_sets_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [["o_orderstatus"], ["o_orderpriority"]]
    return _named(_orders(spark, sf_dir).groupingSets([[F.col(c) for c in s] for s in sets], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")))


@query("SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def outcome_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _orders(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("priority", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")))


_RANKED = "PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey"


@query(
    f"""SELECT o_orderkey AS id, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, ntile(4) OVER w AS quarter,
  lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, first_value(o_orderkey) OVER w AS top FROM orders WINDOW w AS ({_RANKED})"""
)
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    s = Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.row_number().over(w).cast("long").alias("rn"), F.rank().over(s).cast("long").alias("rk"), F.dense_rank().over(s).cast("long").alias("dr"), F.ntile(4).over(w).cast("long").alias("quarter"), F.lag(key).over(w).alias("before"), F.lead(key).over(w).alias("after"), F.first(key).over(w).alias("top")
    )


@query(
    """SELECT event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS last_four, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running,
  count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour FROM events"""
)
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    hour = Window.partitionBy("user_id").orderBy("second").rangeBetween(-3600, 0)
    events = table(spark, sf_dir, "events").withColumn("second", seconds)
    return events.select(F.col("event_id").alias("id"), F.count("*").over(rows.rowsBetween(-3, 0)).alias("last_four"), F.sum("event_id").over(rows.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.count("*").over(hour).alias("last_hour"))


def _custs(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("custkey"))


def _set_sql(op: str) -> str:
    return f"SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' {op} SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'"


@query(_set_sql("UNION"))
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _custs(spark, sf_dir, "F").union(_custs(spark, sf_dir, "P")).distinct()


@query(_set_sql("INTERSECT"))
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _custs(spark, sf_dir, "F").intersect(_custs(spark, sf_dir, "P"))


@query(_set_sql("EXCEPT ALL"))
def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _custs(spark, sf_dir, "F").exceptAll(_custs(spark, sf_dir, "P"))


@query(f"SELECT event_type, {sql_stamp('time_bucket(INTERVAL 6 HOUR, ts)')} AS begin, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("event_type", stamp("w.start").alias("begin"), "n")


@query(f"WITH x AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS b FROM events, unnest([0, 1]) AS t(k)) SELECT {sql_stamp('b')} AS begin, count(*) AS n FROM x GROUP BY b")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(stamp("w.start").alias("begin"), "n")


@query(
    f"""WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOUR THEN 1 ELSE 0 END AS fresh FROM events),
y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, {sql_stamp('min(ts)')} AS begin, count(*) AS n FROM y GROUP BY user_id, s"""
)
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "3 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", stamp("w.start").alias("begin"), "n")


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files: a folder of parts, or one file of its folder."""
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    stream = landed(spark, path, schema) if _is_folder(spark, path) else landed(spark, sf_dir, schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks take no other kind of time


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


@query(f"SELECT event_type, {sql_stamp('time_bucket(INTERVAL 1 DAY, ts)')} AS begin, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts through a stream, the complete result after all that has landed."""
    work = new_path(spark, "stream")
    counts = counts_by_window(_events_stream(spark, sf_dir), "ts", "1 day", "event_type")
    run_to_table(counts.select("event_type", F.col("span.start").alias("begin"), F.col("count").alias("n")), f"{work}/out", f"{work}/state")
    return spark.read.parquet(f"{work}/out").select("event_type", stamp("begin").alias("begin"), "n")


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice in a stream; repeats are dropped wherever in the table they come."""
    work = new_path(spark, "stream")
    twice = _events_stream(spark, sf_dir).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    run_to_table(without_repeats(twice, "event_id", "ts", None).select("event_id"), f"{work}/out", f"{work}/state", "append")
    return spark.read.parquet(f"{work}/out").agg(F.count("*").alias("n"))


_HORIZON = timedelta(hours=20)


@query(
    f"""WITH x AS (SELECT event_id AS id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, {sql_stamp('min(ts)')} AS first, {sql_stamp('max(ts)')} AS last, count(*) AS n FROM x WHERE before IS NULL OR ts > before + INTERVAL 20 HOUR GROUP BY user_id"""
)
def stream_first_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users not seen within 20 hours before: three landings in time's order, the stream begins anew for each."""
    work, events = new_path(spark, "stream"), table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        for k in range(3):
            begin, end = (F.lit(low) + F.make_dt_interval(secs=F.lit((high - low).total_seconds() * x / 3).cast("decimal(18,6)")) for x in (k, k + 1))
            last = F.col("ts") <= F.lit(high) if k == 2 else F.col("ts") < end
            events.where((F.col("ts") >= begin) & last).write.mode("append").parquet(f"{work}/in")
            found = first_encounters(landed(spark, f"{work}/in", events.schema, files_per_batch=1_000_000), "user_id", "ts", _HORIZON)
            run_to_table(found, f"{work}/out", f"{work}/state", "append")
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    kept = spark.read.parquet(f"{work}/out")
    return kept.groupBy("user_id").agg(stamp(F.min("ts")).alias("first"), stamp(F.max("ts")).alias("last"), F.count("*").alias("n"))


@query(f"""WITH {LISTINGS}, x AS (SELECT id, price, row_number() OVER (ORDER BY price DESC, id) AS place FROM p) SELECT id, CAST(price AS DOUBLE) AS price, place FROM x WHERE place BETWEEN 1189 AND 1200""")
def search_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 100 of all listings by price, from sorted ranges: one of them is read."""
    order = ordering("price", "desc")
    pages = SortedPages.build(listings(spark, sf_dir).select("id", "price", "last_seen_at"), order, new_path(spark, "pages"))
    place = F.row_number().over(Window.orderBy(*order)) + 99 * 12  # a page's rows
    return pages.page(100, 12).select("id", number("price").alias("price"), place.cast("long").alias("place"))


@query()
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.approx_percentile("value", 0.5).alias("median"))


@query("SELECT page_id AS id, json_extract_string('{\"props\": {\"k\": ' || page_id || ', \"u\": \"x\"}}', '$.props.k') AS k FROM pages")
def json_in_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script element is put into each page and its JSON read back."""
    data = F.concat(F.lit('{"props": {"k": '), F.col("page_id").cast("string"), F.lit(', "u": "x"}}'))
    page = F.concat(F.col("html"), F.lit('<script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script>"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.get_json_object(script(page), "$.props.k").alias("k"))


@query(
    r"""SELECT page_id AS id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a\b[^>]*href="([^"]*)"', 1)) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs FROM pages"""
)
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda p, g: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(g))).cast("long")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), found(r'<a\b[^>]*href="([^"]*)"', 1).alias("links"), found("<p>", 0).alias("paragraphs"))


@query()
def parse_html_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of pages as cards: cut, stripped of tags and decoded."""
    cards = F.regexp_extract_all("html", F.lit("(?is)<p>(.*?)(?=<p>|</article>|</body>)"), F.lit(1))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.posexplode(cards).alias("position", "card"))
    return rows.select("id", "position", text(F.col("card")).alias("text"))
