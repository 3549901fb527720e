"""Entity resolution, merging, photos and exports.

Candidates: every fourth order is stored, all orders come again as candidates in batches
of forty; the hash is over the place, the price and the beds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import dedup_hash
from ..operators import export, merge, photos
from ..operators.maintenance import centroid, fill_coordinates
from ..operators.resolve import resolve, stored_matches, tally
from ..storage import materialise
from .registry import query
from .tables import AS_OF, HISTORY, LISTINGS, PLACED, TRACKED, listings, number, placed, price_history, sql_stamp, stamp, table, tracked

_AT = f"TIMESTAMP '{AS_OF}'"


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = dedup_hash(F.col("location_string"), F.col("price"), F.col("beds"), F.lit(None).cast("decimal(8,2)"))
    return placed(spark, sf_dir).withColumn("dedup_hash", key)


HASHED = f"""{PLACED}, g AS (
  SELECT *, substr(sha256(strip_accents(lower(trim(location_string))) || '|' || CAST(round_even(price / 2500, 0) * 2500 AS BIGINT) || '|' || coalesce(beds, 0) || '|?'), 1, 16) AS dedup_hash FROM q)"""


@query(f"WITH {HASHED} SELECT id, dedup_hash FROM g", name="dedup_hash")
def dedup_hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(spark, sf_dir).select("id", "dedup_hash")


@query(f"WITH {HASHED} SELECT dedup_hash, count(*) AS n, count(DISTINCT source) AS sources, min(id) AS first FROM g GROUP BY dedup_hash HAVING count(DISTINCT source) >= 2")
def dedup_bucket_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(spark, sf_dir).groupBy("dedup_hash").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.min("id").alias("first")).where("sources >= 2")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(spark, sf_dir).where("id % 4 = 0").withColumn("last_seen_at", F.when(F.col("id") % 8 == 0, F.lit(str(AS_OF)).cast("timestamp_ntz")).otherwise(F.col("last_seen_at")))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders; a third come under the url of the next lower multiple of 3, so urls repeat in a batch."""
    key = F.col("id")
    other = F.when(key % 3 == 1, key - 1).otherwise(key)
    return hashed(spark, sf_dir).select(F.floor(key / 40).alias("batch"), (key % 40).alias("seq"), F.concat(F.lit("https://example.com/p/"), other.cast("string")).alias("url"), "source", (F.col("price") + key % 2).cast("decimal(10,2)").alias("price"), "dedup_hash")


_CANDIDATES = f"""{HASHED}, s AS (SELECT id, url, source, price, dedup_hash, CASE WHEN id % 8 = 0 THEN {_AT} ELSE last_seen_at END AS last_seen_at FROM g WHERE id % 4 = 0),
k AS (SELECT id // 40 AS batch, id % 40 AS seq, 'https://example.com/p/' || CASE WHEN id % 3 = 1 THEN id - 1 ELSE id END AS url, source, CAST(price + id % 2 AS DECIMAL(10,2)) AS price, dedup_hash FROM g)"""
_MATCHED = f"""{_CANDIDATES}, m AS (
  SELECT k.*, u.id AS url_id, u.price AS stored_price, (SELECT min(s.id) FROM s WHERE s.dedup_hash = k.dedup_hash AND s.source <> k.source AND s.last_seen_at >= {_AT} - INTERVAL 30 DAY) AS canonical_id
  FROM k LEFT JOIN s u ON u.url = k.url)"""


#: A replay in turn: what the batch has added so far goes from one candidate to the next.
_OUTCOMES = _MATCHED + """, n AS (
  SELECT *, row_number() OVER (PARTITION BY batch ORDER BY seq) AS pos, CASE WHEN url_id IS NOT NULL THEN 'Updated' WHEN canonical_id IS NOT NULL THEN 'Linked' ELSE 'Added' END AS alone FROM m),
o AS (
  SELECT batch, seq, source, pos, alone AS outcome, CASE WHEN alone = 'Added' THEN [url] ELSE [] END AS urls, CASE WHEN alone = 'Added' THEN [dedup_hash] ELSE [] END AS hashes FROM n WHERE pos = 1
  UNION ALL
  SELECT batch, seq, source, pos, outcome, CASE WHEN outcome = 'Added' THEN list_append(urls, url) ELSE urls END, CASE WHEN outcome = 'Added' THEN list_append(hashes, dedup_hash) ELSE hashes END
  FROM (SELECT n.*, o.urls, o.hashes, CASE WHEN list_contains(o.urls, n.url) OR list_contains(o.hashes, n.dedup_hash) THEN 'Skipped' ELSE alone END AS outcome FROM o JOIN n ON n.batch = o.batch AND n.pos = o.pos + 1))"""


@query(f"WITH RECURSIVE {_OUTCOMES} SELECT batch, seq, outcome FROM o")
def dedup_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(_candidates(spark, sf_dir), _stored(spark, sf_dir), AS_OF).select("batch", "seq", "outcome")


@query(f"WITH RECURSIVE {_OUTCOMES} SELECT source, {', '.join(f"count(*) FILTER (outcome = '{x}') AS {x.lower()}" for x in ('Added', 'Updated', 'Linked', 'Skipped'))} FROM o GROUP BY source")
def dedup_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(resolve(_candidates(spark, sf_dir), _stored(spark, sf_dir), AS_OF), "source")


@query(f"WITH {_MATCHED} SELECT batch, seq, url_id, canonical_id FROM m WHERE canonical_id IS NOT NULL")
def cross_source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_matches(_candidates(spark, sf_dir), _stored(spark, sf_dir), AS_OF).where("canonical_id is not null").select("batch", "seq", "url_id", "canonical_id")


@query(
    f"""WITH {_MATCHED}, w AS (SELECT canonical_id AS property_id, url, max_by(price, batch * 1000 + seq) AS price FROM m WHERE canonical_id IS NOT NULL GROUP BY ALL),
o AS (SELECT id AS property_id, url, source, price, last_seen_at FROM s WHERE id % 16 = 0)
SELECT coalesce(o.property_id, w.property_id) AS property_id, coalesce(o.url, w.url) AS url, CAST(CASE WHEN w.url IS NOT NULL THEN w.price ELSE o.price END AS DOUBLE) AS price, {sql_stamp(f"CASE WHEN w.url IS NOT NULL THEN {_AT} ELSE o.last_seen_at END")} AS last_seen_at
FROM o FULL JOIN w ON o.property_id = w.property_id AND o.url = w.url"""
)
def link_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, sf_dir)
    links = stored.where("id % 16 = 0").select(F.col("id").alias("property_id"), "url", "source", "price", F.col("created_at").alias("first_seen_at"), "last_seen_at")
    linked = stored_matches(_candidates(spark, sf_dir), stored, AS_OF).where("canonical_id is not null")
    return merge.upsert_links(links, linked, AS_OF).select("property_id", "url", number("price").alias("price"), stamp("last_seen_at").alias("last_seen_at"))


@query(
    f"""WITH {_MATCHED}, n AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN stored_price ELSE lag(price) OVER w END AS old_price FROM m WHERE url_id IS NOT NULL WINDOW w AS (PARTITION BY url_id ORDER BY batch, seq))
SELECT url_id AS property_id, CAST(old_price AS DOUBLE) AS old_price, CAST(price AS DOUBLE) AS new_price, batch, seq FROM n WHERE old_price <> price"""
)
def price_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = stored_matches(_candidates(spark, sf_dir), _stored(spark, sf_dir), AS_OF).where("url_id is not null").withColumn("outcome", F.lit("Updated"))
    return merge.price_changes(known, AS_OF).select("property_id", number("old_price").alias("old_price"), number("new_price").alias("new_price"), "batch", "seq")


@query(
    f"""WITH {_MATCHED}, x AS (SELECT url, max_by(price, batch * 1000 + seq) AS price, max_by(seq, batch * 1000 + seq) AS seq FROM m WHERE url_id IS NOT NULL GROUP BY url)
SELECT s.id, CAST(coalesce(x.price, s.price) AS DOUBLE) AS price, CASE WHEN x.url IS NOT NULL AND x.seq % 2 = 0 THEN 'new' ELSE 'old' END AS agent_name, CASE WHEN x.url IS NOT NULL AND x.seq % 3 = 0 THEN 'text ' || x.seq ELSE CASE WHEN x.url IS NULL THEN 'text' ELSE NULL END END AS description,
  x.url IS NOT NULL AS was_reset FROM s LEFT JOIN x USING (url)"""
)
def update_merge_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices are overwritten, agents only with something, a changed text resets its enrichment."""
    stored = _stored(spark, sf_dir).withColumns({"agent_name": F.lit("old"), "description": F.lit("text"), "ai_enriched_at": F.lit(str(AS_OF)).cast("timestamp_ntz")})
    known = stored_matches(_candidates(spark, sf_dir), stored, AS_OF).where("url_id is not null")
    known = known.withColumns({"agent_name": F.when(F.col("seq") % 2 == 0, "new").otherwise(""), "description": F.when(F.col("seq") % 3 == 0, F.concat(F.lit("text "), F.col("seq").cast("string")))})
    return merge.update_by_url(stored, known, AS_OF).select("id", number("price").alias("price"), "agent_name", "description", F.col("ai_enriched_at").isNull().alias("was_reset"))


@query(
    f"""WITH {LISTINGS}, {TRACKED}, {HISTORY} SELECT 'listings' AS name, count(*) AS n FROM p WHERE beds <> 5 UNION ALL SELECT 'tracked', count(*) FROM t WHERE property_id NOT IN (SELECT id FROM p WHERE beds = 5)
UNION ALL SELECT 'history', count(*) FROM h WHERE property_id NOT IN (SELECT id FROM p WHERE beds = 5)"""
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    kept, children = merge.delete_cascade(rows, rows.where("beds = 5"), {"tracked": (tracked(spark, sf_dir), "property_id"), "history": (price_history(spark, sf_dir), "property_id")})
    out = kept.agg(F.lit("listings").alias("name"), F.count("*").alias("n"))
    for name, child in children.items():
        out = out.unionByName(child.agg(F.lit(name).alias("name"), F.count("*").alias("n")))
    return out


@query(
    f"""WITH {PLACED}, z AS (SELECT DISTINCT location_string FROM q WHERE id % 3 = 0 ORDER BY 1 LIMIT 300)
SELECT id, CASE WHEN id % 3 <> 0 THEN 1.5 WHEN z.location_string IS NOT NULL THEN CAST(length(q.location_string) AS DOUBLE) END AS lat FROM q LEFT JOIN z USING (location_string)"""
)
def geocode_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(spark, sf_dir).withColumns({"lat": F.when(F.col("id") % 3 != 0, F.lit(1.5)), "lng": F.lit(None).cast("double")})
    gazetteer = rows.select("location_string").distinct().select("location_string", F.length("location_string").cast("double").alias("lat"), F.lit(0.0).alias("lng"))
    return fill_coordinates(rows, gazetteer).select("id", "lat")


@query("SELECT round(avg(embedding[1]), 6) AS lat, round(avg(embedding[2]), 6) AS lng FROM embeddings")
def map_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding")[0].cast("double").alias("lat"), F.col("embedding")[1].cast("double").alias("lng"))
    return centroid(rows).select(F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as photos: the 64 signs are the hash; place, source and price from the numbers."""
    key = F.col("vec_id")
    sign = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return table(spark, sf_dir, "embeddings").select(
        key.alias("id"), F.concat(F.lit("s"), (key % 3).cast("string")).alias("source"), F.concat(F.lit("place "), (F.col("label") % 4).cast("string")).alias("place"), (key % 50 + 100).cast("decimal(10,2)").alias("price"), sign.alias("hash"), F.concat(F.lit("u"), key.cast("string")).alias("url")
    )


_PAIRS = """s AS (SELECT vec_id AS id, 's' || (vec_id % 3) AS source, label % 4 AS place, vec_id % 50 + 100 AS price, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings),
f AS (SELECT a.id AS id_a, b.id AS id_b, CAST(len(list_filter(list_zip(a.bits, b.bits), lambda z: z[1] <> z[2])) AS INTEGER) AS dist
  FROM s a JOIN s b ON a.place = b.place AND a.id < b.id AND a.source <> b.source AND (greatest(a.price, b.price) - least(a.price, b.price)) / CAST(least(a.price, b.price) AS DOUBLE) <= 0.3)"""


@query(f"WITH {_PAIRS} SELECT id_a, id_b, dist FROM f WHERE dist <= 18")
def photo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos.pairs(_shots(spark, sf_dir), max_distance=18)


@query(f"WITH {_PAIRS}, y AS (SELECT *, row_number() OVER (ORDER BY dist, id_a, id_b) AS place FROM f WHERE dist <= 18) SELECT id_a, id_b, dist FROM y WHERE place <= 50")
def photo_pairs_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos.ranked(photos.pairs(_shots(spark, sf_dir), max_distance=18)).limit(50)


@query(
    f"""WITH {_PAIRS}, y AS (SELECT * FROM f WHERE dist <= 18), d AS (SELECT id FROM (SELECT id_a AS id FROM y UNION ALL SELECT id_b FROM y) GROUP BY id HAVING count(*) = 1)
SELECT id_a AS property_id, 'u' || id_b AS url, s.source FROM y JOIN s ON s.id = id_b WHERE id_a IN (SELECT id FROM d) AND id_b IN (SELECT id FROM d) AND id_b % 10 <> 0"""
)
def photo_new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = _shots(spark, sf_dir)
    found = materialise(photos.pairs(shots, max_distance=18), "photo-pairs")
    stored = found.where("id_b % 10 = 0").select(F.col("id_a").alias("property_id"), F.concat(F.lit("u"), F.col("id_b").cast("string")).alias("url"))
    return photos.new_links(found, shots, stored).select("property_id", "url", "source")


def _shared_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos whose hash is the first eight signs, so that many are equal."""
    return _shots(spark, sf_dir).withColumn("hash", F.col("hash").bitwiseAND(F.lit(255).cast("long")))


_SHARED = """s AS (SELECT vec_id AS id, 's' || (vec_id % 3) AS source, label % 4 AS place, vec_id % 50 + 100 AS price, list_transform(embedding[1:8], lambda x: x > 0) AS bits FROM embeddings),
g AS (SELECT *, min(id) OVER (PARTITION BY place, bits) AS node FROM s),
f AS (SELECT a.id AS id_a, b.id AS id_b, a.node AS node_a, b.node AS node_b, CAST(len(list_filter(list_zip(a.bits, b.bits), lambda z: z[1] <> z[2])) AS INTEGER) AS dist
  FROM g a JOIN g b ON a.place = b.place AND a.id < b.id AND a.source <> b.source AND (greatest(a.price, b.price) - least(a.price, b.price)) / CAST(least(a.price, b.price) AS DOUBLE) <= 0.3)"""


@query(f"WITH {_SHARED} SELECT least(node_a, node_b) AS node_a, greatest(node_a, node_b) AS node_b, dist, count(*) AS n_links FROM f WHERE dist <= 1 GROUP BY 1, 2, 3")
def photo_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that are equal as one node, named by its smallest id, and how many listings match along each pair of nodes."""
    found = photos.groups(_shared_shots(spark, sf_dir), max_distance=1)
    nodes = found.members.groupBy("place", "hash").agg(F.min("id").alias("node"))
    rows = found.edges
    for x in "ab":
        rows = rows.join(nodes.select("place", F.col("hash").alias(f"hash_{x}"), F.col("node").alias(f"node_{x}")), ["place", f"hash_{x}"])
    return rows.select(F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"), "dist", "n_links")


@query(f"WITH {_SHARED}, e AS (SELECT id_a AS id FROM f WHERE dist <= 1 UNION ALL SELECT id_b FROM f WHERE dist <= 1), d AS (SELECT id, count(*) AS degree FROM e GROUP BY id) SELECT g.id, g.node, coalesce(degree, 0) AS degree FROM g LEFT JOIN d USING (id)")
def photo_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing's node and how many listings it matches."""
    found = photos.groups(_shared_shots(spark, sf_dir), max_distance=1)
    nodes = found.members.groupBy("place", "hash").agg(F.min("id").alias("node"))
    return found.members.join(nodes, ["place", "hash"]).select("id", "node", "degree")


@query(
    f"""WITH {_PAIRS}, y AS (SELECT * FROM f WHERE dist <= 18), d AS (SELECT id FROM (SELECT id_a AS id FROM y UNION ALL SELECT id_b FROM y) GROUP BY id HAVING count(*) = 1)
SELECT id_a AS property_id, 'u' || id_b AS url, s.source FROM y JOIN s ON s.id = id_b WHERE id_a IN (SELECT id FROM d) AND id_b IN (SELECT id FROM d)"""
)
def photo_group_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New links out of groups: pairs are made of listings with one match only."""
    shots = _shots(spark, sf_dir)
    clean = photos.unambiguous_of(photos.groups(shots, max_distance=18))
    stored = shots.limit(0).select(F.col("id").alias("property_id"), "url")
    return photos.links_of(clean, shots, stored).select("property_id", "url", "source")


@query(
    """SELECT o_orderkey AS id, o_orderkey || ',' || CASE WHEN o_orderkey % 3 = 0 THEN '"' || replace(o_orderpriority || ', "x"', '"', '""') || '"' ELSE o_orderpriority END || ',' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END AS line FROM orders"""
)
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 3 == 0, F.concat("o_orderpriority", F.lit(', "x"'))).otherwise(F.col("o_orderpriority")).alias("what"), F.when(key % 2 != 0, F.col("o_orderstatus")).alias("state"))
    return export.csv_rows(rows, ["id", "what", "state"])
