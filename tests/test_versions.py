"""Bucketed versions: what a batch writes and reads, old versions, breaks; the stream over them."""

from __future__ import annotations

import glob
import os
import shutil
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth import schema
from hearth.operators import merge, resolve
from hearth.operators.geo import parish_dimension
from hearth.operators.resolve import existing
from hearth.operators.versions import VersionedTable
from hearth.sources import manual
from hearth.storage import materialise
from hearth.streaming import ingest
from hearth.streaming.ingest import landed, merge_batches

KIND = T.StructType([T.StructField("id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("price", T.DecimalType(10, 2))])


def rows(spark, ids, price=1):
    return spark.createDataFrame([(i, f"u{i}", Decimal(price)) for i in ids], KIND)


def size(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def content(table, **options):
    return sorted((r["id"], float(r["price"])) for r in table.read(**options).collect())


def test_a_version_writes_what_changes(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", KIND, "url", buckets=16)
    assert table.version() == 0 and table.read().collect() == [] and table.top() == 0
    assert table.write(rows(spark, range(2000))) == 1 and table.top() == 1999
    new = rows(spark, [7], 5)
    where = table.touched(new.select("url"))
    assert len(where) == 1
    assert table.write(table.read(where).where("id <> 7").unionByName(new), where) == 2
    assert size(f"{tmp_path}/t/v2/data") < size(f"{tmp_path}/t/v1/data") / 8
    assert content(table) == [(i, 5.0 if i == 7 else 1.0) for i in range(2000)]
    assert content(table, version=1) == [(i, 1.0) for i in range(2000)]
    # a page of two urls opens two buckets' files at most
    page = spark.createDataFrame([("u7",), ("nowhere",)], "url string")
    assert len(table.read(table.touched(page)).inputFiles()) <= 2 < len(table.read().inputFiles())
    assert {(r["url"], r["known"], r["stored_price"]) for r in existing(page, table).collect()} == {("u7", True, Decimal(5)), ("nowhere", False, None)}
    assert table.write(rows(spark, []), []) == 3 and len(content(table)) == 2000


def test_vacuum_keeps_what_is_needed(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", KIND, "url", buckets=4)
    table.write(rows(spark, range(40)))
    for price in (2, 3, 4):
        where = table.touched(rows(spark, [1]).select("url"))
        table.write(table.read(where).withColumn("price", F.lit(price).cast("decimal(10,2)")), where)
    before, whole = content(table), size(tmp_path)
    assert table.vacuum(keep=2) == 2 and size(tmp_path) < whole  # the bucket of the first two versions
    assert table.versions() == [3, 4] and content(table) == before and len(content(table, version=3)) == 40
    assert table.vacuum(keep=2) == 0
    table.write(rows(spark, [1]))
    table.vacuum(keep=1)
    assert table.versions() == [5] and content(table) == [(1, 1.0)] and sorted(os.listdir(f"{tmp_path}/t")) == ["v5"]


def test_appended_parts_are_put_together(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", KIND, "url", buckets=2, max_parts=3)
    for k in range(8):
        table.append(rows(spark, range(k * 10, k * 10 + 10)))
        assert max([r["bucket"] for r in table.manifest()].count(b) for b in (0, 1)) <= 3
    assert content(table) == [(i, 1.0) for i in range(80)] and table.top() == 79


def test_a_broken_version_does_not_count(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", KIND, "url", buckets=2)
    table.write(rows(spark, range(5)))
    table.write(rows(spark, range(9)))
    os.remove(f"{tmp_path}/t/v2/manifest/_SUCCESS")
    assert table.version() == 1 and len(content(table)) == 5
    assert table.write(rows(spark, range(7))) == 2 and len(content(table)) == 7


ENTRY = "batch long, seq long, url string, source string, price decimal(10,2), location_string string, beds int, baths int, size_m2 decimal(8,2), description string, photos array<string>"


def landing(spark, path, *entries):
    """(url, source, price, place) as one file."""
    raw = [(0, k, u, s, Decimal(p), place, 2, None, None, "", None) for k, (u, s, p, place) in enumerate(entries)]
    found = manual.parse(spark.createDataFrame(raw, ENTRY)).withColumn("concelho", F.split_part("location_string", F.lit(", "), F.lit(-1)))
    found.coalesce(1).write.mode("append").parquet(path)
    return found.schema


@pytest.mark.parametrize("keyed", [False, True])
def test_stream_over_buckets(spark, tmp_path, keyed):
    """The same tables with and without buckets, and again after a break between hashes and listings."""
    now = datetime(2024, 1, 1)
    kinds = (("listings", schema.PROPERTY, "url"), ("links", schema.PROPERTY_SOURCE, "property_id"), ("history", schema.PRICE_HISTORY, "property_id"))

    def tables():
        made = [VersionedTable(spark, f"{tmp_path}/{n}", kind, key if keyed else None, buckets=8) for n, kind, key in kinds]
        return made, VersionedTable(spark, f"{tmp_path}/hashes", schema.LISTING_HASH, "dedup_hash", buckets=8) if keyed else None

    def run():
        made, hashes = tables()
        merge_batches(landed(spark, f"{tmp_path}/in", kind, files_per_batch=1), *made, lambda n: now, f"{tmp_path}/state", hashes=hashes).awaitTermination()
        return [sorted(str(r) for r in t.read().collect()) for t in made]

    kind = landing(spark, f"{tmp_path}/in", *((f"u{i}", "a", i * 100_000, "Porto") for i in range(1, 30)))
    run()
    landing(spark, f"{tmp_path}/in", ("u1", "a", 150_000, "Porto"), ("v2", "b", 200_000, "Porto"), ("w", "b", 9_900_000, "Faro"))
    run()
    # u1's hash of old must be gone: v1 has that one and is new; v1b has u1's new hash and is linked
    landing(spark, f"{tmp_path}/in", ("v1", "b", 100_000, "Porto"), ("v1b", "b", 150_000, "Porto"))
    whole = run()
    listings, links, history = (t.read() for t in tables()[0])
    assert sorted(r["url"] for r in listings.collect()) == sorted([*(f"u{i}" for i in range(1, 30)), "w", "v1"])
    assert sorted((r["id"], r["url"]) for r in links.collect()) == [(1, "v2"), (2, "v1b")]
    assert [(r["id"], float(r["old_price"]), float(r["new_price"])) for r in history.collect()] == [(1, 100_000.0, 150_000.0)]
    assert len({r["id"] for r in listings.collect()}) == 31
    if keyed:
        assert size(f"{tmp_path}/listings/v3/data") < size(f"{tmp_path}/listings/v1/data") / 2
        assert sorted((r["dedup_hash"], r["id"]) for r in tables()[1].read().collect()) == sorted((r["dedup_hash"], r["id"]) for r in listings.collect())
    os.remove(f"{tmp_path}/state/commits/2")
    shutil.rmtree(f"{tmp_path}/listings/v3")
    for crc in glob.glob(f"{tmp_path}/state/commits/.2.crc"):
        os.remove(crc)
    assert run() == whole


def test_places_are_repaired_before_judging(spark, tmp_path):
    parishes = parish_dimension(spark.createDataFrame([("Felgueiras", "Pombeiro"), ("Porto", "Bonfim")], "municipality string, parish string"))
    kind = landing(spark, f"{tmp_path}/in", ("u1", "a", 100_000, "Porto, Pombeiro"), ("u2", "a", 300_000, "Porto, Porto"))
    made = [VersionedTable(spark, f"{tmp_path}/{n}", k) for n, k in (("listings", schema.PROPERTY), ("links", schema.PROPERTY_SOURCE), ("history", schema.PRICE_HISTORY))]
    merge_batches(landed(spark, f"{tmp_path}/in", kind), *made, lambda n: datetime(2024, 1, 1), f"{tmp_path}/state", parishes=parishes).awaitTermination()
    places = {r["url"]: (r["concelho"], r["freguesia"]) for r in made[0].read().collect()}
    assert places == {"u1": ("Felgueiras", "Pombeiro"), "u2": ("Porto", None)}


def test_a_batch_moves_whole_rows_once(spark, tmp_path, monkeypatch):
    """Only the batch's own rows are kept as wide as listings; judging, numbering and hashes go by narrow ones.  A bucketed write doesn't sort."""
    kept = []
    for module in (ingest, merge, resolve):
        monkeypatch.setattr(module, "materialise", lambda df, name: kept.append((name, "photos" in df.columns)) or materialise(df, name))
    made = [VersionedTable(spark, f"{tmp_path}/{n}", kind, key, buckets=4) for n, kind, key in (("listings", schema.PROPERTY, "url"), ("links", schema.PROPERTY_SOURCE, "property_id"), ("history", schema.PRICE_HISTORY, "property_id"))]
    hashes = VersionedTable(spark, f"{tmp_path}/hashes", schema.LISTING_HASH, "dedup_hash", buckets=4)
    kind = landing(spark, f"{tmp_path}/in", ("u1", "a", 100_000, "Porto"), ("u1", "a", 120_000, "Porto"), ("u2", "a", 300_000, "Porto"))
    merge_batches(landed(spark, f"{tmp_path}/in", kind), *made, lambda n: datetime(2024, 1, 1), f"{tmp_path}/state", hashes=hashes).awaitTermination()
    assert sorted((r["url"], int(r["price"])) for r in made[0].read().collect()) == [("u1", 100_000), ("u2", 300_000)]
    assert {name for name, wide in kept if wide} == {"stream-rows"} < {name for name, _ in kept}
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_upsert_equals_update_and_insert(spark):
    now, later = datetime(2024, 1, 1), datetime(2024, 1, 2)
    row = lambda i, **v: {f.name: None for f in schema.PROPERTY.fields} | {"id": i, "source": "a", "sun_orientation": "N", "orientation_source": "n", "construction_status": "N", "dedup_hash": f"h{i}", "created_at": now, "last_seen_at": now} | v
    stored = spark.createDataFrame([row(1, url="u1", description="old", agent_name="Ana", lat=1.0, ai_enriched_at=now), row(2, url="u2", description="same", ai_enriched_at=now), row(3, url="u3")], schema.PROPERTY)
    new = [row(1, url="u1", description="new", agent_name="", lat=2.0, dedup_hash="k"), row(2, url="u2", description="same", source="b"), row(4, url="u4", agent_name="Rui", photos=["p"]), row(5, url="u5", lat=3.0)]
    drop = ("created_at", "last_seen_at", "first_scraped_at", "ai_enriched_at")
    changes = spark.createDataFrame(new, schema.PROPERTY).drop(*drop).withColumns({"batch": F.lit(0), "seq": F.col("id")})
    expected = merge.insert(merge.update_by_url(stored, changes.where("id < 3"), later), changes.where("id > 3").drop("id"), later, 4)
    assert sorted(map(str, merge.upsert(stored, changes, later).collect())) == sorted(map(str, expected.select(*stored.columns).collect()))
