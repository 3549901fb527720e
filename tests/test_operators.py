"""Operators on small tables; the greedy resolution against a sequential replay."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hearth import schema
from hearth.operators import export, geo, history, maintenance, merge, photos, reports, resolve, search, triage

NOW = datetime(2024, 5, 1, 12)


def simulate(candidates, stored):
    """Candidates (batch, seq, url, source, hash) one after the other against the store at the batch's begin."""
    out = {}
    for batch in sorted({c[0] for c in candidates}):
        urls, hashes = set(), set()
        for _, seq, url, source, key in sorted(c for c in candidates if c[0] == batch):
            if url in urls or key in hashes:
                out[batch, seq] = "Skipped"
            elif any(s[1] == url for s in stored):
                out[batch, seq] = "Updated"
            elif any(s[3] == key and s[2] != source and s[4] >= NOW - timedelta(days=30) for s in stored):
                out[batch, seq] = "Linked"
            else:
                out[batch, seq] = "Added"
                urls.add(url)
                hashes.add(key)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_resolution_equals_replay(spark, seed):
    r = random.Random(seed)
    stored = [(i, f"u{r.randrange(12)}-{i}" if r.random() < 0.5 else f"u{i}", r.choice("ab"), f"h{r.randrange(8)}", NOW - timedelta(days=r.choice([1, 30, 31]))) for i in range(8)]
    candidates = [(b, s, f"u{r.randrange(14)}", r.choice("ab"), f"h{r.randrange(9)}") for b in range(15) for s in range(8)]
    properties = spark.createDataFrame([(*s, Decimal(1)) for s in stored], "id long, url string, source string, dedup_hash string, last_seen_at timestamp_ntz, price decimal(10,2)")
    frame = spark.createDataFrame(candidates, "batch long, seq long, url string, source string, dedup_hash string")
    found = resolve.resolve(frame, properties, NOW).collect()
    assert {(x["batch"], x["seq"]): x["outcome"] for x in found} == simulate(candidates, stored)
    counts = resolve.tally(resolve.resolve(frame, properties, NOW)).first()
    assert sum(counts) == len(candidates)


def test_only_added_ones_block(spark):
    properties = spark.createDataFrame([], "id long, url string, source string, dedup_hash string, last_seen_at timestamp_ntz, price decimal(10,2)")
    rows = spark.createDataFrame([(0, 0, "u1", "a", "h1"), (0, 1, "u1", "a", "h2"), (0, 2, "u2", "a", "h2")], "batch long, seq long, url string, source string, dedup_hash string")
    assert {x["seq"]: x["outcome"] for x in resolve.resolve(rows, properties, NOW).collect()} == {0: "Added", 1: "Skipped", 2: "Added"}


@pytest.mark.parametrize("seed", range(2))
def test_conflict_rounds_equal_replay(spark, seed):
    """Long chains, hot urls and hashes, nulls and repeated rows in one large batch beside small ones."""
    r = random.Random(seed)
    rows = [(0, f"u{k // 2}", f"h{(k + 1) // 2}") for k in range(24)]  # a chain: every second one is added
    rows += [(1, r.choice(["hot", f"u{r.randrange(300)}"]), r.choice(["hot", f"h{r.randrange(300)}"])) for _ in range(600)]
    rows += [(2, r.choice([None, "u"]), r.choice([None, "h"])) for _ in range(12)]
    candidates = [(b, k, u, r.choice("ab"), h) for k, (b, u, h) in enumerate(rows)]
    stored = [(i, f"u{i * 9}", r.choice("ab"), f"h{r.randrange(300)}", NOW) for i in range(12)]
    properties = spark.createDataFrame([(*s, Decimal(1)) for s in stored], "id long, url string, source string, dedup_hash string, last_seen_at timestamp_ntz, price decimal(10,2)")
    frame = spark.createDataFrame(candidates, "batch long, seq long, url string, source string, dedup_hash string").repartition(5)
    found = resolve.resolve(frame, properties, NOW)
    assert {(x["batch"], x["seq"]): x["outcome"] for x in found.collect()} == simulate(candidates, stored)
    assert found.columns == [*resolve.stored_matches(frame, properties, NOW).columns, "outcome"]
    assert resolve.resolve(frame.where("false"), properties, NOW).collect() == []


def _property(i, **values):
    row = {f.name: None for f in schema.PROPERTY.fields} | {"id": i, "url": f"u{i}", "source": "a", "sun_orientation": "Not Available", "orientation_source": "not_available", "construction_status": "Not Available", "dedup_hash": f"h{i}", "created_at": NOW, "last_seen_at": NOW}
    return row | values


def test_update_and_insert(spark):
    stored = spark.createDataFrame([_property(1, price=Decimal(10), description="old", agent_name="Ana", lat=1.0, ai_enriched_at=NOW, beds=2), _property(2)], schema.PROPERTY)
    later = NOW + timedelta(days=1)
    updates = spark.createDataFrame([(0, 0, _property(9, url="u1", price=Decimal(12), description="new", agent_name="", lat=2.0))], "batch long, seq long, p struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.PROPERTY.fields) + ">").select("batch", "seq", "p.*")
    rows = {r["id"]: r for r in merge.update_by_url(stored, updates, later).collect()}
    assert (rows[1]["price"], rows[1]["description"], rows[1]["agent_name"], rows[1]["lat"], rows[1]["beds"], rows[1]["ai_enriched_at"], rows[1]["last_seen_at"]) == (Decimal(12), "new", "Ana", 1.0, None, None, later)
    assert rows[2]["last_seen_at"] == NOW
    grown = merge.insert(stored, updates.drop("id"), later, 3).orderBy("id").collect()
    assert [(r["id"], r["created_at"]) for r in grown] == [(1, NOW), (2, NOW), (3, later)]


def test_price_changes_in_turn(spark):
    rows = spark.createDataFrame([(7, 0, 0, "Updated", Decimal(10), Decimal(12)), (7, 0, 1, "Updated", Decimal(10), Decimal(12)), (7, 0, 2, "Updated", Decimal(10), Decimal(11)), (8, 0, 3, "Updated", None, Decimal(5))], "url_id long, batch long, seq long, outcome string, stored_price decimal(10,2), price decimal(10,2)")
    assert [(r["old_price"], r["new_price"]) for r in merge.price_changes(rows, NOW).orderBy("seq").collect()] == [(10, 12), (12, 11)]


def test_rejection_expiry(spark):
    listings = spark.createDataFrame([(i,) for i in range(1, 5)], "id long")
    tracked = spark.createDataFrame([(1, "Rejected", NOW - timedelta(hours=1)), (2, "Rejected", NOW - timedelta(hours=73)), (3, "Interested", NOW - timedelta(hours=1000))], "property_id long, status string, date_added timestamp_ntz")
    assert sorted(r["id"] for r in search.pending(listings, tracked, NOW).collect()) == [2, 4]


def test_search_plan_reaches_the_scan(spark, sf_dir):
    from hearth.plans.tables import listings, tracked

    rows = search.matching(listings(spark, sf_dir), tracked(spark, sf_dir), search.SearchRequest(source="1-URGENT"), NOW).select("id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_geography(spark):
    parishes = spark.createDataFrame([("Felgueiras", "Pombeiro de Ribavizela"), ("Amarante", "Madalena"), ("Gaia", "Madalena"), ("Gaia", "Grijó e Sermonde")], "municipality string, parish string")
    dim = geo.parish_dimension(parishes)
    places = spark.createDataFrame([(p,) for p in ("pombeiro de RIBAVIZELA", "Madalena", "Grijo", "Gaia", "x", None)], "place string")
    assert {r["place"]: r["municipality"] for r in geo.resolve_municipality(places, dim).collect()} == {"pombeiro de RIBAVIZELA": "Felgueiras", "Madalena": None, "Grijo": "Gaia", "Gaia": "Gaia", "x": None, None: None}


def test_range_guard(spark):
    rows = spark.createDataFrame([(None, None), (50.0, 2), (500.0, 2), (100.0, 9)], "p double, b int")
    assert [r[0] for r in rows.select(geo.in_range(F.col("p"), F.col("b"), 40, 300, 1, 4)).collect()] == [True, True, False, False]


def test_photos_equal_brute_force(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(60):
        h = r.choice(base)
        for _ in range(r.randrange(7)):
            h ^= 1 << r.randrange(64)
        rows.append((i, r.choice("ab"), r.choice(["x", "y"]), Decimal(r.choice([0, 100, 120, 200])), h - (1 << 64) if h >> 63 else h, f"u{i}"))
    frame = spark.createDataFrame(rows, "id long, source string, place string, price decimal(10,2), hash long, url string")
    expected = set()
    for a in rows:
        for b in rows:
            low, high = min(a[3], b[3]), max(a[3], b[3])
            if a[0] < b[0] and a[1] != b[1] and a[2] == b[2] and low and (high - low) / low <= Decimal("0.3") and bin((a[4] ^ b[4]) & (1 << 64) - 1).count("1") <= 4:
                expected.add((a[0], b[0]))
    assert {(x["id_a"], x["id_b"]) for x in photos.pairs(frame).collect()} == expected and expected
    ends = [i for p in expected for i in p]
    assert {(x["id_a"], x["id_b"]) for x in photos.unambiguous(photos.pairs(frame)).collect()} == {p for p in expected if all(ends.count(i) == 1 for i in p)}


def test_as_of_equals_brute_force(spark):
    r = random.Random(5)
    prices = [(r.randrange(4), r.randrange(50), float(r.randrange(9))) for _ in range(40)]
    events = [(r.randrange(5), r.randrange(50), i) for i in range(30)]
    found = history.as_of(spark.createDataFrame(events, "k long, at long, i long"), spark.createDataFrame(prices, "k long, changed long, v double"), "k", "at", "changed", "v")
    for row in found.collect():
        before = [(t, v) for k, t, v in prices if k == row["k"] and t <= row["at"]]
        assert row["v"] == (max(before)[1] if before else None)
    assert found.count() == 30


def test_triage(spark):
    homes = spark.createDataFrame([(1, "Ana", "9", None), (2, None, None, None)], "id long, agent_name string, agent_phone string, agent_email string")
    empty = spark.createDataFrame([], schema.MY_LISTING)
    new = triage.track(empty, spark.createDataFrame([(1, None), (5, "Waiting")], "property_id long, status string"), homes, NOW).collect()
    assert [(r["property_id"], r["status"], r["agent_name"]) for r in new] == [(1, "Interested", "Ana")]
    tracked = spark.createDataFrame([(1, 1, "Interested", "n", NOW, NOW)], "id long, property_id long, status string, notes string, date_added timestamp_ntz, last_updated timestamp_ntz")
    changed = triage.change(tracked, spark.createDataFrame([(1, 0, "Waiting", None), (1, 1, None, "x")], "id long, seq long, status string, notes string"), NOW + timedelta(hours=1)).first()
    assert (changed["status"], changed["notes"]) == ("Waiting", "x") and changed["last_updated"] == NOW + timedelta(hours=1)
    valid, rows = triage.log_contacts(tracked, spark.createDataFrame([(1, "Outbound"), (7, "Outbound")], "my_listing_id long, direction string"), NOW)
    assert valid.count() == 1 and rows.first()["status"] == "Contacted"
    queue = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted(r[0] for r in triage.queue_append(queue, spark.createDataFrame([(2,), (3,)], "id long")).collect()) == [1, 2, 3]


def test_reprocess_is_idempotent(spark):
    rows = spark.createDataFrame([_property(1, description="<b>com elevador</b>"), _property(2, description="sem elevador", ai_enriched_at=NOW), _property(3)], schema.PROPERTY)
    once, counts = maintenance.reprocess(rows)
    assert tuple(counts.first()) == (1, 2)
    found = {r["id"]: (r["description"], r["elevator"]) for r in once.collect()}
    assert found == {1: ("com elevador", True), 2: ("sem elevador", None), 3: (None, None)}
    assert sorted(map(str, maintenance.reprocess(once)[0].collect())) == sorted(map(str, once.collect()))


def test_versioned_table_and_cascade(spark, tmp_path):
    table = merge.VersionedTable(spark, f"{tmp_path}/t", schema.PRICE_HISTORY)
    assert table.read().count() == 0 and table.version() == 0
    rows = spark.createDataFrame([(1, 1, Decimal(1), Decimal(2), NOW), (2, 2, Decimal(1), Decimal(2), NOW)], schema.PRICE_HISTORY)
    assert table.write(rows) == 1
    kept, children = merge.delete_cascade(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,)], "id long"), {"history": (table.read(), "property_id")})
    assert table.write(children["history"]) == 2 and table.read().count() == 1 and kept.count() == 1


def test_csv_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id long, t string")
    export.write_csv(rows.coalesce(1), {"Id": "id", "Text, long": "t"}, f"{tmp_path}/out", [F.asc("id")])
    import glob

    data = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/out/part-*")))
    assert data.decode("utf-8") == '﻿Id,"Text, long"\r\n1,"a ""b"", c"\r\n2,\r\n'


def test_run_record_and_settings(spark):
    tally = spark.createDataFrame([(1, 2, 3, 4)], "added long, updated long, linked long, skipped long")
    row = reports.run_record(tally, "CasaSapo", NOW, NOW + timedelta(seconds=90.9), ["x"]).first()
    assert (row["properties_found"], row["duration_seconds"], row["has_errors"], row["errors"]) == (10, 90, True, ["x"])
    stored = merge.replace_settings(spark, {"districts": ["Porto"], "rooms_min": 1}, schema.APP_SETTING, NOW)
    assert stored.first()["districts"] == ["Porto"]
    assert merge.default_settings(spark.createDataFrame([], schema.APP_SETTING), stored).count() == 1
