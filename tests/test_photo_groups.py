"""Photo groups against pairs: degrees, link counts, exact rebuilding, one hash many times."""

from __future__ import annotations

import random
import time
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from hearth.operators import photos

_SCHEMA = "id long, source string, place string, price decimal(10,2), hash long"


def _pairs(rows):
    out = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[2] == b[2] and a[2] and None not in (a[1], b[1], a[3], b[3], a[4], b[4]) and a[1] != b[1]:
                low, high = min(a[3], b[3]), max(a[3], b[3])
                dist = bin((a[4] ^ b[4]) & (2**64 - 1)).count("1")
                if low != 0 and float(high - low) / float(low) <= photos.MAX_PRICE_GAP and dist <= photos.MAX_DISTANCE:
                    out[a[0], b[0]] = dist
    return out


def test_groups_hold_all_pairs(spark):
    r = random.Random(5)
    bases = [r.getrandbits(64) - 2**63 for _ in range(6)]
    rows = []
    for k in range(700):
        h = r.choice(bases)
        for _ in range(r.choice((0, 0, 1, 3))):
            h ^= 1 << r.randrange(63)
        price = r.choice((Decimal("100.00"), Decimal("130.00"), Decimal("130.01"), Decimal("76.92"), Decimal("76.93"), Decimal("0.00"), Decimal("-5.00"), Decimal(r.randrange(5000, 20000)) / 100, None))
        rows.append((k, r.choice(("x", "y", "z", None)), r.choice(("p", "q", "", None)), price, None if k % 37 == 0 else h))
    frame = spark.createDataFrame(rows, _SCHEMA)
    expected = _pairs(rows)
    assert {(x["id_a"], x["id_b"]): x["dist"] for x in photos.pairs(frame).collect()} == expected
    found = photos.groups(frame)
    rebuilt = photos.expand(found).collect()
    assert len(rebuilt) == len(expected) > 500 and {(x["id_a"], x["id_b"]): x["dist"] for x in rebuilt} == expected
    degree = {}
    for pair in expected:
        for k in pair:
            degree[k] = degree.get(k, 0) + 1
    assert {x["id"]: x["degree"] for x in found.members.collect() if x["degree"]} == degree
    hashes, links = {x[0]: (x[2], x[4]) for x in rows}, {}
    for a, b in expected:
        key = (hashes[a][0], *sorted((hashes[a][1], hashes[b][1])))
        links[key] = links.get(key, 0) + 1
    assert {(x["place"], x["hash_a"], x["hash_b"]): x["n_links"] for x in found.edges.collect()} == links
    assert sorted(photos.unambiguous_of(found).collect()) == sorted(photos.unambiguous(photos.pairs(frame)).collect())


def test_one_hash_many_times_is_linear(spark):
    n = 100_000
    key = F.col("id")
    frame = spark.range(n).select("id", F.concat(F.lit("s"), (key % 3).cast("string")).alias("source"), F.lit("p").alias("place"), (key % 1000 + 1000).cast("decimal(10,2)").alias("price"), F.lit(-1).cast("long").alias("hash"))
    begin = time.monotonic()
    found = photos.groups(frame)
    edge = found.edges.collect()
    assert found.members.count() == n and time.monotonic() - begin < 120
    counts, total = [[0] * 3 for _ in range(1000)], 0
    for k in range(n):
        counts[k % 1000][k % 3] += 1
    for p in range(1000):
        for q in range(p, 1000):
            if (q - p) / (p + 1000) <= 0.3:
                links = sum(counts[p][s] * counts[q][t] for s in range(3) for t in range(3) if s != t)
                total += links // 2 if p == q else links
    assert [(x["dist"], x["n_links"]) for x in edge] == [(0, total)]


def test_wide_distances_are_compared_once(spark, monkeypatch):
    r = random.Random(9)
    bases = [r.getrandbits(64) - 2**63 for _ in range(40)]
    rows = []
    for k in range(900):
        h = r.choice(bases)
        for _ in range(r.randrange(24)):
            h ^= 1 << r.randrange(63)
        rows.append((k, r.choice("xyz"), "p" if k % 3 else f"q{k % 50}", Decimal(r.randrange(5000, 9000)) / 100, h))
    monkeypatch.setattr(photos, "MAX_DISTANCE", 18)
    expected = _pairs(rows)
    monkeypatch.setattr(photos, "TILE_ROWS", 100)
    frame = spark.createDataFrame(rows, _SCHEMA)
    assert len(expected) > 500 and {(x["id_a"], x["id_b"]): x["dist"] for x in photos.pairs(frame, 18).collect()} == expected
    assert {(x["id_a"], x["id_b"]): x["dist"] for x in photos.expand(photos.groups(frame, 18)).collect()} == expected


def test_a_large_place_at_a_wide_distance(spark):
    n = 60_000
    frame = spark.range(n).select("id", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.lit("p").alias("place"), F.lit(100).cast("decimal(10,2)").alias("price"), F.xxhash64("id").alias("hash"))
    rows = sorted((x["id"], x["hash"]) for x in frame.select("id", "hash").collect())
    hashes, source = np.array([h for _, h in rows]).view(np.uint64), np.arange(n) % 3
    expected = 0
    for k in range(0, n, 32):
        close = np.bitwise_count(hashes[k : k + 32, None] ^ hashes) <= 18
        expected += int(np.count_nonzero(close & (source[k : k + 32, None] != source)))
    begin = time.monotonic()
    assert photos.pairs(frame, 18).count() == expected // 2 and time.monotonic() - begin < 60


def test_empty(spark):
    found = photos.groups(spark.createDataFrame([], _SCHEMA))
    assert found.edges.count() == found.members.count() == photos.expand(found).count() == photos.unambiguous_of(found).count() == 0
