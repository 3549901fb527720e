"""Substring lists against contains; reports kept incrementally against full recomputation."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hearth.operators.incremental import LatestRows, SignedCounts, contacts_since, hour_of
from hearth.operators.reports import latest_by, status_histogram
from hearth.operators.substrings import SubstringIndex, containing, trigrams
from hearth.operators.versions import VersionedTable


def test_trigrams_are_of_code_points(spark):
    texts = ["", "a", "ab", "abc", "aaaa", "né😀x", None, "x" * 200_000]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(trigrams(F.col("t"))).collect()]
    assert [sorted(x) if x is not None else None for x in found] == [[], [], [], ["abc"], ["aaa"], ["né😀", "é😀x"], None, ["xxx"]]


def test_substrings_equal_contains(spark, tmp_path):
    r = random.Random(3)
    words = ["Lisboa", "Porto", "São João", "Vila Nova", "a", "", "É😀a", "%_", "aaaaab", "Matosinhos e Leça"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(5))) for _ in range(300)] + [None, None, "aa", "aaa"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    index = SubstringIndex(spark, f"{tmp_path}/index", buckets=4)
    for k in range(3):
        index.add(rows.where(F.col("id") % 3 <= k).select("text"))  # the later ones hold the earlier ones again
    assert index.values.read().count() == len({t for t in texts if t is not None})
    table = VersionedTable(spark, f"{tmp_path}/rows", rows.schema, "text", 8)
    table.write(rows)
    for needle in ("Lisboa", "isb", "João V", "aaa", "aaaa", "😀a", "É😀a", "%_ ", "a", "", "zzz", "Lisboa Lisboa Porto", "Leça Matosinhos e Leça", "LISBOA"):
        expected = sorted(k for k, t in enumerate(texts) if t is not None and needle in t)
        assert sorted(x["id"] for x in containing(rows, "text", index, needle).collect()) == expected, needle
        assert sorted(x["id"] for x in containing(table, "text", index, needle).collect()) == expected, needle


def test_a_needle_opens_few_files(spark, tmp_path):
    rows = spark.range(2000).select(F.concat(F.lit("https://example.com/p/"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    index = SubstringIndex(spark, f"{tmp_path}/index", buckets=32)
    index.add(rows)
    wanted = rows.first()["text"]
    files = len(index.find(wanted[30:60]).inputFiles())
    assert [x["text"] for x in index.find(wanted[30:60]).collect()] == [wanted]
    assert files <= 12 < len(index.values.read().inputFiles()) + len(index.lists.read().inputFiles())


def test_reports_follow_the_table(spark, tmp_path):
    r = random.Random(11)
    begin = datetime(2024, 1, 1)
    schema = spark.createDataFrame([], "id long, status string, created_at timestamp_ntz").schema
    table = VersionedTable(spark, f"{tmp_path}/t", schema, "id", 8)
    counts = lambda: SignedCounts(table, f"{tmp_path}/counts", {"status": F.col("status")})
    hours = lambda: SignedCounts(table, f"{tmp_path}/hours", {"hour": hour_of(F.col("created_at"))})
    assert counts().refresh() == 0 and counts().read().count() == 0
    held: dict[int, tuple] = {}
    for batch in range(7):
        changed = {}
        for _ in range(12):
            k = r.randrange(60)
            changed[k] = None if r.random() < 0.3 else (k, r.choice(("New", "Rejected", None)), begin + timedelta(minutes=r.randrange(72 * 60)))
        held = {k: v for k, v in {**held, **changed}.items() if v is not None}
        keys = spark.createDataFrame([(k,) for k in changed], "id long")
        buckets = table.touched(keys)
        new = spark.createDataFrame([v for v in changed.values() if v is not None], schema)
        table.write(table.read(buckets).join(keys, "id", "left_anti").unionByName(new), buckets)
        if batch == 3:
            continue  # two versions at once
        if batch == 5:
            table.vacuum(1)  # the version before is gone: counted from all rows
        assert counts().refresh() == table.version() == counts().refresh()
        hours().refresh()
        now = spark.createDataFrame(list(held.values()), schema)
        assert sorted(map(str, counts().read().collect())) == sorted(map(str, status_histogram(now).collect()))
        for as_of in (begin + timedelta(hours=50, minutes=17), begin + timedelta(hours=48), begin, begin + timedelta(days=9)):
            expected = sum(v[2] > as_of - timedelta(hours=24) for v in held.values())
            assert contacts_since(hours(), as_of).collect() == [(expected,)]
    table.write(table.read().limit(0))
    counts().refresh()
    assert counts().read().count() == 0


def test_latest_rows_read_the_changed_buckets(spark, tmp_path):
    schema = spark.createDataFrame([], "property_id long, changed_at long, id long, price long").schema
    table = VersionedTable(spark, f"{tmp_path}/t", schema, "property_id", 8)
    latest = lambda: LatestRows(table, f"{tmp_path}/latest", ["changed_at", "id"])
    r, n = random.Random(2), 0
    for batch in range(6):
        rows = []
        for _ in range(30 if batch == 0 else 2):
            n += 1
            rows.append((r.randrange(20), r.randrange(9), n, r.randrange(100)))
        table.append(spark.createDataFrame(rows, schema))
        if batch == 4:  # a property goes with its changes
            gone = spark.createDataFrame([(rows[0][0],)], "property_id long")
            buckets = table.touched(gone)
            table.write(table.read(buckets).join(gone, "property_id", "left_anti"), buckets)
        before = {(x["version"], x["bucket"]) for x in latest().state.manifest()}
        latest().refresh()
        expected = latest_by(table.read(), "property_id", F.struct("changed_at", "id"))
        assert sorted(latest().read().collect()) == sorted(expected.select(*schema.names).collect())
        if batch in (1, 2, 3, 5):
            assert len({(x["version"], x["bucket"]) for x in latest().state.manifest()} - before) <= 2


def test_frequent_trigrams_are_not_opened(spark, tmp_path, monkeypatch):
    """A needle opens the lists that narrow it and is found once; a short one asks no list."""
    rows = spark.range(2000).select(F.concat(F.lit("https://example.com/p/"), F.col("id").cast("string")).alias("text"))
    index = SubstringIndex(spark, f"{tmp_path}/index", buckets=4)
    index.add(rows)
    table = VersionedTable(spark, f"{tmp_path}/rows", rows.schema, "text", 4)
    table.write(rows)
    assert index.rarest("e.com/p/77") == {"/77": 11}
    assert index.rarest("e.com/p/x") == {}
    for needle in ("e.com/p/77", "e.com", "77", "777", "e.com/p/1999", "P/1", "é"):
        expected = [f"https://example.com/p/{k}" for k in range(2000) if needle in f"https://example.com/p/{k}"]
        assert sorted(r["text"] for r in containing(table, "text", index, needle).collect()) == sorted(expected), needle
    monkeypatch.setattr(index, "find", None)
    assert containing(table, "text", index, "99").count() == sum("99" in str(k) for k in range(2000))


def test_short_and_long_texts_have_the_same_trigrams(spark):
    for text in ("né😀x" * 3, "é" * 256, "ab😀" * 85 + "c", "ab😀" * 85 + "cd", "xyz" * 400):
        found = spark.createDataFrame([(text,)], "t string").select(trigrams(F.col("t"))).first()[0]
        assert sorted(found) == sorted({text[k : k + 3] for k in range(len(text) - 2)})
