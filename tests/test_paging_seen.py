"""Deep pages against one sort; expiring keys against the rule on a table, over restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hearth.operators.paging import SortedPages
from hearth.operators.search import page_of
from hearth.streaming.ingest import landed
from hearth.streaming.seen import STORE, first_encounters, first_encounters_of


def test_pages_equal_offsets(spark, tmp_path):
    rows = spark.range(2000).select("id", (F.xxhash64("id") % 40).alias("price")).withColumn("price", F.when(F.col("id") % 9 != 0, F.col("price"))).repartition(6)
    for name, order in (("down", [F.desc("price"), F.asc("id")]), ("up", [F.asc("price"), F.asc("id")])):
        pages = SortedPages.build(rows, order, f"{tmp_path}/{name}", ranges=7)
        assert pages.total == 2000 and pages.page(1, 12).columns == rows.columns
        for page, size in ((1, 12), (0, 0), (84, 12), (167, 12), (168, 12), (2, 700), (50, 37)):
            assert pages.page(page, size).collect() == page_of(rows, order, page, size).collect(), (page, size)
        assert pages.after(1995, 12).collect() == rows.orderBy(*order).offset(1995).collect()
    assert len(pages.page(84, 12).inputFiles()) <= 2 < len(spark.read.parquet(f"{tmp_path}/up/rows").inputFiles())
    empty = SortedPages.build(rows.where("false"), order, f"{tmp_path}/empty")
    assert empty.total == 0 and empty.page(1, 12).collect() == []


def test_first_encounters_over_restarts(spark, tmp_path):
    r = random.Random(7)
    begin = datetime(2024, 1, 1)
    times = sorted(r.sample(range(40 * 24 * 3600), 900))
    rows = [(begin + timedelta(seconds=t), f"k{r.randrange(60)}" if k % 11 else f"once{k}", k) for k, t in enumerate(times)] + [(begin + timedelta(days=50), "last", 900)]
    frame = spark.createDataFrame(rows, "at timestamp, key string, i long")
    horizon = timedelta(days=2)
    expected = sorted(r["i"] for r in first_encounters_of(frame, "key", "at", horizon).collect())
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    sizes = []
    try:
        for k in range(5):
            frame.where((F.col("i") >= k * 225) & (F.col("i") < k * 225 + 225)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            found = first_encounters(landed(spark, f"{tmp_path}/in", frame.schema), "key", "at", horizon)
            query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            sizes += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    assert sorted(r["i"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == expected
    keys = frame.select("key").distinct().count()
    assert sizes[-1] < 10 < max(sizes) < keys  # keys seen long ago are gone, those seen once too
