"""Filters for a range of rooms, and requests whose page goes back to 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.functions import parse
from hearth.operators.search import SearchRequest


def test_room_filters(spark):
    rows = spark.createDataFrame([(1, 3), (0, 0), (0, 6), (3, 1), (-1, 9), (5, 7), (2, 5), (None, 2)], "low int, high int")
    found = rows.select(F.array_join(parse.room_words(F.col("low"), F.col("high")), ",").alias("w"), parse.room_list(F.col("low"), F.col("high")).alias("n")).collect()
    words = ["ONE", "TWO", "THREE", "FOUR", "FIVE", "MORE"]
    assert [r["w"] for r in found[:7]] == [",".join(words[a:b]) for a, b in ((1, 4), (0, 5), (0, 6), (1, 4), (0, 6), (4, 6), (2, 6))]
    assert [r["n"] for r in found[:7]] == ["1,2,3", "0,1,2,3,4,5,6", None, "1,2,3", None, "5,6", "2,3,4,5"]


def test_a_changed_filter_goes_back_to_the_first_page():
    request = SearchRequest(page=4, page_size=24, beds=2)
    assert (request.changed(page=5).page, request.changed(page=5).beds) == (5, 2)
    assert request.changed(beds=3) == SearchRequest(page=1, page_size=24, beds=3)
    assert request.changed(sort_by="price", sort_order="asc").page == 1 and request.changed(page=2, beds=None) == SearchRequest(page=2, page_size=24)
