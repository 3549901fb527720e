"""Source parsers on hand-made payloads."""

from __future__ import annotations

import glob
import json
import os
import shutil
from datetime import datetime
from decimal import Decimal
from functools import partial

from pyspark.sql import functions as F

from hearth import schema
from hearth.functions import parse
from hearth.operators.merge import VersionedTable
from hearth.plans import extension_queries
from hearth.sources import common, html_cards, json_api, json_in_html, manual
from hearth.streaming.ingest import landed, merge_batches


def pages(spark, *payloads):
    return spark.createDataFrame(list(enumerate(payloads)), "batch long, payload string")


def test_json_api(spark):
    page = {"total": 1, "totalPages": 1, "actualPage": 1, "elementList": [
        {"propertyCode": "7", "price": 250000.0, "thumbnail": "t.jpg", "size": 66.0, "rooms": 2, "province": "Porto", "municipality": "Maia", "url": "https://x/7", "description": "Com elevador", "features": {"hasTerrace": True}},
        {"propertyCode": "8", "thumbnail": "u.jpg", "province": "Porto", "district": "Baixa"},
    ]}
    galleries = spark.createDataFrame([("7", json.dumps({"multimedia": {"images": [{"url": "a"}, {"url": "b"}]}})), ("8", "{}")], "property_code string, payload string")
    a, b = json_api.parse(pages(spark, json.dumps(page)), galleries).orderBy("seq").collect()
    assert (a["location_string"], a["photos"], a["elevator"], a["balcony"], a["price"], a["source"]) == ("Porto, Maia", ["a", "b"], True, True, Decimal("250000.00"), "Idealista")
    assert (b["url"], b["photos"], b["freguesia"], b["price"]) == ("https://www.idealista.pt/imovel/8/", ["u.jpg"], "Baixa", None)
    ids = spark.createDataFrame([("Porto", json.dumps({"locations": [{"locationId": "1", "subTypeText": "Concelho"}, {"locationId": "2", "subTypeText": "Distrito"}]}))], "feed string, payload string")
    assert json_api.location_ids(ids).first()["location_id"] == "2"


def script(data):
    return f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script></html>'


def test_json_in_html(spark):
    item = {"id": 5, "slug": "t1-x", "roomsNumber": "TWO", "areaInSquareMeters": 50.5, "shortDescription": "sem elevador", "totalPrice": {"value": 99000}, "location": {"address": {"city": {"name": "Maia"}, "province": {"name": "Porto"}}}, "images": [{"medium": "m"}, {"medium": ""}], "agency": {"name": "Ag"}}
    row = json_in_html.parse_ads(pages(spark, script({"props": {"pageProps": {"data": {"searchAds": {"items": [item]}}}}}), "<html>none</html>")).first()
    assert (row["beds"], row["location_string"], row["photos"], row["elevator"], row["agent_name"], row["url"]) == (1, "Porto, Maia", ["m"], False, "Ag", "https://www.imovirtual.com/pt/anuncio/t1-x")
    items = [
        {"listID": "1", "body": "Caf&eacute; com garagem", "type": "sell", "price": 100, "url": "/a/1", "locationNames": {"district": "Porto", "county": "Maia", "parish": "Moreira"}, "params": {"rooms": "T2", "size": "80 m2"}},
        {"listID": "2", "type": "rent"},
    ]
    (row,) = json_in_html.parse_list(pages(spark, script({"props": {"pageProps": {"listItems": items}}}))).collect()
    assert (row["description"], row["url"], row["beds"], row["size_m2"], row["freguesia"], row["parking"]) == ("Café com garagem", "https://www.custojusto.pt/a/1", 2, Decimal("80.00"), "Moreira", True)
    detail = {"props": {"pageProps": {"adData": {"body": "d", "location": {"lat": 1.0, "lon": 2.0}, "extraImages": [{"yams_oid": "x/{rule}"}, {"yams_oid": ""}]}}}}
    found = json_in_html.list_details(spark.createDataFrame([("u", script(detail))], "url string, payload string")).first()
    assert (found["photos"], found["lat"]) == (["x/gallery"], 1.0)


def test_zipped_lists(spark):
    html = (
        "<div class='property-info-content'><a class='property-info' href='/r?l=https%3A%2F%2Fx%2F1&amp;z=1'>a</a><div class='property-type'>Apartamento T2</div><div class='property-location'>Porto, Gaia &amp; Mar</div>"
        "<div class='property-features-text'>Usado &middot; 75,5 m&#178;</div><div class='property-price-value'>250.000&#8364;</div></div>"
        "<div class='property-description'>Com varanda</div><div class='property-media'><div class='swiper-slide'><picture><source srcset='p1 1x, p1b 2x'></picture></div><div class='swiper-slide'><source data-srcset='p2 1x'></div><div class='swiper-slide'><img data-src='p3'></div></div>"
        "<div class='property-info-content'><a class='property-info' href='http://x/2'>b</a><div class='property-location'>Maia</div></div>"
    )
    a, b = html_cards.parse_zipped(pages(spark, html)).orderBy("seq").collect()
    assert (a["url"], a["beds"], a["location_string"], a["distrito"], a["price"], a["photos"], a["balcony"], a["size_m2"]) == ("https://x/1", 2, "Porto, Gaia & Mar", "Porto", Decimal("250000.00"), ["p1", "p2", "p3"], True, Decimal("75.50"))
    assert (b["url"], b["price"], b["photos"] or []) == ("http://x/2", None, [])


def card(district, town, price, number):
    return f"<div class='result_imovel_txt'><a href='/comprar/imovel.jsp?id={number}&pos=3'>Apartamento T1</a><br/><b>{price} &euro;</b><br/>{district} | {town}<br/><span style='font-size:11px;'>54 m&sup2; de area bruta</span><span>Texto   com elevador.</span><span>Ref. 001/{number}</span></div>"


def test_piped_cards(spark):
    landed_pages = pages(spark, card("Porto", "Maia", "95.000", 7) + card("Lisboa", "Sintra", "1", 8), "<p>none</p>")
    (row,) = html_cards.parse_piped(landed_pages, ["Porto"]).collect()
    assert (row["url"], row["price"], row["location_string"], row["beds"], row["size_m2"], row["description"], row["source_property_id"], row["elevator"]) == (
        "https://www.caixaimobiliario.pt/comprar/imovel.jsp?id=7", Decimal("95000.00"), "Porto, Maia", 1, Decimal("54.00"), "Apartamento T1 — Texto com elevador.", "001/7", True
    )
    assert html_cards.parse_piped(landed_pages).count() == 2


def test_props(spark):
    html = "<div class='prop'><div class='prop-imgWrap'><a href='/i/9'><div class='prop-imgArea' style=\"background:url('p.jpg')\"></div></a></div><div class='prop-tag'>Apartamento Ref: 123</div><div class='x prop-tag-sub'>80.500 &euro;</div><span class='prop-titleFirst'>Porto</span><span class='prop-titleSecond'>Maia</span><div class='prop-description'>Com garagem</div><div class='a prop-specsWrapInner'>2 quartos 1 wc 1.080,5 m2</div></div>"
    row = html_cards.parse_props(pages(spark, html)).first()
    assert (row["url"], row["price"], row["beds"], row["baths"], row["size_m2"], row["source_property_id"], row["photos"], row["parking"], row["location_string"]) == ("https://imoveis.santander.pt/i/9", Decimal("80500.00"), 2, 1, Decimal("1080.50"), "123", ["p.jpg"], True, "Porto, Maia")


def test_pages_stop_and_first_encounter(spark):
    rows = spark.createDataFrame([("f", 1, 2), ("f", 2, 0), ("f", 3, 5)], "feed string, page int, n int")
    assert [r["page"] for r in common.pages_until_empty(rows, F.col("n")).collect()] == [1]
    items = spark.createDataFrame([("f", 1, 0, "a", "x"), ("f", 2, 0, "a", "y")], "feed string, page int, position int, listing string, v string")
    assert common.first_encounter(items, "listing").first()["v"] == "x"


def test_detail_precedence(spark):
    kind = "url string, description string, lat double, lng double, energy_rating string, photos array<string>"
    preview = spark.createDataFrame([("u", "short", None, None, None, ["p"]), ("w", "only", None, None, None, ["q"])], kind)
    detail = spark.createDataFrame([("u", "", 1.0, None, "B", [])], kind)
    stored = spark.createDataFrame([("u", "long", 9.0, 2.0, "C", ["s1", "s2"])], kind)
    a, b = common.merge_detail(preview, detail, stored).orderBy("url").collect()
    assert tuple(a) == ("u", "long", 1.0, 2.0, "B", ["s1", "s2"]) and tuple(b)[1] == "only"
    assert [r["url"] for r in common.needs_detail(preview, stored).collect()] == ["w"]


def test_stream_counts_events_of_mixed_times(spark, tmp_path, monkeypatch):
    # the latest file comes first, one file is a batch
    monkeypatch.setattr(extension_queries, "landed", partial(landed, files_per_batch=1))
    for k, day in enumerate((30, 1, 15, 2)):
        rows = [(100 * k + i, datetime(2024, 1, day, i)) for i in range(10)] + [(3, datetime(2024, 1, day))]
        spark.createDataFrame(rows, "event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert [r["n"] for r in extension_queries.stream_without_repeats(spark, str(tmp_path)).collect()] == [40]


def test_stream_merges_pages(spark, tmp_path):
    now = datetime(2024, 1, 1)
    page = lambda i, price: json.dumps({"elementList": [{"propertyCode": str(i), "price": price, "province": "Porto", "municipality": f"m{i}"}]})
    for k, payload in enumerate((page(1, 10.0), page(1, 12.0), page(2, 90000.0))):
        json_api.parse(spark.createDataFrame([(k, payload)], "batch long, payload string")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in")
    table, links, history = (VersionedTable(spark, f"{tmp_path}/{name}", kind) for name, kind in (("store", schema.PROPERTY), ("links", schema.PROPERTY_SOURCE), ("history", schema.PRICE_HISTORY)))
    query = merge_batches(landed(spark, f"{tmp_path}/in", rows.schema, files_per_batch=1), table, links, history, lambda n: now, f"{tmp_path}/state")
    query.awaitTermination()
    assert sorted((r["id"], r["source_property_id"], float(r["price"])) for r in table.read().collect()) in ([(1, "1", 12.0), (2, "2", 90000.0)], [(1, "1", 10.0), (2, "2", 90000.0)], [(1, "2", 90000.0), (2, "1", 12.0)], [(1, "2", 90000.0), (2, "1", 10.0)])
    assert table.version() == 3 and links.version() == 3 and [(r["id"], {float(r["old_price"]), float(r["new_price"])}) for r in history.read().collect()] == [(1, {10.0, 12.0})]


def test_stream_restarts_between_its_tables(spark, tmp_path):
    """A run that ended after some of a batch's tables were written: the others follow, nothing comes twice."""
    now = datetime(2024, 1, 1)
    entry = lambda k, url, source, price: (0, k, url, source, price, "Porto", 2, None, None, "", None)
    kind = "batch long, seq long, url string, source string, price decimal(10,2), location_string string, beds int, baths int, size_m2 decimal(8,2), description string, photos array<string>"

    def land(*entries):
        manual.parse(spark.createDataFrame([entry(k, u, s, Decimal(p)) for k, (u, s, p) in enumerate(entries)], kind)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def tables(name):
        return [VersionedTable(spark, f"{tmp_path}/{name}/{t}", k) for t, k in (("store", schema.PROPERTY), ("links", schema.PROPERTY_SOURCE), ("history", schema.PRICE_HISTORY))]

    def merge(name):
        merge_batches(landed(spark, f"{tmp_path}/in", manual.parse(spark.createDataFrame([], kind)).schema, files_per_batch=1), *tables(name), lambda n: now, f"{tmp_path}/{name}/state").awaitTermination()
        return [sorted(str(r) for r in t.read().collect()) for t in tables(name)]

    land(("u1", "a", "100000"), ("u2", "a", "200000"), ("u2", "a", "210000"))
    land(("u1", "a", "110000"), ("v2", "b", "200000"), ("v3", "b", "300000"), ("v4", "a", "300000"))
    whole = merge("whole")
    assert [len(t) for t in whole] == [3, 1, 1]  # u1, u2, v3; v2 linked to u2; u1 has a new price; v4 is skipped
    # the second run loses its last commit and its version of the listings
    assert merge("again") == whole
    os.remove(f"{tmp_path}/again/state/commits/1")
    shutil.rmtree(f"{tmp_path}/again/store/v2")
    for crc in glob.glob(f"{tmp_path}/again/state/commits/.1.crc"):
        os.remove(crc)
    assert merge("again") == whole


def test_very_long_json_lists(spark):
    urls = [f'https://x/{i}/"q\\' + "p" * 200 for i in range(400)]
    rows = [(json.dumps(urls), 400), (json.dumps(["x" * 1_000_000]), 1), ('["' + "x" * 1_000_000, 0), ("[" + '"a",' * 100_000, 0), ('["a" , "b"]', 2), (" [ ] ", 0), ('["a",1]', 0), ("", 0), (None, 0), ('[null]', 0), ('["\\u00e9"]', 1)]
    found = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i long, t string").select("i", parse.json_list(F.col("t")).alias("l")).orderBy("i").collect()
    assert [len(r["l"]) for r in found] == [n for _, n in rows] and found[0]["l"] == urls and found[10]["l"] == ["é"]
    back = spark.createDataFrame([(urls,), (None,)], "l array<string>").select(parse.json_text(F.col("l")).alias("t")).collect()
    assert json.loads(back[0]["t"]) == urls and back[1]["t"] == "[]"


def test_guards_by_source(spark):
    rows = spark.createDataFrame([(s, p, b, place) for s in schema.SOURCES for p, b, place in ((None, None, "Porto"), (Decimal(9), 2, "Porto"), (Decimal(5), 2, "Porto"), (Decimal(9), 9, "Porto"), (Decimal(9), 2, "Lisboa"))], "source string, price decimal(10,2), beds int, location_string string")
    kept = common.guarded(rows, {"price_min": 8, "rooms_max": 4, "districts": ["PORTO"]}).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in kept} == {"Idealista": 3, "CustoJusto": 3, "CasaSapo": 3, "Santander": 3, "CaixaImobiliario": 4, "ImoVirtual": 4}
    assert common.guarded(rows, {}).count() == rows.count()
