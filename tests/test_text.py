"""Golden cases of the text functions, evaluated as columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hearth.functions import display, extract, normalize, parse
from hearth.functions.clean import clean_description

NA = "Not Available"


def each(spark, function, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def check(spark, function, cases):
    assert each(spark, function, [a for a, _ in cases]) == [b for _, b in cases]


def test_orientation(spark):
    check(spark, extract.orientation, [
        (None, NA), ("", NA), ("   ", NA), ("Apartamento com fachada sul", "Sul"), ("Virado a norte", "Norte"), ("sala a nascente", "Oriente"), ("quarto poente", "Poente"), ("Matosinhos Sul, perto da praia", NA),
        ("Norte Shopping a 5 min", NA), ("Este apartamento tem luz", NA), ("frente sul e frente norte", "Sul"), ("Orientação solar: NE", "Norte/Nascente"), ("Orientação: Nascente", "Oriente"), ("EXPOSIÇÃO: S/O", "Sul/Poente"),
        ("Boa orientação e luz", "Oriente"),
    ])
    assert each(spark, lambda c: extract.orientation_source(extract.orientation(c)), ["fachada sul", None]) == ["extracted", "not_available"]


def test_construction(spark):
    check(spark, extract.construction_status, [
        (None, NA), ("em fase de construção", "Em Construção"), ("EM CONSTRUÇÃO", "Em Construção"), ("Moradia nova com jardim", "Nova Construção"), ("casa para recuperar", "Para Recuperar"), ("pronto a habitar", "Concluída"), ("novo em folha", NA),
        ("moradia nova, em construção", "Em Construção"), ("recém-construído", "Nova Construção"),
    ])


@pytest.mark.parametrize("name, cases", [
    ("elevator", [(None, None), ("", None), ("sem nada", None), ("prédio com elevador", True), ("Sem elevador", False), ("não dispõe de elevador", False), ("ASCENSOR", True)]),
    ("parking", [("garagem dupla", True), ("sem lugar de garagem", False), ("não tem estacionamento", False), ("casa", None)]),
    ("furnished", [("mobilado", True), ("não está mobilado", False), ("sem mobília", False), ("móveis", None)]),
    ("air_conditioning", [("ar condicionado", True), ("ar-condicionado", True), ("ar condicionado", True), ("sem ar condicionado", False), ("ar fresco", None)]),
    ("balcony", [("varanda ampla", True), ("terraço", True), ("sem varanda", False), ("avarandado", None)]),
    ("storage", [("arrumos", True), ("arrecadação", True), ("sem arrumos", False), ("arrumada", None)]),
    ("has_usage_license", [("possui licença de utilização", True), ("sem licença de habitação", False), ("ao abrigo do Simplex", False), ("Decreto-Lei n.º 10/2024", False), ("licença", None)]),
    ("open_plan_kitchen", [("cozinha americana", True), ("sala e cozinha em open space", True), ("varanda aberta", None), ("cozinha aberta para a sala", True), (None, None)]),
    ("renovated", [("totalmente remodelado", True), ("renovada", True), ("obras", None)]),
    ("water_view", [("vista para o mar", True), ("vista rio", True), ("vista margem", None)]),
    ("near_metro", [("junto ao metro", True), ("120 metros quadrados", None), ("a um quilómetro", True)]),
])
def test_facts(spark, name, cases):
    check(spark, lambda c: extract.fact(c, name), cases)


def test_energy(spark):
    check(spark, extract.energy_rating, [(None, None), ("Certificado Energético: B-", "B-"), ("classe energética c, ótimo", "C"), ("certificado energético a solicitar", "A"), ("classe energética boa", None), ("B", None)])


def test_flag_or_fact(spark):
    rows = spark.createDataFrame([(True, "sem ar condicionado"), (None, "sem ar condicionado"), (False, "ar condicionado")], "f boolean, t string")
    assert [r[0] for r in rows.select(extract.flag_or_fact(F.col("f"), F.col("t"), "air_conditioning")).collect()] == [True, False, True]


CLEAN = [
    (None, None), ("  ", "  "), ("a<br>b<br/>c", "a\nb\nc"), ("<b>bom</b> <i>apartamento</i>", "bom apartamento"), ("Casa.\n5 razões para comprar com a agência\nmuito", "Casa."), ("Marque a sua visita!\nBoa casa", "Boa casa"),
    ("Contacte-nos\nRef: AB12\nT2", "T2"), ("Não hesite em contactar", "Não hesite em contactar"), ("#128205; Porto", "📍 Porto"), ("preço 128000; fim", "preço 128000; fim"), ("ruim� aqui", "ruim aqui"), ("#9999999; x", "#9999999; x"),
    ("a\n\n\n\nb", "a\n\nb"), ("x   y\t\tz", "x y z"), ("Fale com quem o contacte sobre a casa", "Fale com quem o contacte sobre a casa"),
]


def test_cleaner(spark):
    check(spark, clean_description, CLEAN)
    once = each(spark, clean_description, [a for a, _ in CLEAN])
    assert each(spark, clean_description, once) == once


def test_hash(spark):
    rows = [("Porto, Maia", "220000", 2, "66.0"), ("porto,  MAIA ", "221000", 2, "66.4"), ("Porto, Maia", "225000", 2, "66"), ("Porto, Maia", "220000", None, "66"), ("Porto, Maia", "220000", 0, "66"), ("Porto, Maia", "220000", 2, None), ("Pórto, Maia", "220000", 2, "66"), ("Pórto, Maia", "220000", 2, "66")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l string, p string, b int, s string")
    h = [r[0] for r in frame.orderBy("i").select(normalize.dedup_hash(F.col("l"), F.col("p").cast("decimal(10,2)"), F.col("b"), F.col("s").cast("decimal(8,2)"))).collect()]
    assert h[0] == h[1] == h[6] == h[7] and h[3] == h[4] and len({h[0], h[2], h[3], h[5]}) == 4 and all(len(x) == 16 for x in h)


def test_places(spark):
    check(spark, normalize.normalize_location, [(None, ""), ("  ", ""), ("  Setúbal,   Almada  ", "setubal, almada"), ("ÉVORA", "evora")])
    check(spark, normalize.district_name, [("lisbon", "Lisboa"), ("  Faro  ", "  Faro  "), (" OPORTO ", "Porto")])
    check(spark, normalize.district_slug, [("Vila Real", "vila-real"), ("Évora", "evora")])
    check(spark, normalize.parish_key, [("Pombeiro de Ribavizela", "pombeiro ribavizela"), ("São-João da Madeira", "sao joao madeira")])
    pairs = spark.createDataFrame([("Porto, Maia, X",), ("Porto",), ("Unknown",), (" ",), (None,)], "x string")
    first, second = normalize.split_location(F.col("x"))
    assert [tuple(r) for r in pairs.select(first, second).collect()] == [("Porto", "Maia, X"), ("Porto", None), (None, None), (None, None), (None, None)]


def test_parsers(spark):
    check(spark, parse.rooms, [("Apartamento T3", 3), ("sem", None), (None, None)])
    check(spark, parse.rooms_of_word, [("ONE", 0), ("MORE", 5), ("x", None)])
    assert [str(x) for x in each(spark, parse.size_m2, ["66,5 m2", "1.200 m", "70 m"])] == ["66.50", "1.20", "70.00"]
    assert [x and str(x) for x in each(spark, parse.size_m2_grouped, ["1.200,5 m2", "0 m"])] == ["1200.50", None]
    assert [x and str(x) for x in each(spark, parse.price_digits, ["250.000 €", "sob consulta"])] == ["250000.00", None]
    assert [str(x) for x in each(spark, parse.price_decimal, ["250.000,50 €"])] == ["250000.50"]
    check(spark, parse.canonical_url, [("https://h/p.jsp?pos=1&id=77&x=2", "https://h/p.jsp?id=77"), ("https://h/p", "https://h/p")])
    check(spark, parse.unwrap_tracking, [("/t?a=1&amp;l=https%3A%2F%2Fx%2Fy&amp;b=2", "https://x/y"), ("http://x", "http://x"), ("/rel", None)])
    check(spark, parse.photo_count, [('["a","b"]', 2), ("[1,2]", 0), ("{", 0), (None, 0), ("", 0), ("[]", 0)])
    check(spark, parse.html_to_text, [("a<br>b &amp; <i>c</i><br><br>d", "a\nb & c\nd"), (None, None)])
    two = spark.createDataFrame([(1, 3), (5, 2), (-4, 99)], "a int, b int")
    assert [r[0] for r in two.select(parse.room_range(F.col("a"), F.col("b"), 6)).collect()] == [[1, 2, 3], [2, 3, 4, 5], [0, 1, 2, 3, 4, 5, 6]]


def test_display(spark):
    check(spark, display.is_mobile, [("912 345 678", True), ("+351 912345678", True), ("223279548", False), (None, False)])
    check(spark, display.platform_label, [("CasaSapo", "Casa SAPO"), ("Other", "Other"), (None, "Unknown")])
    rows = spark.createDataFrame([(100.0, 0.0), (100.0, 8.0), (None, 1.0)], "p double, s double")
    assert [r[0] for r in rows.select(display.price_per_m2(F.col("p"), F.col("s"))).collect()] == [None, 13, None]
    one = spark.range(1)
    body = display.inquiry_body(F.lit("Porto"), F.lit("€1"), F.lit(" Ana "), F.lit("u"), F.lit(""), F.lit("Sul"), F.lit(True), F.lit(None).cast("string"), F.lit("Rui"))
    text = one.select(body).first()[0]
    assert text.startswith("Olá Ana,\n\nTenho interesse no imóvel em Porto (€1)") and "agendar uma visita" in text and text.endswith("Cumprimentos,\nRui")


def test_cleaning_runs_its_steps_once(spark):
    plan = spark.range(1).select(clean_description(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("consultor imobili") == 1
    rows = spark.createDataFrame([(0, None), (1, ""), (2, " \u00a0\n"), (3, "<br>"), (4, "Venha conhecer!"), (5, " a<p>")], "id int, t string")
    assert [r[0] for r in rows.orderBy("id").select(clean_description(F.col("t"))).collect()] == [None, "", " \u00a0\n", "<br>", "Venha conhecer!", "a"]
