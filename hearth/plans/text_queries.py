"""Text, place and parsing queries.

Documents stand for listing texts: a phrase chosen by the document's number stands before
the whole text, in both engines.  RE2 has ASCII word boundaries, so the SQL spells them out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, extract, normalize, parse
from ..functions.clean import CALL_TO_ACTION, clean_description
from ..operators.geo import in_districts, parish_dimension, repair, resolve_municipality
from ..operators.maintenance import enrichment_queue, reprocess
from ..operators.merge import apply_facts
from .registry import query
from .tables import AS_OF, EVENTS_AS_OF, PLACED, TRACKED, placed, stamp, table, tracked

PHRASES = (
    "Apartamento T2 com elevador e garagem, fachada sul.", "Edifício sem elevador, não tem garagem.", "Exposição solar: NE, cozinha americana.", "ORIENTAÇÃO: SO. AR CONDICIONADO e varanda.",
    "Virado a norte, em construção, conclusão prevista para breve.", "Moradia nova com terraço e arrumos.", "Para recuperar, sem ar-condicionado, sem varanda.", "Pronto a habitar, mobilado, vista para o mar.",
    "Não está mobilado. Sem arrecadação.", "Certificado Energético: B-, possui licença de habitação.", "classe energética c, junto ao metro.", "Ao abrigo do Simplex, totalmente remodelado.", "Isento de licença de utilização; poente.",
    "Open space com cozinha, 120 metros quadrados.", "Sala e cozinha em conceito aberto, nascente.", "Boa orientação e luz, vista rio.", "Sem nada de especial.", "Sala aberta para a cozinha; obras de renovação recentes.",
)


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.element_at(F.array(*(F.lit(p) for p in PHRASES)), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(phrase, F.lit("\n"), F.col("text")).alias("description"))


_PHRASES_SQL = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
DESCRIBED = f"d AS (SELECT doc_id AS id, {_PHRASES_SQL}[doc_id % {len(PHRASES)} + 1] || chr(10) || text AS description FROM documents)"
_EDGE = r"[^\pL\pN_]"


def re2(pattern: str) -> str:
    """A pattern for RE2: boundaries as explicit neighbours, quotes doubled."""
    pattern = re.sub(r"\\b(?=[a-z(])", lambda m: f"(?:^|{_EDGE})", pattern)
    return "(?is)" + pattern.replace(r"\b", f"(?:$|{_EDGE})").replace("'", "''")


def _sql_fact(name: str) -> str:
    denies, states = extract.FACT_PATTERNS[name]
    first = f"WHEN regexp_matches(description, '{re2(denies)}') THEN false " if denies else ""
    return f"CASE {first}WHEN regexp_matches(description, '{re2(states)}') THEN true END"


def _sql_cases(patterns, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(description, '{re2(p)}') THEN '{v}'" for v, p in patterns) + f" ELSE '{otherwise}' END"


def _register_fact(name: str) -> None:
    @query(f"WITH {DESCRIBED} SELECT id, {_sql_fact(name)} AS found FROM d", name=f"extract_{name}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return described(spark, sf_dir).select("id", extract.fact(F.col("description"), name).alias("found"))


for _name in extract.FACT_PATTERNS:
    _register_fact(_name)


@query(f"WITH {DESCRIBED} SELECT id, {_sql_cases(extract.CONSTRUCTION_PATTERNS, extract.NOT_AVAILABLE)} AS found FROM d")
def extract_construction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("id", extract.construction_status(F.col("description")).alias("found"))


_COMPASS_SQL = "CASE upper(regexp_replace(regexp_extract(description, '" + re2(extract.COMPASS_PATTERN) + "', 1), '[/-]', '', 'g')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in extract.COMPASS.items()) + " END"


@query(
    f"WITH {DESCRIBED}, x AS (SELECT id, coalesce({_COMPASS_SQL}, {_sql_cases(extract.ORIENTATION_PATTERNS, extract.NOT_AVAILABLE)}) AS found FROM d) "
    f"SELECT id, found, CASE found WHEN '{extract.NOT_AVAILABLE}' THEN 'not_available' ELSE 'extracted' END AS source FROM x"
)
def extract_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = described(spark, sf_dir).select("id", extract.orientation(F.col("description")).alias("found"))
    return found.withColumn("source", extract.orientation_source(F.col("found")))


_ENERGY = re2(extract.ENERGY_PATTERN[: extract.ENERGY_PATTERN.index("(?!")]) + "(?:$|[^a-zçãõáéíóúâêô])"


@query(f"WITH {DESCRIBED} SELECT id, upper(nullif(regexp_extract(description, '{_ENERGY}', 1), '')) AS found FROM d")
def extract_energy_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("id", extract.energy_rating(F.col("description")).alias("found"))


_FACTS_SQL = ", ".join(f"{_sql_fact(n)} AS {n}" for n in extract.FACT_PATTERNS)


@query(
    f"WITH {DESCRIBED} SELECT id, {_FACTS_SQL}, {_sql_cases(extract.CONSTRUCTION_PATTERNS, extract.NOT_AVAILABLE)} AS construction_status, upper(nullif(regexp_extract(description, '{_ENERGY}', 1), '')) AS energy_rating, "
    f"coalesce({_COMPASS_SQL}, {_sql_cases(extract.ORIENTATION_PATTERNS, extract.NOT_AVAILABLE)}) AS sun_orientation FROM d"
)
def extract_all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of whole texts by one scan for the stems of their patterns."""
    return extract.with_facts(described(spark, sf_dir), F.col("description")).drop("description", "orientation_source")


BOILERPLATE = (
    "<p>Sala ampla</p><br/>Cozinha&nbsp;   nova\nMarque a sua visita!\nfim", "Ref: ABC123\nVaranda grande\n\n\n\nContacte-nos já", "Boa casa.\n5 razões para comprar com a nossa equipa\nmuito mais",
    "Antes. Caso seja um consultor imobiliário, fale connosco em partilha de negócio 50/50.\nDepois", "Venha conhecer!\nN�o hesite em contactar\nTexto final", "Sem marcas",
)
_BOILER_SQL = "[" + ", ".join("'" + b.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for b in BOILERPLATE) + "]"


def _boiler(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*(F.lit(b) for b in BOILERPLATE)), (F.col("doc_id") % len(BOILERPLATE) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(text, F.lit("\n"), F.col("text")).alias("raw"))


_CTA_SQL = "(?i)" + "|".join(f"(?:{p})" for p in CALL_TO_ACTION).replace(r"\W*", r"[^\pL\pN_]*").replace(r"\w*", r"[\pL\pN_]*").replace(r"\b[^\n]*", r"(?:$|[^\pL\pN_][^\n]*)")


@query(
    rf"""WITH b AS (SELECT doc_id AS id, {_BOILER_SQL}[doc_id % {len(BOILERPLATE)} + 1] || chr(10) || text AS raw FROM documents),
h AS (SELECT id, raw, regexp_replace(replace(regexp_replace(regexp_replace(raw, '(?i)<\s*(br|/p|/div|/li)\s*/?>', chr(10), 'g'), '<[a-zA-Z/][^<>]*>', '', 'g'), '�', ''), '[ \t]{{2,}}', ' ', 'g') AS t FROM b),
n AS (SELECT id, raw, regexp_replace(regexp_replace(t, '(?is)\d+\s*raz[õo]es\s*para\s*comprar\s*com\s*a(?:$|[^\pL\pN_]).*$', ''), '(?is)caso seja um consultor imobili[áa]rio.*?partilha de neg[óo]cio[^\n]*\.?', '', 'g') AS t FROM h),
k AS (SELECT id, raw, trim(regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(trim(x, E' \t\r\n\v\f'), '{_CTA_SQL}')), chr(10)), '\n{{3,}}', E'\n\n', 'g'), E' \t\r\n\v\f') AS t FROM n)
SELECT id, CASE WHEN t = '' THEN raw ELSE t END AS cleaned FROM k"""
)
def clean_description_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boiler(spark, sf_dir).select("id", clean_description(F.col("raw")).alias("cleaned"))


_LOCATIONS = ("  Setúbal,   Almada  ", "ÉVORA", "São João da Madeira", "Póvoa de Varzim", "", "Lisbon", "oporto", " Braganca ")
_LOCATIONS_SQL = "[" + ", ".join(f"'{x}'" for x in _LOCATIONS) + "]"


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.element_at(F.array(*(F.lit(x) for x in _LOCATIONS)), (F.col("doc_id") % len(_LOCATIONS) + 1).cast("int")).alias("spot"))


@query(f"WITH x AS (SELECT doc_id AS id, {_LOCATIONS_SQL}[doc_id % {len(_LOCATIONS)} + 1] AS spot FROM documents) SELECT id, strip_accents(lower(regexp_replace(trim(spot), ' +', ' ', 'g'))) AS place, coalesce(CASE lower(trim(spot)) {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in normalize.DISTRICT_ALIASES.items())} END, spot) AS district FROM x")
def normalize_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spots(spark, sf_dir).select("id", normalize.normalize_location(F.col("spot")).alias("place"), normalize.district_name(F.col("spot")).alias("district"))


@query(f"WITH x AS (SELECT doc_id AS id, {_LOCATIONS_SQL}[doc_id % {len(_LOCATIONS)} + 1] AS spot FROM documents) SELECT id, nullif(trim(CASE WHEN contains(spot, ',') THEN split_part(spot, ',', 1) ELSE spot END), '') AS first, CASE WHEN contains(spot, ',') THEN nullif(trim(substr(spot, strpos(spot, ',') + 1)), '') END AS second FROM x")
def split_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = normalize.split_location(F.col("spot"))
    return _spots(spark, sf_dir).select("id", first.alias("first"), second.alias("second"))


@query(f"WITH x AS (SELECT doc_id AS id, {_LOCATIONS_SQL}[doc_id % {len(_LOCATIONS)} + 1] AS spot FROM documents) SELECT id, contains(strip_accents(lower(trim(spot))), 'evora') OR contains(strip_accents(lower(trim(spot))), 'povoa') AS inside FROM x")
def district_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spots(spark, sf_dir).select("id", in_districts(F.col("spot"), ["Évora", " Póvoa"]).alias("inside"))


@query(
    """WITH x AS (SELECT doc_id AS id, 'T' || (doc_id % 7) || ' ' || (doc_id % 300) || ',' || (doc_id % 10) || ' m2 ' || (doc_id % 900 + 100) || '.' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ' €' AS t,
  (doc_id % 900 + 100) || '.' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ' €' AS c FROM documents)
SELECT id, CAST(regexp_extract(t, 'T(\\d+)', 1) AS INTEGER) AS rooms, CAST(replace(regexp_extract(t, '(\\d+(?:[.,]\\d+)?)\\s*m', 1), ',', '.') AS DOUBLE) AS size_m2, CAST(regexp_replace(c, '[^0-9]', '', 'g') AS DOUBLE) AS price, CAST(regexp_replace(c, '[^0-9]', '', 'g') AS DOUBLE) AS price_decimal FROM x"""
)
def parse_price_size_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    cost = F.concat((key % 900 + 100).cast("string"), F.lit("."), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(" €"))
    text = F.concat(F.lit("T"), (key % 7).cast("string"), F.lit(" "), (key % 300).cast("string"), F.lit(","), (key % 10).cast("string"), F.lit(" m2 "), cost)
    rows = table(spark, sf_dir, "documents").select(key.alias("id"), text.alias("t"), cost.alias("c"))
    return rows.select("id", parse.rooms(F.col("t")).alias("rooms"), parse.size_m2(F.col("t")).cast("double").alias("size_m2"), parse.price_digits(F.col("c")).cast("double").alias("price"), parse.price_decimal(F.col("c")).cast("double").alias("price_decimal"))


@query("SELECT page_id AS id, regexp_extract(url || '&id=' || page_id, '^([^?#]*)', 1) || '?id=' || page_id AS canonical, url AS unwrapped FROM pages")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    number = F.col("page_id").cast("string")
    wrapped = F.concat(F.lit("/track?x=1&amp;l="), F.url_encode("url"), F.lit("&amp;y=2"))
    return pages.select(F.col("page_id").alias("id"), parse.canonical_url(F.concat("url", F.lit("&id="), number)).alias("canonical"), parse.unwrap_tracking(wrapped).alias("unwrapped"))


#: A few parishes, among them one that two municipalities share.
PARISHES = (("Felgueiras", "Pombeiro de Ribavizela"), ("Felgueiras", "Macieira da Lixa e Caramos"), ("Amarante", "Amarante (São Gonçalo), Madalena, Cepelos e Gatão"), ("Vila Nova de Gaia", "Madalena"), ("Vila Nova de Gaia", "Grijó e Sermonde"))
_PLACES = ("Pombeiro de Ribavizela", "pombeiro da ribavizela", "Madalena", "Grijó", "Amarante", "Caramos, Macieira da Lixa", "Nowhere", "Cepelos e Sermonde")
_PARISH_KEYS = (
    ("felgueiras", "Felgueiras"), ("pombeiro ribavizela", "Felgueiras"), ("macieira lixa caramos", "Felgueiras"), ("macieira lixa", "Felgueiras"), ("caramos", "Felgueiras"), ("amarante", "Amarante"), ("amarante sao goncalo", "Amarante"), ("cepelos", "Amarante"),
    ("gatao", "Amarante"), ("vila nova gaia", "Vila Nova de Gaia"), ("grijo sermonde", "Vila Nova de Gaia"), ("grijo", "Vila Nova de Gaia"), ("sermonde", "Vila Nova de Gaia"),
)
_KEY_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'), '\\b(de|do|da|dos|das)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


_DIM_SQL = f"k(key, municipality) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _PARISH_KEYS)}), y AS (SELECT doc_id AS id, {list(_PLACES)}[doc_id % {len(_PLACES)} + 1] AS place FROM documents), x AS (SELECT DISTINCT place FROM y)"
_RESOLVED_SQL = f"""{_DIM_SQL},
v AS (SELECT place, min(municipality) AS lo, max(municipality) AS hi FROM (SELECT place, unnest(list_append(regexp_split_to_array(place, ',| e | - '), place)) AS part FROM x) JOIN k ON key = {_KEY_SQL.format('part')} GROUP BY place),
w AS (SELECT x.place, coalesce(k.municipality, CASE WHEN lo = hi THEN lo END) AS municipality FROM x LEFT JOIN k ON k.key = {_KEY_SQL.format('x.place')} LEFT JOIN v ON v.place = x.place)"""


def _parishes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A place for each document, and the dimension."""
    place = F.element_at(F.array(*(F.lit(p) for p in _PLACES)), (F.col("doc_id") % len(_PLACES) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), place.alias("place"))
    return rows, parish_dimension(spark.createDataFrame(list(PARISHES), "municipality string, parish string"))


@query(f"WITH {_RESOLVED_SQL} SELECT place, municipality FROM w")
def resolve_municipality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_municipality(*_parishes(spark, sf_dir))


@query(
    f"""WITH {_RESOLVED_SQL} SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE coalesce(municipality, place) END AS concelho, CASE WHEN id % 7 <> 0 AND municipality <> place THEN CASE WHEN id % 3 = 0 THEN 'own' ELSE place END WHEN id % 3 = 0 THEN 'own' END AS freguesia FROM y JOIN w USING (place)"""
)
def repair_municipality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parish in the place of a municipality moves, unless a parish is there."""
    rows, dimension = _parishes(spark, sf_dir)
    rows = rows.select("id", F.when(F.col("id") % 7 != 0, F.col("place")).alias("concelho"), F.when(F.col("id") % 3 == 0, "own").alias("freguesia"))
    return repair(rows, dimension)


@query("SELECT event_id AS id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 200 = 4 THEN 400 WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN event_id % 200 = 4 THEN 400 ELSE 0 END AS back FROM events")
def json_list_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    # as many urls as a large gallery has, each of 200 characters
    urls = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.rpad(F.concat(F.lit("https://x/"), i.cast("string"), F.lit("/\"q\\")), 200, "p"))
    text = F.when(key % 5 == 0, '["a", "b,\\"c"]').when(key % 5 == 1, "[1,2]").when(key % 5 == 2, "{oops").when(key % 200 == 4, parse.json_text(urls))
    back = F.when((key % 200 == 4) & (parse.json_list(text) == urls), parse.photo_count(text)).otherwise(0)
    return table(spark, sf_dir, "events").select(key.alias("id"), F.get_json_object("props", "$.k").alias("k"), parse.photo_count(text).alias("n"), back.alias("back"))


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = described(spark, sf_dir).withColumns({"ai_enriched_at": F.when(F.col("id") % 6 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "quality": F.lit(None).cast("int")})
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 100_000_000).otherwise(0)).alias("id"), "quality", F.col("doc_id").alias("seq"))
    return docs, labels


@query(f"WITH {DESCRIBED} SELECT id, sha256(description) AS text FROM d WHERE id % 6 <> 0 ORDER BY id LIMIT 40")
def enrichment_queue_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment_queue(_facts(spark, sf_dir)[0]).select("id", F.sha2("description", 256).alias("text"))


@query("SELECT d.doc_id AS id, CAST(l.quality AS INTEGER) AS quality, CASE WHEN l.doc_id IS NOT NULL THEN '1998-01-01 00:00:00' WHEN d.doc_id % 6 = 0 THEN '2024-01-01 00:00:00' END AS enriched FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.doc_id % 10 <> 0")
def enrichment_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = apply_facts(*_facts(spark, sf_dir), ["quality"], "ai_enriched_at", AS_OF)
    return rows.select("id", "quality", stamp("ai_enriched_at").alias("enriched"))


@query("SELECT count(*) FILTER (doc_id % 10 <> 0) AS applied, count(*) FILTER (doc_id % 10 = 0) AS skipped FROM labels")
def enrichment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_facts(*_facts(spark, sf_dir), ["quality"], "ai_enriched_at", AS_OF)[1]


@query("SELECT count(*) FILTER (doc_id % 6 <> 0) AS processed, count(*) FILTER (doc_id % 6 = 0) AS skipped FROM documents")
def reprocess_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reprocess(_facts(spark, sf_dir)[0])[1]


@query(f"WITH {DESCRIBED} SELECT id, {_sql_fact('elevator')} AS elevator, {_sql_fact('furnished')} AS furnished FROM d WHERE id % 6 <> 0 UNION ALL SELECT id, true, true FROM d WHERE id % 6 = 0")
def reprocess_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir)[0].withColumns({"elevator": F.lit(True), "furnished": F.lit(True)})
    return reprocess(rows)[0].select("id", "elevator", "furnished")


def _since(c: Column) -> Column:
    return display.relative_time(c, F.lit(str(EVENTS_AS_OF)).cast("timestamp_ntz"))


@query(
    f"""WITH m AS (SELECT event_id AS id, floor(date_diff('second', date_trunc('second', ts), TIMESTAMP '{EVENTS_AS_OF}') / 60.0 + 0.5) AS m FROM events), h AS (SELECT *, floor(m / 60 + 0.5) AS h FROM m)
SELECT id, CASE WHEN id % 50 = 0 THEN 'Never synced' WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN CAST(m AS BIGINT) || 'm ago' WHEN h < 24 THEN CAST(h AS BIGINT) || 'h ago' ELSE CAST(floor(h / 24 + 0.5) AS BIGINT) || 'd ago' END AS since FROM h"""
)
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    seen = F.when(key % 50 != 0, F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select(key.alias("id"), _since(seen).alias("since"))



@query(
    f"""WITH {PLACED}, {TRACKED}, x AS (SELECT t.id, agent_name, location_string, sun_orientation, CASE t.id % 4 WHEN 0 THEN '912 345 678' WHEN 1 THEN '+351 22 327 9548' END AS phone, CASE WHEN t.id % 4 = 2 THEN 'a@b.pt' END AS email, t.id % 3 = 0 AS asked FROM t JOIN q ON q.id = t.property_id)
SELECT id, CASE id % 4 WHEN 0 THEN 'WhatsApp' WHEN 2 THEN 'Email' ELSE 'Phone' END AS channel, CASE id % 4 WHEN 1 THEN 'tel:+351223279548' END AS link,
  'Olá ' || agent_name || ',' || chr(10) || chr(10) || 'Tenho interesse no imóvel em ' || location_string || ' e gostaria de saber mais detalhes.' || chr(10) || chr(10) || 'Anúncio: https://x/' || id || ' (Ref. R' || id || ')'
  || CASE WHEN sun_orientation <> 'Not Available' THEN '{display.ASK_VISIT}' || ' Estou disponível: sábado.' WHEN NOT asked THEN '{display.ASK_ORIENTATION}' ELSE '' END || chr(10) || chr(10) || 'Fico a aguardar a sua resposta.' || chr(10) || chr(10) || 'Cumprimentos.' AS body
FROM x"""
)
def inquiry_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    rows = tracked(spark, sf_dir).select("id", "agent_name").join(placed(spark, sf_dir).select("id", "location_string", "sun_orientation"), "id")
    phone, email = F.when(key % 4 == 0, "912 345 678").when(key % 4 == 1, "+351 22 327 9548"), F.when(key % 4 == 2, "a@b.pt")
    number = key.cast("string")
    body = display.inquiry_body(F.col("location_string"), F.lit(""), F.col("agent_name"), F.concat(F.lit("https://x/"), number), F.concat(F.lit("R"), number), F.col("sun_orientation"), key % 3 == 0, F.lit(" sábado "), F.lit(None).cast("string"))
    kind = display.channel(F.lit(""), phone, email)
    link = F.when(kind == "Phone", display.contact_link(kind, phone, email, display.inquiry_subject(F.col("location_string")), body))
    return rows.select("id", kind.alias("channel"), link.alias("link"), body.alias("body"))


@query("SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN '1-URGENT' ELSE o_orderpriority END AS label, CASE WHEN o_orderkey % 3 = 0 THEN 'yes' WHEN o_orderkey % 3 = 1 THEN 'no' END AS badge, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS DOUBLE) / CAST(o_orderkey % 180 + 20 AS DOUBLE) + 0.5) AS BIGINT) END AS per_m2 FROM orders")
def card_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import listings

    return listings(spark, sf_dir).select("id", display.platform_label(F.col("source")).alias("label"), display.badge(F.col("open_plan_kitchen")).alias("badge"), display.price_per_m2(F.col("price"), F.col("size_m2")).alias("per_m2"))
