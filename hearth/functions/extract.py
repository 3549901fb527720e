"""Facts from Portuguese listing texts, as columns.

Every pattern ignores case and follows Unicode's letters and spaces.  Null and blank
texts give null (or ``Not Available``).  A negative pattern is tested before a positive one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NOT_AVAILABLE

FLAGS = "(?iU)"

# Phrases that state or deny a fact.
#: fact -> (pattern that denies it, or None; pattern that states it)
FACT_PATTERNS: dict[str, tuple[str | None, str]] = {
    "elevator": (r"sem elevador|n[ãa]o (tem|possui|disp[õo]e de) elevador|desprovido de elevador|edif[íi]cio sem elevador", r"\belevador\b|\bascensor\b"),
    "parking": (
        r"sem garagem|sem estacionamento|sem lugar de (garagem|estacionamento)|n[ãa]o (tem|possui|inclui|disp[õo]e de) (garagem|estacionamento)",
        r"garagem|estacionamento|parqueamento|lugar de garagem|box de garagem",
    ),
    "furnished": (r"n[ãa]o\s*(est[áa]\s*)?mobiliad[ao]|n[ãa]o\s*(est[áa]\s*)?mobilad[ao]|sem mob[íi]lia", r"mobiliad[ao]|mobilad[ao]"),
    "air_conditioning": (r"sem ar[\s-]condicionado|n[ãa]o (tem|possui|disp[õo]e de) ar[\s-]condicionado", r"ar[\s-]condicionado"),
    "balcony": (r"sem varanda|sem terra[çc]o|n[ãa]o (tem|possui|disp[õo]e de) varanda|n[ãa]o (tem|possui|disp[õo]e de) terra[çc]o", r"\bvaranda\b|\bterra[çc]o\b"),
    "storage": (r"sem arrecada[çc][ãa]o|sem arrumos|n[ãa]o (tem|possui|disp[õo]e de) (arrecada[çc][ãa]o|arrumos)", r"arrecada[çc][ãa]o|\barrumos\b|\barrumo\b"),
    "has_usage_license": (
        r"sem licen[çc]a de (utiliza[çc][ãa]o|habita[çc][ãa]o|habitabilidade)"
        r"|n[ãa]o (tem|possui|disp[õo]e de) licen[çc]a de (utiliza[çc][ãa]o|habita[çc][ãa]o|habitabilidade)"
        r"|(isent[ao]|dispensad[ao]) de licen[çc]a de (utiliza[çc][ãa]o|habita[çc][ãa]o)"
        r"|sem t[íi]tulos? urban[íi]stic[oa]|ao abrigo do simplex|regime simplex|simplex urban[íi]stico|decreto-lei n\.?[ºo°]?\s*10/2024",
        r"(possui|tem|com|dispõe de) licen[çc]a de (utiliza[çc][ãa]o|habita[çc][ãa]o)",
    ),
    "open_plan_kitchen": (
        None,
        r"cozinha[^.\n]{0,40}open[\s-]?space|open[\s-]?space[^.\n]{0,40}cozinha"
        r"|cozinha abert[ao]\s*(para|à|a)\s*(a\s+)?sala|sala abert[ao]\s*(para|à|a)\s*(a\s+)?cozinha"
        r"|sala\s*(e|,)?\s*cozinha\s*(em\s+)?(espaço|conceito)\s*abert[oa]|cozinha\s*(e|,)?\s*sala\s*(em\s+)?(espaço|conceito)\s*abert[oa]"
        r"|cozinha american[ao]|conceito\s*open[\s-]?space|\bopen[\s-]?space\b|\bopen[\s-]?plan\b",
    ),
    "renovated": (None, r"remodelad[ao]|renovad[ao]|obras de renova[çc][ãa]o (recentes|conclu[íi]das)"),
    "water_view": (None, r"vista\s+(para\s+o\s+|do\s+)?(mar|rio|douro)\b"),
    "near_metro": (None, r"metro\b"),
}
#: Construction states in the order in which they are tested.
CONSTRUCTION_PATTERNS = (
    ("Em Construção", r"em constru[cç][ãa]o|em fase de constru[cç][ãa]o|obra em curso|previs[ãa]o de (entrega|conclus[ãa]o)|conclus[ãa]o prevista"),
    ("Nova Construção", r"nova constru[cç][ãa]o|constru[cç][ãa]o nova|pr[ée]dio novo|moradia nova|rec[ée]m[\s-]constru[íi]d[oa]|acabado de construir"),
    ("Para Recuperar", r"para recuperar|para restaurar|para reabilitar|necessita(ndo)? de obras|a necessitar de obras|por remodelar|para remodelar|em ru[íi]na|para recupera[cç][ãa]o"),
    ("Concluída", r"pront[oa] (a|para) habitar|constru[cç][ãa]o conclu[íi]da|obra conclu[íi]da|im[óo]vel conclu[íi]do|conclu[íi]da em \d{4}"),
)
#: Orientations by phrase, in the order in which they are tested.
ORIENTATION_PATTERNS = (
    ("Sul", r"fachada sul|frente sul|virad[oa] a sul|volt(ado|ada) a sul|\ba sul\b|exposi[cç][ãa]o (solar )?a sul"),
    ("Norte", r"fachada norte|frente norte|virad[oa] a norte|volt(ado|ada) a norte|\ba norte\b|exposi[cç][ãa]o (solar )?a norte"),
    ("Oriente", r"nascente|oriente|virad[oa] a (nascente|este|leste)|exposi[cç][ãa]o (solar )?a este|fachada este|\bleste\b"),
    ("Poente", r"poente|virad[oa] a (poente|oeste)|\boeste\b"),
)
#: One or two compass letters after a label.
COMPASS_PATTERN = r"(?:orienta[cç][ãa]o|exposi[cç][ãa]o)(?:\s+solar)?\s*:?\s*([nselo][/\-]?[nselo]?)\b"
COMPASS = {
    "N": "Norte", "S": "Sul", "E": "Oriente", "L": "Oriente", "O": "Poente",
    "NE": "Norte/Nascente", "EN": "Norte/Nascente", "NL": "Norte/Nascente", "LN": "Norte/Nascente", "NO": "Norte/Poente", "ON": "Norte/Poente",
    "SE": "Sul/Nascente", "ES": "Sul/Nascente", "SL": "Sul/Nascente", "LS": "Sul/Nascente", "SO": "Sul/Poente", "OS": "Sul/Poente",
}
#: A grade after a label; what follows it is no letter.
ENERGY_PATTERN = r"(?:certificado|classe|categoria)\s+energ[ée]tic[ao]\s*:?\s*([A-G][+-]?)(?![a-zçãõáéíóúâêô])"

#: What a text must hold for any pattern of a fact to match, in ASCII (fixed values, implied by the patterns above).
STEMS: dict[str, tuple[str, ...]] = {
    "elevator": ("elevador", "ascensor"),
    "parking": ("garagem", "estacionamento", "parqueamento"),
    "furnished": ("mob",),
    "air_conditioning": ("condicionado",),
    "balcony": ("varanda", "terra"),
    "storage": ("arrecada", "arrumo"),
    "has_usage_license": ("licen", "urban", "simplex", "decreto-lei"),
    "open_plan_kitchen": ("open", "cozinha"),
    "renovated": ("remodelad", "renova"),
    "water_view": ("vista",),
    "near_metro": ("metro",),
    "construction_status": ("constru", "obra", "previs", "conclu", "dio novo", "moradia nova", "recupera", "restaurar", "reabilitar", "remodelar", "em ru", "habitar"),
    "sun_orientation": ("sul", "norte", "nascente", "oriente", "este", "leste", "poente", "orienta", "exposi"),
    "energy_rating": ("energ",),
}
_ALL_STEMS = sorted({s for stems in STEMS.values() for s in stems})


def _trie(words: list[str]) -> str:
    """A pattern for any of the words that branches on one letter at a time; of words that begin alike the shortest counts."""
    if "" in words:
        return ""
    heads = sorted({w[0] for w in words})
    tails = {h: _trie([w[1:] for w in words if w[0] == h]) for h in heads}
    return "(?:" + "|".join(h + tails[h] for h in heads) + ")" if len(heads) > 1 else heads[0] + tails[heads[0]]


_SHORTEST = [s for s in _ALL_STEMS if not any(s != t and s.startswith(t) for t in _ALL_STEMS)]
#: The first letters keep the engine from trying a branch where none can begin; a look ahead finds stems that overlap.
STEM_PATTERN = FLAGS + "(?=[" + "".join(sorted({s[0] for s in _SHORTEST})) + "])(?=(" + _trie(_SHORTEST) + "))"


def stems(text: Column) -> Column:
    """The stems that a text holds, by one scan.  Letters that the patterns take for ASCII ones count as those."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(STEM_PATTERN), F.lit(1)))
    return F.array_distinct(F.transform(found, lambda s: F.lower(F.translate(s, "\u0130\u0131\u017f\u212a", "iisk"))))


def may_match(found: Column, name: str) -> Column:
    """Whether a fact's patterns can match a text with these stems."""
    needed = {next(t for t in _SHORTEST if s.startswith(t)) for s in STEMS[name]}
    return F.arrays_overlap(found, F.array(*(F.lit(s) for s in sorted(needed))))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def fact(text: Column, name: str) -> Column:
    """True, false or null for one of ``FACT_PATTERNS``."""
    denies, states = FACT_PATTERNS[name]
    found = F.when(matches(text, states), F.lit(True))
    return F.when(matches(text, denies), F.lit(False)).when(matches(text, states), F.lit(True)) if denies else found


def construction_status(text: Column) -> Column:
    out = F.lit(NOT_AVAILABLE)
    for value, pattern in reversed(CONSTRUCTION_PATTERNS):
        out = F.when(matches(text, pattern), F.lit(value)).otherwise(out)
    return out


def orientation(text: Column) -> Column:
    """The orientation: letters after a label first, then phrases."""
    letters = F.upper(F.regexp_replace(F.regexp_extract(text, FLAGS + COMPASS_PATTERN, 1), "[/-]", ""))
    out = F.lit(NOT_AVAILABLE)
    for value, pattern in reversed(ORIENTATION_PATTERNS):
        out = F.when(matches(text, pattern), F.lit(value)).otherwise(out)
    by_letters = F.create_map(*(F.lit(x) for pair in COMPASS.items() for x in pair))[letters]
    return F.coalesce(by_letters, out)


def orientation_source(found: Column) -> Column:
    return F.when(found == NOT_AVAILABLE, F.lit("not_available")).otherwise(F.lit("extracted"))


def energy_rating(text: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(text, FLAGS + ENERGY_PATTERN, 1), F.lit("")))


def flag_or_fact(flag: Column, text: Column, name: str) -> Column:
    """A source's own flag counts when true; otherwise the text decides."""
    return F.when(flag, F.lit(True)).otherwise(fact(text, name))


def extract_all(text: Column, found: Column | None = None) -> dict[str, Column]:
    """All extractors, by the name of the column that each fills.

    found: the text's ``stems``, as a column that is computed once; a pattern then runs only on texts that it can match.
    """

    def where(name: str, value: Column, otherwise: Column) -> Column:
        return value if found is None else F.when(may_match(found, name), value).otherwise(otherwise)

    nothing, unknown = F.lit(None), F.lit(NOT_AVAILABLE)
    facing = where("sun_orientation", orientation(text), unknown)
    return {
        "sun_orientation": facing,
        "orientation_source": orientation_source(facing),
        "construction_status": where("construction_status", construction_status(text), unknown),
        **{name: where(name, fact(text, name), nothing) for name in FACT_PATTERNS},
        "energy_rating": where("energy_rating", energy_rating(text), nothing),
    }


def with_facts(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with a column for each extractor, in place of those of the same name; each text is scanned once for all."""
    scanned = rows.withColumns({"__facts_text": text, "__facts_stems": stems(text)})
    out = scanned.withColumns(extract_all(F.col("__facts_text"), F.col("__facts_stems")))
    return out.drop("__facts_text", "__facts_stems")
