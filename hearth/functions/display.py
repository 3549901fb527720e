"""What the pages derive from listings: ratios, changes, drafts and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NOT_AVAILABLE

#: Platform names and domains (fixed values).
PLATFORMS = {
    "Idealista": ("Idealista", "idealista.pt"), "ImoVirtual": ("ImoVirtual", "imovirtual.com"), "CustoJusto": ("CustoJusto", "custojusto.pt"),
    "CasaSapo": ("Casa SAPO", "casa.sapo.pt"), "CaixaImobiliario": ("Caixa Imobiliário", "caixaimobiliario.pt"), "Santander": ("Santander", "santander.pt"),
}
# Sentences of an inquiry.
ASK_ORIENTATION = (
    " Antes de agendar uma visita, gostaria de perceber qual é a orientação solar do imóvel "
    "(a sul, norte, nascente ou poente), já que não consegui encontrar essa informação no anúncio."
)
ASK_VISIT = " Se possível, gostaria de agendar uma visita."
CLOSING = "\n\nFico a aguardar a sua resposta."


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def price_per_m2(price: Column, size: Column) -> Column:
    """Rounded half up; null if either is null or 0."""
    return F.when((price != 0) & (size != 0), F.floor(price.cast("double") / size.cast("double") + 0.5))


def price_change(price: Column, previous: Column) -> tuple[Column, Column]:
    """(dropped, rose or same; the difference without its sign), null without a previous price."""
    kind = F.when(price < previous, "dropped").when(price > previous, "rose").when(price == previous, "same")
    return kind, F.abs(price - previous)


def badge(fact: Column, yes: str = "yes", no: str = "no") -> Column:
    return F.when(fact, F.lit(yes)).when(~fact, F.lit(no))


def is_new(created: Column, now: Column) -> Column:
    return created > now - F.expr("INTERVAL '24' HOUR")


def relative_time(then: Column, now: Column) -> Column:
    """Since when, each unit rounded from the one below; null was never."""
    half_up = lambda c: F.floor(c + 0.5)
    minutes = half_up(F.timestamp_diff("SECOND", then, now) / 60)
    hours = half_up(minutes / 60)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    recent = F.when(minutes < 1, "Just now").when(minutes < 60, text(minutes, "m ago"))
    return F.when(then.isNull(), "Never synced").otherwise(recent.when(hours < 24, text(hours, "h ago")).otherwise(text(half_up(hours / 24), "d ago")))


def platform_label(source: Column) -> Column:
    return F.coalesce(_map({k: v[0] for k, v in PLATFORMS.items()})[source], source, F.lit("Unknown"))


def platform_domain(source: Column) -> Column:
    return _map({k: v[1] for k, v in PLATFORMS.items()})[source]


def is_mobile(phone: Column) -> Column:
    """A Portuguese mobile number, with or without its country code."""
    digits = F.regexp_replace(F.regexp_replace(phone, "[^0-9]", ""), "^351", "")
    return F.coalesce(digits.rlike("^9[0-9]{8}$"), F.lit(False))


def phone_digits(phone: Column, country: str = "351") -> Column:
    """Digits with the country code, which a number without + gets."""
    kept = F.regexp_replace(phone, "[^0-9+]", "")
    return F.when(kept.startswith("+"), F.substring(kept, 2, 40)).otherwise(F.concat(F.lit(country), kept))


def channel(clicked: Column, phone: Column, email: Column) -> Column:
    """The one clicked, else WhatsApp for a mobile number, Email for an address, Phone."""
    return F.coalesce(_filled(clicked), F.when(is_mobile(phone), "WhatsApp").when(_filled(email).isNotNull(), "Email").otherwise("Phone"))


def contact_link(kind: Column, phone: Column, email: Column, subject: Column, body: Column) -> Column:
    quoted = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return (
        F.when(kind == "Email", F.concat(F.lit("mailto:"), email, F.lit("?subject="), quoted(subject), F.lit("&body="), quoted(body)))
        .when(kind == "WhatsApp", F.concat(F.lit("https://wa.me/"), phone_digits(phone), F.lit("?text="), F.url_encode(body)))
        .when(kind == "SMS", F.concat(F.lit("sms:"), F.regexp_replace(phone, "[^0-9+]", ""), F.lit("?body="), quoted(body)))
        .otherwise(F.concat(F.lit("tel:+"), phone_digits(phone)))
    )


def inquiry_subject(location: Column) -> Column:
    return F.concat(F.lit("Interesse no imóvel - "), F.coalesce(location, F.lit("o imóvel")))


def inquiry_body(location: Column, price_text: Column, agent: Column, url: Column, reference: Column, orientation: Column, asked: Column, availability: Column, sender: Column) -> Column:
    """A message: with a known orientation it asks for a visit, with an unknown one it asks about it once."""
    name, link, ref, who, when = (_filled(c) for c in (agent, url, reference, sender, availability))
    empty = F.lit("")
    greeting = F.concat(F.lit("Olá"), F.coalesce(F.concat(F.lit(" "), name), empty), F.lit(","))
    cost = F.coalesce(F.concat(F.lit(" ("), _filled(price_text), F.lit(")")), empty)
    line = F.coalesce(F.concat(F.lit("\n\nAnúncio: "), link, F.coalesce(F.concat(F.lit(" (Ref. "), ref, F.lit(")")), empty)), empty)
    known = F.coalesce((orientation != "") & (orientation != NOT_AVAILABLE), F.lit(False))
    visit = F.concat(F.lit(ASK_VISIT), F.coalesce(F.concat(F.lit(" Estou disponível: "), when, F.lit(".")), empty))
    middle = F.when(known, visit).when(~F.coalesce(asked, F.lit(False)), F.lit(ASK_ORIENTATION)).otherwise(empty)
    signature = F.coalesce(F.concat(F.lit("\n\nCumprimentos,\n"), who), F.lit("\n\nCumprimentos."))
    place = F.coalesce(location, F.lit("o imóvel"))
    return F.concat(greeting, F.lit("\n\nTenho interesse no imóvel em "), place, cost, F.lit(" e gostaria de saber mais detalhes."), line, middle, F.lit(CLOSING), signature)
