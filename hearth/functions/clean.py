"""Cleaning of listing texts: markup, broken symbols, marketing tails and calls to action."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as markup, tail, notice and call to action.
BREAK_TAG = r"(?i)<\s*(br|/p|/div|/li)\s*/?>"
ANY_TAG = r"<[a-zA-Z/][^<>]*>"
REPLACEMENT_CHARACTER = "�"
TAIL = r"(?isU)\d+\s*raz[õo]es\s*para\s*comprar\s*com\s*a\b.*$"
BROKER_NOTICE = r"(?isU)caso seja um consultor imobili[áa]rio.*?partilha de neg[óo]cio[^\n]*\.?"
CALL_TO_ACTION = (
    r"^\W*(agende|marque)\s+(j[áa]\s+)?a\s+sua\s+visita\W*$",
    r"^\W*contacte(-nos)?\b[^\n]*$",
    r"^\W*entre em contacto\b[^\n]*$",
    r"^\W*n[ãa]o hesite em (contact|apresent)\w*[^\n]*$",
    r"^\W*venha conhecer\W*.{0,30}$",
    r"^\W*ref\.?\s*:\s*\S+\.?\W*$",
)
#: A symbol's number at a line's begin, as a stripped entity leaves it.
BROKEN_SYMBOL = r"^#(\d{4,7});[ \t]*"

TRIM = r"(?U)^\s+|\s+$"


def symbol(number: Column) -> Column:
    """The character of a code point, null if there is none."""
    point = number.cast("int")
    valid = point.between(0, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))


def _with_symbol(line: Column) -> Column:
    number = F.regexp_extract(line, BROKEN_SYMBOL, 1)
    fixed = F.concat(symbol(F.when(number != "", number)), F.lit(" "), F.regexp_replace(line, BROKEN_SYMBOL, ""))
    return F.coalesce(fixed, line)


def clean_description(text: Column) -> Column:
    """The cleaned text; blank texts, and texts of which nothing is left, stay as they are."""
    out = F.regexp_replace(text, BREAK_TAG, "\n")
    out = F.regexp_replace(out, ANY_TAG, "")
    out = F.regexp_replace(out, REPLACEMENT_CHARACTER, "")
    out = F.regexp_replace(out, "[ \t]{2,}", " ")
    out = F.array_join(F.transform(F.split(out, "\n"), _with_symbol), "\n")
    out = F.regexp_replace(out, TAIL, "")
    out = F.regexp_replace(out, BROKER_NOTICE, "")
    pattern = "(?iU)" + "|".join(f"(?:{p})" for p in CALL_TO_ACTION)
    out = F.array_join(F.filter(F.split(out, "\n"), lambda line: ~F.regexp_replace(line, TRIM, "").rlike(pattern)), "\n")
    out = F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), TRIM, "")
    # as an array, so that the steps above are in the expression once and run once
    return F.coalesce(F.try_element_at(F.filter(F.array(out, text), lambda x: x != ""), F.lit(1)), text)
