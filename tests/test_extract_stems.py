"""The scan for stems loses no text that a pattern matches."""

from __future__ import annotations

import itertools
import re._parser as sre

import pytest
from pyspark.sql import functions as F

from hearth.functions import extract
from hearth.plans.text_queries import PHRASES


def strings(parsed) -> list[str]:
    """Strings that a pattern matches: each branch, each letter of a class, repeats at their least and once more."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "NOT_LITERAL":
            parts.append(["-"])
        elif name == "IN":
            parts.append([chr(v) if str(k) == "LITERAL" else chr(v[0]) if str(k) == "RANGE" else {"CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "1"}[str(v)] for k, v in arg if str(k) != "NEGATE"] if str(arg[0][0]) != "NEGATE" else ["-"])
        elif name == "BRANCH":
            parts.append([s for branch in arg[1] for s in strings(branch)])
        elif name == "SUBPATTERN":
            parts.append(strings(arg[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            one = strings(inner)
            parts.append([s * low for s in one] + ([s * (low + 1) for s in one] if high > low else []))
        elif name not in ("AT", "ASSERT_NOT"):
            raise ValueError(name)
    return list({"".join(p) for p in itertools.product(*parts)})


PATTERNS = {
    **{name: [p for p in pair if p] for name, pair in extract.FACT_PATTERNS.items()},
    "construction_status": [p for _, p in extract.CONSTRUCTION_PATTERNS],
    "sun_orientation": [p for _, p in extract.ORIENTATION_PATTERNS] + [extract.COMPASS_PATTERN],
    "energy_rating": [extract.ENERGY_PATTERN],
}


@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_every_match_holds_a_stem(name):
    for pattern in PATTERNS[name]:
        for alternative in strings(sre.parse(pattern)):
            assert any(s in alternative.lower() for s in extract.STEMS[name]), (name, alternative)
    assert set(extract.STEMS) == set(PATTERNS)


def test_same_facts_with_and_without(spark):
    texts = [None, "", "  ", "x" * 100_000, "OESTE", "Eſtacionamento", "FURNİ MOBİLIADO", "vısta rıo", "K metro", "aarrecadaçãoarrumos", "voestee a leste", "ESTE", "exposição solar: N-E"]
    made = [s for ps in PATTERNS.values() for p in ps for s in sorted(strings(sre.parse(p)))[::7][:40]]
    texts += [*PHRASES, *made, *(m.upper() for m in made), *(f"a{m}\n{n}b" for m, n in zip(made, reversed(made), strict=True))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, description string")
    plain = rows.select("i", *(c.alias(n) for n, c in extract.extract_all(F.col("description")).items()))
    fast = extract.with_facts(rows, F.col("description")).select(plain.columns)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, fast.collect()))


def test_stems_that_overlap(spark):
    row = spark.createDataFrame([("Arrumos a Oeste, exposição a SUL; reMOBilar",)], "t string").select(extract.stems(F.col("t")).alias("s")).first()
    assert sorted(row["s"]) == ["arrumo", "este", "exposi", "mob", "sul"]
