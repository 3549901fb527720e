"""Quality rules whose cutoffs are controlled for risk.

Each rule rejects a text when a ratio is above a cutoff.  Texts labelled good are the
holdout: along a fixed grid from the most lenient to the strictest cutoff, a cutoff is
certified while the exact binomial test rejects "the rule discards more than its share
of good texts".  The walk along a grid stops at the first failure, and the level is
divided over all strata and rules (Bonferroni), so with probability 1 - ``delta`` no
stratum loses more than ``alpha`` of its good texts to all rules together.  A stratum
with too few good labels to certify rules one by one walks all grids at once, a step of
every rule at a time, and needs a fourth of the labels for the same guarantee.  How a
stratum is tested follows from the numbers of labels alone, so the correction holds.

Defined results: null and empty texts have zero counts and fail the base rules.  A
stratum with too few good labels has no cutoff and keeps what the base rules keep; a null
stratum is one of its own.  Labels for unknown documents are ignored; repeated labels of
a document count once, a good one prevails.  Repeated rows each get a row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, fresh, materialise, slices, small_batches, texts

SYMBOLS = b"#*$%&|<>"
_SPACES = b"\t\n\x0b\x0c\r "
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rule -> (numerator, denominator, cutoffs from lenient to strict).
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "repeat_words": ("n_repeat_words", "n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "word_chars": ("word_chars", "n_words", (16.0, 14.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5, 7.0)),
}


#: Steps of the walk along all grids at once; shorter grids stay at their strictest cutoff.
STEPS = max(len(grid) for _, _, grid in RULES.values())


def cutoff_at(rule: str, step: int) -> float:
    grid = RULES[rule][2]
    return grid[min(step, len(grid) - 1)]


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that the text has twice or more."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts, covered = Counter(grams), bytearray(len(words))
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered[i : i + window] = b"\1" * window
    return sum(covered)


def counts_of(text: bytes) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text."""
    words = text.split()  # bytes: exactly the six ASCII white space characters
    lines = [x for x in text.split(b"\n") if x.strip()]
    solid = text.translate(None, _SPACES)
    points = len(solid) if solid.isascii() else len(solid.decode())
    return len(words), points, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines)


def _with_counts(column: str, kept: list[str], at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            counts = zip(*map(counts_of, texts(batch, column)), strict=True)
            found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in counts], COUNTS)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), found], [*kept, at])

    return run


def count(docs: DataFrame, at: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of each row, and its counts as the fields of a new column ``at``."""
    keep = docs.columns if keep is None else keep
    kept = [f for f in docs.schema.fields if f.name in keep]
    counts = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([*kept, T.StructField(at, counts)])
    return small_batches(docs).select(*dict.fromkeys([*keep, text])).mapInArrow(_with_counts(text, [f.name for f in kept], at), schema)


def base_failed(at: str, min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    counts = F.col(at)
    return (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > max_repeat_percent * counts["n_words"])


def ratio(rule: str, at: str) -> Column:
    above, below, _ = RULES[rule]
    return F.col(at)[above] / F.greatest(F.col(at)[below], F.lit(1))


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed exactly from its terms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certify(n: int, rejected: list[int], share: float, level: float) -> int:
    """How many cutoffs of a grid are certified, from the lenient end; rejected: good texts that each discards."""
    for i, k in enumerate(rejected):
        # beyond the mean the test can't succeed; this also bounds the terms to sum
        if k >= share * n or at_most(k, n, share) > level:
            return i
    return len(rejected)


def least_labels(share: float, level: float) -> int:
    """The fewest good texts with which a cutoff that discards none of them is certified."""
    return math.ceil(math.log(level) / math.log1p(-share))


def _certified(n_strata: int, alpha: float, delta: float):
    level = delta / max(1, n_strata)
    share_of_rule, level_of_rule = alpha / len(RULES), level / len(RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {rule: [] for rule in RULES}
            for r in batch.to_pylist():
                each = r["n"] >= least_labels(share_of_rule, level_of_rule)
                together = 0 if each else certify(r["n"], r["together"], alpha, level)
                for rule, (_, _, grid) in RULES.items():
                    passed = certify(r["n"], r[rule], share_of_rule, level_of_rule) if each else together
                    found[rule].append(cutoff_at(rule, passed - 1) if passed else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in found.values())], ["stratum", *RULES])

    return run


def calibrate(counted: DataFrame, at: str, labels: DataFrame, doc_id: str = "doc_id", stratum: str = "lang", label: str = "quality", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, a cutoff or null for each rule) from the good labels among the counted rows that pass the base rules.

    Only strata with enough good labels for one certificate, were they the only one, are tested.
    """
    good = labels.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("good")).where("good = 1").select("id")
    rows = counted.where(~base_failed(at)).select(F.col(doc_id).alias("id"), F.col(stratum).alias("stratum"), *(ratio(r, at).alias(r) for r in RULES))
    tallies = [F.array(*(F.count_if(F.col(r) > c) for c in grid)).alias(r) for r, (_, _, grid) in RULES.items()]
    beyond = [reduce(or_, (F.col(r) > cutoff_at(r, i) for r in RULES)) for i in range(STEPS)]
    tallies.append(F.array(*(F.count_if(x) for x in beyond)).alias("together"))
    found = rows.join(good, "id").groupBy("stratum").agg(F.count("*").alias("n"), *tallies).where(F.col("n") >= least_labels(alpha, delta))
    found = materialise(found, "quality-tallies")
    kind = counted.schema[stratum].dataType.simpleString()
    return found.mapInArrow(_certified(found.count(), alpha, delta), ", ".join([f"stratum {kind}", *(f"{r} double" for r in RULES)]))


#: Strata whose cutoffs a broadcast holds at most (a few MB).
MAX_STRATA = 50_000


def with_verdict(counted: DataFrame, at: str, cutoffs: DataFrame, stratum: str, verdict: str) -> DataFrame:
    """``counted`` with a column ``verdict``: whether neither the base rules nor a certified cutoff rejects a row."""
    over = materialise(cutoffs.select(F.col("stratum").alias(f"{at}_of"), F.struct(*RULES).alias(f"{at}_cut")), "quality-cutoffs")
    joined = counted.join(broadcast_if_small(over, MAX_STRATA), F.col(stratum).eqNullSafe(F.col(f"{at}_of")), "left")
    hit = F.lit(False)
    for rule in RULES:
        hit = hit | F.coalesce(ratio(rule, at) > F.col(f"{at}_cut")[rule], F.lit(False))
    return joined.withColumn(verdict, ~base_failed(at) & ~hit).select(*counted.columns, verdict)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", **limits) -> DataFrame:
    """One row for each row of ``docs``: id, stratum, the counts, base_failed and kept."""
    at = fresh(docs, "counts")
    counted = materialise(count(docs, at, text, [doc_id, stratum]), "quality")
    judged = with_verdict(counted, at, calibrate(counted, at, labels, doc_id, stratum, **limits), stratum, f"{at}_kept")
    return judged.select(doc_id, *([stratum] if stratum != doc_id else []), *(F.col(at)[c].alias(c) for c in COUNTS), base_failed(at).alias("base_failed"), F.col(f"{at}_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", **limits) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep.

    Counts twice, once for the cutoffs and once beside the rows, so texts are never shuffled.
    """
    at = fresh(docs, "counts")
    cutoffs = calibrate(count(docs, at, text, [doc_id, stratum]), at, labels, doc_id, stratum, **limits)
    return with_verdict(count(docs, at, text), at, cutoffs, stratum, f"{at}_kept").where(f"`{at}_kept`").select(*docs.columns)
