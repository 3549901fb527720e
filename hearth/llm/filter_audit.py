"""Filter interaction audit: what each of five filters removes in every order, and what it shares with the others.

Texts are measured from the Arrow buffers themselves: a table of 256 byte classes, prefix sums
of the classes at the texts' offsets, and hashes of all words of a batch at once.  A text's
words are sorted by their hashes; neighbours with equal hashes are compared byte by byte, and a
text in which two words share a hash is counted by the words themselves.

A document then is a mask of the filters that it fails.  Masks are counted by part, and every
figure of the 120 orders follows from at most 32 counts of a part.

Defined results: a null text is empty and has no word; words are runs without ASCII white space,
case counts.  Filter E asks for a smaller id with the same text, so neither rows that share an
id nor rows without one fail it or cause it.  A document has a label if any of its id's rows has
it; one without an id has none.  A null part is the empty string.  Repeated rows count each.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, small_batches

FILTERS = "ABCDE"
#: Labels that a broadcast holds at most, and texts that occur more than once.
MAX_IDS = 500_000
#: Bytes of text whose classes and hashes are held at a time (more for a single longer word), and of words compared.
BLOCK_BYTES = 1 << 20

_SPACE, _CAPITAL, _SYMBOL, _LEAD = 1, 2, 4, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _classes(symbols: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] |= _SPACE
    table[0x41:0x5B] |= _CAPITAL
    table[list(symbols)] |= _SYMBOL
    table[[b for b in range(256) if b & 0xC0 != 0x80]] |= _LEAD  # the first byte of a code point
    return table


class Meter:
    """Measures the texts of Arrow arrays."""

    def __init__(self, symbols: bytes = b"#$%&*|"):
        self.table = _classes(symbols)
        self.codes = _mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
        self.powers = np.ones(1, dtype=np.uint64)

    def _power(self, n: int) -> np.ndarray:
        """The first ``n`` powers of an odd number modulo 2^64."""
        if len(self.powers) < n:
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 64) - 1, _STEP, dtype=np.uint64))])
        return self.powers[:n]

    def _words(self, data: np.ndarray, klass: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, hash) of the words of one block; ``starts`` are the places where a text begins."""
        inside = (klass & _SPACE) == 0
        first = np.zeros(len(data) + 1, dtype=bool)
        first[starts] = True
        first[-1] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | first[1:-1]
        b, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if not len(b):
            return b, e, np.zeros(0, dtype=np.uint64)
        size = e - b
        within = np.arange(len(data)) - np.repeat(b, np.diff(np.append(b, len(data)))) if b[0] == 0 else np.arange(len(data)) - np.concatenate([np.arange(b[0]), np.repeat(b, np.diff(np.append(b, len(data))))])
        within[~inside] = 0
        terms = np.where(inside, self.codes[data] * self._power(int(size.max()))[within], np.uint64(0))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
        return b, e, _mix((sums[e] - sums[b]) * _STEP + size.astype(np.uint64))

    def _distinct(self, data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, distinct words) of each text from all words' places and hashes."""
        n = len(offsets) - 1
        doc = np.searchsorted(offsets, begin, side="right") - 1
        words = np.bincount(doc, minlength=n)
        order = np.lexsort((value, doc))
        a, b = order[:-1], order[1:]
        same = (doc[a] == doc[b]) & (value[a] == value[b])
        a, b = a[same], b[same]
        wrong = (end[a] - begin[a]) != (end[b] - begin[b])
        wrong[~wrong] = self._unequal(data, begin[a[~wrong]], begin[b[~wrong]], (end - begin)[a[~wrong]])
        distinct = words - np.bincount(doc[b], minlength=n)
        for i in np.unique(doc[b[wrong]]).tolist():  # two words of the text share a hash
            distinct[i] = len(set(data[offsets[i] : offsets[i + 1]].tobytes().split()))
        return words, distinct

    @staticmethod
    def _unequal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes at ``a`` and ``b`` differ, ``size`` of each pair, which isn't 0."""
        out = np.zeros(len(a), dtype=bool)
        upto = np.cumsum(size)
        at = 0
        while at < len(a):
            before = int(upto[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, before + BLOCK_BYTES, side="right")))
            n = size[at:stop]
            firsts = np.concatenate([[0], np.cumsum(n)[:-1]])
            step = np.arange(int(n.sum())) - np.repeat(firsts, n)
            differs = data[np.repeat(a[at:stop], n) + step] != data[np.repeat(b[at:stop], n) + step]
            out[at:stop] = np.logical_or.reduceat(differs, firsts)
            at = stop
        return out

    def measure(self, column: pa.Array) -> dict[str, np.ndarray]:
        """n_words, n_distinct, n_capitals, n_symbols, n_chars of each text of a large_binary array without nulls."""
        _, at, held = column.buffers()
        offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        counts = {c: np.zeros(len(column), dtype=np.int64) for c in ("n_capitals", "n_symbols", "n_chars")}
        found: list[tuple] = []
        lo = 0
        while lo < len(data):
            klass = self.table[data[lo : lo + 2 * BLOCK_BYTES]]
            hi = self._cut(data, klass, lo)
            klass = klass[: hi - lo] if hi - lo <= len(klass) else self.table[data[lo:hi]]
            near = np.clip(offsets, lo, hi) - lo
            for name, flag in (("n_capitals", _CAPITAL), ("n_symbols", _SYMBOL), ("n_chars", _LEAD)):
                upto = np.concatenate([[0], np.cumsum((klass & flag) != 0)])
                counts[name] += np.diff(upto[near])
            inner = offsets[(offsets > lo) & (offsets < hi)] - lo
            b, e, value = self._words(data[lo:hi], klass, inner)
            found.append((b + lo, e + lo, value))
            lo = hi
        begin, end, value = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
        counts["n_words"], counts["n_distinct"] = self._distinct(data, offsets, begin, end, value)
        return counts

    @staticmethod
    def _cut(data: np.ndarray, klass: np.ndarray, lo: int) -> int:
        """Where the block from ``lo`` ends: behind white space, so that no word is cut."""
        if len(data) - lo <= BLOCK_BYTES:
            return len(data)
        spaces = np.flatnonzero(klass[BLOCK_BYTES - 1 :] & _SPACE)
        if len(spaces):
            return lo + BLOCK_BYTES + int(spaces[0])
        at = lo + len(klass)
        while at < len(data):
            spaces = np.flatnonzero(np.isin(data[at : at + BLOCK_BYTES], [0x20, *range(0x09, 0x0E)]))
            if len(spaces):
                return at + int(spaces[0]) + 1
            at += BLOCK_BYTES
        return len(data)


MEASURES = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars")


def _measure(symbols: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(symbols)
        for batch in batches:
            column = pa.compute.fill_null(batch.column(2).cast(pa.large_binary()), b"")
            found = meter.measure(column)
            digests = [hashlib.blake2b(x.as_buffer(), digest_size=16).digest() for x in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[c], pa.int64()) for c in MEASURES), pa.array(digests, pa.binary())], ["id", "part", *MEASURES, "digest"])

    return run


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", symbols: str = "#$%&*|") -> DataFrame:
    """(id, part, the five measures, digest) of each row; a 128-bit digest of the text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    found = ", ".join(f"{c} long" for c in MEASURES)
    return small_batches(rows).mapInArrow(_measure(symbols.encode("ascii")), f"id {kind}, part string, {found}, digest binary")


def failures(min_words: int = 50, distinct_percent: int = 65, capitals_percent: int = 5) -> list[Column]:
    """The conditions of the filters A to D on the measures."""
    return [
        F.col("n_words") < min_words,
        100 * F.col("n_distinct") < distinct_percent * F.col("n_words"),
        100 * F.col("n_capitals") > capitals_percent * F.col("n_chars"),
        F.col("n_symbols") > 0,
    ]


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", **limits: int) -> DataFrame:
    """(id, part, the measures, mask) of each row; bit k of the mask is set if it fails filter k of ``FILTERS``."""
    measured = materialise(measure(docs, doc_id, text, part), "audit-measures")
    # written first: both sides of the join are plain shuffles, of which Spark splits a text with very many copies
    first = materialise(measured.where("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first"), "audit-copies")
    rows = measured.join(broadcast_if_small(first, MAX_IDS), "digest", "left")
    fails = [*failures(**limits), F.coalesce(F.col("id") > F.col("first"), F.lit(False))]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("id", "part", *MEASURES, mask.alias("mask"))


def labelled(judged: DataFrame, labels: DataFrame, label_id: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``judged`` with the columns good and toxic."""
    flags = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in ((good, "good"), (toxic, "toxic"))))
    flags = materialise(flags.where("good or toxic"), "audit-labels")
    rows = judged.join(broadcast_if_small(flags, MAX_IDS), "id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def counted(judged: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows a part."""
    return judged.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def steps() -> list[tuple[str, int, int, int, int, int]]:
    """(filter_order, step, mask, met, removed, share) of every order, step and mask: 19,200 rows.

    met: whether an earlier filter has removed the mask's documents; share: how many of the
    orders let the step's filter remove them.
    """
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            for mask in range(1 << len(FILTERS)):
                fails, met = mask >> f & 1, bool(mask & before)
                # each of the filters that a document fails comes first in as many orders
                share = 120 // mask.bit_count() if fails else 0
                out.append(("".join(FILTERS[i] for i in order), k + 1, mask, int(met), fails, share))
            before |= 1 << f
    return out


def report(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step from ``counted``."""
    table = counts.sparkSession.createDataFrame(steps(), "filter_order string, step int, mask int, met int, fails int, share long")
    rows = counts.join(F.broadcast(table), "mask")
    of = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0)).cast("long")
    met, fails, own = F.col("met") == 1, F.col("fails") == 1, F.col("mask").isin(*(1 << k for k in range(len(FILTERS))))
    return rows.groupBy("part", "filter_order", "step").agg(
        of("n", ~met & ~fails).alias("kept"), of("n", ~met & fails).alias("removed"), of("n", met & fails).alias("redundant"), of("n", fails & own).alias("unique_fails"),
        of("good", ~met & fails).alias("good_lost"), of("toxic", ~met & fails).alias("toxic_lost"), F.sum(F.col("n") * F.col("share")).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns: str | int) -> DataFrame:
    """The report on ``docs``: every part, all 120 orders, five steps each."""
    return report(counted(labelled(judge(docs, **columns), labels)))
