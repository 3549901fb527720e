"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised alike: A-Z in lower case, words are runs of digits, a-z and
characters beyond ASCII, one space between words.  Every window of ``window`` words of
an item is a pattern (a shorter item is one pattern); the automaton finds all of them in
one scan of a text.  Word positions lead back to code points of the original.

Defined results: null and empty texts have no words, no hits and aren't contaminated;
items without a word or without an id have no pattern.  Repeated items and windows count
once, repeated documents each get a row.  Columns beyond id and text are ignored by
``scan`` and kept by ``remove_contaminated``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, share, slices, small_batches, texts

#: Bytes outside words become spaces, A-Z become a-z.
_NORMAL = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if len(words) <= window:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


class Scanner:
    """The automaton of some items; each worker builds it from their texts once, the driver never does."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.items, self.window = items, window
        self.patterns: list[tuple[bytes, ...]] | None = None

    def _build(self) -> None:
        self.owners: dict[tuple[bytes, ...], list[str]] = {}
        for item, text in self.items:
            for words in windows_of(words_of(text), self.window):
                owners = self.owners.setdefault(words, [])
                if item not in owners:
                    owners.append(item)
        self.patterns = list(self.owners)
        self.automaton = ahocorasick.Automaton()
        for k, words in enumerate(self.patterns):
            self.automaton.add_word(f" {b' '.join(words).decode('latin-1')} ", k)
        self.automaton.make_automaton()

    def __getstate__(self):
        return self.items, self.window

    def __setstate__(self, state):
        self.__init__(*state)

    def scan(self, text: bytes) -> tuple[int, list[int], list[str]]:
        """The number of words, the positions of the hit ones, the items found."""
        words = words_of(text)
        if self.patterns is None:
            self._build()
        if not words or not self.patterns:
            return len(words), [], []
        # each byte a character: the scan needs no decoding, and patterns are made alike
        found = list(self.automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not found:
            return len(words), [], []
        last = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        at = np.searchsorted(last, np.array([end for end, _ in found]))
        hit = np.zeros(len(words) + 1, dtype=np.int64)
        sizes = np.array([len(self.patterns[k]) for _, k in found])
        np.add.at(hit, at - sizes + 1, 1)
        np.add.at(hit, at + 1, -1)
        items = {x for k in {k for _, k in found} for x in self.owners[self.patterns[k]]}
        return len(words), np.flatnonzero(np.cumsum(hit[:-1])).tolist(), sorted(items)


def runs_of(text: str, hit: list[int]) -> list[dict]:
    """Runs of hit words: the first and the last word, and the code points of the original text that they cover."""
    wanted, runs = set(hit), []
    for k, m in enumerate(_WORD.finditer(text)):
        if k in wanted:
            if runs and runs[-1]["last"] == k - 1:
                runs[-1] |= {"last": k, "end": m.end()}
            else:
                runs.append({"first": k, "last": k, "begin": m.start(), "end": m.end()})
    return runs


def joined(runs: list[dict]) -> list[dict]:
    """Runs that overlap or follow each other word by word become one."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: (r["first"], r["last"])):
        if out and r["first"] <= out[-1]["last"] + 1:
            if r["last"] > out[-1]["last"]:
                out[-1] |= {"last": r["last"], "end": r["end"]}
        else:
            out.append(dict(r))
    return out


def scanners(benchmark: DataFrame, item_id: str, text: str, window: int, max_bytes: int) -> tuple[int, Iterator[Scanner]]:
    """How many automata there are, and they one by one: several for a benchmark of more than ``max_bytes`` of text.

    An automaton takes some 60 bytes for each byte of its patterns, and each byte of an
    item is in ``window`` of them; so ``max_bytes`` bounds what a task holds.  The driver
    holds the texts of one block.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // max_bytes))
    if blocks > 1:
        items = items.distinct()

    def each() -> Iterator[Scanner]:
        for k in range(blocks):
            block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
            yield Scanner([(r["item"], r["text"].encode()) for r in block.toLocalIterator()], window)

    return blocks, each()


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_bytes: int = 1 << 20) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, items (sorted), spans (begin, end), contaminated."""
    blocks, automata = scanners(benchmark, item_id, item_text, window, max_bytes)
    docs = small_batches(docs)
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"row long, id {kind}, n_words long, items array<string>, runs array<struct<first:long,last:long,begin:long,end:long>>"
    if blocks == 1:
        found = rows.mapInArrow(_scan(share(sc, next(automata))), schema)
    else:
        rows = materialise(rows, "decontaminate")  # the parts are put together by row, so numbers must be the same each time
        parts = []
        for k, a in enumerate(automata):  # written one by one: one automaton at a time in a worker's memory
            shared = share(sc, a)
            part = rows.mapInArrow(_scan(shared), schema)
            # the first block tells of every row, the others only of rows that they hit
            parts.append(materialise(part if k == 0 else part.where(F.size("items") > 0), "decontaminate-part"))
            shared.destroy()
        found = functools.reduce(DataFrame.unionByName, parts)
        found = found.groupBy("row").agg(
            F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs")
        )
        found = found.mapInArrow(_join, schema)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    spans = F.transform("runs", lambda r: F.struct(r["begin"].alias("begin"), r["end"].alias("end")))
    return found.select(F.col("id").alias(doc_id), "n_words", n_hit.alias("n_hit"), "items", spans.alias("spans"), (F.size("runs") > 0).alias("contaminated"))


_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("first", "last", "begin", "end")]))


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in slices(batches):
            out = []
            for text in texts(batch):
                n, hit, items = scanner.scan(text)
                out.append((n, items, runs_of(text.decode(), hit) if hit else []))
            n, items, runs = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, _RUNS)], ["row", "id", "n_words", "items", "runs"]
            )

    return run


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("runs")
        yield batch.set_column(at, "runs", pa.array([joined(runs) for runs in batch.column(at).to_pylist()], _RUNS))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_bytes: int = 1 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window occurs."""
    blocks, automata = scanners(benchmark, item_id, item_text, window, max_bytes)
    docs = small_batches(docs)
    for k, a in enumerate(automata):
        shared = share(docs.sparkSession.sparkContext, a)
        docs = docs.mapInArrow(_clean(shared, text), docs.schema)
        if k < blocks - 1:  # one automaton at a time in a worker's memory
            docs = materialise(docs, "decontaminate")
            shared.destroy()
    return docs


def _clean(shared, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in slices(batches, column):
            yield batch.filter(pa.array([not scanner.scan(x)[1] for x in texts(batch, column)], pa.bool_()))

    return run
