"""Substring dedup by hashing passages of sentences.

Units are the sentences of each line: a word that ends in ``.``, ``!`` or ``?``, or the
line's end, ends a unit.  From each unit on, the shortest passage of whole units with
``min_words`` words is normalised (A-Z in lower case, one space between words, wherever
lines end) and hashed to 128 bits.  Of the passages with one digest the earliest stays,
by the order of ids, then of position; the units of the others go.  Each unit that goes
is part of a passage that stands earlier, so its first occurrence is never lost.  Offsets
of what goes are those of the original text.

Defined results: null texts have no units and stay null.  What repeats over fewer than
``min_words`` words stays, so texts of fewer words stay whole.  A passage that begins or
ends inside a unit is found from its first whole unit to its last.  A line of which no
unit is left goes with its line end; lines without a word stay.  Rows with one id and one
text are one document, so repeated rows lose the same units.  Rows without an id rank
last.  Other columns are ignored by ``find`` and kept by ``apply``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialise, slices, small_batches, texts

_SPACE = " \t\x0b\x0c\r"
#: The white space between two units of a line.
_GAP = rf"(?<=[.!?])[{_SPACE}]+(?=[^{_SPACE}])"
_GAP_TEXT, _GAP_BYTES = re.compile(_GAP), re.compile(_GAP.encode())
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def units_of(text: bytes) -> list[list[bytes]]:
    """The words of each unit, normalised."""
    return [words for line in text.lower().split(b"\n") for unit in _GAP_BYTES.split(line) if (words := unit.split())]


def passages(units: list[list[bytes]], min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(first unit, the one behind the last, digest) of the shortest passage from each unit on."""
    n, stop = 0, 0
    joined = [b" ".join(words) for words in units]
    for first, words in enumerate(units):
        while n < min_words and stop < len(units):
            n += len(units[stop])
            stop += 1
        if n < min_words:
            return
        yield first, stop, hashlib.blake2b(b" ".join(joined[first:stop]), digest_size=16).digest()
        n -= len(words)


def _passages(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, first, stop, digest = [], [], [], []
            for i, text in enumerate(texts(batch)):
                for a, b, d in passages(units_of(text), min_words):
                    row.append(i)
                    first.append(a)
                    stop.append(b)
                    digest.append(d)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int32()), pa.array(stop, pa.int32()), pa.array(digest, pa.binary())], ["id", "hash", "first", "stop", "digest"]
            )

    return run


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 25) -> DataFrame:
    """(id, hash, runs) of the documents that lose units; hash is xxhash64 of the text, runs (first, stop) are sorted and may overlap."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = small_batches(docs).where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    found = materialise(rows.mapInArrow(_passages(min_words), f"id {kind}, hash long, first int, stop int, digest binary"), "line-dedup-passages")
    place = F.struct(F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"), F.col("hash").alias("hash"), F.col("first").alias("first"))
    earliest = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("earliest")).where("n > 1")
    # written first: both sides of the join are then plain shuffles, of which Spark splits skewed ones
    earliest = materialise(earliest.select("digest", "earliest"), "line-dedup-earliest")
    gone = found.join(earliest, "digest").where(place != F.col("earliest"))
    return gone.groupBy("id", "hash").agg(F.array_sort(F.collect_set(F.struct("first", "stop"))).alias("runs"))


def cut(text: str, runs: list[dict]) -> tuple[str, list[dict]]:
    """The text without the units of the runs, and where these were."""
    gone = {k for r in runs for k in range(r["first"], r["stop"])}
    kept, spans, at, k = [], [], 0, 0
    for line in text.split("\n"):
        begin = len(line) - len(line.lstrip(_SPACE))
        edges = [begin, *(m.end() for m in _GAP_TEXT.finditer(line, begin)), len(line)] if begin < len(line) else []
        stay = []
        for a, b in zip(edges, edges[1:], strict=False):
            if k in gone:
                spans.append({"begin": at + a, "end": at + b})
            else:
                stay.append(line[a:b])
            k += 1
        if stay or not edges:
            kept.append(line[:begin] + "".join(stay))
        at += len(line) + 1
    return "\n".join(kept), spans


def apply(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str = "removed", min_words: int = 25) -> DataFrame:
    """``docs`` with all columns, the text without the units that go, and their original spans in ``removed``.

    A column of ``docs`` named like ``removed`` is replaced.
    """
    docs = docs.drop(removed)
    key, digest, runs = (fresh(docs, name) for name in ("id", "hash", "runs"))
    found = find(docs, doc_id, text, min_words).select(F.col("id").alias(key), F.col("hash").alias(digest), F.col("runs").alias(runs))
    joined = docs.join(found, F.col(doc_id).eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(digest)), "left").select(*docs.columns, runs)
    at, names = docs.columns.index(text), [*docs.columns, removed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            columns, found = list(batch.columns[:-1]), batch.column(batch.num_columns - 1).to_pylist()
            spans: list = [[]] * len(found)
            if any(found):
                bodies = columns[at].to_pylist()
                for i, r in enumerate(found):
                    if r:
                        bodies[i], spans[i] = cut(bodies[i], r)
                columns[at] = pa.array(bodies, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, _SPANS)], names)

    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(removed, T.ArrayType(span))]))
