"""Near-duplicates by SimHash: fingerprints that differ in few bits, found by deletion variants.

A fingerprint's bit is 1 if it is set in over half of the hashes of a text's word shingles,
repeats included.  Two fingerprints that differ in at most ``max_bits`` bits are linked; linked
documents form components.

Cut into ``max_bits // 2 + 1`` segments, one segment of two such fingerprints differs by at most
one bit.  So each distinct fingerprint is indexed by every segment with one bit taken out (64
rows in all); two that agree there meet in an equality join, which verifies them and takes each
pair in one place only.  Documents with one fingerprint are one node from the start.

A key that more than ``dense`` fingerprints share isn't compared pair by pair.  Its fingerprints
are indexed by all 64 bits with ``max_bits`` taken out: those that agree there, at most
2 ** max_bits, are all linked.  That is as exact, and grows with their number, not its square;
``dense`` is where both cost the same.

Defined results: words are runs without ASCII white space, A-Z in lower case.  A text of fewer
words than a shingle is one shingle; one without words, or null, has fingerprint zero and is
linked like any other.  Each row is judged by its own text, rows that share an id too.  Rows
without an id have a fingerprint, link nothing and have no component.  Ids may be of any kind
that has an order.  Other columns are ignored by ``find`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, materialise, slices, small_batches, texts
from .components import connected_components
from .near_dup import MAX_IDS

SEED = 42
#: Bytes of a text whose words are held at a time.
BLOCK_BYTES = 1 << 20
#: Hashes whose bits are summed in bytes before they are widened.
_LANE = 63
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _blocks(text: bytes) -> Iterator[bytes]:
    """The text cut behind white space into blocks of about ``BLOCK_BYTES``."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + BLOCK_BYTES) if len(text) - at > BLOCK_BYTES else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def hashes_of(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle, in their order."""
    out, tail = [], []
    digest = xxhash.xxh64_intdigest
    for block in _blocks(text):
        words = tail + block.lower().split()
        if len(words) >= size:
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ends = np.cumsum(lengths + 1) - 1
            begins, stops = (ends - lengths).tolist(), ends[size - 1 :].tolist()
            out.append(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=False)), dtype=np.uint64, count=len(stops)))
            tail = words[len(words) - size + 1 :]
        else:
            tail = words
    if not out and tail:
        out.append(np.array([digest(b" ".join(tail), SEED)], dtype=np.uint64))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def fingerprints(found: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each array of hashes; zero for an empty one.

    Bits are summed eight at a time in the bytes of 64-bit numbers, ``_LANE`` hashes a row.
    """
    out = np.zeros(len(found), dtype=np.uint64)
    full = [i for i, h in enumerate(found) if len(h)]
    if not full:
        return out
    sizes = np.array([len(found[i]) for i in full])
    rows = -(-sizes // _LANE)
    firsts = np.concatenate([[0], np.cumsum(rows)[:-1]])
    grid = np.zeros((int(rows.sum()), _LANE), dtype=np.uint64)
    flat = grid.reshape(-1)
    for i, at in zip(full, (firsts * _LANE).tolist(), strict=True):
        flat[at : at + len(found[i])] = found[i]
    ones = np.uint64(0x0101010101010101)
    for k in range(8):
        lanes = ((grid >> np.uint64(k)) & ones).sum(axis=1, dtype=np.uint64)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), firsts, axis=0)
        for j in range(8):
            out[full] |= (2 * counts[:, j] > sizes).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def _fingerprint(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=BLOCK_BYTES):
            found = fingerprints([hashes_of(x, size) for x in texts(batch)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return run


def sign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) of each row; the fingerprint as a signed 64-bit number."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return small_batches(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))).mapInArrow(_fingerprint(size), f"id {kind}, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of the segments; two at least, so that a key has room for its place."""
    n = max(2, max_bits // 2 + 1)
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _cut(value: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << bits) - 1))


def variants(fp: Column, max_bits: int) -> Column:
    """64 keys: for each bit, its segment without it, below the bit's number."""
    keys = []
    for first, bits in segments(max_bits):
        part = _cut(fp, first, bits)
        keys += [F.shiftleft(F.lit(first + i).cast("long"), 58).bitwiseOR(part.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << i)))) for i in range(bits)]
    return F.array(*keys)


def _first_place(x: Column, key: Column, max_bits: int) -> Column:
    """Whether a pair whose fingerprints XOR to ``x`` and that meets at ``key`` is taken there.

    That is in the first segment that differs by at most one bit: at that bit, or at its
    first one if nothing differs.
    """
    place = F.shiftrightunsigned(key, 58)
    out, earlier = F.lit(False), F.lit(True)
    for first, bits in segments(max_bits):
        part = _cut(x, first, bits)
        here = (place >= first) & (place < first + bits)
        out = out | (here & earlier & ((part != 0) | (place == first)))
        earlier = earlier & (F.bit_count(part) > 1)
    return out


def pairs(index: DataFrame, max_bits: int) -> DataFrame:
    """Linked pairs (u, v) of fingerprints from (key, fp), each once."""
    left, right = index.select("key", F.col("fp").alias("u")), index.select("key", F.col("fp").alias("v"))
    x = F.col("u").bitwiseXOR(F.col("v"))
    linked = (F.col("u") < F.col("v")) & (F.bit_count(x) <= max_bits)
    return left.join(right, "key").where(linked & _first_place(x, F.col("key"), max_bits)).select("u", "v")


def dense_links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Links (u, v) that connect all of ``nodes`` (fp) at most ``max_bits`` bits apart, through the least of those that agree without some ``max_bits`` bits."""
    rows = nodes.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("mask"), F.lit(0).alias("next"))
    for k in range(max_bits):
        rows = rows.select("fp", "rest", "mask", F.explode(F.sequence(F.col("next"), F.lit(64 - max_bits + k))).alias("bit"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
        rows = rows.select("fp", F.col("rest").bitwiseAND(F.bitwise_not(one)).alias("rest"), F.col("mask").bitwiseOR(one).alias("mask"), (F.col("bit") + 1).alias("next"))
    groups = rows.groupBy("mask", "rest").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)  # 2 ** max_bits at most
    return groups.select(F.array_min("members").alias("u"), F.explode("members").alias("v")).where("u <> v").distinct()


def links(nodes: DataFrame, max_bits: int = 2, dense: int | None = None) -> DataFrame:
    """Links (u, v) between the distinct fingerprints of ``nodes`` (fp) that connect all that are at most ``max_bits`` bits apart."""
    dense = dense or 2 * math.comb(64, max_bits)
    index = nodes.select("fp", F.explode(variants(F.col("fp"), max_bits)).alias("key"))
    shared = materialise(index.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "simhash-keys")
    # always merged, so that the plan is the same at every size and Spark can split a key that very many share
    index = materialise(index.join(shared.hint("merge"), "key").select("key", "fp", (F.col("members") > dense).alias("many")), "simhash-index")
    found = pairs(index.where("not many"), max_bits)
    crowd = materialise(index.where("many").select("fp").distinct(), "simhash-dense")
    if crowd.take(1):
        found = found.unionByName(dense_links(crowd, max_bits))
    return materialise(found, "simhash-links")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, max_bits: int = 2, dense: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: its id, fp (signed), component_id (the least id reachable)."""
    signed = materialise(sign(docs, doc_id, text, size), "simhash-signed")
    nodes = materialise(signed.where("id is not null").groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    component = connected_components(links(nodes.select("fp"), max_bits, dense))
    of = nodes.join(component.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    of = materialise(of, "simhash-components")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("size")).where("size > 1")
    # written first, so that Spark can split a fingerprint that very many rows share
    shared = materialise(of.join(least, "component").select("fp", "component_id"), "simhash-shared")
    found = signed.join(broadcast_if_small(shared, MAX_IDS), "fp", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return found.select(F.col("id").alias(doc_id), "fp", own.alias("component_id"))


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id is the least of a component, and those without an id; rows that share an id stay together."""
    found = find(docs, doc_id, text, size, max_bits)
    key = fresh(docs, "first")
    first = materialise(found.where(F.col(doc_id) == F.col("component_id")).select(F.col(doc_id).alias(key)).distinct(), "simhash-first")
    kept = docs.join(first, F.col(doc_id) == F.col(key), "left_semi")
    return kept.unionByName(docs.where(F.col(doc_id).isNull())).select(*docs.columns)
