"""Near-duplicate documents by MinHash.

Each document's set of word shingles gives ``bands * rows`` minima of universal hash
functions.  Documents that agree on a band are candidates; their signatures, then their
full sets confirm a link; linked documents form components.

Documents with equal sets are joined first and only one of them goes on.  In a bucket
every member is compared with one centre, the document that shares most buckets with
others.  Then members outside a bucket's main component are compared with all members of
other components, inside the join and by sketches, one of which is exact from one side:
the XOR of two sets' parity bits has no more ones than their symmetric difference has
members.  Only pairs that may be links leave the join, each from the first band that it
shares; pairs inside a component are never compared, and no link between components is
lost.

A pair of similarity s agrees on no band with probability (1 - s^rows)^bands: 3e-6 for
0.8 with 32 bands of 5 rows.

Defined results: words are runs without ASCII white space, A-Z in lower case.  A text of
fewer words than a shingle is one shingle; one without words has an empty set and is
linked with nothing.  Rows that share an id are one document, of which the greatest text
counts; ids may be of any kind that has an order.  Rows without an id are linked with
nothing and kept.  Other columns are ignored
by ``find`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import with_ids
from .common import broadcast_if_small, materialise, slices, small_batches, texts
from .components import connected_components

#: Words with their hashes, and shingles of texts that come again, that a task holds (a longer text is held alone).
CACHE_WORDS, CACHE_SHINGLES = 200_000, 100_000
#: Ids that a broadcast holds at most (8 MB of keys).
MAX_IDS = 500_000
#: Parity bits of a set: each tells whether an odd number of its shingles falls on it.
PARITY_BITS = 2048
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingles_of(text: bytes, size: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


class Signer:
    """Shingle sets as 64-bit hashes, and their minima under universal hash functions."""

    def __init__(self, size: int, bands: int, rows: int):
        self.size, self.bands, self.rows = size, bands, rows
        seeds = _mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * _STEP)
        # x -> a x + b modulo 2^64, with odd a
        self.a, self.b = seeds[: bands * rows] | np.uint64(1), seeds[bands * rows :]
        self.hashes = _Hashes()

    def hashed(self, text: bytes) -> np.ndarray:
        """The distinct shingles of one text, sorted."""
        words = words_of(text)
        h = np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(self.size, len(words))
        if not size:
            return h
        out = h[: len(h) - size + 1].copy()
        for j in range(1, size):
            out = _mix(out) * _STEP + h[j : len(h) - size + 1 + j]
        return np.unique(_mix(out + np.uint64(size)))

    def parity(self, found: np.ndarray) -> np.ndarray:
        """``PARITY_BITS`` bits as longs; those of two sets XOR to those of their symmetric difference."""
        at = (_mix(found ^ _STEP) % np.uint64(PARITY_BITS)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=PARITY_BITS) & 1).astype(np.uint8)).view(np.int64)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of minima for each of the sets, none of them empty."""
        x = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((self.bands * self.rows, len(sets)), dtype=np.uint64)
        y = np.empty_like(x)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            np.multiply(x, a, out=y)
            np.add(y, b, out=y)
            np.minimum.reduceat(y, starts, out=out[i])
        return np.ascontiguousarray(out.T)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band."""
        parts = minima.reshape(len(minima), self.bands, self.rows)
        out = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) * _STEP, parts.shape[:2])
        for j in range(self.rows):
            out = _mix(out * _STEP + parts[:, :, j])
        return out.view(np.int64)


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(size, bands, rows)
        for batch in slices(batches):
            sets = [signer.hashed(x) for x in texts(batch)]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            keys: list = [None] * len(sets)
            signatures: list = [None] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            begin = 0
            while begin < len(full):  # about 64 thousand shingles at a time stay in the processor's cache
                end, total = begin, 0
                while end < len(full) and (end == begin or total + len(sets[full[end]]) <= 65_536):
                    total += len(sets[full[end]])
                    end += 1
                minima = signer.minima([sets[i] for i in full[begin:end]])
                # eight mixed bits of each minimum: two that differ agree once in 256 times
                short = np.ascontiguousarray((_mix(minima) >> np.uint64(56)).astype(np.uint8))
                for i, k, s in zip(full[begin:end], signer.keys(minima), short.view(np.int64), strict=True):
                    keys[i], signatures[i] = k, s
                begin = end
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.list_(pa.int64())), pa.array([signer.parity(s) if len(s) else None for s in sets], pa.list_(pa.int64()))], ["id", "n", "digest", "keys", "signature", "parity"]
            )

    return run


def sign(docs: DataFrame, doc_id: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """(id, n, digest, keys, signature, parity) of each row; the last three are null for an empty set."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(_sign(size, bands, rows), f"id {kind}, n long, digest binary, keys array<long>, signature array<long>, parity array<long>")


def places_apart(a: Column, b: Column, words: int) -> Column:
    """In how many of 8 * ``words`` places two signatures differ: bytes of their XORs that aren't 0."""
    low = F.lit(0x0101010101010101)
    total = F.lit(0)
    for i in range(words):
        x = a[i].bitwiseXOR(b[i])
        for step in (4, 2, 1):  # each byte's lowest bit becomes 1 if any of its bits is
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        total = total + F.bit_count(x.bitwiseAND(low))
    return total


def bits_apart(a: Column, b: Column) -> Column:
    """A lower bound of the size of the symmetric difference of two sets, from their parity bits."""
    total = F.lit(0)
    for i in range(PARITY_BITS // 64):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


def _similar(size: int, percent: int):
    """Keeps pairs whose full shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set] = {}  # the centre of a star comes many times
        held = 0

        def of(node: int, text: bytes) -> set:
            nonlocal held
            if node not in known:
                found = shingles_of(text, size)
                if held + len(found) > CACHE_SHINGLES:
                    known.clear()
                    held = 0
                known[node] = found
                held += len(found)
            return known[node]

        for batch in slices(batches, "text_u", 1 << 20):
            keep = []
            for u, a, b in zip(batch.column(0).to_pylist(), texts(batch, "text_u"), texts(batch, "text_v"), strict=True):
                x, y = of(u, a), shingles_of(b, size)
                both = len(x & y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


class Finder:
    """One run over one set of documents with distinct ids."""

    def __init__(self, docs: DataFrame, size: int, percent: int, bands: int, rows: int):
        self.docs, self.size, self.percent = docs, size, percent
        places, s = bands * rows, percent / 100
        if places % 8:
            raise ValueError("bands * rows must be a multiple of 8")
        self.words = places // 8
        # 5.5 standard deviations beyond what documents of just that similarity expect
        self.most_apart = min(places - 1, math.ceil(places * (1 - s) + 5.5 * math.sqrt(places * s * (1 - s))))
        self.signed = materialise(sign(docs, "id", "text", size, bands, rows), "near-dup-signed")

    def may_link(self, nu: str, nv: str, pu: str, pv: str, su: str, sv: str) -> Column:
        """Lengths and parity bits that don't rule a link out, and signatures that agree.

        Of two sets with similarity s or more, the symmetric difference has at most
        (1 - s) / (1 + s) of the sum of their sizes.
        """
        sized = 100 * F.least(nu, nv) >= self.percent * F.greatest(nu, nv)
        near = (100 + self.percent) * bits_apart(F.col(pu), F.col(pv)) <= (100 - self.percent) * (F.col(nu) + F.col(nv))
        return sized & near & (places_apart(F.col(su), F.col(sv), self.words) <= self.most_apart)

    def stars(self, members: DataFrame) -> DataFrame:
        """Distinct pairs (u, v) of a bucket's centre and its other members that may be linked."""
        centres = materialise(members.groupBy("key").agg(F.min("rank").alias("c")).select("key", F.col("c.id").alias("centre")), "near-dup-centres")
        pairs = members.join(centres, "key").where("id <> centre").select(F.col("centre").alias("u"), F.col("id").alias("v")).distinct()
        for x in "uv":
            pairs = pairs.join(self.signed.where("id is not null").select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "parity", "signature"))), x)
        return pairs.where(self.may_link("n_u", "n_v", "parity_u", "parity_v", "signature_u", "signature_v")).select("u", "v")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (u, v) whose full sets are similar."""
        pairs = materialise(pairs, "near-dup-alike")
        nodes = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
        nodes = materialise(nodes, "near-dup-nodes")
        full = self.docs.join(broadcast_if_small(nodes, MAX_IDS), "id", "left_semi")
        pairs = pairs.join(full.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u")
        pairs = pairs.join(full.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v")
        return materialise(pairs.select("u", "v", "text_u", "text_v").mapInArrow(_similar(self.size, self.percent), "u long, v long"), "near-dup-links")

    def buckets(self, groups: DataFrame) -> DataFrame:
        """(key, band, members, id, rank) of the buckets with two members or more; rank orders documents alike in all of them."""
        nodes = self.signed.join(groups.select("digest", F.col("node").alias("id")), ["digest", "id"], "left_semi")
        rows = nodes.select("id", F.posexplode("keys").alias("band", "key"))
        # written first: both sides of the joins are then plain shuffles, of which Spark splits skewed ones
        shared = materialise(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "near-dup-buckets")
        members = materialise(rows.join(shared, "key"), "near-dup-members")
        degree = materialise(members.groupBy("id").agg(F.sum("members").alias("degree")), "near-dup-degrees")
        ranked = members.join(degree, "id").select("key", "band", "members", "id", F.struct((-F.col("degree")).alias("d"), F.xxhash64("id").alias("h"), F.col("id").alias("id")).alias("rank"))
        return materialise(ranked, "near-dup-ranked")

    def still_open(self, members: DataFrame, component: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, with theirs and the bucket's most frequent one (main)."""
        labelled = members.where("members > 2").join(component.withColumnRenamed("node", "id"), "id", "left")
        labelled = materialise(labelled.select("key", "band", "id", "rank", F.coalesce("component", "id").alias("component")), "near-dup-labelled")
        sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
        mixed = sizes.groupBy("key").agg(F.count("*").alias("components"), F.max(F.struct("n", "component")).alias("m")).where("components > 1")
        mixed = materialise(mixed.select("key", F.col("m.component").alias("main")), "near-dup-mixed")
        return materialise(labelled.join(mixed, "key"), "near-dup-open")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(digest, node) of the groups of equal sets, and (node, component) of the linked nodes."""
        groups = materialise(self.signed.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("node")), "near-dup-groups")
        members = self.buckets(groups)
        links = self.confirm(self.stars(members))
        component = connected_components(links)
        more = self.confirm(self.across(self.still_open(members, component)))
        if more.take(1):
            component = connected_components(links.unionByName(more))
        return groups, component

    def across(self, rest: DataFrame) -> DataFrame:
        """Distinct pairs (u, v) of a bucket from different components that may be linked, each from the first band that it shares."""
        known = self.signed.where("id is not null").select("id", "n", "parity", "signature", "keys")
        # keys hold their band, so equal ones are of equal bands; those of earlier bands tell whether a pair came before
        full = rest.join(known, "id").select("key", "id", "component", "main", "n", "parity", "signature", F.slice("keys", F.lit(1), F.col("band")).alias("before"))
        full = materialise(full, "near-dup-rest")
        left, right = (full.select("key", *(F.col(c).alias(f"{c}_{x}") for c in full.columns if c != "key")) for x in "uv")
        left, right = left.where("component_u <> main_u"), right.withColumnRenamed("key", "k")
        apart = (F.col("component_u") != F.col("component_v")) & ((F.col("component_v") == F.col("main_v")) | (F.col("id_u") < F.col("id_v")))
        alike = self.may_link("n_u", "n_v", "parity_u", "parity_v", "signature_u", "signature_v")
        pairs = left.join(right, (F.col("key") == F.col("k")) & apart & alike & ~F.arrays_overlap("before_u", "before_v"))
        return pairs.select(F.least("id_u", "id_v").alias("u"), F.greatest("id_u", "id_v").alias("v")).distinct()


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row for each row of ``docs``: its id, n_shingles, component_id (the least id of its component), kept."""
    kind = docs.schema[doc_id].dataType
    if isinstance(kind, T.IntegralType):
        found = _find(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), size, percent, bands, rows)
        return found.select(F.col("id").cast(kind).alias(doc_id), "n_shingles", F.col("component_id").cast(kind).alias("component_id"), "kept")
    # ids of any other kind: their places in their own order, so that the least one is the least place
    names = docs.select(F.col(doc_id).alias("name")).where("name is not null").distinct()
    names = materialise(with_ids(names, 0, [F.asc("name")]).select("name", F.col("id").cast("long").alias("id")), "near-dup-names")
    placed = materialise(docs.select(F.col(doc_id).alias("name"), F.col(text).alias("text")).join(names, "name", "left").select("id", "text"), "near-dup-placed")
    found = _find(placed, size, percent, bands, rows)
    own, first = (names.select(F.col("id").alias(c), F.col("name").alias(f"name_{c}")) for c in ("id", "component_id"))
    found = found.join(own, "id", "left").join(first, "component_id", "left")
    return found.select(F.col("name_id").alias(doc_id), "n_shingles", F.col("name_component_id").alias("component_id"), "kept")


def _find(docs: DataFrame, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``find`` for (id, text) with ids that are longs."""
    plain = small_batches(docs)
    repeated = bool(plain.groupBy("id").count().where("id is not null and count > 1").take(1))
    one = plain
    if repeated:
        one = plain.where("id is not null").groupBy("id").agg(F.max("text").alias("text"))
        one = materialise(one.unionByName(plain.where("id is null")), "near-dup-texts")
    finder = Finder(one, size, percent, bands, rows)
    groups, component = finder.links()
    of = groups.join(component, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    found = finder.signed.select("id", "n", "digest").join(of, "digest", "left")
    found = found.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    if repeated:
        found = plain.where("id is not null").select("id").join(found, "id").unionByName(found.where("id is null"))
    kept = F.col("id").isNull() | (F.col("id") == F.col("component_id"))
    return found.select("id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but the least id of each component.

    Of rows that share a kept id one stays, of those with the greatest text the one whose columns
    have the greatest hash.
    """
    found = materialise(find(docs, doc_id, text, size, percent), "near-dup-found")
    gone = materialise(found.where(~F.col("kept")).select(doc_id).distinct(), "near-dup-gone")
    out = docs.join(broadcast_if_small(gone, MAX_IDS), doc_id, "left_anti").select(*docs.columns)
    repeated = found.where(F.col("kept") & F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").select(doc_id)
    repeated = materialise(repeated, "near-dup-repeated")
    if repeated.take(1):
        several = out.join(broadcast_if_small(repeated, MAX_IDS), doc_id, "left_semi")
        # the greatest text, then the greatest hash of the row: a maximum that is combined before the shuffle
        rank = F.struct(F.coalesce(F.col(text), F.lit("")), F.xxhash64(*docs.columns))
        first = several.groupBy(doc_id).agg(F.max_by(F.struct(*docs.columns), rank).alias("r")).select("r.*")
        out = out.join(broadcast_if_small(repeated, MAX_IDS), doc_id, "left_anti").select(*docs.columns).unionByName(first)
    return out
