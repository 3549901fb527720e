"""Listings of different sources that show the same photo.

Hashes are compared within a place: 64-bit perceptual hashes that differ in at most
``max_distance`` bits match, if the sources differ and the prices are close.  The hashes are input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_batches
from ..storage import materialise

MAX_DISTANCE = 4
MAX_PRICE_GAP = 0.30
#: Rows of a place in one tile, as expected; two tiles are compared at once.
TILE_ROWS = 4096
#: Bands are used while they leave at most this part of a block's pairs, were the bits even.
BAND_SHARE = 1 / 64


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def close_prices(a: Column, b: Column, gap: float = MAX_PRICE_GAP) -> Column:
    """The gap in terms of the lower price, which isn't 0; prices that aren't known don't pass."""
    low, high = F.least(a, b), F.greatest(a, b)
    return a.isNotNull() & b.isNotNull() & (low != 0) & ((high - low).cast("double") / low.cast("double") <= gap)


def _edges(max_distance: int) -> list[tuple[int, int]]:
    """The stretches of bits of ``max_distance + 1`` bands."""
    bands = max_distance + 1
    edges = [64 * k // bands for k in range(bands + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _bands(max_distance: int) -> Column:
    """The bands of ``hash`` that two hashes at most ``max_distance`` bits apart can't all differ in."""
    mask = lambda n: (1 << n) - 1 if n < 64 else -1
    return F.array(*(F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("hash", a).bitwiseAND(F.lit(mask(b - a)).cast("long")).alias("bits")) for k, (a, b) in enumerate(_edges(max_distance))))


def selective(max_distance: int) -> bool:
    """Whether bands spare most comparisons; narrow ones give each pair several times over."""
    return sum(2.0 ** (a - b) for a, b in _edges(max_distance)) <= BAND_SHARE


def _tiles_compared(names: list[str], max_distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of two tiles (lists ``a`` and ``b``) to those of their pairs that are near enough, some ten thousands at a time."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = batch.column("a")[k].values, batch.column("b")[k].values
                left, right = (x.field("hash").to_numpy().view(np.uint64) for x in (a, b))
                key = {n: batch.column(n)[k] for n in ("place", "one", "two")}
                step, held, found = max(1, 2**18 // len(right)), 0, []
                for at in range(0, len(left), step):
                    i, j = np.nonzero(np.bitwise_count(left[at : at + step, None] ^ right) <= max_distance)
                    found.append((i + at, j))
                    held += len(i)
                    if held >= 2**15 or (held and at + step >= len(left)):
                        ends = [(x, y.take(np.concatenate(z))) for x, y, z in zip("ab", (a, b), zip(*found, strict=True), strict=True)]
                        yield pa.RecordBatch.from_pydict({**{n: pa.repeat(v, held) for n, v in key.items()}, **{f"{n}_{x}": rows.field(n) for x, rows in ends for n in names}})
                        held, found = 0, []

    return compare


def near(rows: DataFrame, key: str, max_distance: int) -> DataFrame:
    """Pairs of ``rows`` (place, hash and others) of one place and at most ``max_distance`` bits apart, with ``dist``.

    The columns of the two sides end in _a and _b; each pair of unlike keys comes from one side only,
    not with the smaller key first.  Where bands are selective the join is on one of them, and a pair
    comes once for each band it agrees in.  Where they aren't, all pairs of a place are compared once: its
    rows are dealt to tiles, and each pair of tiles is one row of the join, so that no task and no
    batch grows with the place.  The comparisons grow with its square, what leaves them doesn't.
    """
    others = [c for c in rows.columns if c != "place"]
    ordered = F.col(f"{key}_a") < F.col(f"{key}_b")
    if selective(max_distance):
        dealt = rows.select("*", F.explode(_bands(max_distance)).alias("p")).select("*", "p.*")
        a, b = (dealt.select("place", "band", "bits", *(F.col(c).alias(f"{c}_{x}") for c in others)) for x in "ab")
        # bits first: few pairs pass, and all that follows is dearer
        joined = a.join(b, ["place", "band", "bits"]).where((distance(F.col("hash_a"), F.col("hash_b")) <= max_distance) & ordered)
    else:
        bounded_batches(rows.sparkSession)
        counts = rows.groupBy("place").agg(F.ceil(F.count("*") / TILE_ROWS).alias("tiles"))
        dealt = rows.join(counts, "place").withColumn("tile", F.pmod(F.xxhash64(key), F.col("tiles")))
        tiles = dealt.groupBy("place", "tile").agg(F.first("tiles").alias("tiles"), F.collect_list(F.struct(*others)).alias("rows"))
        a = tiles.select("place", F.col("tile").alias("one"), F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("two"), F.col("rows").alias("a"))
        b = tiles.select("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tile"))).alias("one"), F.col("tile").alias("two"), F.col("rows").alias("b"))
        both = a.join(b, ["place", "one", "two"])
        kind = T.StructType([both.schema[n] for n in ("place", "one", "two")] + [T.StructField(f"{c}_{x}", rows.schema[c].dataType) for x in "ab" for c in others])
        joined = both.mapInArrow(_tiles_compared(others, max_distance), kind).where((F.col("one") < F.col("two")) | ordered)
    return joined.select("place", *(f"{c}_{x}" for x in "ab" for c in others), distance(F.col("hash_a"), F.col("hash_b")).alias("dist"))


def pairs(listings: DataFrame, max_distance: int = MAX_DISTANCE, gap: float = MAX_PRICE_GAP) -> DataFrame:
    """(id_a, id_b, dist) from (id, source, place, price, hash), id_a < id_b, one row for each pair: its least distance."""
    rows = listings.where("place <> '' and hash is not null").select("id", "source", "place", "price", "hash")
    joined = near(rows, "id", max_distance).where((F.col("source_a") != F.col("source_b")) & close_prices(F.col("price_a"), F.col("price_b"), gap))
    return joined.groupBy(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).agg(F.min("dist").alias("dist"))


def ranked(found: DataFrame) -> DataFrame:
    """Pairs by their distance, then by their ids."""
    return found.orderBy("dist", "id_a", "id_b")


def unambiguous(found: DataFrame) -> DataFrame:
    """Pairs whose both ends occur in no other pair; ``found`` is read three times, so it had better be a table."""
    ends = found.select(F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")).where("degree = 1").select("id")
    return found.join(ends.withColumnRenamed("id", "id_a"), "id_a", "left_semi").join(ends.withColumnRenamed("id", "id_b"), "id_b", "left_semi").select("id_a", "id_b", "dist")


def new_links(found: DataFrame, listings: DataFrame, links: DataFrame) -> DataFrame:
    """(property_id, url, source, price) of the higher ids, linked to the lower ones and not yet stored."""
    return links_of(unambiguous(found), listings, links)


def links_of(clean: DataFrame, listings: DataFrame, links: DataFrame) -> DataFrame:
    """The links of unambiguous pairs that aren't stored."""
    other = listings.select(F.col("id").alias("id_b"), "url", "source", "price")
    rows = clean.join(other, "id_b").select(F.col("id_a").alias("property_id"), "url", "source", "price")
    return rows.join(links.select("property_id", "url"), ["property_id", "url"], "left_anti")


@dataclass
class PhotoGroups:
    """Matches without their pairs: listings that share place and hash are one node.

    members: (id, source, place, price, hash, degree), the degree being the listings it matches.
    edges: (place, hash_a, hash_b, dist, n_links), hash_a <= hash_b as signed numbers; an edge of a
    hash with itself stands for its own listings.  Edges without a link are left out.
    """

    members: DataFrame
    edges: DataFrame


def _cents(price: Column) -> Column:
    return (price * 100).cast("long")


def _spans(price: Column, gap: float) -> Column:
    """Signed bounds (cents, sign): the prices close to ``price`` are the sum of sign * count(prices <= cents).

    The bounds are settled by ``close_prices`` itself among the cents around them, so that they
    agree with it to the last cent.  Prices below 0 are close to any, as the rule has it.
    """
    around = lambda estimate: F.transform(F.array(*(F.lit(k) for k in range(-2, 3))), lambda k: ((estimate + k).cast("decimal(18,0)") / 100).cast("decimal(18,2)"))
    cents = _cents(price).cast("double")
    above = F.array_max(F.filter(around(F.floor(cents * (1 + gap))), lambda q: (q >= price) & close_prices(price, q, gap)))
    below = F.array_min(F.filter(around(F.ceil(cents / (1 + gap))), lambda q: (q > 0) & (q <= price) & close_prices(q, price, gap)))
    bound = lambda at, sign: F.struct(at.cast("long").alias("at"), F.lit(sign).alias("sign"))
    negative = bound(F.lit(-1), 1)
    return F.when(price < 0, F.array(bound(F.lit(2**62), 1))).when(price == 0, F.array(negative)).otherwise(F.array(negative, bound(_cents(F.coalesce(above, price)), 1), bound(_cents(F.coalesce(below, price)) - 1, -1)))


def groups(listings: DataFrame, max_distance: int = MAX_DISTANCE, gap: float = MAX_PRICE_GAP) -> PhotoGroups:
    """What ``pairs`` finds in (id, source, place, price, hash), as nodes, edges with link counts, and membership.

    Pairs are made of distinct hashes only.  How many listings a listing matches along an edge is
    counted from running sums over the prices of the other node, all sources less its own, so a hash
    that very many listings share costs its listings, not their square.  Those sums sort a node's
    distinct (source, price), not its listings.  Ids are distinct; prices are whole cents; listings
    without a source, place, price or hash match nothing and are left out.
    """
    rows = listings.where("place <> '' and hash is not null and source is not null and price is not null").select("id", "source", "place", F.col("price").cast("decimal(18,2)").alias("price"), "hash")
    cells = materialise(rows.groupBy("place", "hash", "source", "price").agg(F.count("*").alias("n")), "photo-cells")
    nodes = cells.select("place", "hash").distinct()
    alike = near(nodes, "hash", max_distance).select("place", F.least("hash_a", "hash_b").alias("hash_a"), F.greatest("hash_a", "hash_b").alias("hash_b"), "dist").distinct()
    same = nodes.select("place", F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.lit(0).alias("dist"))
    found = materialise(alike.unionByName(same), "photo-edges")

    both = found.select("place", F.col("hash_a").alias("hash"), F.col("hash_b").alias("other")).unionByName(found.where("hash_a <> hash_b").select("place", F.col("hash_b").alias("hash"), F.col("hash_a").alias("other")))
    asked = cells.join(both, ["place", "hash"]).select("place", F.col("other").alias("node"), "hash", "source", "price", F.explode(_spans(F.col("price"), gap)).alias("b"))
    nothing = F.lit(None)
    points = cells.select("place", F.col("hash").alias("node"), nothing.cast("long").alias("hash"), "source", "price", _cents(F.col("price")).alias("at"), F.lit(0).alias("sign"), "n")
    bounds = asked.select("place", "node", "hash", "source", "price", "b.at", "b.sign", F.lit(0).cast("long").alias("n"))
    # points come before bounds of the same cents: a bound counts prices up to and with its own
    order = [F.col("at"), F.abs("sign")]
    upto = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = points.unionByName(bounds).withColumn("others", F.sum("n").over(upto("place", "node")) - F.sum("n").over(upto("place", "node", "source")))
    # running sums to a bound among equals: all points of these cents are before it
    along = materialise(counted.where("sign <> 0").groupBy("place", "hash", "node", "source", "price").agg(F.sum(F.col("others") * F.col("sign")).alias("links")).where("links > 0"), "photo-links")

    cell = ["place", "hash", "source", "price"]
    degrees = along.groupBy(*cell).agg(F.sum("links").alias("degree"))
    members = rows.join(degrees, cell, "left").select("id", "source", "place", "price", "hash", F.coalesce("degree", F.lit(0)).alias("degree"))
    sums = along.where(F.col("hash") <= F.col("node")).join(cells, cell).groupBy("place", F.col("hash").alias("hash_a"), F.col("node").alias("hash_b")).agg(F.sum(F.col("links") * F.col("n")).alias("n_links"))
    # an edge of a hash with itself has counted each of its pairs from both ends
    edges = found.join(sums, ["place", "hash_a", "hash_b"]).withColumn("n_links", F.when(F.col("hash_a") == F.col("hash_b"), F.expr("n_links div 2")).otherwise(F.col("n_links")))
    return PhotoGroups(members, edges)


def expand(found: PhotoGroups, gap: float = MAX_PRICE_GAP) -> DataFrame:
    """The pairs (id_a, id_b, dist) of ``found``, exactly those of ``pairs``; as many as the links of all edges."""
    a, b = (found.members.where("degree > 0").select("place", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "source", "price", "hash"))) for x in "ab")
    rows = found.edges.select("place", "hash_a", "hash_b", "dist").join(a, ["place", "hash_a"]).join(b, ["place", "hash_b"])
    rows = rows.where((F.col("source_a") != F.col("source_b")) & close_prices(F.col("price_a"), F.col("price_b"), gap) & ((F.col("hash_a") != F.col("hash_b")) | (F.col("id_a") < F.col("id_b"))))
    return rows.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "dist")


def unambiguous_of(found: PhotoGroups, gap: float = MAX_PRICE_GAP) -> DataFrame:
    """The pairs whose both ends match nothing else, as ``unambiguous`` has them, without all other pairs.

    Only listings of degree 1 are joined: in the prices close to one of them there is one listing of
    another source, so few of them meet in one hash.
    """
    return expand(PhotoGroups(found.members.where("degree = 1"), found.edges), gap)
