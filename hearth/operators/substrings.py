"""Substring search over stored texts by lists of their trigrams.

Each distinct text is one value; for each three code points in a row that occur in it, the list
of that trigram holds the value's key.  A needle opens the buckets of its rarest trigrams,
the keys that are in all of their lists are candidates, and candidates are verified on the
whole text.  So the result is that of ``contains``, whatever the lists leave in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise
from .versions import SIGN, VersionedTable

#: Lists that are intersected for one needle at most; verification settles what they leave in.
MAX_LISTS = 8
#: A list this many times as long as the shortest one isn't opened: it costs more than the candidates that it takes away.
LONGEST = 4
#: Buckets are looked up one by one for up to this many keys a bucket; more lie in all of them.
KEYS_PER_BUCKET = 8
#: Code points of a text that is cut by places.
SHORT = 256

_VALUES = T.StructType().add("key", "long").add("text", "string")
_LISTS = T.StructType().add("gram", "string").add("key", "long")
_COUNTS = T.StructType().add("gram", "string").add("n", "long")


def trigrams(c: Column) -> Column:
    """The distinct runs of three code points; none in a text of fewer."""
    # a short text is cut by places, which takes its square at most; a long one by its list of points
    at = F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1)))
    short = F.when(F.length(c) < 3, F.array().cast("array<string>")).otherwise(F.transform(at, lambda k: F.substring(c, k, F.lit(3))))
    points = F.split(c, "")
    later = lambda n: F.slice(points, n, F.greatest(F.size(points), F.lit(1)))
    joined = lambda a, b: F.concat(a, b)
    # beyond the end there is null, and a run with a null is null
    runs = F.zip_with(F.zip_with(points, later(2), joined), later(3), joined)
    long = F.filter(runs, lambda x: x.isNotNull())
    return F.array_distinct(F.when(F.length(c) <= SHORT, short).otherwise(long))


class SubstringIndex:
    """The texts and lists in ``path``.

    Two texts may share a key; both are verified, so that costs time and loses nothing.  A batch
    that broke off is added again: its lists then hold keys twice, which changes no result.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        path = path.rstrip("/")
        self.spark = spark
        self.values = VersionedTable(spark, f"{path}/values", _VALUES, "key", buckets)
        self.lists = VersionedTable(spark, f"{path}/lists", _LISTS, "gram", buckets)
        self.counts = VersionedTable(spark, f"{path}/counts", _COUNTS, "gram", buckets)

    def add(self, texts: DataFrame) -> None:
        """Take in the only column of ``texts``; nulls and texts that are there already are left out.

        The values are written last: until then the batch counts as not added.
        """
        column = F.col(texts.columns[0])
        found = texts.select(F.xxhash64(column).alias("key"), column.alias("text")).where("text is not null").distinct()
        known = self.values.read(self.values.touched(found.select("key")))
        new = materialise(found.join(known, ["key", "text"], "left_anti"), "substrings-new")
        pairs = new.select(F.explode(trigrams(F.col("text"))).alias("gram"), "key")
        before = self.lists.version()
        self.lists.append(pairs)
        # lists that were put together come with both signs
        self.counts.append(self.lists.changes(before).groupBy("gram").agg(F.sum(SIGN).alias("n")).where("n <> 0"))
        self.values.append(new)

    def rarest(self, needle: str) -> dict[str, int]:
        """The needle's trigrams with the fewest values and how many these are: at most ``MAX_LISTS``, none longer than ``LONGEST`` times the first; {} if one has none."""
        grams = sorted({needle[k : k + 3] for k in range(len(needle) - 2)})
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        rows = self.counts.read(self.counts.touched(asked)).where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()  # a row for each trigram of the needle
        if len(rows) < len(grams):
            return {}
        found = sorted((r["n"], r["gram"]) for r in rows)[:MAX_LISTS]
        return {g: n for n, g in found if n <= LONGEST * found[0][0]}

    def find(self, needle: str) -> DataFrame:
        """(text): the distinct texts that contain ``needle``; one of fewer than three code points is looked for in all."""
        verified = F.col("text").contains(needle)
        if len(needle) < 3:
            return self.values.read().where(verified).select("text").distinct()
        grams = self.rarest(needle)
        if not grams:
            return self.values.read([]).select("text")
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        held = self.lists.read(self.lists.touched(asked)).where(F.col("gram").isin(list(grams)))
        if len(grams) > 1:
            bit = F.element_at(F.create_map(*(F.lit(x) for k, g in enumerate(grams) for x in (g, 1 << k))), F.col("gram"))
            held = held.groupBy("key").agg(F.bit_or(bit).alias("held")).where(F.col("held") == (1 << len(grams)) - 1)
        keys = held.select("key")
        # no more candidates than the shortest list has values
        buckets = None
        if min(grams.values()) <= KEYS_PER_BUCKET * self.values.buckets:
            keys = materialise(keys, "substrings-keys")
            buckets = self.values.touched(keys)
        return self.values.read(buckets).where(verified).join(keys, "key", "left_semi").select("text").distinct()


def containing(rows: DataFrame | VersionedTable, column: str, index: SubstringIndex, needle: str) -> DataFrame:
    """The rows whose ``column`` contains ``needle``.

    A stored table whose key is that column opens only the buckets that hold texts found.  No
    list narrows a needle of fewer than three code points: the rows themselves are looked through.
    """
    if len(needle) < 3:
        return (rows.read() if isinstance(rows, VersionedTable) else rows).where(F.col(column).contains(needle))
    found = index.find(needle).withColumnRenamed("text", column)
    if isinstance(rows, VersionedTable):
        # found once: the look-up of the buckets and the join read it
        found = materialise(found, "substrings-found")
        rows = rows.read(rows.touched(found)) if rows.key == column else rows.read()
    return rows.where(F.col(column).contains(needle)).join(found, column, "left_semi")
