"""Deep pages: a search result stored in its order, in ranges, beside a histogram of them.

``offset`` sorts all rows up to the page each time.  Here the order is settled once: the result
is written in sorted ranges, each row with its place in its range, and the rows of each range
are counted.  A page then is a stretch of places, and only the ranges that hold it are read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGE, _AT = "__range", "__at"


class SortedPages:
    """Pages over a folder that ``build`` wrote.  The histogram has one row a range; the driver holds it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        histogram = spark.read.parquet(f"{self.path}/histogram").orderBy(_RANGE).collect()
        self.ranges = [r[_RANGE] for r in histogram]
        self.firsts = [0]
        for r in histogram:
            self.firsts.append(self.firsts[-1] + r["n"])

    @classmethod
    def build(cls, rows: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> SortedPages:
        """Write ``rows`` in a total ``order``; in so many ranges, or as many as Spark finds fit."""
        at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
        placed = dealt.sortWithinPartitions(*order).withColumns({_AT: at, _RANGE: F.spark_partition_id()})
        placed.write.partitionBy(_RANGE).parquet(f"{path}/rows")
        spark = rows.sparkSession
        written = spark.read.schema(T.StructType([*placed.schema.fields])).parquet(f"{path}/rows")
        written.groupBy(_RANGE).agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/histogram")
        return cls(spark, path)

    @property
    def total(self) -> int:
        return self.firsts[-1]

    def _between(self, first: int, last: int) -> DataFrame:
        """Rows at the places ``first`` to ``last - 1`` of the whole, in their order."""
        found: list[DataFrame] = []
        k = max(0, bisect_right(self.firsts, first) - 1)
        while k < len(self.ranges) and self.firsts[k] < last:
            part = self.spark.read.parquet(f"{self.path}/rows/{_RANGE}={self.ranges[k]}")
            low, high = first - self.firsts[k], last - self.firsts[k]
            # places grow within a file, so its row groups outside are skipped
            found.append(part.where((F.col(_AT) >= low) & (F.col(_AT) < high)).withColumn(_RANGE, F.lit(k)))
            k += 1
        if not found:
            return self.spark.read.parquet(f"{self.path}/rows").drop(_RANGE, _AT).limit(0) if self.ranges else self.spark.createDataFrame([], T.StructType([]))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out.orderBy(_RANGE, _AT).drop(_RANGE, _AT)

    def page(self, page: int, size: int, default_size: int = 12) -> DataFrame:
        """One page; bounds below 1 fall back to page 1 and the default size."""
        page, size = max(1, page), size if size >= 1 else default_size
        return self._between((page - 1) * size, page * size)

    def after(self, place: int, size: int) -> DataFrame:
        """The ``size`` rows behind a cursor: how many rows the reader has seen."""
        return self._between(max(0, place), max(0, place) + size)
