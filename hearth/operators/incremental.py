"""Reports kept beside stored tables, brought up to date from what changed between two versions.

A report is itself a versioned table, and its version's number is the version of the table that
it accounts for: a refresh that broke off is made again, one that ended isn't made twice.  If
the version before has been vacuumed away, the report is counted from all rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reports import latest_by
from .search import timestamp
from .versions import SIGN, VersionedTable


class SignedCounts:
    """Counts of a table's rows by ``keys`` (columns by name): sums of signed changes, combined before the shuffle."""

    def __init__(self, table: VersionedTable, path: str, keys: dict[str, Column]):
        self.table, self.keys = table, keys
        typed = table.read([]).select(*(c.alias(k) for k, c in keys.items())).schema
        self.state = VersionedTable(table.spark, path, T.StructType([*typed.fields]).add("n", "long"))

    def refresh(self) -> int:
        """The version that the counts account for now."""
        target, done = self.table.version(), self.state.version()
        if target == done:
            return done
        names = list(self.keys)
        follows = done > 0 and done in self.table.versions()
        rows = self.table.changes(done, target) if follows else self.table.read(version=target).withColumn(SIGN, F.lit(1))
        counts = rows.groupBy(*(c.alias(k) for k, c in self.keys.items())).agg(F.sum(SIGN).alias("n"))
        if follows:
            counts = counts.unionByName(self.state.read(version=done)).groupBy(*names).agg(F.sum("n").alias("n"))
        return self.state.write(counts.where("n <> 0"), version=target)

    def read(self) -> DataFrame:
        return self.state.read()


class LatestRows:
    """The greatest row of each key of a table that is bucketed by that key.

    A greatest row that goes can't be taken off a sum, so the keys of the buckets that changed are
    decided anew, from these buckets alone.  Ties of ``order`` are settled by it: make it total.
    """

    def __init__(self, table: VersionedTable, path: str, order: list[str]):
        if not table.key:
            raise ValueError("the table needs a key")
        self.table, self.order = table, order
        self.state = VersionedTable(table.spark, path, table.schema, table.key, table.buckets)

    def refresh(self) -> int:
        """The version that the rows account for now."""
        target, done = self.table.version(), self.state.version()
        if target == done:
            return done
        buckets = None
        if done > 0 and done in self.table.versions():
            gone, come = self.table.differing(done, target)
            buckets = sorted({b for _, b in gone | come})
        rows = latest_by(self.table.read(buckets, target), self.table.key, F.struct(*self.order))
        return self.state.write(rows, buckets, target)

    def read(self) -> DataFrame:
        return self.state.read()


def hour_of(created: Column) -> Column:
    return F.date_trunc("hour", created).cast("timestamp_ntz")


def contacts_since(counts: SignedCounts, as_of: datetime, hours: int = 24, hour: str = "hour", created: str = "created_at", where: Column | None = None) -> DataFrame:
    """(contacts): rows strictly later than so many hours ago; ``counts`` has a key ``hour``, from ``hour_of``.

    Whole hours come from the counts, the hour that the bound cuts from the version of the table that they account for.
    """
    bound = as_of - timedelta(hours=hours)
    edge = bound.replace(minute=0, second=0, microsecond=0)
    chosen = F.lit(True) if where is None else where
    whole = counts.read().where((F.col(hour) >= timestamp(edge + timedelta(hours=1))) & chosen).agg(F.sum("n").alias("n"))
    cut = counts.table.read(version=counts.state.version()).where((F.col(created) > timestamp(bound)) & (F.col(created) < timestamp(edge + timedelta(hours=1))) & chosen).agg(F.count("*").alias("n"))
    return whole.unionByName(cut).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("contacts"))
