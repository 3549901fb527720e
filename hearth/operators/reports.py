"""Reports on contacts, pending listings, statuses and runs, all as of a given time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SOURCES, STATUSES
from .search import pending, timestamp


def since(created: Column, as_of: datetime, hours: int = 24) -> Column:
    """Strictly later than so many hours ago."""
    return created > timestamp(as_of) - F.make_dt_interval(hours=F.lit(hours))


def literal_rows(like: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """The known values as rows with their order."""
    return like.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"{column} string, place int")


def contacts_made(comms: DataFrame, as_of: datetime) -> DataFrame:
    return comms.where(since(F.col("created_at"), as_of) & (F.col("direction") == "Outbound")).agg(F.count("*").alias("contacts"))


def recent_contacts(comms: DataFrame, tracked: DataFrame, properties: DataFrame, as_of: datetime, top: int = 5) -> DataFrame:
    """The latest outbound contacts with their property; the cut comes before the joins."""
    cut = comms.where(since(F.col("created_at"), as_of) & (F.col("direction") == "Outbound")).orderBy(F.desc("created_at"), "id").limit(top)
    owner = tracked.select(F.col("id").alias("my_listing_id"), "property_id", "agent_name")
    home = properties.select(F.col("id").alias("property_id"), "location_string", "price")
    return F.broadcast(cut).join(owner, "my_listing_id").join(home, "property_id").select("id", "channel", "created_at", "agent_name", "location_string", "price").orderBy(F.desc("created_at"), "id")


def pending_count(properties: DataFrame, tracked: DataFrame, as_of: datetime) -> DataFrame:
    """Properties of the last day that wait for a decision."""
    return pending(properties.where(since(F.col("created_at"), as_of)), tracked, as_of).agg(F.count("*").alias("pending"))


def status_histogram(tracked: DataFrame, zero_filled: bool = False) -> DataFrame:
    counts = tracked.groupBy("status").agg(F.count("*").alias("n"))
    if not zero_filled:
        return counts
    known = literal_rows(tracked, "status", STATUSES)
    return F.broadcast(known).join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def latest_by(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The greatest row of each key; combined before the shuffle, so no group is sorted."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def platform_status(runs: DataFrame) -> DataFrame:
    """One row for each known source, with its last ended run if it had one."""
    last = latest_by(runs.where(F.col("run_end_time").isNotNull()), "source", F.struct("run_end_time", "id"))
    known = literal_rows(runs, "source", SOURCES)
    return F.broadcast(known).join(last, "source", "left").select("source", "place", F.col("run_end_time").alias("last_run"), "properties_added", "has_errors")


def recent_runs(runs: DataFrame, take: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("run_start_time"), F.desc("id")).limit(take)


def merge_runs(runs: DataFrame, *keys: str) -> DataFrame:
    """Sums of counts, any error, all messages in their order."""
    sums = [F.sum(c).alias(c) for c in ("properties_found", "properties_added", "properties_updated", "properties_linked", "properties_skipped")]
    errors = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "errors"))), lambda x: x["errors"]))
    return runs.groupBy(*keys).agg(*sums, F.bool_or("has_errors").alias("has_errors"), errors.alias("errors"))


def run_record(tally: DataFrame, source: str | Column, begin: datetime, end: datetime, errors: list[str]) -> DataFrame:
    """An audit row from the outcome counts of a run, or one for each row of counts that names its source."""
    found = F.col("added") + F.col("updated") + F.col("linked") + F.col("skipped")
    messages = F.array(*(F.lit(e) for e in errors)).cast("array<string>")
    return tally.select(
        F.lit(source).alias("source"), timestamp(begin).alias("run_start_time"), timestamp(end).alias("run_end_time"), found.alias("properties_found"), F.col("added").alias("properties_added"), F.col("updated").alias("properties_updated"), F.col("linked").alias("properties_linked"),
        F.col("skipped").alias("properties_skipped"), F.lit(bool(errors)).alias("has_errors"), messages.alias("errors"), F.lit(int((end - begin).total_seconds())).alias("duration_seconds"),
    )
