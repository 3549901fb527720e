"""Tracking of listings: states, notes and the log of contacts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import timestamp

#: What a change request may set.
CHANGEABLE = ("status", "notes", "agent_name", "agent_phone", "agent_email", "asked_about_orientation", "asked_about_open_plan_kitchen", "follow_up_date")


def track(tracked: DataFrame, requests: DataFrame, properties: DataFrame, as_of: datetime) -> DataFrame:
    """New tracked listings for requests (property_id, status) of known properties not tracked yet, with the agent's data."""
    agent = properties.select(F.col("id").alias("property_id"), "agent_name", "agent_phone", "agent_email")
    first = requests.groupBy("property_id").agg(F.max("status").alias("status"))
    new = first.join(agent, "property_id").join(tracked.select("property_id"), "property_id", "left_anti")
    now = timestamp(as_of)
    return new.select("property_id", F.coalesce("status", F.lit("Interested")).alias("status"), "agent_name", "agent_phone", "agent_email", now.alias("date_added"), now.alias("last_updated"))


def change(tracked: DataFrame, changes: DataFrame, as_of: datetime) -> DataFrame:
    """Tracked listings with what a change (id, seq, and some of ``CHANGEABLE``) sets; null leaves a value."""
    named = [c for c in CHANGEABLE if c in changes.columns and c in tracked.columns]
    last = changes.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"__{c}") for c in named), F.lit(True).alias("__hit"))
    rows = tracked.join(last, "id", "left")
    out = {c: F.coalesce(f"__{c}", c) for c in named} | {"last_updated": F.when(F.col("__hit"), timestamp(as_of)).otherwise(F.col("last_updated"))}
    return rows.withColumns(out).select(*tracked.columns)


def log_contacts(tracked: DataFrame, contacts: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(valid contacts with their time, tracked listings): an outbound contact moves Interested to Contacted."""
    valid = contacts.join(tracked.select(F.col("id").alias("my_listing_id")), "my_listing_id", "left_semi").withColumn("created_at", timestamp(as_of))
    out = valid.where(F.col("direction") == "Outbound").select(F.col("my_listing_id").alias("id"), F.lit(True).alias("__out")).distinct()
    rows = tracked.join(out, "id", "left")
    moved = F.col("__out") & (F.col("status") == "Interested")
    return valid, rows.withColumn("status", F.when(moved, "Contacted").otherwise(F.col("status"))).select(*tracked.columns)


def queue_append(queue: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """The queue and those of the batch that aren't in it."""
    return queue.unionByName(batch.join(queue.select(key), key, "left_anti").select(*queue.columns))
