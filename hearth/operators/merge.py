"""Changes of stored tables: new versions from old ones by joins; nothing is updated in place."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .search import timestamp
from .versions import VersionedTable

__all__ = [
    "IF_FILLED", "OVERWRITTEN", "VersionedTable", "add_rows", "apply_facts", "default_settings", "delete_cascade", "insert", "merge_links", "price_changes", "replace_settings", "update_by_url", "upsert_links", "with_ids",
]

#: Columns that an update overwrites even with nulls.
OVERWRITTEN = (
    "price", "location_string", "distrito", "concelho", "freguesia", "beds", "baths", "size_m2", "sun_orientation", "orientation_source", "open_plan_kitchen", "construction_status", "elevator",
    "parking", "furnished", "air_conditioning", "balcony", "renovated", "storage", "water_view", "near_metro", "energy_rating", "photos", "dedup_hash",
)
#: Columns that an update overwrites only with something.
IF_FILLED = ("agent_name", "agent_phone", "agent_email")


def update_by_url(properties: DataFrame, updates: DataFrame, as_of: datetime, also: tuple[str, ...] = ()) -> DataFrame:
    """Properties with the last update of each url applied.

    A new description resets ``ai_enriched_at``.  has_usage_license, lat, lng and
    source_property_id keep their values unless ``also`` names them.
    """
    named = [c for c in (*OVERWRITTEN, *IF_FILLED, "description", *also) if c in properties.columns and c in updates.columns]
    last = updates.groupBy("url").agg(F.max_by(F.struct(*named), F.struct("batch", "seq")).alias("__new"))
    rows = properties.join(last, "url", "left")
    return rows.withColumns(_overwrites(properties.columns, named, as_of)).select(*properties.columns)


def _overwrites(columns: list[str], named: list[str], as_of: datetime) -> dict[str, Column]:
    """What an update, ``__new`` where there is one, makes of a row's columns."""
    hit, new = F.col("__new").isNotNull(), F.col("__new")
    changes: dict[str, Column] = {}
    for c in named:
        if c == "description":
            changed = hit & ~F.col(c).eqNullSafe(new[c])
            changes[c] = F.when(changed, new[c]).otherwise(F.col(c))
            changes["ai_enriched_at"] = F.when(changed, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("ai_enriched_at"))
        elif c in IF_FILLED:
            changes[c] = F.when(hit & (F.coalesce(new[c], F.lit("")) != ""), new[c]).otherwise(F.col(c))
        else:
            changes[c] = F.when(hit, new[c]).otherwise(F.col(c))
    changes["last_seen_at"] = F.when(hit, timestamp(as_of)).otherwise(F.col("last_seen_at"))
    return changes


def upsert(properties: DataFrame, changes: DataFrame, as_of: datetime) -> DataFrame:
    """``update_by_url`` and ``insert`` in one join: changes, one for each url, update the row of their url or come in under their ``id``."""
    taken = [c for c in properties.columns if c in changes.columns]
    named = [c for c in (*OVERWRITTEN, *IF_FILLED, "description") if c in taken]
    rows = properties.join(changes.select(F.col("url").alias("__url"), F.struct(*taken).alias("__new")), F.col("url") == F.col("__url"), "full_outer")
    overwritten, now = _overwrites(properties.columns, named, as_of), timestamp(as_of)
    inserted = {c: F.col("__new")[c] for c in taken} | {c: now for c in ("created_at", "last_seen_at", "first_scraped_at")}
    fresh = F.col("id").isNull()
    return rows.select(*(F.when(fresh, inserted.get(c, F.lit(None).cast(properties.schema[c].dataType))).otherwise(overwritten.get(c, F.col(c))).alias(c) for c in properties.columns))


def price_changes(outcomes: DataFrame, as_of: datetime) -> DataFrame:
    """A row for each update whose price differs from the one before; repeated urls compare with one another in turn.

    The stored price seeds the first comparison; a change needs both prices.
    """
    order = Window.partitionBy("url_id").orderBy("batch", "seq")
    first = F.row_number().over(order) == 1
    before = F.when(first, F.col("stored_price")).otherwise(F.lag("price").over(order))
    rows = outcomes.where(F.col("outcome") == "Updated").withColumn("old_price", before)
    changed = F.col("old_price").isNotNull() & F.col("price").isNotNull() & (F.col("old_price") != F.col("price"))
    return rows.where(changed).select(F.col("url_id").alias("property_id"), "old_price", F.col("price").alias("new_price"), timestamp(as_of).alias("changed_at"), "batch", "seq")


def with_ids(rows: DataFrame, start: int, order: list[Column]) -> DataFrame:
    """New rows numbered from ``start + 1``, without one task that holds them all.

    Rows are sorted in ranges, which are written with each row's place; a range's offset is the sum of the counts before it.
    """
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranged = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": part, "__place": place}), "new-ids")
    counts = ranged.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__offset"))  # one row for each partition
    return ranged.join(F.broadcast(offsets), "__part").withColumn("id", F.lit(start) + F.col("__offset") + F.col("__place")).drop("__part", "__offset", "__place")


def insert(properties: DataFrame, added: DataFrame, as_of: datetime, next_id: int) -> DataFrame:
    now = timestamp(as_of)
    rows = with_ids(added, next_id - 1, [F.asc("batch"), F.asc("seq")]).withColumns({"created_at": now, "last_seen_at": now, "first_scraped_at": now, "ai_enriched_at": F.lit(None).cast("timestamp_ntz")})
    return properties.unionByName(rows.select(*[c for c in properties.columns if c in rows.columns]), allowMissingColumns=True)


def upsert_links(links: DataFrame, linked: DataFrame, as_of: datetime) -> DataFrame:
    """Child links keyed by (property_id, url): price and last sight of a known one, a new row else.

    An ``id`` of the links stays; new rows have none yet.
    """
    now = timestamp(as_of)
    new = linked.groupBy(F.col("canonical_id").alias("property_id"), "url").agg(F.max_by(F.struct("source", "price"), F.struct("batch", "seq")).alias("n"))
    rows = links.join(new, ["property_id", "url"], "full_outer")
    hit = F.col("n").isNotNull()
    return rows.select(
        *(["id"] if "id" in links.columns else []), "property_id", "url", F.coalesce(F.col("source"), F.col("n.source")).alias("source"), F.when(hit, F.col("n.price")).otherwise(F.col("price")).alias("price"), F.coalesce("first_seen_at", now).alias("first_seen_at"), F.when(hit, now).otherwise(F.col("last_seen_at")).alias("last_seen_at")
    )


def add_rows(stored: DataFrame, new: DataFrame, order: list[Column], top: int | None = None) -> DataFrame:
    """Stored rows and new ones, these numbered behind ``top``, or the greatest stored id."""
    if top is None:
        top = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return stored.unionByName(with_ids(new, top, order).select(*stored.columns))


def merge_links(links: DataFrame, linked: DataFrame, as_of: datetime, top: int | None = None) -> DataFrame:
    """Stored links (with ids) after an upsert, new ones numbered by property and url behind ``top``."""
    rows = upsert_links(links, linked, as_of)
    return add_rows(rows.where("id is not null").select(*links.columns), rows.where("id is null").drop("id"), [F.asc("property_id"), F.asc("url")], top)


def delete_cascade(parents: DataFrame, gone: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str = "id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without those in ``gone``, and each child table (name -> rows, foreign key) without theirs."""
    ids = gone.select(key).distinct()
    kept = {name: rows.join(ids.withColumnRenamed(key, fk), fk, "left_anti").select(*rows.columns) for name, (rows, fk) in children.items()}
    return parents.join(ids, key, "left_anti").select(*parents.columns), kept


def apply_facts(rows: DataFrame, facts: DataFrame, columns: list[str], stamp: str, as_of: datetime, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows with the last facts of each id written over ``columns`` and ``stamp`` set; (rows, counts of applied and skipped).

    Unknown ids are skipped; every repeated fact counts.
    """
    last = facts.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("seq")).alias("__new"))
    joined = rows.join(last, key, "left")
    hit = F.col("__new").isNotNull()
    changes = {c: F.when(hit, F.col("__new")[c]).otherwise(F.col(c)) for c in columns} | {stamp: F.when(hit, timestamp(as_of)).otherwise(F.col(stamp))}
    known = facts.join(rows.select(key, F.lit(True).alias("__known")), key, "left")
    counts = known.agg(F.count_if("__known").alias("applied"), F.count_if(F.col("__known").isNull()).alias("skipped"))
    return joined.withColumns(changes).select(*rows.columns), counts


def replace_settings(spark: SparkSession, settings: dict, schema, as_of: datetime) -> DataFrame:
    """The one settings row, written anew."""
    return spark.createDataFrame([{f.name: settings.get(f.name) for f in schema.fields}], schema).withColumn("updated_at", timestamp(as_of))


def default_settings(existing: DataFrame, defaults: DataFrame) -> DataFrame:
    """The stored settings row, or the defaults if there is none."""
    return defaults if existing.isEmpty() else existing.limit(1)
