"""Faceted listing search: optional predicates, one sort, a count and a page."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime
from functools import cached_property, reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = "All"
#: Hours after which a rejected listing may be shown again.
REJECTION_HOURS = 72


@dataclass(frozen=True)
class SearchRequest:
    """What a search asks for; None leaves a predicate out."""

    price_min: float | None = None
    price_max: float | None = None
    beds: int | None = None
    orientation: str | None = None
    construction: str | None = None
    open_plan_kitchen: bool | None = None
    elevator: bool | None = None
    parking: bool | None = None
    price_per_m2_min: float | None = None
    price_per_m2_max: float | None = None
    added_within_days: int | None = None
    pending_only: bool = False
    location: str | None = None
    source: str | None = None
    sort_by: str | None = None
    sort_order: str | None = None
    page: int = 1
    page_size: int = 12

    def changed(self, **values) -> SearchRequest:
        """The request with other values; a change of anything but the page goes back to page 1."""
        return replace(self, **values) if "page" in values else replace(self, page=1, **values)


@dataclass
class Page:
    """One page and what it is a page of."""

    items: DataFrame
    rows: DataFrame
    page: int
    page_size: int

    @cached_property
    def total(self) -> int:
        """All rows, counted when somebody asks."""
        return self.rows.count()

    @property
    def total_pages(self) -> int:
        return -(-self.total // self.page_size) if self.page_size else 0


def timestamp(as_of: datetime) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def facet(column: Column, wanted: str | None) -> Column | None:
    return column == wanted if wanted and wanted != ANY else None


def not_true(flag: Column) -> Column:
    """False or not known."""
    return ~flag.eqNullSafe(F.lit(True))


def ratio(price: Column, size: Column) -> Column:
    """Price per square metre where both are known and the size is over 0."""
    return F.when(price.isNotNull() & (size > 0), price.cast("double") / size.cast("double"))


def added_since(created: Column, as_of: datetime, days: int) -> Column:
    return created >= timestamp(as_of) - F.make_dt_interval(F.lit(days))


def pending(properties: DataFrame, tracked: DataFrame, as_of: datetime, key: str = "id") -> DataFrame:
    """Properties never tracked, or rejected more than ``REJECTION_HOURS`` ago.

    A single anti join: what is excluded are the tracked ones that aren't due again.
    """
    due = (F.col("status") == "Rejected") & (F.col("date_added") < timestamp(as_of) - F.make_dt_interval(hours=F.lit(REJECTION_HOURS)))
    busy = tracked.where(~F.coalesce(due, F.lit(False))).select(F.col("property_id").alias(key))
    return properties.join(busy, key, "left_anti")


def predicates(r: SearchRequest, as_of: datetime) -> list[Column]:
    c = F.col
    found = [
        c("price") >= r.price_min if r.price_min is not None else None,
        c("price") <= r.price_max if r.price_max is not None else None,
        c("beds") == r.beds if r.beds is not None else None,
        facet(c("sun_orientation"), r.orientation),
        facet(c("construction_status"), r.construction),
        None if r.open_plan_kitchen is None else c("open_plan_kitchen").eqNullSafe(F.lit(True)) if r.open_plan_kitchen else not_true(c("open_plan_kitchen")),
        c("elevator") == r.elevator if r.elevator is not None else None,
        c("parking") == r.parking if r.parking is not None else None,
        ratio(c("price"), c("size_m2")) >= r.price_per_m2_min if r.price_per_m2_min is not None else None,
        ratio(c("price"), c("size_m2")) <= r.price_per_m2_max if r.price_per_m2_max is not None else None,
        added_since(c("created_at"), as_of, r.added_within_days) if r.added_within_days is not None else None,
        c("location_string").contains(r.location) if r.location else None,
        c("source") == r.source if r.source else None,
    ]
    return [p for p in found if p is not None]


def matching(properties: DataFrame, tracked: DataFrame, r: SearchRequest, as_of: datetime) -> DataFrame:
    """All rows that a request finds; filters reach the scan."""
    found = predicates(r, as_of)
    rows = properties.where(reduce(and_, found)) if found else properties
    return pending(rows, tracked, as_of) if r.pending_only else rows


def ordering(sort_by: str | None, sort_order: str | None) -> list[Column]:
    """price and size go either way (down unless asc); any other key is the last seen first. The id breaks ties."""
    key = {"price": "price", "size": "size_m2"}.get((sort_by or "").lower())
    if key is None:
        return [F.desc("last_seen_at"), F.asc("id")]
    return [F.asc(key) if (sort_order or "").lower() == "asc" else F.desc(key), F.asc("id")]


def page_of(rows: DataFrame, order: list[Column], page: int, size: int, default_size: int = 12) -> DataFrame:
    """One page; bounds below 1 fall back to page 1 and the default size."""
    page, size = max(1, page), size if size >= 1 else default_size
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def with_children(parents: DataFrame, price_history: DataFrame, links: DataFrame) -> DataFrame:
    """Parents with their price changes by time, the last one spread out, and their links by source.

    Each child table is gathered by parent before its join, so rows never multiply.
    """
    history = price_history.groupBy("property_id").agg(F.array_sort(F.collect_list(F.struct("changed_at", "id", "old_price", "new_price"))).alias("price_history"))
    rows = parents.join(history.withColumnRenamed("property_id", "id"), "id", "left").join(linked_sources(links).withColumnRenamed("property_id", "id"), "id", "left")
    last = F.element_at("price_history", -1)
    return rows.withColumns({"previous_price": last["old_price"], "price_changed_at": last["changed_at"]})


def search(properties: DataFrame, tracked: DataFrame, price_history: DataFrame, links: DataFrame, r: SearchRequest, as_of: datetime) -> Page:
    """The page is cut before children are joined, so only its rows reach the join."""
    rows = matching(properties, tracked, r, as_of)
    page, size = max(1, r.page), r.page_size if r.page_size >= 1 else 12
    items = page_of(rows, ordering(r.sort_by, r.sort_order), page, size)
    ids = F.broadcast(items.select(F.col("id").alias("property_id")))  # a page's ids
    full = with_children(items, price_history.join(ids, "property_id", "left_semi"), links.join(ids, "property_id", "left_semi"))
    return Page(full.orderBy(*ordering(r.sort_by, r.sort_order)), rows, page, size)


#: Columns that leave under another name.
RENAMED = {"location_string": "location", "source_property_id": "external_id"}


def view(properties: DataFrame) -> DataFrame:
    """Properties as they leave the store: all columns but the hash, some renamed."""
    return properties.select(*(F.col(c).alias(RENAMED.get(c, c)) for c in properties.columns if c != "dedup_hash"))


def by_id(rows: DataFrame, value: int, key: str = "id") -> DataFrame:
    """No row or one; the predicate reaches the scan."""
    return rows.where(F.col(key) == value).limit(1)


def linked_sources(links: DataFrame) -> DataFrame:
    """(property_id, linked_sources): each property's links by source, in one row."""
    return links.groupBy("property_id").agg(F.array_sort(F.collect_list(F.struct("source", "url", "price", "last_seen_at"))).alias("linked_sources"))


def contacts_of(comms: DataFrame, listing: int) -> DataFrame:
    """The contacts of one tracked listing, the latest first."""
    return comms.where(F.col("my_listing_id") == listing).orderBy(F.desc("created_at"), F.desc("id"))


def listing_page(tracked: DataFrame, properties: DataFrame, comms: DataFrame, links: DataFrame | None = None, status: str | None = None, page: int = 1, size: int = 20) -> Page:
    """Tracked listings, the last updated first, with their property, its links, and a count and last time of contacts."""
    rows = tracked.where(F.col("status") == status) if status else tracked
    items = page_of(rows, [F.desc("last_updated"), F.asc("id")], page, size, 20)
    ids = F.broadcast(items.select(F.col("id").alias("my_listing_id")))  # a page's ids
    contacts = comms.join(ids, "my_listing_id", "left_semi").groupBy("my_listing_id").agg(F.count("*").alias("comm_history_count"), F.max("created_at").alias("last_contacted_at"))
    home = properties.select(F.col("id").alias("property_id"), *(F.col(c).alias(f"property_{c}") for c in properties.columns if c not in ("id", "property_id")))
    full = items.join(home, "property_id", "left").join(contacts.withColumnRenamed("my_listing_id", "id"), "id", "left").fillna(0, ["comm_history_count"])
    if links is not None:
        homes = F.broadcast(items.select("property_id"))
        full = full.join(linked_sources(links.join(homes, "property_id", "left_semi")), "property_id", "left")
    return Page(full.orderBy(F.desc("last_updated"), F.asc("id")), rows, max(1, page), size if size >= 1 else 20)
