"""Entity resolution: each candidate is added, updates a listing, is linked to one, or is skipped.

Candidates of a batch are judged in their order against the store as it was when the batch
began.  A candidate is skipped if an added one of the batch before it has its url or its
hash; otherwise a known url updates, a hash seen at another source within the horizon
links, and the rest is added.  Only added ones block, and they are found in rounds over the
graph of shared urls and hashes: no batch and no group is replayed in one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .search import timestamp
from .versions import VersionedTable

#: Days that a listing's last sight may lie back to be linked.
HORIZON_DAYS = 30
ADDED, UPDATED, LINKED, SKIPPED = "Added", "Updated", "Linked", "Skipped"


def stored_matches(candidates: DataFrame, properties: DataFrame, as_of: datetime, hashes: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Candidates with the store's row of the same url, and the least id of a linkable one.

    hashes: (dedup_hash, id, source, last_seen_at) of the listings that may be linked, if
    ``properties`` doesn't hold all of them.
    also: further columns of the store's row, as ``stored_<name>``.
    """
    by_url = properties.select("url", F.col("id").alias("url_id"), *(F.col(c).alias(f"stored_{c}") for c in ("price", *also)))
    recent = (properties if hashes is None else hashes).where(F.col("last_seen_at") >= timestamp(as_of) - F.make_dt_interval(F.lit(HORIZON_DAYS)))
    # one row for each hash: the least id of each source, so the first two hold the least id of another source than any
    least = recent.where("source is not null").groupBy("dedup_hash", "source").agg(F.min("id").alias("id"))
    by_hash = least.groupBy("dedup_hash").agg(F.slice(F.array_sort(F.collect_list(F.struct("id", "source"))), 1, 2).alias("__least"))
    canonical = F.get(F.filter("__least", lambda x: x["source"] != F.col("source")), F.lit(0))["id"]
    found = candidates.join(by_url, "url", "left").join(by_hash, "dedup_hash", "left").withColumn("canonical_id", canonical)
    return found.select(*candidates.columns, *(c for c in by_url.columns if c != "url"), "canonical_id")


def _same(left: DataFrame, right: DataFrame, key: str) -> Column:
    """Batch and key agree; nulls agree with nulls."""
    return (left["batch"] == right["__batch"]) & left[key].eqNullSafe(right[f"__{key}"])


def _of(rows: DataFrame, key: str, found: Column, name: str) -> DataFrame:
    return rows.groupBy(F.col("batch").alias("__batch"), F.col(key).alias(f"__{key}")).agg(found.alias(name))


def added(willing: DataFrame) -> DataFrame:
    """(batch, seq, url, dedup_hash) of those that are added, from the candidates that nothing stored keeps from it.

    Two of them that share a url or a hash are in conflict, and the earlier one wins if it is
    added itself.  Each round adds every candidate that is the first of its url and the first
    of its hash, and leaves out all that share either with one of these; the rest is decided by
    later rounds.  A round is aggregates and joins, so a batch of any size and a url or hash of
    any frequency is dealt to all tasks.  There are as many rounds as the longest row of
    candidates of which each waits for the one before: few, unless a batch is made for it.
    """
    left = materialise(willing.groupBy("batch", "url", "dedup_hash").agg(F.min("seq").alias("seq")), "resolve-willing")
    found = left.where("false").select("batch", "seq", "url", "dedup_hash")
    while not left.isEmpty():
        firsts = {key: _of(left, key, F.min("seq"), f"first_{key}") for key in ("url", "dedup_hash")}
        marked = left
        for key, first in firsts.items():
            marked = marked.join(first, _same(marked, first, key)).drop("__batch", f"__{key}")
        marked = materialise(marked, "resolve-round")
        now = marked.where("seq = first_url and seq = first_dedup_hash").select("batch", "seq", "url", "dedup_hash")
        found = found.unionByName(now)
        rest = marked.where("seq <> first_url or seq <> first_dedup_hash").select("batch", "seq", "url", "dedup_hash")
        for key in ("url", "dedup_hash"):
            won = now.select(F.col("batch").alias("__batch"), F.col(key).alias(f"__{key}"))
            rest = rest.join(won, _same(rest, won, key), "left_anti")
        left = materialise(rest, "resolve-left")
    return found


def _contested(matched: DataFrame, willing: Column) -> DataFrame | None:
    """``matched`` with whether another candidate of the batch, and one that would be added, shares the url or the hash; None if no two do."""
    shared = {}
    for key in ("url", "dedup_hash"):
        groups = matched.groupBy("batch", key).agg(F.count("*").alias("n"), F.count_if(willing).alias("n_willing")).where("n > 1 and n_willing > 0")
        shared[key] = materialise(groups.select(F.col("batch").alias("__batch"), F.col(key).alias(f"__{key}"), F.lit(True).alias(f"__by_{key}")), "resolve-shared")
    if all(groups.isEmpty() for groups in shared.values()):
        return None
    rows = matched
    for key, groups in shared.items():
        rows = rows.join(groups, _same(rows, groups, key), "left").drop("__batch", f"__{key}")
    return rows.withColumn("__contested", F.coalesce("__by_url", "__by_dedup_hash", F.lit(False))).drop("__by_url", "__by_dedup_hash")


def resolve(candidates: DataFrame, properties: DataFrame, as_of: datetime, hashes: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Candidates (batch, seq, url, source, dedup_hash, ...) with their outcome, url_id and canonical_id.

    A batch is one result page or one micro-batch; (batch, seq) is a key.  An added candidate is
    the only one of its url and of its hash in the batch, so each candidate meets at most two.
    Only candidates that share a url or a hash go through the rounds.
    """
    matched = materialise(stored_matches(candidates, properties, as_of, hashes, also), "resolve-matched")
    alone = outcome_alone(F.col("url_id"), F.col("canonical_id"))
    marked = _contested(matched, alone == ADDED)
    if marked is None:
        return matched.withColumn("outcome", alone)
    marked = materialise(marked, "resolve-marked")
    rows = marked.where("__contested").drop("__contested")
    winners = materialise(added(rows.where(alone == ADDED)), "resolve-added")
    for key in ("url", "dedup_hash"):
        won = _of(winners, key, F.min("seq"), f"__by_{key}")
        rows = rows.join(won, _same(rows, won, key), "left").drop("__batch", f"__{key}")
    before = F.coalesce(F.col("__by_url") < F.col("seq"), F.lit(False)) | F.coalesce(F.col("__by_dedup_hash") < F.col("seq"), F.lit(False))
    judged = rows.withColumn("outcome", F.when(before, SKIPPED).otherwise(alone)).drop("__by_url", "__by_dedup_hash")
    return marked.where("not __contested").drop("__contested").withColumn("outcome", alone).unionByName(judged)


def existing(candidates: DataFrame, store: VersionedTable) -> DataFrame:
    """Candidates with whether their url is stored, and its price; only the buckets of their urls are opened."""
    rows = store.read(store.touched(candidates.select("url"))).select("url", F.col("price").alias("stored_price"), F.lit(True).alias("__known"))
    return candidates.join(rows, "url", "left").withColumn("known", F.coalesce("__known", F.lit(False))).drop("__known")


def outcome_alone(url_id: Column, canonical_id: Column) -> Column:
    return F.when(url_id.isNotNull(), UPDATED).when(canonical_id.isNotNull(), LINKED).otherwise(ADDED)


def tally(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Counts of each outcome in one pass."""
    return outcomes.groupBy(*keys).agg(*(F.count_if(F.col("outcome") == x).alias(x.lower()) for x in (ADDED, UPDATED, LINKED, SKIPPED)))


def first_seen(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; a minimum that is combined before the shuffle."""
    rank = F.struct(*order)
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), rank).alias("r")).select(*keys, "r.*")
