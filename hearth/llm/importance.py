"""Importance resampling towards a target: documents that look like the target are drawn more often.

Runs of 1 to ``max_n`` words are hashed into buckets, which are counted over all documents and
over all target texts.  A bucket's gain is the logarithm of its smoothed share in the target
over that in the documents, in thousandths; a document's weight is the sum over its features.
Gumbel noise from a hash of the id makes the greatest scores a draw without replacement in
proportion to exp(weight / 1000), the same draw on every run.

Everything is DataFrame work: arrays of words are exploded, buckets are counted with a combine
before the shuffle, the gains (one row a bucket, at most ``MAX_BUCKETS``) are broadcast, and
ranks come from a sort in ranges whose offsets are the counts of the ranges before.

Defined results: words are runs of letters, digits and characters beyond ASCII, A-Z in lower
case; a null or empty text has none, its weight is 0.  Rows that share an id are documents of
their own with the same noise; equal rows stay as many as they are.  A null id counts as an
empty one for the noise and comes last in a tie.  Documents below ``min_words`` are never drawn
but count among the documents' features.  An empty target gives gains too (a uniform share).
Other columns are ignored by ``scores`` and kept by ``resample``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, lower_ascii, materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of the broadcast gains at most (16 bytes each).
MAX_BUCKETS = 1 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _run_at(words: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.concat_ws(" ", *(F.get(words, i + j) for j in range(n)))


def features_of(words: Column, max_n: int) -> Column:
    """All runs of 1 to ``max_n`` words, joined by a space, repeats included; ``words`` is a plain column."""
    runs = [words]
    for n in range(2, max_n + 1):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(starts, _run_at(words, n)))
    return F.concat(*runs) if max_n > 1 else words


def bucket_of(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % F.lit(buckets)


def bucket_counts(texts: DataFrame, text: str, max_n: int, buckets: int) -> DataFrame:
    """(bucket, n) of the features of all texts."""
    words = texts.select(words_of(F.col(text)).alias("words"))
    found = words.select(F.explode(features_of(F.col("words"), max_n)).alias("feature"))
    return found.groupBy(bucket_of(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", max_n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of every bucket, whether or not a feature falls into it."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MAX_BUCKETS}")
    counts = bucket_counts(docs, text, max_n, buckets).withColumn("m", F.lit(0).cast("long"))
    aims = bucket_counts(target, text, max_n, buckets).select("bucket", F.lit(0).cast("long").alias("n"), F.col("n").alias("m"))
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), *(F.lit(0).cast("long").alias(c) for c in "nm"))
    rows = materialise(every.unionByName(counts).unionByName(aims).groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("m").alias("t")), "importance-buckets")
    total = rows.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    # doubles from the start: products of counts pass 63 bits at 100 TB
    above = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))
    below = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets))
    return rows.select("bucket", F.floor(1000 * F.log(above / below)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``rows`` with their places 1, 2, 3... in a total order, without a task that sees them all.

    The sort in ranges is written with each row's partition and place in it, so neither can
    change when a task runs again; the partitions' offsets are one row each.
    """
    at, part, first = fresh(rows, "at"), fresh(rows, "part"), fresh(rows, "first")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = materialise(placed, "importance-ranges").withColumn(part, F.shiftright(at, 33))
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(part, F.coalesce(before, F.lit(0)).alias(first))  # one row for each partition
    place = F.col(first) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(offsets), part).withColumn(rank, place).drop(at, part, first)


def _weighed(docs: DataFrame, table: DataFrame, doc_id: str, text: str, max_n: int, buckets: int) -> DataFrame:
    """(id, digest, n_words, n_features, weight, copy) of each row of ``docs``."""
    words = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("digest"), words_of(F.col(text)).alias("words"))
    found = words.select("id", "digest", F.size("words").alias("n_words"), F.posexplode_outer(features_of(F.col("words"), max_n)).alias("pos", "feature"))
    found = found.withColumn("bucket", bucket_of(F.col("feature"), buckets)).join(F.broadcast(table), "bucket", "left")
    # rows of one text are next to each other, so nearly all of this sum is combined before the shuffle
    sums = found.groupBy("id", "digest").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count("feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"), F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("copies")
    )
    each = lambda c: F.expr(f"{c} div copies").alias(c)
    return sums.select("id", "digest", "n_words", each("n_features"), each("weight"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


def _drawn(docs: DataFrame, target: DataFrame, doc_id: str, text: str, max_n: int, buckets: int, min_words: int, percent: int, seed: int) -> DataFrame:
    table = gains(docs, target, text, max_n, buckets)
    rows = _weighed(docs, table, doc_id, text, max_n, buckets)
    rows = materialise(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "importance-scores")
    enough = rows.where(F.col("n_words") >= min_words)
    size = percent * enough.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("digest"), F.asc("copy")]
    placed = ranked(enough, order, "rank").withColumn("rank", F.when(F.col("rank") <= size, F.col("rank")))
    return placed.unionByName(rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def scores(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", max_n: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024
) -> DataFrame:
    """One row for each row of ``docs``: its id, n_features, weight, score, and rank if it is among the drawn ``percent`` of the documents with enough words."""
    found = _drawn(docs, target, doc_id, text, max_n, buckets, min_words, percent, seed)
    return found.select(F.col("id").alias(doc_id), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; equal ones of which some are drawn stay together."""
    settings = {"max_n": 1, "buckets": 10_000, "min_words": 20, "percent": 10, "seed": 2024} | options
    chosen = _drawn(docs, target, doc_id, text, **settings).where("rank is not null").select("id", "digest").distinct()
    key = fresh(docs, "digest")
    rows = docs.withColumn(key, F.xxhash64(text))
    same = rows[doc_id].eqNullSafe(chosen["id"]) & (rows[key] == chosen["digest"])
    return rows.join(chosen, same, "left_semi").select(*docs.columns)
