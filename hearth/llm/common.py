"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import clear, materialise, shared_dir

__all__ = ["BATCH_ROWS", "BATCH_SIZE", "broadcast_if_small", "clear", "crc_mod", "fresh", "lower_ascii", "materialise", "share", "shared_dir", "slices", "small_batches", "texts"]


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if ``df`` has at most ``max_rows`` rows; give it a written frame, whose count is in its files.

    Larger sides stay without a hint: Spark sorts and merges, and splits skewed keys.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` with which no column of ``df`` begins, whatever its case."""
    name = f"__{name}"
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo ``n`` (null stays null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows and bytes of a batch between the JVM and Python: texts are long, and a batch is held on both sides.
BATCH_ROWS, BATCH_SIZE = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands at most ``BATCH_ROWS`` rows at a time to Python, or fewer if it did so before.

    A batch ends at ``BATCH_SIZE`` bytes, unless the session sets another size.  The
    settings count when a job begins, long after this call, so they stay.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_SIZE))
    return df


def share(sc: SparkContext, value: object):
    """A broadcast variable; callers state what bounds the size of ``value``."""
    return sc.broadcast(value)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null gives empty bytes."""
    values = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in values.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column_at = batch.schema.get_field_index(column)
        begin, size = 0, 0
        lengths = pa.compute.binary_length(batch.column(column_at)).to_pylist()
        for i, n in enumerate(lengths):
            if i > begin and size + (n or 0) > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n or 0
        yield batch.slice(begin)
