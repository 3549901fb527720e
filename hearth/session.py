"""Sessions: settings that every job wants, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Settings that don't depend on the cluster; sizes of partitions are left to it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
_shipped: set[str] = set()


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with ``SETTINGS``, then ``settings`` (dots written as double underscores)."""
    builder = SparkSession.builder.appName("hearth")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Batches to Python end at ``size`` in this session, unless a bound is set: rows that hold whole pages or lists are many MB otherwise."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, size)


@contextmanager
def unsorted_writes(spark: SparkSession, files: int = 64) -> Iterator[None]:
    """Within it a task that writes folders by a key has up to ``files`` open at once; without, it sorts (and spills) its rows by the key before."""
    before = spark.conf.get(_OPEN_FILES, None)
    spark.conf.set(_OPEN_FILES, files)
    try:
        yield
    finally:
        spark.conf.set(_OPEN_FILES, before) if before is not None else spark.conf.unset(_OPEN_FILES)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="hearth-ship-"), "hearth_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
