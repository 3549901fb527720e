"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written in this process, by application.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local(spark.sparkContext.applicationId)
    return root.rstrip("/")


_folders: dict[str, str] = {}


def _local(application: str) -> str:
    if application not in _folders:
        _folders[application] = tempfile.mkdtemp(prefix="hearth-shared-")
    return _folders[application]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; ``clear`` deletes what is there."""
    path = f"{shared_dir(spark)}/hearth/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage so that the rows are computed once and a lost executor costs
    no recomputation.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application; call it when its results are written.

    Frames that were made before can't be read afterwards.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
