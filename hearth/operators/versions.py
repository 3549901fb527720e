"""Stored tables as Parquet folders of numbered versions, whose rows are dealt to buckets by a key.

A version writes the buckets that change and, in its manifest, where every other bucket lies.
So what a small batch writes follows the batch, not the table, and a reader with some keys in
hand opens the buckets of these alone.  A version counts once its manifest is complete; one
that broke off is written again under the same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import unsorted_writes

_BUCKET = "__bucket"
SIGN = "__sign"
_MANIFEST = "bucket int, version long, n_rows long, top long"


class VersionedTable:
    """A table in ``path``; without a key it has one bucket and each version is the whole table.

    buckets: also bounds the manifest, which the driver reads: one row for each bucket, and up
    to ``max_parts`` where rows were appended.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str | None = None, buckets: int = 64, max_parts: int = 16):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.buckets, self.max_parts = buckets if key else 1, max_parts

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Versions that have a folder, complete or not."""
        fs, root = self._fs(), self._at(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def versions(self) -> list[int]:
        """The complete versions that are still there; Spark marks complete manifests with _SUCCESS."""
        fs = self._fs()
        return [n for n in self._numbers() if fs.exists(self._at(f"{self.path}/v{n}/manifest/_SUCCESS"))]

    def version(self) -> int:
        """The last complete version, 0 if there is none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> list[T.Row]:
        version = self.version() if version is None else version
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/v{version}/manifest").collect() if version else []

    def top(self, version: int | None = None) -> int:
        """The greatest id, 0 if there is none."""
        return max((r["top"] for r in self.manifest(version) if r["top"] is not None), default=0)

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int") if self.key else F.lit(0)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys in the only column of ``keys``: as many as there are buckets at most."""
        found = keys.select(self.bucket_of(F.col(keys.columns[0])).alias(_BUCKET)).distinct().collect()
        return sorted(r[0] for r in found)

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.path}/v{r['version']}/data/{_BUCKET}={r['bucket']}" for r in self.manifest(version) if wanted is None or r["bucket"] in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _commit(self, rows: DataFrame, kept: list[T.Row], version: int) -> int:
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        typed = typed.withColumn(_BUCKET, self.bucket_of(F.col(self.key) if self.key else F.lit(0)))
        data = f"{self.path}/v{version}/data"
        # a file for each bucket, several where a bucket is large: a hot key's rows aren't written by one task
        with unsorted_writes(rows.sparkSession):
            typed.hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(data)
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(_BUCKET, T.IntegerType())])).parquet(data)
        top = F.max("id").cast("long") if "id" in self.schema.names else F.lit(None).cast("long")
        new = written.groupBy(F.col(_BUCKET).alias("bucket")).agg(F.count("*").alias("n_rows"), top.alias("top")).select("bucket", F.lit(version).cast("long").alias("version"), "n_rows", "top")
        old = self.spark.createDataFrame([tuple(r) for r in kept], _MANIFEST)
        old.unionByName(new).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v{version}/manifest")
        return version

    def write(self, rows: DataFrame, buckets: list[int] | None = None, version: int | None = None) -> int:
        """The next version: ``rows`` in place of all that the named buckets hold (of everything, without names).

        version: its number, greater than the last one's, for a table that follows another.
        """
        last = self.version()
        if version is not None and version <= last:
            raise ValueError(f"version {version} isn't after version {last}")
        kept = [] if buckets is None else [r for r in self.manifest(last) if r["bucket"] not in set(buckets)]
        return self._commit(rows, kept, last + 1 if version is None else version)

    def differing(self, old: int, new: int | None = None) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
        """The parts (version, bucket) that only the old version has, and those that only the new one has."""
        before, after = ({(r["version"], r["bucket"]) for r in self.manifest(v)} for v in (old, new))
        return before - after, after - before

    def changes(self, old: int, new: int | None = None) -> DataFrame:
        """What leads from one version to another: rows with ``__sign`` -1 that go and 1 that come.

        Only parts that differ are read; a row that lies in a part written anew comes with both
        signs, which cancel in any sum.
        """
        out = self.spark.createDataFrame([], self.schema).withColumn(SIGN, F.lit(0))
        for sign, parts in zip((-1, 1), self.differing(old, new), strict=True):
            paths = [f"{self.path}/v{v}/data/{_BUCKET}={b}" for v, b in sorted(parts)]
            if paths:
                out = out.unionByName(self.spark.read.schema(self.schema).parquet(*paths).withColumn(SIGN, F.lit(sign)))
        return out

    def append(self, rows: DataFrame) -> int:
        """The next version: ``rows`` beside all others.  Buckets of ``max_parts`` parts are put together."""
        last = self.version()
        held = self.manifest(last)
        parts = [r["bucket"] for r in held]
        full = {b for b in parts if parts.count(b) >= self.max_parts}
        names = self.schema.names
        if full:
            rows = rows.select(*names).unionByName(self.read(sorted(full), last))
        return self._commit(rows, [r for r in held if r["bucket"] not in full], last + 1)

    def vacuum(self, keep: int = 2) -> int:
        """Delete what the last ``keep`` versions don't need; the number of folders deleted.

        A batch that runs again reads the version before its own, so keep two at least.
        """
        stay = self.versions()[-max(keep, 1) :]
        needed = {(r["version"], r["bucket"]) for v in stay for r in self.manifest(v)}
        fs, gone = self._fs(), 0
        for version in self._numbers():
            if not stay or version >= stay[0]:
                break
            folder, data = f"{self.path}/v{version}", self._at(f"{self.path}/v{version}/data")
            names = [s.getPath().getName() for s in fs.listStatus(data)] if fs.exists(data) else []
            # the manifest goes first: a version without one doesn't count
            fs.delete(self._at(f"{folder}/manifest"), True)
            for name in names:
                if name.startswith(f"{_BUCKET}=") and (version, int(name.split("=")[1])) not in needed:
                    gone += bool(fs.delete(self._at(f"{folder}/data/{name}"), True))
            if not any(v == version for v, _ in needed):
                fs.delete(self._at(folder), True)
        return gone
