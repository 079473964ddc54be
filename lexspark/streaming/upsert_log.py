"""An upsert sink as a log: each batch appends its own newest values, reads merge, and touched buckets are compacted."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets by key, and batches after which what they touched is compacted.
BUCKETS, EVERY = 16, 4


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder of any store that Spark opens; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(at) if f.isDirectory()] if store.exists(at) else []


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _numbers(names: list[str], name: str) -> list[int]:
    return sorted(int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}="))


def _merged(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row for each key: of each field the struct of highest order. Merging twice, or in parts, changes nothing."""
    return rows.groupBy("bucket", *keys).agg(*[F.max(c).alias(c) for c in fields])


class UpsertLog:
    """The newest value of each field of each key, at `path`, as batches of rows come in.

    path/delta/batch=n/bucket=b holds what batch n brought: one row for each of its keys, for each field the newest value
    that isn't null with the order it came at. Every `every` batches the buckets that they touched are merged with their
    base to path/base/v=n/bucket=b; then older bases of those buckets and the deltas up to n go. A read takes of each
    bucket the newest complete base and the deltas behind it. So a batch writes what it brings, and a bucket is written
    anew only if it was touched. A batch that comes again overwrites its own delta, or, if it is in a base already,
    merges to the same. keys must not be null; of rows of one order in all columns the larger value counts.
    """

    def __init__(self, path: str, keys: list[str], order: list[str], fields: list[str], buckets: int = BUCKETS, every: int = EVERY):
        self.path, self.keys, self.order, self.fields, self.buckets, self.every = path.rstrip("/"), keys, order, fields, buckets, every

    def append(self, batch: DataFrame, number: int) -> None:
        """Write one batch; after every `every`-th compact."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
        values = [F.when(F.col(c).isNotNull(), F.struct(*self.order, F.col(c).alias("value"))).alias(c) for c in self.fields]
        rows = _merged(batch.select(bucket, *self.keys, *values), self.keys, self.fields)
        # one file for each bucket and batch, however many tasks there are
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/delta/batch={number}")
        if (number + 1) % self.every == 0:
            self.compact(batch.sparkSession, number)

    def _bases(self, spark: SparkSession) -> dict[int, int]:
        """The newest complete base of each bucket."""
        found: dict[int, int] = {}
        for v in _numbers(_folders(spark, f"{self.path}/base"), "v"):
            if _there(spark, f"{self.path}/base/v={v}/_SUCCESS"):
                found |= {b: v for b in _numbers(_folders(spark, f"{self.path}/base/v={v}"), "bucket")}
        return found

    def _rows(self, spark: SparkSession, only: list[int] | None = None, upto: int | None = None) -> DataFrame | None:
        """Rows of bases and deltas, not yet merged, of some buckets and up to some batch; None if there are none."""
        bases = self._bases(spark)
        parts = []
        for v in sorted(set(bases.values())):
            own = [f"{self.path}/base/v={v}/bucket={b}" for b, w in bases.items() if w == v and (only is None or b in only)]
            if own:
                parts.append(spark.read.option("basePath", f"{self.path}/base/v={v}").parquet(*own))
        for n in _numbers(_folders(spark, f"{self.path}/delta"), "batch"):
            fresh = [b for b in _numbers(_folders(spark, f"{self.path}/delta/batch={n}"), "bucket") if bases.get(b, -1) < n and (only is None or b in only)]
            if fresh and (upto is None or n <= upto) and _there(spark, f"{self.path}/delta/batch={n}/_SUCCESS"):
                parts.append(spark.read.option("basePath", f"{self.path}/delta/batch={n}").parquet(*[f"{self.path}/delta/batch={n}/bucket={b}" for b in fresh]))
        names = ["bucket", *self.keys, *self.fields]
        return reduce(DataFrame.unionByName, [p.select(*names) for p in parts]) if parts else None

    def compact(self, spark: SparkSession, number: int) -> None:
        """Merge the buckets that deltas up to `number` touch into bases; drop what these replace. Again: changes nothing."""
        deltas = [n for n in _numbers(_folders(spark, f"{self.path}/delta"), "batch") if n <= number]
        target = f"{self.path}/base/v={number}"
        if not _there(spark, f"{target}/_SUCCESS"):
            touched = sorted({b for n in deltas for b in _numbers(_folders(spark, f"{self.path}/delta/batch={n}"), "bucket")})
            rows = self._rows(spark, touched, number)
            if rows is None:
                return
            _merged(rows, self.keys, self.fields).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        newest = self._bases(spark)
        for v in _numbers(_folders(spark, f"{self.path}/base"), "v"):
            for b in _numbers(_folders(spark, f"{self.path}/base/v={v}"), "bucket"):
                if v < newest.get(b, v):
                    _drop(spark, f"{self.path}/base/v={v}/bucket={b}")
            if v < number and not _numbers(_folders(spark, f"{self.path}/base/v={v}"), "bucket"):
                _drop(spark, f"{self.path}/base/v={v}")
        for n in deltas:
            _drop(spark, f"{self.path}/delta/batch={n}")

    def read(self, spark: SparkSession) -> DataFrame:
        """keys and fields, one row for each key. Raises AnalysisException if nothing was written."""
        rows = self._rows(spark)
        if rows is None:
            raise AnalysisException(f"no upserts at {self.path}")
        return _merged(rows, self.keys, self.fields).select(*self.keys, *[F.col(f"{c}.value").alias(c) for c in self.fields])

    def start(self, events: DataFrame, checkpoint: str):
        """A query that appends each batch of a stream."""
        return events.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
