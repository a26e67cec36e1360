"""Keyed state as a table in buckets: joined without an exchange of the state, rewritten a bucket at a time.

A row lies in the bucket that Spark's hash of its key gives. Buckets are the table's partitions and its Parquet bucketing
at once: as bucketing, they let a join by key read the state as it lies; as partitions, they let an upsert read and
overwrite (dynamically) the touched buckets alone, so files of the others stay as they are.

An upsert is staged first: new rows of the touched buckets are written, then a note of them, then the buckets are
overwritten, then the note goes. A run that dies before the note has changed nothing, and one that dies behind it is
finished by whoever opens the table next, so half an upsert is never read. One writer at a time.

Cases: a null key has a bucket like any; an empty upsert changes nothing; a bucket that an upsert leaves empty is deleted; rows
of equal keys all stay (the step decides); the number of buckets and the columns are the table's for good.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.session import discard, materialize

_BUCKET, _DYNAMIC = "bucket_no", "spark.sql.sources.partitionOverwriteMode"


class StateTable:
    """columns: DDL without a bucket column; key: the columns that joins go by."""

    def __init__(self, spark: SparkSession, path: str, columns: str, key: tuple[str, ...], buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.name = f"state_{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        clustered = ", ".join(f"`{x}`" for x in key)
        spark.sql(
            f"create table {self.name} ({columns}, {_BUCKET} int) using parquet options (compression 'zstd') partitioned by ({_BUCKET}) "
            f"clustered by ({clustered}) sorted by ({clustered}) into {buckets} buckets location '{self.path}'"
        )
        self.columns = [x for x in spark.table(self.name).columns if x != _BUCKET]
        self._sync()
        self._finish()

    def _sync(self) -> None:
        """The session's catalog has the buckets that are there."""
        self.spark.sql(f"msck repair table {self.name} sync partitions")

    def _bucket(self, *key: str | Column) -> Column:
        return F.pmod(F.hash(*key), F.lit(self.buckets))

    def read(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.columns)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in keys.select(self._bucket(*keys.columns).alias("b")).distinct().collect())

    def part(self, buckets: list[int]) -> DataFrame:
        """The rows of some buckets; only their files are read."""
        return self.spark.table(self.name).where(F.col(_BUCKET).isin(buckets)).select(*self.columns)

    def upsert(self, keys: DataFrame, step: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replaces the rows of the buckets that keys (the key columns) touch by what step makes of them; gives the buckets.

        step gets all rows of the touched buckets and must give all that are to stay, none of another bucket.
        """
        buckets = self.touched(keys)
        if not buckets:
            return []
        rows = step(self.part(buckets)).select(*self.columns).withColumn(_BUCKET, self._bucket(*self.key))
        astray = F.when(~F.col(_BUCKET).isin(buckets), F.raise_error(F.lit("a row of a bucket that wasn't touched")))
        rows = rows.withColumn(_BUCKET, F.coalesce(astray.cast("int"), F.col(_BUCKET)))
        _, staged = materialize(rows, "state-staged")
        note = self.spark.createDataFrame([(staged, buckets)], "staged string, buckets array<int>")
        note.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_pending")
        self._finish()
        return buckets

    def _pending(self) -> tuple[str, list[int]] | None:
        """The note of an upsert that is staged in whole, if there is one."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_pending/_SUCCESS")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            return None
        return tuple(self.spark.read.parquet(f"{self.path}/_pending").first())

    def _finish(self) -> None:
        """Puts a staged upsert in the place of its buckets; doing it again changes nothing."""
        if (note := self._pending()) is None:
            return
        staged, buckets = note
        rows = self.spark.read.parquet(staged)
        left = {r[0] for r in rows.select(_BUCKET).distinct().collect()}
        before = self.spark.conf.get(_DYNAMIC)
        self.spark.conf.set(_DYNAMIC, "dynamic")
        try:
            rows.repartition(self.buckets, *self.key).select(*self.columns, _BUCKET).write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(_DYNAMIC, before)
        discard(self.spark, *[f"{self.path}/{_BUCKET}={b}" for b in buckets if b not in left])
        self._sync()
        discard(self.spark, f"{self.path}/_pending", staged)

    def close(self) -> None:
        """Takes the name out of the session; the files stay."""
        self.spark.sql(f"drop table if exists {self.name}")


def all_names(rows: DataFrame, *columns: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """(key): every name that rows have in some columns and arrays, nulls aside; what an upsert by names touches."""
    parts = [F.array(*[F.col(c).cast("string") for c in columns]), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists]]
    return rows.select(F.explode(F.array_compact(reduce(F.concat, parts))).alias("key"))
