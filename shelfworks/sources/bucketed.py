"""Tables whose rows are replaced by key without rewriting the rest.

A table lies in a folder of Parquet files by bucket, the hash of its key modulo a fixed number. A batch of changes reads and
rewrites only the buckets that its keys fall into, by dynamic partition overwrite; files of all other buckets stay as
they are. Where a catalogue has row-level changes of its own, merge_into() leaves the work to it.

A batch is first staged beside the table and then moved in, and its stage goes last. A batch that has a name and is run
again takes up where it was broken off: from its stage, never from buckets that it has half rewritten; one that was
finished before does nothing. One writer at a time; readers should not read while a batch moves in.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256


class BucketedTable:
    """A table by buckets of one key column. Keys need not be distinct: all rows of a key are replaced together."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int, schema: T.StructType):
        self.spark, self.path, self.key, self.buckets, self.schema = spark, path, key, buckets, schema
        self.bucket = "_bucket"
        while self.bucket in schema.names:
            self.bucket += "_"

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> BucketedTable:
        """Write a table; its key, number of buckets and schema are kept beside it."""
        table = cls(df.sparkSession, path, key, buckets, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]))
        table._write(df, path)
        about = json.dumps({"key": key, "buckets": buckets, "schema": table.schema.jsonValue()})
        df.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/_table")
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BucketedTable:
        """A table that create() has written."""
        about = json.loads(spark.read.text(f"{path}/_table").first().value)
        return cls(spark, path, about["key"], about["buckets"], T.StructType.fromJson(about["schema"]))

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        """Whether create() has finished a table there."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_table/_SUCCESS")
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def bucket_of(self, key: str | Column) -> Column:
        """The bucket of a key."""
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, path: str) -> None:
        # rebalanced: a bucket that is large for a task is written by several
        placed = df.withColumn(self.bucket, self.bucket_of(self.key)).hint("rebalance", self.bucket)
        placed.write.partitionBy(self.bucket).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(self.bucket, T.IntegerType())])).parquet(path)

    def rows(self) -> DataFrame:
        """All rows."""
        return self._read(self.path).drop(self.bucket)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that keys fall into: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket_of(self.key)).distinct().collect())

    def near(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that keys fall into; no other file is read."""
        return self._read(self.path).filter(F.col(self.bucket).isin(self.touched(keys))).drop(self.bucket)

    def replace(self, rows: DataFrame, keys: DataFrame | None = None, batch: str | None = None) -> None:
        """Put ``rows`` in place of all rows that have one of their keys, or of ``keys``; rows with a null key are only added."""
        batch = batch or uuid.uuid4().hex
        stage, done = f"{self.path}/_staged/{batch}", f"{self.path}/_done/{batch}"
        if self._there(done):
            return
        if not self._there(f"{stage}/rows/_SUCCESS"):
            new = rows.select(*self.schema.names)
            gone = new.select(self.key) if keys is None else new.select(self.key).union(keys.select(self.key))
            touched = self.touched(gone)
            self.spark.createDataFrame([(json.dumps(touched),)], "value string").coalesce(1).write.mode("overwrite").text(f"{stage}/touched")
            old = self._read(self.path).filter(F.col(self.bucket).isin(touched)).drop(self.bucket)
            # the batch's keys, each once, meet only the touched buckets
            self._write(old.join(gone.distinct(), self.key, "left_anti").unionByName(new), f"{stage}/rows")
        touched = json.loads(self.spark.read.text(f"{stage}/touched").first().value)
        staged = self._read(f"{stage}/rows")
        left = {r[0] for r in staged.select(self.bucket).distinct().collect()}
        # staged files hold one bucket each: they are copied as they lie, without a shuffle
        staged.write.partitionBy(self.bucket).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        for b in touched:
            if b not in left:  # nothing is left in it, which an overwrite cannot say
                self._delete(f"{self.path}/{self.bucket}={b}")
        self.spark.createDataFrame([("",)], "value string").coalesce(1).write.mode("overwrite").text(done)
        self._delete(stage)

    def remove(self, keys: DataFrame, batch: str | None = None) -> None:
        """Drop all rows of these keys; keys that are not there do nothing."""
        self.replace(self.spark.createDataFrame([], self.schema), keys, batch)

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _there(self, path: str) -> bool:
        fs, at = self._hadoop(path)
        return fs.exists(at)

    def _delete(self, path: str) -> None:
        fs, at = self._hadoop(path)
        fs.delete(at, True)


def merge_into(rows: DataFrame, table: str, key: str) -> None:
    """Replace or add whole rows by key in a catalogue's table that has row-level changes."""
    same = F.col(f"{table}.{key}") == F.col(f"source.{key}")
    rows.alias("source").mergeInto(table, same).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def save(target: BucketedTable | str, rows: DataFrame, key: str, batch: str | None = None) -> None:
    """Whole rows by key into a table by buckets, or into a catalogue's table by its name."""
    if isinstance(target, str):
        merge_into(rows, target, key)
    else:
        target.replace(rows, batch=batch)
