"""Global row numbers and running sums without a single-task window.

Rows are range-partitioned on their order, numbered inside each partition, and shifted by the totals of the partitions
before; only one row per partition (and key) goes through the window that adds those up.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id() keeps the partition above this many bits.
_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session (all of whose tasks run in the driver) gets a temporary folder; a cluster gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("shelfworks.shared.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shelfworks-")
        spark.conf.set("shelfworks.shared.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage is cut and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_for(spark: SparkSession, folder: str, batch: str | None, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives for a batch, written beside a table: a batch of the same name that is run again gets the same rows."""
    if batch is None:
        return written(make(), "batch")
    path = f"{folder}/_batches/{batch}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def in_order(df: DataFrame, order: list[Column], pid: str = "_pid", pos: str = "_pos") -> DataFrame:
    """Rows in range partitions of ``order``, with their partition and their place in it, written so that both stay."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return written(
        placed.withColumn(pid, F.shiftright("_id", _BITS)).withColumn(pos, F.col("_id").bitwiseAND((1 << _BITS) - 1)).drop("_id"), "ordered"
    )


def number_rows(df: DataFrame, order: list[Column], name: str = "n", by: list[str] | None = None) -> DataFrame:
    """Add the row number from 1 in ``order``, within each value of the columns ``by``.

    ``order`` starts with the columns ``by`` where those are given, so that a group lies in neighbouring partitions.
    """
    by = by or []
    placed = in_order(df, order)
    counts = placed.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = F.lit(True)
    renamed = bases.select(*[F.col(c).alias(f"_b_{c}") for c in ("_pid", *by)], "_base", "_first")
    for c in ("_pid", *by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return placed.join(renamed, same).select(
        *df.columns, (F.col("_base") + F.col("_pos") - F.col("_first") + 1).alias(name)
    )


def beside(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, after: bool = False) -> DataFrame:
    """Add ``value`` of the row before (or after) in ``order`` within ``by``, in a struct that is null where there is no such row.

    A group lies in as many range partitions as it needs; of each partition one row for each of its groups meets the others.
    """
    placed = in_order(df.withColumn(name, F.struct(value.alias("v"))), [F.col(c) for c in (*by, *order)])
    step, end = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    within = step(name).over(Window.partitionBy("_pid", *by).orderBy("_pos"))
    ends = placed.groupBy("_pid", *by).agg(end(name, "_pos").alias("_end"))
    across = ends.select(*[F.col(c).alias(f"_b_{c}") for c in ("_pid", *by)], step("_end").over(Window.partitionBy(*by).orderBy("_pid")).alias("_end"))
    across = across.filter("_end IS NOT NULL")  # only groups of several partitions: few rows
    same = F.lit(True)
    for c in ("_pid", *by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    # within a partition only the row at its end has no neighbour there
    return placed.withColumn(name, within).join(across, same, "left").select(*df.columns, F.coalesce(name, "_end").alias(name))
