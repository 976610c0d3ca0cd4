"""Lists laid out for paging: any page is read from the one or two files that hold it.

Rows are range-partitioned on their order, so that part after part is the whole list; every row keeps its place in its part.
An index has one row for each part (and each value of ``by`` in it): how many rows come before, and where its rows lie.
A page is found in the index and read by part and place; no task sorts or skips the rows before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfworks.operators.browse import PAGE

#: Rows of a part, about a file of 100 MB.
PART_ROWS = 1_000_000
#: monotonically_increasing_id() keeps the partition above this many bits.
_BITS = 33


class PagedTable:
    """Rows in ``order`` (within each value of ``by``) in numbered parts, with an index of them."""

    def __init__(self, spark: SparkSession, path: str, order: list[str], by: str | None = None):
        self.order, self.by = order, by
        self.all = spark.read.parquet(f"{path}/rows")
        self.index = spark.read.parquet(f"{path}/index")
        self.columns = [c for c in self.all.columns if c not in ("_part", "_pos")]

    @classmethod
    def create(cls, df: DataFrame, path: str, order: list[str], by: str | None = None, part_rows: int = PART_ROWS) -> PagedTable:
        """Lay out a list; rows that are equal in ``order`` come in any order, but stay in it."""
        spark = df.sparkSession
        keys = [F.col(c) for c in ([by] if by else []) + order]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // part_rows))
        placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
        placed = placed.withColumns({"_part": F.shiftright("_id", _BITS).cast("int"), "_pos": F.col("_id").bitwiseAND((1 << _BITS) - 1)}).drop("_id")
        placed.sortWithinPartitions("_part", "_pos").write.partitionBy("_part").parquet(f"{path}/rows")
        group = ["_part"] + ([by] if by else [])
        counts = spark.read.parquet(f"{path}/rows").groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.min("_pos").alias("first"))
        order_ = Window.partitionBy(*([by] if by else [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
        counts.withColumn("before", F.coalesce(F.sum("rows").over(order_), F.lit(0))).write.parquet(f"{path}/index")
        return cls(spark, path, order, by)

    def pages(self, value=None, size: int = PAGE) -> int:
        """How many pages there are, of one value of ``by`` where the list has one; read from the index."""
        n = self._of(value).agg(F.sum("rows")).first()[0] or 0
        return -(-n // size)

    def _of(self, value) -> DataFrame:
        return self.index.filter(F.col(self.by).eqNullSafe(F.lit(value))) if self.by else self.index

    def page(self, p: int, value=None, size: int = PAGE) -> DataFrame:
        """Page ``p`` (from 1), of one value of ``by`` where the list has one; empty beyond the end."""
        start = (p - 1) * size
        inside = (F.col("before") < start + size) & (F.col("before") + F.col("rows") > start)
        spans = self._of(value).filter(inside).collect()  # the parts that hold the page's rows: at most ``size``
        here: Column = F.lit(False)
        for s in spans:
            low = s["first"] + max(0, start - s["before"])
            high = s["first"] + min(s["rows"], start + size - s["before"]) - 1
            here = here | ((F.col("_part") == s["_part"]) & F.col("_pos").between(low, high))
        rows = self.all.filter(F.col("_part").isin([s["_part"] for s in spans]) & here)
        return rows.orderBy("_part", "_pos").select(*self.columns)

    def many(self, requests: DataFrame, size: int = PAGE) -> DataFrame:
        """page() for a table of requests (request_id, page, and a value of ``by``): their rows with ``request_id``, ``page`` and ``rn`` in the page.

        Requests meet the index by ``by`` and by stretches of as many rows as the largest part has, and the rows by part and
        place: equi-joins, of which the second prunes the parts not asked for.
        """
        start, long = (F.col("page") - 1) * size, self.index.agg(F.coalesce(F.max("rows"), F.lit(1))).first()[0]
        stretches = lambda low, n: F.sequence(F.floor(low / long), F.floor((low + n - 1) / long))
        given = requests.filter("page > 0").select("request_id", "page", *([F.col(self.by).alias("_by")] if self.by else []), F.explode(stretches(start, size)).alias("_stretch"))
        parts = self.index.select("*", F.explode(stretches(F.col("before"), F.col("rows"))).alias("_there"))
        same = (F.col("_stretch") == F.col("_there")) & (F.col("_by").eqNullSafe(F.col(self.by)) if self.by else F.lit(True))
        spans = given.join(parts, same & (F.col("before") < start + size) & (F.col("before") + F.col("rows") > start))
        # a request and a part that share two stretches meet in the first of them
        spans = spans.filter(F.col("_stretch") == F.greatest(F.floor(start / long), F.floor(F.col("before") / long)))
        low, high = F.greatest(start - F.col("before"), F.lit(0)), F.least(F.col("rows"), start + size - F.col("before")) - 1
        asked = spans.select("request_id", "page", "_part", (F.col("before") - start + 1).alias("_shift"), "first", F.explode(F.sequence(low, high)).alias("_at"))
        asked = asked.select("request_id", "page", "_part", (F.col("first") + F.col("_at")).alias("_pos"), (F.col("_at") + F.col("_shift")).alias("rn"))
        return asked.join(self.all, ["_part", "_pos"]).select("request_id", "page", "rn", *self.columns)
