"""Taking in brands and models as they come, micro-batch by micro-batch, with the results of one batch of them all.

The names that were accepted are a stored table by buckets of the name, with the batch that brought them. A batch is judged
against the given table and what earlier batches brought, never against itself or later ones; so a batch that was broken
off, or that Spark runs again after a restart, is judged as it was the first time and overwrites what it wrote.

Submissions are taken in order of arrival: by batch, and by ``seq`` in a batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfworks.functions.numbering import number_rows
from shelfworks.operators import ingest
from shelfworks.sources.bucketed import BucketedTable
from shelfworks.sources.tables import split_judged


@dataclass
class Kind:
    """What is taken in: the id's name, the table's columns from a submission's, the name that decides, and the judge."""

    key: str
    columns: dict[str, str]
    name: Callable[[str], Column]
    judge: Callable[[DataFrame, DataFrame], DataFrame]


def brands() -> Kind:
    """Submissions (seq, brand_name) into (id_brand, brand_name)."""
    return Kind("id_brand", {"brand_name": "brand_name"}, F.col, ingest.judge_brands)


def models(brand: DataFrame) -> Kind:
    """Submissions (seq, model, brand) into (id_model, model_name, id_brand), of known brands."""
    return Kind("id_model", {"model_name": "model", "id_brand": "brand"}, F.lower, lambda model, new: ingest.judge_models(model, brand, new))


class Intake:
    """The stored outcome of a stream of submissions: accepted rows with their ids, and rejected ones by batch."""

    def __init__(self, kind: Kind, given: DataFrame, path: str, buckets: int = 64):
        self.kind, self.given, self.path, spark = kind, given, path, given.sparkSession
        self.last = given.agg(F.coalesce(F.max(kind.key), F.lit(0))).first()[0]
        if BucketedTable.exists(spark, f"{path}/taken"):
            self.taken = BucketedTable.open(spark, f"{path}/taken")
        else:
            none = given.limit(0).select(kind.key, *kind.columns, F.lit("").alias("name"), F.lit(0).cast("bigint").alias("batch"))
            self.taken = BucketedTable.create(none, f"{path}/taken", "name", buckets)

    def take(self, batch: DataFrame, number: int) -> dict[str, int]:
        """Judge one batch and store its outcome; gives the numbers of accepted and rejected rows."""
        kind, (first, *_) = self.kind, self.kind.columns.items()
        keys = batch.select(kind.name(first[1]).alias("name"))
        # what earlier batches brought under these names: only their buckets are read
        earlier = self.taken.near(keys).filter(F.col("batch") < number).select(kind.key, *kind.columns)
        judged = kind.judge(self.given.select(kind.key, *kind.columns).unionByName(earlier), batch)
        accepted, _, counts = split_judged(judged, f"{self.path}/judged/batch={number}")
        last = self.taken.rows().filter(F.col("batch") < number).agg(F.max(kind.key)).first()[0] or self.last
        new = number_rows(accepted, [F.col("seq")], "_n").withColumn(kind.key, F.col("_n") + last)
        rows = new.select(kind.key, *[F.col(theirs).alias(ours) for ours, theirs in kind.columns.items()])
        rows = rows.withColumns({"name": kind.name(first[0]), "batch": F.lit(number).cast("bigint")})
        self.taken.replace(rows, batch=str(number))
        return counts

    def table(self) -> DataFrame:
        """The given table with all accepted rows."""
        return self.given.unionByName(self.taken.rows().select(*self.given.columns))

    def rejected(self) -> DataFrame:
        """All rejected submissions with their reason and batch."""
        return self.given.sparkSession.read.parquet(f"{self.path}/judged").filter("verdict = 'rejected'").drop("verdict")

    def start(self, submissions: DataFrame, checkpoint: str, available_now: bool = False):
        """The started stream that takes in every micro-batch."""
        writer = submissions.writeStream.foreachBatch(lambda batch, number: self.take(batch, number) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
