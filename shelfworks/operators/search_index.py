"""A stored index for word search, in which a text looks no farther than it must.

The catalogue's distinct names (brand and model, with the k lowest ids that bear them) are put in order of their lowest id
and cut into blocks; blocks are gathered in levels, each twice as long as the one before. A posting says that a block
has a name with a piece of a word. A search goes from level to level: texts meet the blocks that have all their pieces,
and those blocks' names. A text is done as soon as its k-th hit has a lower id than anything in the levels to come, so a
common word is settled among the first blocks, and only texts that few names hold go on, to few blocks.

Changed names are taken in as a further segment that voids their older entries; nothing else is indexed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfworks.functions.numbering import number_rows, written
from shelfworks.operators.search import HITS, all_terms_in, asked_pieces, held_pieces, terms_of, top_k

#: Names of a block.
BLOCK = 1_000
#: Names, or postings, of a level up to which it is broadcast (about 20 MB); beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000
_NAME = ["brand", "model"]


def lowest_of(cat: DataFrame, k: int) -> DataFrame:
    """``brand, model, ids``: every name that can be found with its k lowest ids."""
    order = Window.partitionBy(*_NAME).orderBy("id_phone")
    some = cat.filter(F.coalesce("brand", "model").isNotNull()).select("id_phone", *_NAME).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    return some.groupBy(*_NAME).agg(F.sort_array(F.collect_list("id_phone")).alias("ids"))


class SearchIndex:
    """Segments of names and postings in a folder, each by level."""

    def __init__(self, spark: SparkSession, path: str, k: int = HITS):
        self.spark, self.path, self.k = spark, path, k

    @classmethod
    def build(cls, cat: DataFrame, path: str, k: int = HITS, block: int = BLOCK) -> SearchIndex:
        """Index a flat catalogue."""
        index = cls(cat.sparkSession, path, k)
        index._add(0, lowest_of(cat, k), block)
        return index

    def update(self, cat: DataFrame, changed: DataFrame, block: int = BLOCK) -> None:
        """Take in the names (brand, model) of which phones came, went or were renamed; ``cat`` is the catalogue as it is now."""
        segment = 1 + max(r.segment for r in self._levels())
        names = written(changed.select(F.col("brand").alias("_b"), F.col("model").alias("_m")).distinct(), "changed-names")
        same = F.col("brand").eqNullSafe(F.col("_b")) & F.col("model").eqNullSafe(F.col("_m"))
        names.write.parquet(f"{self.path}/changed/segment={segment}")
        self._add(segment, lowest_of(cat.join(names, same, "left_semi"), self.k), block)

    def _add(self, segment: int, lowest: DataFrame, block: int) -> None:
        numbered = number_rows(lowest.withColumn("low", F.get("ids", F.lit(0))), [F.col("low"), *map(F.col, _NAME)], "_n")
        placed = numbered.withColumn("block", F.floor((F.col("_n") - 1) / block))
        placed = placed.withColumn("level", F.length(F.bin(F.col("block") + 1)) - 1).drop("_n")
        at = f"segment={segment}"
        placed.write.partitionBy("level").parquet(f"{self.path}/names/{at}")
        names = self.spark.read.schema(placed.schema).parquet(f"{self.path}/names/{at}")
        posted = names.select("level", "block", F.explode(held_pieces(F.col("brand"), F.col("model"))).alias("piece")).distinct()
        posted.write.partitionBy("level").parquet(f"{self.path}/postings/{at}")
        sizes = names.groupBy("level").agg(F.count(F.lit(1)).alias("names"), F.min("low").alias("low")).withColumn("segment", F.lit(segment))
        postings = self.spark.read.schema(posted.schema).parquet(f"{self.path}/postings/{at}").groupBy("level").agg(F.count(F.lit(1)).alias("postings"))
        sizes.join(postings, "level", "left").coalesce(1).write.mode("append").parquet(f"{self.path}/levels")

    def _levels(self) -> list:
        """(segment, level, names, postings, low) in order of the lowest id: a few dozen rows for each segment."""
        return self.spark.read.parquet(f"{self.path}/levels").orderBy("low", "segment", "level").collect()

    def _part(self, kind: str, level) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}/segment={level.segment}/level={level.level}")

    def _names(self, level, segments: int) -> DataFrame:
        """Names of a level that no later segment has changed."""
        names = self._part("names", level)
        for later in range(level.segment + 1, segments):
            changed = self.spark.read.parquet(f"{self.path}/changed/segment={later}")
            names = names.join(changed, F.col("brand").eqNullSafe(F.col("_b")) & F.col("model").eqNullSafe(F.col("_m")), "left_anti")
        return names

    def search(self, queries: DataFrame, looked: list[int] | None = None) -> DataFrame:
        """search() for every row of ``queries`` (query_id, text): ``query_id, rn, id_phone, brand, model``.

        ``looked`` gets, for each level that is visited, how many pairs of a text and a name were tested.
        """
        levels, k = self._levels(), self.k
        segments = 1 + max((x.segment for x in levels), default=0)
        texts = written(queries.select("text").dropna().distinct().withColumn("pieces", asked_pieces(F.col("text"))), "texts")
        wordless = True
        best = self.spark.createDataFrame([], "text string, id_phone bigint, brand string, model string")
        open_ = texts
        for n, level in enumerate(levels):
            names, postings = self._names(level, segments), self._part("postings", level)
            names = F.broadcast(names) if level.names <= BROADCAST_ROWS else names
            postings = F.broadcast(postings) if (level.postings or 0) <= BROADCAST_ROWS else postings
            asked = open_.select("text", F.size("pieces").alias("asked"), F.explode("pieces").alias("piece"))
            blocks = asked.join(postings, "piece").groupBy("text", "block", "asked").agg(F.count(F.lit(1)).alias("found")).filter("found = asked").select("text", "block")
            tested = blocks.join(names, "block")
            hits = tested.filter(all_terms_in(terms_of(F.col("text")), F.col("brand"), F.col("model"))).select("text", F.explode("ids").alias("id_phone"), *_NAME)
            if wordless and (wordless := not (every := open_.filter(F.size("pieces") == 0)).isEmpty()):
                lowest = names.select(F.explode("ids").alias("id_phone"), *_NAME).orderBy("id_phone").limit(k).collect()
                rows = [F.struct(F.lit(r.id_phone).cast("bigint").alias("id_phone"), *[F.lit(r[c]).cast("string").alias(c) for c in _NAME]) for r in lowest]
                hits = hits.union(every.select("text", F.inline(F.array(*rows)))) if rows else hits
            best = written(top_k(best.union(hits), k, "text").drop("rn"), "best-hits")
            if looked is not None:
                looked.append(tested.count())
            if n + 1 < len(levels):
                done = best.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.max("id_phone").alias("last"))
                done = done.filter((F.col("n") == k) & (F.col("last") < levels[n + 1].low))
                open_ = written(open_.join(done, "text", "left_anti"), "open-texts")
                if open_.isEmpty():
                    break
        return queries.join(top_k(best, k, "text"), "text").select("query_id", "rn", "id_phone", "brand", "model")
