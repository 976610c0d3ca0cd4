"""Mixing sources to target weights.

Each source's documents, in the order of their ids, are one stream of words that is packed into fixed-length blocks. A
source gets as many slots as its target asks for. Slots are dealt to output shards by multinomial draws that keep each
source's total: every seeded draw halves a range of shards. A source's ranges of a few shards are found first and dealt
out; each is then halved further by itself, and ranges without slots are not walked. A slot's number goes through its source's pseudorandom
permutation of block numbers (a Feistel network per pass over the source), and blocks are joined by that index.

Defined cases: a null text has no words; documents without words are taken 0 times; a null source is a source of its
own, last in order; repeated rows are documents of their own; long documents span many blocks; an empty table gives an
empty result; other columns are ignored. All draws are seeded by the source's name, so reruns agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfworks.functions.numbering import in_order, number_rows
from shelfworks.llm.shared import in_batches, small, table, written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 64
SHARD_BLOCKS = 16_384
#: Shards of a source that one row stands for until they are dealt one by one.
SHARD_RANGE = 8
SEED = 20_240


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, source, tie, size`` of every document; ``tie`` orders rows of one id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len((t.as_py() or "").encode().split()) for t in b.column("body")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), b.column("tie"), pa.array(n, pa.int64())], names=["doc_id", "source", "tie", "size"]
            )

    picked = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("tie"), F.col(text).alias("body"))
    kind = dict(picked.dtypes)["doc_id"]
    return in_batches(picked).mapInArrow(count, f"doc_id {kind}, source string, tie bigint, size bigint")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """``sid, source, source_size, weight, target`` of every source: shares by weight, stopped at ``most`` times the size."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(sizes, [F.col("source").asc_nulls_last()], "sid")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = written(ranked.withColumn("weight", F.get(cycle, ((F.col("sid") - 1) % len(weights)).cast("int"))), "sources")
    cap, level, stopped = F.col("source_size") * float(most), None, -1
    while True:  # each round stops more sources; only sums come to the driver
        over = F.lit(False) if level is None else cap <= F.col("weight") * level
        total, held, free, n = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(over, 1)),
        ).first()
        if n == stopped or not free:
            break
        stopped, level = n, (total - held) / free
    return weighed.withColumn("target", F.least(cap, F.col("weight") * F.lit(level or 0.0)))


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big")


def dealt(seed: int, source: str | None, lo: int, hi: int, first: int, slots: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """``lo, hi, first, slots`` of the ranges of at most ``width`` shards below [lo, hi) that get slots: one seeded binomial draw per halving.

    The draws depend on the ranges alone, so a range may be walked on elsewhere.
    """
    open_ = [(lo, hi, first, slots)]
    while open_:
        lo, hi, first, slots = open_.pop()
        if not slots:
            continue
        if hi - lo <= width:
            yield lo, hi, first, slots
            continue
        mid = (lo + hi) // 2
        left = int(np.random.default_rng(_seed(seed, source, lo, hi)).binomial(slots, (mid - lo) / (hi - lo)))
        open_ += [(mid, hi, first + left, slots - left), (lo, mid, first, left)]


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A bijection of 0..size-1 for each key: four Feistel rounds, walked until the value falls inside."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> bits[todo], out[todo] & mask[todo]
            for r in range(4):
                turn = _mix64(right + key[todo] + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) & mask[todo]
                left, right = right, left ^ turn
            out[todo] = (left << bits[todo]) | right
            todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def packed_blocks(sized: DataFrame, targets: DataFrame, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The documents with a row number ``rid`` and their source's figures; and their parts: ``sid, block, rid, at, words``."""
    known = targets.select("sid", F.col("source").alias("_s"), "source_size", "target")
    joined = sized.join(small(known), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = in_order(joined, [F.col("sid"), F.col("doc_id"), F.col("tie")])

    local = Window.partitionBy("_pid", "sid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_pid", "sid").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("sid").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select("_pid", "sid", "_base")
    rows = placed.withColumn("_in", F.coalesce(F.sum("size").over(local), F.lit(0))).join(bases, ["_pid", "sid"])
    rows = rows.withColumn("rid", F.shiftleft("_pid", 33) + F.col("_pos")).withColumn("start", F.col("_base") + F.col("_in"))
    full = rows.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    )
    from_word = F.greatest(F.col("block") * block, F.col("start"))
    to_word = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    parts = full.select("sid", "block", "rid", "doc_id", "tie", (from_word - F.col("start")).alias("at"), (to_word - from_word).alias("words"))
    return placed.withColumn("rid", F.shiftleft("_pid", 33) + F.col("_pos")).drop("_pid", "_pos"), parts


def slots(targets: DataFrame, block: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """One row for each slot of the mix: ``shard, sid, slot, block``."""
    sized = targets.filter("source_size > 0").select(
        "sid", "source", F.ceil(F.col("source_size") / block).cast("long").alias("blocks"), "source_size", "target"
    )
    sized = sized.withColumn("n", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_blocks))

    key = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(seed))
    whole = sized.select("sid", "source", "blocks", key.alias("key"), F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.lit(0).cast("long").alias("first"), "n")
    names = whole.columns

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each source's ranges of SHARD_RANGE shards."""
        for b in batches:
            for r in b.to_pylist():
                got = list(dealt(seed, r["source"], r["lo"], r["hi"], r["first"], r["n"], SHARD_RANGE))
                if got:
                    yield pa.RecordBatch.from_pylist([r | dict(zip(("lo", "hi", "first", "n"), x)) for x in got], schema=b.schema)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each range's shards with their slots and the blocks that these stand for."""
        for b in batches:
            for r in b.to_pylist():
                for shard, _, first, n in dealt(seed, r["source"], r["lo"], r["hi"], r["first"], r["n"], 1):
                    for at in range(first, first + n, 1 << 16):
                        slot = np.arange(at, min(at + (1 << 16), first + n), dtype=np.int64)
                        with np.errstate(over="ignore"):
                            turn = _mix64(np.uint64(r["key"] % (1 << 64)) + (slot // r["blocks"]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                        block = permuted(slot % r["blocks"], np.full(len(slot), r["blocks"]), turn)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(slot), x)) for x in (shard, r["sid"])] + [pa.array(slot), pa.array(block)], names=["shard", "sid", "slot", "block"]
                        )

    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, which is not merged into one task
    kinds = "sid bigint, source string, blocks bigint, key bigint, lo bigint, hi bigint, first bigint, n bigint"
    parts = in_batches(whole.repartition(tasks, "sid")).mapInArrow(ranges, kinds).repartition(tasks, "sid", "lo")
    return in_batches(parts.select(*names)).mapInArrow(numbers, "shard bigint, sid bigint, slot bigint, block bigint")


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, block: int = BLOCK_WORDS) -> dict[str, DataFrame]:
    """The mix as tables: ``documents`` (with rid), ``targets``, ``parts`` of blocks and ``slots`` of shards."""
    sized = written(word_counts(docs), "sizes")
    targets = written(source_targets(sized, weights, most), "targets")
    documents, parts = packed_blocks(sized, targets, block)
    return {"documents": documents, "targets": targets, "parts": parts, "slots": slots(targets, block)}


def mixed_words(docs: DataFrame, mixed: dict[str, DataFrame]) -> DataFrame:
    """The mix itself: ``shard, sid, slot, doc_id, at, text``, a row for each document's part of each slot."""

    spans = mixed["slots"].join(mixed["parts"], ["sid", "block"])
    words = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "").alias("_w")).dropDuplicates(["doc_id", "tie"])
    return spans.join(words, ["doc_id", "tie"]).select(
        "shard", "sid", "slot", "doc_id", "at", F.array_join(F.slice("_w", F.col("at").cast("int") + 1, F.col("words").cast("int")), " ").alias("text")
    )


def takes(docs: DataFrame, weights=WEIGHTS, most: float = MOST, block: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document: the words that the mix takes of it."""
    m = mix(docs, weights, most, block)
    times = m["slots"].groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    # the planner takes exploded tables for as small as what they are exploded from: no broadcast here
    taken = m["parts"].join(times.hint("merge"), ["sid", "block"]).groupBy("rid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return m["documents"].join(taken.hint("merge"), "rid", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, with the words that the mix takes of each."""
    return takes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
