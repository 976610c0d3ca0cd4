"""Near-duplicate groups by SuperMinHash signatures.

A document's set is its distinct n-word shingles. SuperMinHash gives every element a pseudorandom permutation of the
signature's places and a rank-plus-fraction value for each; ranks are dealt in rounds, and a document stops as soon as
every place is taken by a lower rank. Bands of the signature propose links, which are confirmed on the full sets.

1. Rows with equal sets collapse to one node each, so groups of copies cost one row per task that holds some.
2. For every node that shares a bucket its shingles are counted that no other such node has. With n shingles of which u
   are its own, nodes x and y are no closer than min(nx - ux, ny - uy) / max(nx + uy, ny + ux): most pairs of a large
   group of altered copies are ruled out by this without being looked at. Of buckets with the same nodes one is enough.
3. Every band's bucket names the member with the smallest share of own shingles as its leader, and the others are
   compared with it, so that a bucket is not expanded into pairs while this joins most of it.
4. Pairs with a leader whose signatures agree far too little (by six standard deviations) are dropped; the rest meet as
   whole texts.
5. Then the members of a bucket that is not yet one component meet in blocks: of their pairs those of different components
   that sizes and own shingles allow are compared on their whole sets, each pair in one of the buckets that it shares.
   Only links that join components come out, so no pairs are emitted and no link between components is lost.

With 32 bands of 4 a pair at similarity 0.8 shares no band with a chance of 5e-8.

Defined cases: a null text counts as empty; an empty set has no link and is its own component; a text with fewer words
than a shingle is one shingle; repeated rows are one node; rows of one id with different texts are nodes of their own
that bear the same id; a row without an id is grouped like any other, but its id stands for a group only where no row of
the group has one (then component_id is null, and rows without an id are its kept rows); an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfworks.functions.numbering import in_order
from shelfworks.llm.blobs import deltas, planes, runs_of, undeltas, unplaned
from shelfworks.llm.components import components
from shelfworks.llm.shared import fresh, in_batches, new_path, small, table, written
from shelfworks.llm.words import mix64, shingle_hashes, word_hashes

PLACES, ROWS = 128, 4
BANDS = PLACES // ROWS
SHINGLE, PERCENT = 5, 80
#: Members that meet one copy of their leader's text.
MEMBERS = 100
#: Shingles in one range of the count of own shingles.
RANGE_SHINGLES = 1_000_000
#: Nodes whose counts are added up together.
BLOCK_NODES = 50_000
#: Shingles in one block of a bucket, what a row counts as at least, and columns of one matrix of a product of blocks.
BLOCK_SHINGLES, LEAST_WEIGHT, FEATURES = 60_000, 100, 2_048
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_RANK = np.uint64(56)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles; A-Z are read as a-z."""
    return np.unique(shingle_hashes(word_hashes((text or "").encode().lower()), n))


def super_minhash(elements: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The signature: at each place the least ``rank + fraction`` of any element, as rank in the top byte."""
    best = np.full(places, np.iinfo(np.uint64).max, np.uint64)
    order = None
    rows = np.arange(len(elements))
    with np.errstate(over="ignore"):
        for rank in range(places):
            seed = elements + np.uint64(2 * rank + 1) * _PRIME
            pick = rank + (mix64(seed) % np.uint64(places - rank)).astype(np.int64)
            if rank == 0:
                first = place = pick
            else:
                if order is None:  # most long texts are done after rank 0 and need no permutations
                    order = np.tile(np.arange(places, dtype=np.uint8), (len(elements), 1))
                    order[rows, first] = 0
                place = order[rows, pick].astype(np.int64)
                order[rows, pick] = order[:, rank]
            value = (np.uint64(rank) << _RANK) | (mix64(seed ^ _PRIME) >> np.uint64(8))
            np.minimum.at(best, place, value)
            if int(best.max() >> _RANK) <= rank:  # later ranks cannot lower any place
                break
    return best


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band, different for different bands."""
    grid = signature.reshape(-1, rows)
    with np.errstate(over="ignore"):
        key = mix64(np.arange(1, len(grid) + 1, dtype=np.uint64) * _PRIME)
        for k in range(rows):
            key = mix64(key * _PRIME + grid[:, k])
    return key.view(np.int64)


def sketch(signature: np.ndarray) -> tuple[bytes, int, int]:
    """A byte of each place, and a bit of each in two numbers, to estimate similarities from."""
    mixed = mix64(signature)
    bits = np.packbits((mixed >> np.uint64(40)).astype(np.uint8) & 1).view(np.int64)
    return mixed.astype(np.uint8).tobytes(), int(bits[0]), int(bits[1])


def set_rows(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """``doc_id, tie, n_shingles, digest, sketch, s0, s1, bands`` of every row; the last five are null where the set is empty."""
    kind = dict(docs.dtypes)["doc_id"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, sketches, s0, s1, bands = [], [], [], [], [], []
            for t in b.column("text"):
                s = shingle_set(t.as_py(), n)
                sizes.append(len(s))
                if len(s):
                    signature = super_minhash(s)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    for into, x in zip((sketches, s0, s1), sketch(signature)):
                        into.append(x)
                    bands.append(band_keys(signature))
                else:
                    for into in (digests, sketches, s0, s1, bands):
                        into.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tie"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())]
                + [pa.array(s0, pa.int64()), pa.array(s1, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "tie", "n_shingles", "digest", "sketch", "s0", "s1", "bands"],
            )

    rows = docs.select("doc_id", F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    return in_batches(rows).mapInArrow(
        signed, f"doc_id {kind}, tie bigint, n_shingles bigint, digest binary, sketch binary, s0 bigint, s1 bigint, bands array<bigint>"
    )


def _least_estimate(percent: int) -> float:
    """Places that agree at the threshold, less six standard deviations."""
    j = percent / 100
    return PLACES * j - 6 * (PLACES * j * (1 - j)) ** 0.5


def _alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree often enough."""
    least = _least_estimate(percent)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("x", "y"))
            yield batch.filter(pa.array((x == y).sum(axis=1) >= least)).select(["a", "b"])

    one = sketches.select(F.col("nid").alias("a"), F.col("sketch").alias("x"))
    two = sketches.select(F.col("nid").alias("b"), F.col("sketch").alias("y"))
    return in_batches(pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y")).mapInArrow(kept, "a bigint, b bigint")


class Bodies:
    """Whole texts of the nodes that share a bucket, bucketed by node: a round moves its pairs to the texts, not the reverse."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, shared: DataFrame, text: str):
        self.spark = docs.sparkSession
        self.name = f"bodies_{uuid.uuid4().hex}"
        ids = shared.select("nid").distinct().hint("merge")
        wanted = written(nodes.select("nid", "id0", "tie0").join(ids, "nid", "left_semi"), "wanted")
        rows = docs.select(F.col("doc_id").alias("id0"), F.xxhash64(text).alias("tie0"), F.col(text).alias("text"))
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        found = rows.join(small(wanted), ["id0", "tie0"]).select("nid", "text")
        # nodes of rows without an id: any of their rows with this text, once
        bare = small(wanted.filter("id0 IS NULL").select("nid", "tie0"))
        found = found.union(rows.filter("id0 IS NULL").join(bare, "tie0").select("nid", "text").dropDuplicates(["nid"]))
        rows = found.repartition(n, "nid")
        self.path = new_path(self.spark, "bodies")
        rows.write.bucketBy(n, "nid").sortBy("nid").option("path", self.path).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def confirmed(pairs: DataFrame, bodies: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets reach the threshold.

    Member texts go to their leader; a leader with many members is split, with a copy of its text for each part.
    """

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, s = None, None
        for batch in batches:
            ok = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y")):
                if a != last:
                    last, s = a, shingle_set(x.as_py(), n)
                t = shingle_set(y.as_py(), n)
                common = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    leaders = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    split = pairs.join(leaders, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    members = split.join(bodies.select(F.col("nid").alias("b"), F.col("text").alias("y")), "b")
    heads = leaders.join(bodies.select(F.col("nid").alias("a"), F.col("text").alias("x")), "a")
    heads = heads.select("a", "x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    met = members.join(heads.hint("merge"), ["a", "part"]).select("a", "b", "x", "y")
    return in_batches(met).mapInArrow(checked, "a bigint, b bigint")


def own_shingles(bodies: DataFrame, n: int, total: int, nodes: int) -> DataFrame:
    """``nid, own``: how many shingles of a node no other node of ``bodies`` has (48-bit hashes: never too many).

    Each range of hashes counts what it finds for blocks of nodes, a row for each block, and the blocks add that up.
    """
    ranges, blocks = max(8, total // RANGE_SHINGLES), max(1, nodes // BLOCK_NODES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nids = b.column("nid").to_numpy()
            sets = [shingle_set(t.as_py(), n) >> np.uint64(16) for t in b.column("text")]
            who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            if not len(who):
                continue
            fp, first, count = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
            holder = np.where(count == 1, nids[who[first]] + 1, 0)  # 0: more than one node here has it
            where = (fp % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            for r, part in runs_of(where[order]):
                rows = order[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r]), pa.array([deltas(fp[rows])], pa.binary()), pa.array([planes(holder[rows])], pa.binary())], names=["range", "fp", "holder"]
                )

    def count(rows: pa.Table) -> pa.Table:
        fp = np.concatenate([undeltas(x) for x in rows.column("fp").to_pylist()])
        holder = np.concatenate([unplaned(x) for x in rows.column("holder").to_pylist()])
        _, first, times = np.unique(fp, return_index=True, return_counts=True)
        alone = holder[first[times == 1]]
        nid, own = np.unique(alone[alone > 0] - np.uint64(1), return_counts=True)
        block = (mix64(nid) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        out = [{"block": k, "nids": deltas(nid[order[part]]), "own": planes(own[order[part]])} for k, part in runs_of(block[order])]
        return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("nids", pa.binary()), ("own", pa.binary())]))

    def added(rows: pa.Table) -> pa.Table:
        nid = np.concatenate([undeltas(x) for x in rows.column("nids").to_pylist()])
        own = np.concatenate([unplaned(x) for x in rows.column("own").to_pylist()])
        unique, place = np.unique(nid, return_inverse=True)
        return pa.table({"nid": pa.array(unique.astype(np.int64)), "own": pa.array(np.bincount(place, weights=own).astype(np.int64))})

    dealt = in_batches(bodies).mapInArrow(deal, "range bigint, fp binary, holder binary")
    counted = dealt.groupBy("range").applyInArrow(count, "block bigint, nids binary, own binary")
    return counted.groupBy("block").applyInArrow(added, "nid bigint, own bigint")


def linked_in_blocks(rows: DataFrame, bodies: DataFrame, n: int, percent: int, counter=None) -> DataFrame:
    """Links ``a, b`` between components within each bucket, from whole sets; ``rows`` has ``key, nid, n, own, comp, bands``.

    Sets whose sizes are too far apart do not meet: a bucket is cut into classes of sizes, and a class meets itself and the
    next. Both are cut into blocks by their number of shingles, those of the largest component apart from all others, and
    every two blocks that may join components meet in a task of their own. Only links that join components come out. ``counter``, an accumulator, gets the number of pairs whose sets are compared.
    """
    ids = rows.select("nid").distinct().hint("merge")

    def as_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), n).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("nid"), pa.array(sets, pa.binary())], names=["nid", "elements"])

    sets = in_batches(bodies.join(ids, "nid", "left_semi").select("nid", "text")).mapInArrow(as_set, "nid bigint, elements binary")
    # from one class to the next but one, sizes differ by more than the threshold allows
    size_class = F.floor(F.log("n") / (np.log(100 / percent) + 1e-6))
    own_class = rows.withColumn("class", size_class.cast("long"))
    # a node is in its class, and looks on from the class below
    both = own_class.withColumn("upper", F.lit(False)).union(own_class.withColumn("class", F.col("class") - 1).withColumn("upper", F.lit(True)))
    weight = F.greatest("n", F.lit(LEAST_WEIGHT))  # so that a block of tiny sets has few rows as well
    comps = both.groupBy("key", "class", "comp").agg(F.sum(weight).alias("w"), F.min("upper").alias("none_here"))
    facts = comps.groupBy("key", "class").agg(
        F.max_by("comp", F.struct("w", "comp")).alias("giant"), F.max("w").alias("gw"), F.sum("w").alias("tw"), F.count(F.lit(1)).alias("k"), F.min("none_here").alias("none_here")
    )
    in_blocks = lambda w: F.greatest(F.ceil(w / BLOCK_SHINGLES), F.lit(1).cast("bigint"))
    facts = facts.filter("NOT none_here AND k > 1").select("key", "class", "giant", in_blocks(F.col("gw")).alias("own_blocks"), in_blocks(F.col("tw") - F.col("gw")).alias("others"))
    # the largest component has blocks of its own, which only blocks of strangers meet: its members are copied for these, not for each other
    cut = both.join(written(facts, "bucket-facts").hint("merge"), ["key", "class"])
    inside, spread = F.col("comp") == F.col("giant"), F.xxhash64("nid", "key")
    cut = cut.withColumn("block", F.when(inside, F.pmod(spread, "own_blocks")).otherwise(F.col("own_blocks") + F.pmod(spread, "others")))
    first = F.when(inside, F.col("own_blocks")).otherwise(F.lit(0).cast("bigint"))
    meet = cut.join(sets.hint("merge"), "nid").withColumn("with", F.explode(F.sequence(first, F.col("own_blocks") + F.col("others") - 1)))
    meet = meet.select(
        "key", "class", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "nid", "own", "comp", "upper", "bands", "elements"
    )

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        k, _, i, j = (x.as_py() for x in key)
        rows = {c: table.column(c).to_numpy() for c in ("nid", "own", "comp", "upper", "block")}
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(table), BANDS)
        out, looked = _joining_links(rows, rows["block"] == i, i == j, k, bands, table.column("elements").to_pylist(), percent)
        if counter is not None:
            counter.add(looked)
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return meet.groupBy("key", "class", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def _joining_links(rows: dict, first: np.ndarray, same: bool, key: int, bands: np.ndarray, elements: list[bytes], percent: int) -> tuple[list[tuple[int, int]], int]:
    """Links between the rows of the first and the second block (or within one) that join different components, and how many pairs were compared.

    A pair is compared where the bound of own shingles lets it reach the threshold, in the least of the keys that it shares.
    """
    nid, own, comp, upper = (rows[c] for c in ("nid", "own", "comp", "upper"))
    one = np.flatnonzero(first)
    two = one if same else np.flatnonzero(~first)
    if not len(one) or not len(two) or len(np.unique(comp)) < 2:
        return [], 0
    sets = [np.frombuffer(e, np.uint64) for e in elements]
    size = np.array([len(s) for s in sets])
    left = size - own
    most = np.minimum(left[one][:, None], left[two][None, :])
    least = np.maximum(size[one][:, None] + own[two][None, :], size[two][None, :] + own[one][:, None])
    # two nodes that look on from below meet in their own class
    open_ = (100 * most >= percent * least) & (comp[one][:, None] != comp[two][None, :]) & ~(upper[one][:, None] & upper[two][None, :])
    if same:
        open_ = np.triu(open_, 1)
    x, y = np.nonzero(open_)
    keep = np.zeros(len(x), bool)
    for at in range(0, len(x), 1 << 15):
        p, q = bands[one[x[at : at + (1 << 15)]]], bands[two[y[at : at + (1 << 15)]]]
        keep[at : at + (1 << 15)] = np.where(p == q, p, np.iinfo(np.int64).max).min(axis=1) == key
    x, y = x[keep], y[keep]
    if not len(x):
        return [], 0
    common = _common(sets, one[x], two[y])
    fits = 100 * common >= percent * (size[one[x]] + size[two[y]] - common)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(one[x[fits]].tolist(), two[y[fits]].tolist()):
        r, q = find(int(comp[a])), find(int(comp[b]))
        if r != q:
            root[max(r, q)] = min(r, q)
            out.append((int(nid[a]), int(nid[b])))
    return out, len(x)


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of these pairs of sets: one by one where they are few, else by products of matrices."""
    one, two = np.unique(a), np.unique(b)
    if 20 * len(a) < len(one) * len(two) or len(a) < 20:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist())])
    used = np.union1d(one, two)
    who = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    _, feature, count = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    shared = count[feature] > 1
    who, feature = who[shared], (np.cumsum(count > 1) - 1)[feature[shared]]
    order = np.argsort(feature, kind="stable")
    who, feature = who[order], feature[order]
    rows, columns = np.searchsorted(used, one), np.searchsorted(used, two)
    common = np.zeros((len(one), len(two)), np.float32)
    for lo in range(0, int(feature[-1]) + 1 if len(feature) else 0, FEATURES):
        part = slice(*np.searchsorted(feature, [lo, lo + FEATURES]))
        grid = np.zeros((len(used), FEATURES), np.float32)
        grid[who[part], feature[part] - lo] = 1
        common += grid[rows] @ grid[columns].T
    return common[np.searchsorted(one, a), np.searchsorted(two, b)].astype(np.int64)


def one_bucket_each(placed: DataFrame) -> DataFrame:
    """The rows of ``placed`` (key, nid) in buckets of several nodes; of buckets with the same nodes only the one of the least key.

    A set of nodes is told by its size, its ends, and 128 bits of hashes.
    """
    nodes = [F.bit_xor(F.xxhash64("nid", F.lit(k))).alias(f"h{k}") for k in range(2)]
    buckets = placed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("nid").alias("least"), F.max("nid").alias("most"), *nodes).filter("k > 1")
    kept = buckets.groupBy("k", "least", "most", "h0", "h1").agg(F.min("key").alias("key")).select("key")
    return placed.join(kept.hint("merge"), "key", "left_semi")


def _linked(nodes: DataFrame, shared: DataFrame, bodies: Bodies, n: int, percent: int, counter) -> tuple[DataFrame, DataFrame]:
    """Steps 2 to 5 for the nodes and their buckets: the components of the leader round, and the links that join these further."""
    total, many = nodes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count(F.lit(1))).first()
    facts = nodes.join(shared.select("nid").distinct().hint("merge"), "nid", "left_semi").select("nid", "n_shingles", "s0", "s1")
    facts = written(facts.join(own_shingles(bodies.rows, n, total, many).hint("merge"), "nid", "left").withColumn("own", F.coalesce("own", F.lit(0))), "facts")
    # a node whose own shingles alone keep it below the threshold links with none
    may = facts.withColumnRenamed("n_shingles", "n").filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    placed = written(one_bucket_each(shared.join(may.hint("merge"), "nid")), "placed")

    lead = placed.groupBy("key").agg(F.min_by(F.struct("nid", "n", "own", "s0", "s1"), F.struct(F.col("own") / F.col("n"), "nid")).alias("a"))
    pairs = placed.join(lead, "key").filter((F.col("nid") != F.col("a.nid")) & _may_link(percent)).select(F.col("a.nid").alias("a"), F.col("nid").alias("b"))
    pairs = written(_alike(pairs.distinct(), nodes.select("nid", "sketch"), percent), "pairs")
    first = written(confirmed(pairs, bodies.rows, n, percent), "confirmed")
    comps = components(first)

    known = placed.join(comps.withColumnRenamed("node", "nid").hint("merge"), "nid", "left").withColumn("comp", F.coalesce("root", "nid")).drop("root")
    mixed = known.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key")
    left = known.join(mixed.hint("merge"), "key").join(nodes.select("nid", "bands").hint("merge"), "nid")
    left = written(left.select("key", "nid", "n", "own", "comp", "bands"), "mixed")
    second = written(linked_in_blocks(left, bodies.rows, n, percent, counter), "confirmed")
    return comps, second


def near_groups(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, text: str = "text", counter=None) -> DataFrame:
    """``doc_id, tie, n_shingles, component_id, head`` of every row: its component bears the smallest id that it reaches.

    ``tie`` is the text's hash; ``head`` marks the rows of the one text that stands for the component. ``counter``, an
    accumulator, gets the number of pairs whose whole sets step 5 compares.
    """
    rows = written(set_rows(docs, n, text), "sets")
    found = rows.filter("digest IS NOT NULL")
    nodes = found.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("r"), *[F.first(c).alias(c) for c in ("n_shingles", "sketch", "s0", "s1", "bands")]
    )
    nodes = nodes.select(F.col("r.doc_id").alias("id0"), F.col("r.tie").alias("tie0"), "digest", "n_shingles", "sketch", "s0", "s1", "bands")
    nodes = in_order(nodes, [F.col("id0").asc_nulls_last(), F.col("digest")]).withColumn("nid", F.shiftleft("_pid", 33) + F.col("_pos")).drop("_pid", "_pos")
    buckets = nodes.select("nid", F.explode("bands").alias("key"))
    full = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key").hint("merge")
    shared = written(buckets.join(full, "key"), "buckets")
    bodies = Bodies(docs, nodes, shared, text)
    try:
        comps, second = _linked(nodes, shared, bodies, n, percent, counter)
    finally:
        bodies.drop()
    comps = components(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second))

    ids = nodes.select("nid", "id0", "tie0", "digest").join(comps.withColumnRenamed("node", "nid"), "nid", "left")
    heads = nodes.select(F.col("nid").alias("root"), F.col("id0").alias("root_id"))
    named = ids.join(heads, "root", "left").select(
        "digest", F.coalesce("root_id", "id0").alias("component_id"), F.when(F.col("root").isNull(), F.struct("id0", "tie0")).alias("first")
    )
    joined = rows.select("doc_id", "tie", "n_shingles", "digest").join(named, "digest", "left")
    head = F.col("digest").isNull() | (F.col("first").isNotNull() & F.struct("doc_id", "tie").eqNullSafe(F.col("first")))
    return joined.select("doc_id", "tie", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), head.alias("head"))


def one_each(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each near-duplicate group."""
    heads = written(near_groups(docs, n, percent, text).filter("head").groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("k")), "heads")
    repeated = heads.agg(F.max("k")).first()[0] or 0
    key, tie, of = fresh(docs.columns, "_id", "_tie", "_of")
    keyed = docs.withColumn(of, F.xxhash64(text))
    ids = heads.select(F.col("doc_id").alias(key), F.col("tie").alias(tie))
    kept = keyed.join(small(ids), F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(of) == F.col(tie)), "left_semi")
    return (kept.dropDuplicates(["doc_id", of]) if repeated > 1 else kept).drop(of)


def _may_link(percent: int) -> Column:
    """Whether the node of a row and the node ``a`` can be linked: by their own shingles, and by the bits of their signatures.

    Of the 128 bits as many agree as at the threshold less six standard deviations.
    """
    n, own, an, aown = F.col("n"), F.col("own"), F.col("a.n"), F.col("a.own")
    most = F.least(n - own, an - aown)
    least = F.greatest(n + aown, an + own)
    p = (1 + percent / 100) / 2
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("a.s0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("a.s1")))
    return (100 * most >= percent * least) & (apart <= int(PLACES * (1 - p) + 6 * (PLACES * p * (1 - p)) ** 0.5))


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all of ``documents`` on two-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_groups(docs, n=2).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
