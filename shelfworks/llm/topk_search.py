"""Exact top-k search by inner product with block-at-a-time pruning.

Candidates are packed into blocks of rows that are alike: a tree of cuts across main directions, at wide gaps, fitted on a
bounded sample, gives every row a code, and a block holds neighbours in the order of codes. A block has a forward index (the
quantised vectors) and, for each dimension, its largest and smallest value. For one query a block's bound is the sum over
dimensions of the larger of ``q * max`` and ``q * min``; no row of the block scores more.

1. Queries are packed into groups of like queries. Each group meets block summaries only.
2. Each query scores the block of its highest bound through that block's forward index; its k-th score is a floor.
3. Of every group the blocks in which some query's bound reaches its floor are visited from the highest bound down, lane
   by lane (a lane has a bounded number of blocks, so that no task gets them all). A query takes part only where its own
   bound reaches its floor, which rises from block to block. A lane gives the k best of each query.

Scores are whole numbers: products are exact in 64-bit floats while their sum stays under 2**53, and are worked out in
Python's whole numbers beyond that. How much is pruned depends on the data: vectors in clusters are, vectors spread evenly
over all directions are not, as their bounds all lie above the best scores.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of another length than
the query's do not meet it; ties go to the smaller vec_id; repeated rows and rows that share a vec_id are candidates of
each other, only the query's own row is not; fewer than k candidates give all of them; an empty table gives an empty
result; other columns are ignored. Work and rows moved are at most (queries / group size) x blocks: a stated query set
against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfworks.functions.numbering import in_order
from shelfworks.llm.shared import drawn, in_batches, table, written

K, SCALE, EVERY = 20, 64, 20
BLOCK_ROWS, GROUP_ROWS = 512, 512
#: Blocks of one lane of a group.
LANE_BLOCKS = 256
#: Blocks and groups of queries that meet in one cell of the grid in which bounds are worked out.
CELL_BLOCKS, CELL_GROUPS = 20_000, 500
#: Rows that the tree is fitted on, about; rows of it at a leaf; and levels.
SAMPLE_ROWS, LEAF_ROWS, LEVELS = 8_192, 8, 10
PACKED = "pack bigint, dim int, rids binary, ids binary, vectors binary, high binary, low binary"


def quantised(vectors: DataFrame, vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every component; rows that take no part are gone."""
    x = F.col(vec).cast("array<double>")
    fine = F.col(vec).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(fine & F.col("vec_id").isNotNull() & (F.size(x) > 0)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v")
    )


def cut_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each inner node (children of node i are 2i + 1 and 2i + 2) a direction and a cut: the widest gap in the middle half of the rows' projections."""
    levels = int(np.clip(np.log2(max(len(x), 1) / LEAF_ROWS), 0, LEVELS))
    way, cut = np.zeros((2**levels - 1, x.shape[1])), np.zeros(2**levels - 1)
    rows = {0: np.arange(len(x))}
    for i in range(len(way)):
        of = rows.pop(i)
        own = x[of]
        if len(own) < 2:  # all rows go left
            cut[i], rows[2 * i + 1], rows[2 * i + 2] = np.inf, of, of[:0]
            continue
        centred = own - own.mean(axis=0)
        d = centred[np.argmax((centred**2).sum(axis=1))]
        for _ in range(8):  # power steps towards the main direction
            d = centred.T @ (centred @ d)
            d /= np.linalg.norm(d) or 1.0
        way[i], at = d, own @ d
        order = np.argsort(at, kind="stable")
        low = len(of) // 4
        k = low + int(np.argmax(np.diff(at[order])[low : max(low + 1, len(of) - 1 - low)]))
        cut[i], of = (at[order][k] + at[order][k + 1]) / 2, of[order]
        rows[2 * i + 1], rows[2 * i + 2] = of[: k + 1], of[k + 1 :]
    return way, cut


def codes(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The leaf of each row, counted from the left."""
    way, cut = tree
    node = np.zeros(len(x), np.int64)
    for _ in range((len(cut) + 1).bit_length() - 1):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", x, way[node]) > cut[node])
    return node - len(cut)


def placed(rows: DataFrame) -> DataFrame:
    """Rows in the order of length, code and id, written, with their partition and place in it."""
    some = rows.filter(drawn(F.xxhash64("vec_id", "v"), SAMPLE_ROWS, rows.count()))
    by_dim: dict[int, list] = {}
    for r in some.select("v").distinct().collect():  # about SAMPLE_ROWS rows, copies once
        by_dim.setdefault(len(r.v), []).append(r.v)
    trees = {d: cut_tree(np.array(sorted(v), np.float64)) for d, v in by_dim.items()}
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            dims, out = v.value_lengths().to_numpy(zero_copy_only=False), np.zeros(b.num_rows, np.int64)
            flat, starts = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            for d in np.unique(dims).tolist():
                if d in shared.value:
                    of = np.flatnonzero(dims == d)
                    out[of] = codes(flat[starts[of][:, None] + np.arange(d)], shared.value[d])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "code"])

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    return in_order(in_batches(rows).mapInArrow(coded, f"{kinds}, code bigint"), [F.size("v"), F.col("code"), F.col("vec_id"), F.xxhash64("v")])


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` neighbours of one length, of rows as placed() gives them, with each dimension's largest and smallest value.

    A block that is half full ends where the code changes.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            rids, ids, vectors, _ = held.pop(dim)
            m = np.array(vectors, np.float64).reshape(len(ids), dim)
            return pa.RecordBatch.from_pylist(
                [{
                    "pack": rids[0], "dim": dim, "rids": np.array(rids, np.int64).tobytes(), "ids": np.array(ids, np.int64).tobytes(), "vectors": _narrow(m),
                    "high": m.max(axis=0).tobytes(), "low": m.min(axis=0).tobytes(),
                }],
                schema=pa.schema([("pack", pa.int64()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("rids", "ids", "vectors", "high", "low"))]),
            )

        for b in batches:
            for pid, pos, i, v, code in zip(*(b.column(c).to_pylist() for c in ("_pid", "_pos", "vec_id", "v", "code"))):
                own = held.get(len(v))
                if own and (len(own[1]) >= size or code != own[3] and 2 * len(own[1]) >= size):
                    yield block(len(v))
                own = held.setdefault(len(v), [[], [], [], code])
                for into, x in zip(own, (pid << 33 | pos, i, v)):
                    into.append(x)
                own[3] = code
        for dim in sorted(held):
            yield block(dim)

    return written(in_batches(rows.select("_pid", "_pos", "vec_id", "v", "code")).mapInArrow(pack, PACKED), "packed")


def _narrow(m: np.ndarray) -> bytes:
    """A matrix in the narrowest numbers that hold it, behind one byte that says which."""
    for kind in ("i1", "i2", "i4"):
        if m.size and np.iinfo(kind).min <= m.min() and m.max() <= np.iinfo(kind).max:
            return kind[1].encode() + m.astype(kind).tobytes()
    return b"8" + m.tobytes()


def _wide(raw: bytes, dim: int) -> np.ndarray:
    kind = {b"1": "i1", b"2": "i2", b"4": "i4", b"8": "f8"}[raw[:1]]
    return np.frombuffer(raw, kind, offset=1).reshape(-1, dim).astype(np.float64)


def _times(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """All inner products, exactly."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * q.shape[1] < 2**53:
        return (q @ m.T).astype(np.int64)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in m] for x in q], dtype=object)
    return exact.astype(np.int64)  # a score beyond 64 bits is an error, as it has no place in the result


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No score of a block exceeds this; a little is added where floats round."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    out = up @ high.T + down @ low.T
    return out + np.abs(out) * 1e-12


def _best(scores: np.ndarray, ids: np.ndarray, use: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``use`` those of the k highest scores, ties to smaller ids."""
    if len(use) > k:
        cut = np.partition(scores[use], len(use) - k)[len(use) - k]
        use = use[scores[use] >= cut]
    return use[np.lexsort((ids[use], -scores[use]))][:k]


#: What a lane's task reads: first the group (its queries, floors and seeds), then blocks, the highest bound first.
STREAM = "grp bigint, lane bigint, kind int, top double, pack bigint, dim int, rids binary, ids binary, vectors binary, bounds binary, floors binary, seeds binary"
MADE = "grp bigint, q bigint, query_id bigint, vec_id bigint, score bigint"


def _hits(k: int, counter=None):
    """The task that reads streams of STREAM and gives the k best of each query in each lane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None

        def ended() -> Iterator[pa.RecordBatch]:
            if group is not None:
                found = [(t, s, i) for t, (s, i) in enumerate(group["best"]) if len(s)]
                many = [len(s) for _, s, _ in found]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(group["grp"], sum(many))), pa.array(np.repeat([t for t, *_ in found], many))]
                        + [pa.array(np.repeat(group["ids"][[t for t, *_ in found]], many)), pa.array(np.concatenate([i for *_, i in found]))]
                        + [pa.array(np.concatenate([s for _, s, _ in found]))],
                        names=["grp", "q", "query_id", "vec_id", "score"],
                    )

        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 0:
                    yield from ended()
                    of = lambda c, kind: np.frombuffer(r[c], kind)  # noqa: B023, E731
                    q = _wide(r["vectors"], r["dim"])
                    group = {"grp": r["grp"], "q": q, "rids": of("rids", np.int64), "ids": of("ids", np.int64), "seeds": of("seeds", np.int64)}
                    group |= {"floors": of("floors", np.float64).copy(), "best": [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)}
                    continue
                take = np.flatnonzero((np.frombuffer(r["bounds"], np.float64) >= group["floors"]) & (group["seeds"] != r["pack"]))
                if not len(take):
                    continue
                if counter is not None:
                    counter.add(len(take))
                m, rids, ids = _wide(r["vectors"], r["dim"]), np.frombuffer(r["rids"], np.int64), np.frombuffer(r["ids"], np.int64)
                scores = _times(group["q"][take], m)
                for t, s in zip(take.tolist(), scores):
                    use = np.flatnonzero((s >= group["floors"][t]) & (rids != group["rids"][t]))
                    if not len(use):
                        continue
                    use = _best(s, ids, use, k)
                    s, i = np.concatenate([group["best"][t][0], s[use]]), np.concatenate([group["best"][t][1], ids[use]])
                    top = _best(s, i, np.arange(len(s)), k)
                    group["best"][t] = s[top], i[top]
                    if len(top) == k:  # the floor rises
                        group["floors"][t] = max(group["floors"][t], s[top[-1]])
        yield from ended()

    return run


def search(rows: DataFrame, is_query: Column, k: int = K, counter=None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of each row for which ``is_query`` holds, of rows as quantised() gives them.

    ``counter``, an accumulator, gets the number of (query, block) pairs that were scored.
    """
    ordered = placed(rows)
    blocks = packed(ordered, BLOCK_ROWS)
    groups = packed(ordered.filter(is_query), GROUP_ROWS).withColumnRenamed("pack", "grp").drop("high", "low")
    # each group meets every block's summary (two numbers a dimension for some hundred rows), not its rows
    # cell by cell of a grid, so that no task gets all pairs of one length
    across, down = (max(1, -(-t.count() // n)) for t, n in ((blocks, CELL_BLOCKS), (groups, CELL_GROUPS)))
    row, column = F.pmod(F.xxhash64("grp"), F.lit(down)), F.pmod(F.xxhash64("pack"), F.lit(across))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    asked = groups.select("grp", "dim", F.col("vectors").alias("qs"), row.alias("down"), each(across).alias("across"))
    met = asked.join(blocks.select("pack", "dim", "high", "low", column.alias("across"), each(down).alias("down")), ["dim", "across", "down"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, q = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["grp"] != last:
                    last, q = r["grp"], _wide(r["qs"], r["dim"])
                x = _bounds(q, *(np.frombuffer(r[c], np.float64).reshape(1, -1) for c in ("high", "low")))[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["grp"]]), pa.array([r["pack"]]), pa.array([x.astype(np.float64).tobytes()], pa.binary())], names=["grp", "pack", "bounds"]
                )

    # worked out twice, for the first block of each query and against the floors that it gives: only open pairs are stored
    bounds = in_batches(met).mapInArrow(bound, "grp bigint, pack bigint, bounds binary")

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task: of each query of a group the block of the highest bound so far."""
        best: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for g, p, x in zip(b.column("grp").to_pylist(), b.column("pack").to_pylist(), b.column("bounds").to_pylist()):
                x = np.frombuffer(x, np.float64)
                if g not in best:
                    best[g] = [x.copy(), np.full(len(x), p)]
                else:
                    up = x > best[g][0]
                    best[g][0][up], best[g][1][up] = x[up], p
        for g, (x, p) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), g)), pa.array(np.arange(len(x))), pa.array(x), pa.array(p)], names=["grp", "q", "x", "pack"])

    def streamed(pairs: DataFrame, facts: DataFrame) -> DataFrame:
        """Hits of the given pairs (grp, pack, lane, bounds); ``facts`` has the groups' floors and seeds."""
        heads = pairs.groupBy("grp", "lane").agg(F.lit(0).alias("kind"), F.lit(0.0).alias("top")).join(groups, "grp").join(facts, "grp")
        heads = heads.select("grp", "lane", "kind", "top", F.lit(0).cast("bigint").alias("pack"), "dim", "rids", "ids", "vectors", F.lit(None).cast("binary").alias("bounds"), "floors", "seeds")
        none = F.lit(None).cast("binary")
        body = pairs.join(blocks.drop("high", "low").hint("merge"), "pack").select(
            "grp", "lane", F.lit(1).alias("kind"), "top", "pack", "dim", "rids", "ids", "vectors", "bounds", none.alias("floors"), none.alias("seeds")
        )
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: few bytes may be much work
        stream = heads.union(body).repartition(tasks, "grp", "lane").sortWithinPartitions("grp", "lane", "kind", F.desc("top"), "pack")
        return in_batches(stream).mapInArrow(_hits(k, counter), MADE)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups' floors and seeds as bytes, in the order of the queries."""
        for b in batches:
            out = [[], []]
            for f in b.column("facts").to_pylist():
                f.sort(key=lambda x: x["q"])
                out[0].append(np.array([-np.inf if x["floor"] is None else x["floor"] for x in f], np.float64).tobytes())
                out[1].append(np.array([x["seed"] for x in f], np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("grp"), *(pa.array(x, pa.binary()) for x in out)], names=["grp", "floors", "seeds"])

    def facts_of(each: DataFrame) -> DataFrame:
        """``grp, floors, seeds`` of ``grp, q, floor, seed``: at most GROUP_ROWS of one group."""
        lists = each.groupBy("grp").agg(F.collect_list(F.struct("q", "floor", "seed")).alias("facts"))
        return in_batches(lists).mapInArrow(arrays, "grp bigint, floors binary, seeds binary")

    first = in_batches(bounds).mapInArrow(highest, "grp bigint, q bigint, x double, pack bigint").groupBy("grp", "q").agg(F.max_by("pack", F.struct("x", "pack")).alias("seed"))
    first = written(first, "first")

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bounds of a seed pair: without limit for the queries that begin with the block, below any floor for the rest."""
        for b in batches:
            out = []
            for n, q in zip(b.column("n").to_pylist(), b.column("take").to_pylist()):
                x = np.full(n, -np.inf)
                x[q] = np.inf
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("grp", "pack", "lane", "top")), pa.array(out, pa.binary())], names=["grp", "pack", "lane", "top", "bounds"])

    sizes = groups.select("grp", (F.octet_length("rids") / 8).cast("int").alias("n"))
    seeds = first.groupBy("grp", F.col("seed").alias("pack")).agg(F.collect_list("q").alias("take")).join(sizes, "grp")
    seeds = seeds.withColumn("lane", F.col("pack")).withColumn("top", F.lit(0.0))
    seeds = in_batches(seeds).mapInArrow(only, "grp bigint, pack bigint, lane bigint, top double, bounds binary")
    # the lowest float is no floor that a bound of minus infinity reaches
    start = facts_of(first.select("grp", "q", F.lit(-1.7e308).alias("floor"), F.lit(-1).cast("bigint").alias("seed")))
    seeded = written(streamed(seeds, start), "seeded")
    floors = seeded.groupBy("grp", "q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
    facts = written(facts_of(first.join(floors, ["grp", "q"], "left").select("grp", "q", "floor", "seed")), "facts")

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs in which some query's bound reaches its floor and that query has not scored the block yet."""
        for b in batches:
            keep, top = [], []
            for p, x, f, s in zip(*(b.column(c).to_pylist() for c in ("pack", "bounds", "floors", "seeds"))):
                x, f, s = np.frombuffer(x, np.float64), np.frombuffer(f, np.float64), np.frombuffer(s, np.int64)
                over = x[(x >= f) & (s != p)]
                keep.append(len(over) > 0)
                top.append(float(over.max(initial=-1.7e308)))
            out = pa.RecordBatch.from_arrays([b.column("grp"), b.column("pack"), pa.array(top, pa.float64()), b.column("bounds")], names=["grp", "pack", "top", "bounds"])
            yield out.filter(pa.array(keep, pa.bool_()))

    todo = in_batches(bounds.join(facts.hint("broadcast") if groups.count() <= 1_000 else facts, "grp")).mapInArrow(open_pairs, "grp bigint, pack bigint, top double, bounds binary")
    lanes = max(1, -(-blocks.count() // LANE_BLOCKS))
    todo = written(todo.withColumn("lane", F.pmod(F.xxhash64("pack"), F.lit(lanes))), "todo")
    order = Window.partitionBy("grp", "q").orderBy(F.desc("score"), "vec_id")
    ranked = seeded.union(streamed(todo, facts)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector of ``embeddings`` against all others."""
    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return search(rows, F.col("vec_id") % EVERY == 0)


ORACLE_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
