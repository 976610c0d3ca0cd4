"""Vectors as short codes: a codebook of entries for each part of a vector, learnt in rounds, searched through trees.

Components become whole numbers floor(scale * x). Vectors are cut into equal parts; each part position has a codebook that
starts as the parts of the rows of smallest id. A round gives every part the nearest entry of its codebook (squared
distance, ties to the lower index) and then moves each entry to the floored mean of its parts; unused entries stay.

The nearest entry is found through a geometric near-neighbour access tree over the entries: a node has split points, and for
each pair of a split point and another one's child the range of distances from the point to what lies below that child. A
query is compared with the split points, and its distances to them rule out whole children: strictly, so that an entry
as near as the best one is never lost, and with square roots rounded outwards. What decides are whole numbers: squared
distances and indexes. Whole batches of parts go down a tree together.

A task adds up its parts' components for each entry it used; at most parts x entries sums of each task meet, and only
the new codebooks, whose size does not depend on the input, come to the driver.

Defined cases: vectors that are null or hold null or non-finite components take no part, and neither do vectors of
another length than the row of smallest id has, or of a length that cannot be cut evenly;
components beyond 2**60 count as 2**60, and an error beyond the largest long as that; rows that share an id are all
coded, the codebooks start from the smallest (id, vector) pairs, null ids last; fewer rows than entries make a smaller
codebook; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfworks.llm.shared import fresh, in_batches, small, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Children of a tree's node, and entries up to which a node has none.
DEGREE, LEAF = 8, 12
#: Components are held to this size.
LARGEST = 1 << 60
LONG = (1 << 63) - 1
#: What a rounded square root or difference may be off by, relative to its size, with room to spare.
SLACK = 2.0**-48


@dataclass
class Node:
    """Entries below a node: those at its split points, or all of them in a leaf; the rest below its children."""

    own: np.ndarray
    children: list[Node | None]
    low: np.ndarray
    high: np.ndarray


def _squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, exact: in 64-bit floats where every sum fits, else in whole numbers."""
    if points.dtype == object or entries.dtype == object:
        return np.array([[int(((p - e) ** 2).sum()) for e in entries.astype(object)] for p in points.astype(object)], object).reshape(len(points), len(entries))
    return (points**2).sum(axis=1)[:, None] - 2 * (points @ entries.T) + (entries**2).sum(axis=1)[None, :]


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def numbers_of(rows: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit floats where all sums of squares are exact in them, else as Python's whole numbers."""
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(scale * rows.astype(np.float64)), -float(LARGEST), float(LARGEST))
    if exact_in_floats(np.abs(scaled).max(initial=0), rows.shape[1]):
        return scaled
    return _whole(scaled)


def _whole(rows: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in rows], object).reshape(rows.shape)


def _as_numbers(rows: list[list[int]]) -> np.ndarray:
    out = np.array(rows, object).reshape(len(rows), -1)
    return out.astype(np.float64) if exact_in_floats(float(np.abs(out).max(initial=0)), out.shape[1]) else out


def exact_in_floats(largest: float, size: int) -> bool:
    """Whether squared distances of vectors with components up to ``largest`` stay below 2**53."""
    return 4.0 * largest * largest * size < 2.0**53


def build_tree(entries: np.ndarray, of: np.ndarray | None = None) -> Node:
    """The tree over the entries ``of``: split points far from each other, every other entry below its nearest one."""
    of = np.arange(len(entries)) if of is None else of
    none = np.zeros((0, 0))
    if len(of) <= LEAF:
        return Node(of, [], none, none)
    chosen, near = [0], _squared(entries[of], entries[of[:1]])[:, 0]
    while len(chosen) < DEGREE and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _squared(entries[of], entries[of[chosen[-1:]]])[:, 0])
    if len(chosen) == 1:  # all alike
        return Node(of, [], none, none)
    splits = np.sort(of[chosen])
    rest = np.setdiff1d(of, splits)
    far = _squared(entries[rest], entries[splits])
    home, roots = far.argmin(axis=1), _root(far)
    k = len(splits)
    low, high, children = np.full((k, k), np.inf), np.full((k, k), -np.inf), []
    for j in range(k):
        mine = home == j
        children.append(build_tree(entries, rest[mine]) if mine.any() else None)
        if mine.any():
            low[:, j], high[:, j] = roots[mine].min(axis=0) * (1 - SLACK), roots[mine].max(axis=0) * (1 + SLACK)
    return Node(splits, children, low, high)


class Search:
    """The nearest entry of each of many points, ties to the lower index; ``looked`` counts the distances worked out."""

    def __init__(self, entries: np.ndarray, tree: Node):
        self.entries, self.tree, self.looked = entries, tree, 0

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.points = points
        whole = object if points.dtype == object or self.entries.dtype == object else np.float64
        self.best = np.full(len(points), 1 << 140 if whole is object else np.inf, whole)
        self.index = np.full(len(points), len(self.entries), np.int64)
        self._visit(self.tree, np.arange(len(points)))
        return self.index, self.best

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        far = _squared(self.points[rows], self.entries[node.own])
        self.looked += far.size
        at = far.argmin(axis=1)  # the entries of a node are in order, so the first of equals has the lowest index
        least, found = far[np.arange(len(rows)), at], node.own[at]
        nearer = (least < self.best[rows]) | ((least == self.best[rows]) & (found < self.index[rows]))
        nearer = nearer.astype(bool)
        self.best[rows[nearer]], self.index[rows[nearer]] = least[nearer], found[nearer]
        if not node.children:
            return
        roots = _root(far)
        lower, upper = roots * (1 - SLACK), roots * (1 + SLACK)
        for home in (True, False):  # first below the nearest split point: that brings the best distance down
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                here = np.flatnonzero((at == j) == home)
                reach = (_root(self.best[rows[here]]) * (1 + SLACK))[:, None]
                apart = (lower[here] > node.high[:, j] + reach * (1 + SLACK)) | (node.low[:, j] > (upper[here] + reach) * (1 + SLACK))
                here = here[~apart.any(axis=1)]
                if len(here):
                    self._visit(child, rows[here])


def kept_vectors(vectors: DataFrame, vector: str, parts: int = PARTS, size: int | None = None) -> DataFrame:
    """Rows whose vector is there and finite throughout, of the given size and one that ``parts`` divides."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.filter(F.col(vector).isNotNull() & finite & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    return rows if size is None else rows.filter(F.size(vector) == size)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


class Codebooks:
    """The entries of each part and the trees over them."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.trees = [build_tree(e) for e in entries]

    @property
    def size(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def nearest(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, its numbers, indexes, squared distances) of each part."""
        for p, (entries, tree, own) in enumerate(zip(self.entries, self.trees, np.split(numbers, len(self.entries), axis=1))):
            largest = max(abs(x) for a in (own, entries) for x in (a.max(initial=0), a.min(initial=0)))
            if not exact_in_floats(float(largest), own.shape[1]):
                own, entries = _whole(own), _whole(entries)
            yield p, own, *Search(entries, tree)(own)

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, as decimal numbers with commas between."""
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for row in e for x in row).encode()).hexdigest()


def _sums(rows: DataFrame, vector: str, books: Codebooks, scale: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> number and summed components of the parts that it is nearest to; one row each comes to the driver."""
    given = rows.sparkSession.sparkContext.broadcast(books)
    kind = pa.decimal128(38, 0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, totals = given.value, {}
        for b in batches:
            for p, own, index, _ in books.nearest(numbers_of(_matrix(b.column(0), books.size), scale)):
                order = np.argsort(index, kind="stable")
                heads = np.flatnonzero(np.diff(index[order], prepend=-1))
                for e, n, part in zip(index[order][heads].tolist(), np.diff([*heads, len(order)]).tolist(), np.add.reduceat(own[order], heads, axis=0) if len(heads) else ()):
                    m, old = totals.get((p, e), (0, [0] * len(part)))
                    totals[p, e] = m + n, [x + int(y) for x, y in zip(old, part)]
        made = [{"part": p, "entry": e, "at": i, "n": n, "total": decimal.Decimal(x)} for (p, e), (n, s) in totals.items() for i, x in enumerate(s)]
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("total", kind)]))

    found = in_batches(rows.select(vector)).mapInArrow(add, "part int, entry int, at int, n bigint, total decimal(38,0)")
    out: dict = {}
    for r in found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("at").collect():
        out.setdefault((r.part, r.entry), (r.n, []))[1].append(int(r.total))
    return out


def train(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all vectors; None where there is none."""
    rows = kept_vectors(vectors, vector, parts)
    order = [F.col(key).asc_nulls_last(), F.col(vector)]
    first = rows.orderBy(*order).select(F.size(vector)).head()
    if first is None:
        return None
    rows = rows.filter(F.size(vector) == first[0])
    start = np.array([r[0] for r in rows.orderBy(*order).select(vector).limit(entries).collect()], np.float64).reshape(-1, first[0])
    books = Codebooks(np.split(numbers_of(start, scale), parts, axis=1))
    for _ in range(rounds):
        moved = [[[int(x) for x in e] for e in es] for es in books.entries]
        for (p, e), (n, total) in _sums(rows, vector, books, scale).items():
            moved[p][e] = [x // n for x in total]
        books = Codebooks([_as_numbers(m) for m in moved])
    return books


def _digits(books: Codebooks) -> int:
    return max(2, -(-max(len(e) - 1 for e in books.entries).bit_length() // 4))


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding", keep: tuple[str, ...] = (), scale: int = SCALE) -> DataFrame:
    """The columns ``keep`` of all vectors that the codebooks fit, with ``code`` (indexes in order of parts, two hex digits each or as many as they need) and ``error``."""
    spark = vectors.sparkSession
    given = spark.sparkContext.broadcast(books)
    own = fresh(keep, "_vector")[0]
    digits = _digits(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = given.value
        for b in batches:
            codes, errors = [""] * b.num_rows, [0] * b.num_rows
            for _, _, index, far in books.nearest(numbers_of(_matrix(b.column(own), books.size), scale)):
                codes = [c + f"{i:0{digits}x}" for c, i in zip(codes, index.tolist())]
                errors = [e + int(x) for e, x in zip(errors, far.tolist())]
            made = [pa.array(codes, pa.string()), pa.array([min(e, LONG) for e in errors], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], names=[*keep, "code", "error"])

    rows = kept_vectors(vectors, vector, len(books.entries), books.size).select(*keep, F.col(vector).alias(own))
    schema = rows.drop(own).schema.add("code", T.StringType()).add("error", T.LongType())
    return in_batches(rows).mapInArrow(code, schema)


def decode(codes: DataFrame, books: Codebooks, code: str = "code", out: str = "numbers") -> DataFrame:
    """``codes`` with the entries that each code names on end: what is left of the scaled vector."""
    given = codes.sparkSession.sparkContext.broadcast(books)
    digits = _digits(books)

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [[[int(x) for x in e] for e in es] for es in given.value.entries]
        for b in batches:
            found = [
                None if c is None else [x for p, es in enumerate(lists) for x in es[int(c[p * digits : (p + 1) * digits], 16)]] for c in b.column(code).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], names=[*b.schema.names, out])

    return in_batches(codes).mapInArrow(open_, T.StructType([*codes.schema.fields, T.StructField(out, T.ArrayType(T.LongType()))]))


def _round_sql(k: int) -> str:
    """Two tables: the nearest entry of every part under codebooks c{k}, and the codebooks c{k+1}."""
    return (
        f"a{k} AS MATERIALIZED (SELECT x.vec_id, x.p, any_value(x.x) AS x, min(list_sum(list_transform(list_zip(x.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + c.e) AS m "
        f"FROM parts x JOIN c{k} c ON c.p = x.p GROUP BY x.vec_id, x.p), "
        f"s{k} AS (SELECT p, m % 256 AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, range(1, 17) r(i) GROUP BY ALL), "
        f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.c, c.c) AS c FROM c{k} c LEFT JOIN "
        f"(SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY p, e) n ON n.p = c.p AND n.e = c.e)"
    )


#: For vectors of 64 components and distinct ids.
ORACLE_SQL = (
    "WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
    "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
    "parts AS MATERIALIZED (SELECT vec_id, p, v[16 * p + 1 : 16 * p + 16] AS x FROM kept, range(4) r(p)), "
    "firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 256), "
    "c0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN firsts USING (vec_id)), "
    + ", ".join(_round_sql(k) for k in range(ROUNDS + 1))
    + ", o AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id), "
    "h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c4) "
    "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN kept USING (vec_id), h"
)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings`` as codes of four bytes, with their errors and those of their label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = train(rows)
    if books is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = written(encode(rows, books, keep=("vec_id", "label")), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("bigint")
    sums = written(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "label-errors")
    return coded.join(small(sums), F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )
