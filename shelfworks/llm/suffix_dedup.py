"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id are removed.

Suffixes at anchors are sorted within ranges dealt by hash, which are not in order among each other: there is no one sorted
run of all suffixes, and anchors that occur very often are aggregated instead. The suffixes are sorted by a distributed merge sort that never looks at known prefixes again (string sorting with
front-coded runs and prefix doubling, as in the published literature):

* Only anchored suffixes are sorted. Of every 19 neighbouring 32-byte strings the one with the least hash is an anchor,
  so each 50-byte string holds an anchor, at the same place wherever the string occurs.
* Duplicate detection first drops suffixes that cannot meet another: each chunk of texts deals the sorted, delta-coded
  48-bit hashes of its anchors' 32 bytes out to hash ranges, once per chunk, and gets back those that occur in two
  documents or more.
* Each chunk then sorts its remaining suffixes (50 bytes, with the 18 bytes before them), front-codes the run (length
  of the prefix shared with the suffix before, and the rest), and deals it out by the hash of the first 32 bytes, so
  that equal prefixes meet and ranges stay even. Loser trees merge the runs of a range on stored prefix lengths: two
  suffixes are compared only where these are equal, and from the 8-byte word on in which the known prefix ends.
* In the merged order the common-prefix array gives, for every window around an anchor, the rows with the same window
  and their least document id.
* An anchor that occurs very often, in many documents or within a few, would fill one range; its windows are aggregated
  by their 50 bytes instead, one row for each window and document of a chunk with all its places, which is combined
  before the shuffle.

Hashes only choose candidates and order; every removal rests on equal bytes, on both ways.

Strings are judged on the input and matches never cross documents. Defined cases: a null text counts as the empty one;
texts under 50 bytes stay whole; rows with one id never cover each other; a row with a null id is left whole and covers
nothing; repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfworks.llm.blobs import deltas, planes, runs_of, squeezed, undeltas, unplaned, unsqueezed
from shelfworks.llm.shared import fresh, in_batches, table, written
from shelfworks.llm.words import mix64

LENGTH, GRAM = 50, 32
WINDOW = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
#: Whole 8-byte words that hold a suffix, and the bytes before it.
WORDS, LEFT_WORDS = -(-LENGTH // 8), -(-LEFT // 8)
CHUNK_BYTES, GROUP_BYTES = 6 << 20, 1 << 16
#: Bytes of text for each range of anchor hashes, and of suffixes; over MANY ranges they hold more each.
HASH_BYTES, SUFFIX_BYTES, MANY = 16 << 20, 4 << 20, 4_000
#: An anchor that occurs more often than this goes through the aggregation.
HOT_DOCS = 100_000
#: Bytes of all texts for each occurrence that this limit grows by: at most 10 million anchors (80 MB) can be above it.
HOT_SHARE = 100_000_000
FP_BITS = 48
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings, from prefix sums of random byte numbers times powers of an odd base."""
    n = len(data)
    if len(_tables.get("up", ())) < n + 1:
        size = max(n + 1, 2 * GROUP_BYTES)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                _tables[name] = np.cumprod(np.append(np.uint64(1), np.full(size, base, np.uint64)), dtype=np.uint64)
            _tables["letters"] = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(_tables["letters"][data] * _tables["up"][:n], dtype=np.uint64))
        return (sums[k:] - sums[:-k]) * _tables["down"][: n - k + 1]


def _slide(x: np.ndarray, w: int, least: np.ufunc) -> np.ndarray:
    """The least (or largest) of every w neighbours, by doubling spans."""
    n, span = len(x) - w + 1, 1
    while span * 2 <= w:
        x, span = least(x[:-span], x[span:]), span * 2
    return least(x[:n], x[w - span : w - span + n])


def anchors(data: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of texts on end, and the hashes of the 32 bytes there; ``doc`` has each byte's text, -1 for none."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = _grams(data, GRAM)
    lows = _slide(hashes, WINDOW, np.minimum)
    lows[(doc[: len(lows)] != doc[LENGTH - 1 :]) | (doc[: len(lows)] < 0)] = 0  # no window crosses texts
    edge = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, lows, edge]), WINDOW, np.maximum) == hashes)
    return at, hashes[at]


class Chunk:
    """Some documents' bytes on end: ids, whether an id is there, and where each text begins."""

    def __init__(self, row: dict):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.bool_)
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.data = np.frombuffer(pa.decompress(row["texts"], decompressed_size=int(self.starts[-1]), codec="zstd", asbytes=True), np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the chunk, hashes and document numbers of all anchors."""
        at, hashes, doc = [], [], []
        i, n = 0, len(self.ids)
        while i < n:  # groups of texts that stay in the processor's cache
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + GROUP_BYTES)) - 1)
            sizes = self.starts[i + 1 : j + 1] - self.starts[i:j]
            of = np.repeat(np.where(self.known[i:j], np.arange(i, j), -1), sizes)
            a, h = anchors(self.data[self.starts[i] : self.starts[j]], of)
            at.append(a + self.starts[i])
            hashes.append(h)
            doc.append(of[a])
            i = j
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(at), np.concatenate(hashes) >> np.uint64(64 - FP_BITS), np.concatenate(doc)


def _copied(b: pa.RecordBatch, first: int, end: int) -> pa.RecordBatch:
    """Some rows in memory of their own, so that the batch they came in can go."""
    return b.take(pa.array(range(first, end), pa.int64()))


def _table_bytes(rows: list[pa.RecordBatch]) -> bytes | None:
    if not rows or not rows[0].num_columns:
        return None
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(pa.Table.from_batches(rows).combine_chunks())
    return out.getvalue().to_pybytes()


def make_chunks(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``chunk, ids, known, lengths, texts, n_bytes, rest`` rows of about CHUNK_BYTES of text each, compressed.

    ``rest`` has the columns ``keep`` of the same rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, ids, texts, size, rest = TaskContext.get().partitionId(), 0, [], [], 0, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{
                    "chunk": part << 32 | k,
                    "ids": np.array([i or 0 for i in ids], np.int64).tobytes(),
                    "known": np.array([i is not None for i in ids], np.bool_).tobytes(),
                    "lengths": np.array([len(t) for t in texts], np.int64).tobytes(),
                    "texts": pa.compress(b"".join(texts), codec="zstd", asbytes=True),
                    "n_bytes": size,
                    "rest": _table_bytes(rest),
                }],
                schema=pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("ids", "known", "lengths", "texts")), ("n_bytes", pa.int64()), ("rest", pa.binary())]),
            )

        for b in batches:
            others = b.select(list(keep))
            first = 0  # the first row of this batch whose other columns are not held yet
            for at, (i, t) in enumerate(zip(b.column(doc_name).to_pylist(), b.column(body_name))):
                raw = (t.as_py() or "").encode()
                if texts and size + len(raw) > CHUNK_BYTES:
                    rest.append(_copied(others, first, at))
                    yield row()
                    first, k, ids, texts, size, rest = at, k + 1, [], [], 0, []
                ids.append(i)
                texts.append(raw)
                size += len(raw)
            rest.append(_copied(others, first, b.num_rows))
        if texts:
            yield row()

    doc_name, body_name = fresh(docs.columns, "_doc", "_body")
    rows = docs.select(F.col("doc_id").cast("bigint").alias(doc_name), F.col(text).alias(body_name), *keep)
    schema = "chunk bigint, ids binary, known binary, lengths binary, texts binary, n_bytes bigint, rest binary"
    return written(in_batches(rows).mapInArrow(pack, schema), "chunks")


def _range_of(fingerprints: np.ndarray, ranges: int) -> np.ndarray:
    return (fingerprints % np.uint64(ranges)).astype(np.int64)


def repeated_anchors(chunks: DataFrame, ranges: int, hot: int) -> DataFrame:
    """``chunk, found, hot``: for each chunk and range the fingerprints that two documents share, and those of them that occur over ``hot`` times."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row)
                _, fp, doc = c.anchors()
                order = np.argsort(fp, kind="stable")  # documents stay in order
                fp, doc = fp[order], doc[order]
                heads = np.flatnonzero(np.append(True, fp[1:] != fp[:-1])[: len(fp)])
                ends = np.append(heads[1:], len(fp)) - 1 if len(fp) else heads
                unique, first = fp[heads], c.ids[doc[heads]].astype(np.uint64)
                n = (ends - heads + 1) << 1 | (doc[heads] != doc[ends])  # occurrences, and whether two documents have it
                where = _range_of(unique, ranges)
                order = np.argsort(where, kind="stable")
                unique, n, first, where = unique[order], n[order], first[order], where[order]
                for r, part in runs_of(where):
                    yield pa.RecordBatch.from_pylist(
                        [{"range": r, "chunk": row["chunk"], "fp": deltas(unique[part]), "n": planes(n[part]), "id": planes(first[part])}],
                        schema=pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("fp", pa.binary()), ("n", pa.binary()), ("id", pa.binary())]),
                    )

    def meet(rows: pa.Table) -> pa.Table:
        lists = [undeltas(x) for x in rows.column("fp").to_pylist()]
        counts = np.concatenate([unplaned(x) for x in rows.column("n").to_pylist()])
        ids = np.concatenate([unplaned(x) for x in rows.column("id").to_pylist()])
        unique, place = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(place, weights=counts >> np.uint64(1)).astype(np.int64)
        low, high = np.full(len(unique), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(unique), np.uint64)
        np.minimum.at(low, place, ids)
        np.maximum.at(high, place, ids)
        many = np.bincount(place, weights=counts & np.uint64(1)) > 0
        shared = unique[many | (low != high)]
        out = []
        for chunk, own in zip(rows.column("chunk").to_pylist(), lists):
            mine = own[np.isin(own, shared, assume_unique=True)]
            if len(mine):
                out.append({"chunk": chunk, "found": deltas(mine), "hot": None})
        over = unique[(total > hot) & (many | (low != high))]
        if len(over):
            out.append({"chunk": None, "found": None, "hot": deltas(over)})
        return pa.Table.from_pylist(out, schema=pa.schema([("chunk", pa.int64()), ("found", pa.binary()), ("hot", pa.binary())]))

    dealt = in_batches(chunks.drop("rest")).mapInArrow(deal, "range bigint, chunk bigint, fp binary, n binary, id binary")
    return written(dealt.groupBy("range").applyInArrow(meet, "chunk bigint, found binary, hot binary"), "repeated")


def suffixes_at(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes from each place on as rows of WORDS words, zeros beyond a suffix's length."""
    padded = np.concatenate([data, np.zeros(8 * WORDS, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, 8 * WORDS)[at]
    rows[:, LENGTH:] = 0
    short = np.flatnonzero(lengths < LENGTH)
    rows[short] *= np.arange(8 * WORDS) < lengths[short, None]
    return rows


def lefts_at(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes before each place, the nearest first, zeros beyond their number."""
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data])
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, LEFT)[at, ::-1])
    short = np.flatnonzero(lengths < LEFT)
    rows[short] *= np.arange(LEFT) < lengths[short, None]
    return rows


def sorted_order(rows: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The order by ``first`` (32 bits), then by suffix; the shorter of two that are equal but for zeros goes first."""
    key = np.empty((len(rows), LENGTH + 5), np.uint8)
    key[:, :4] = first.astype(">u4").view(np.uint8).reshape(-1, 4)
    key[:, 4:-1] = rows[:, :LENGTH]
    key[:, -1] = lengths
    return np.argsort(key.view(f"S{LENGTH + 5}").ravel(), kind="stable")


def neighbours_share(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        apart = rows[1:] != rows[:-1]
        same = ~apart.any(axis=1)
        n = np.where(same, LENGTH, apart.argmax(axis=1))
        out[1:] = np.minimum(n, np.minimum(lengths[1:], lengths[:-1]))
    return out


def front_coded(rows: np.ndarray, lengths: np.ndarray, shared: np.ndarray) -> bytes:
    """The bytes of sorted suffixes beyond what each shares with the one before, on end."""
    column = np.arange(rows.shape[1])
    return rows[(column >= shared[:, None]) & (column < lengths[:, None])].tobytes()


def decoded(shared: np.ndarray, lengths: np.ndarray, rests: bytes) -> np.ndarray:
    """The rows of front_coded() again; several runs on end, each of which begins with nothing shared."""
    column = np.arange(8 * WORDS)
    rows = np.zeros((len(shared), 8 * WORDS), np.uint8)
    own = (column >= shared[:, None]) & (column < lengths[:, None])
    rows[own] = np.frombuffer(rests, np.uint8)
    # a byte below the shared length is the one of the last suffix that does not share it
    source = np.where(column < shared[:, None], 0, np.arange(len(shared), dtype=np.int32)[:, None])
    return np.take_along_axis(rows, np.maximum.accumulate(source, axis=0), axis=0)


def merge_runs(known: list[list[int]], words: list[list[list[int]]], lengths: list[list[int]]) -> tuple[array, array]:
    """Merge sorted runs with a loser tree on common prefixes: the runs' numbers in the merged order, and each suffix's prefix shared with the one before.

    Of each run its suffixes' shared prefixes, words and lengths are given. A run's entry carries the length that it
    shares with the last winner; -1 where the run is at its end. Of two entries the one that shares more is the smaller;
    only where both share as much are they compared, from the word on in which what is known to be equal ends.
    """
    k = 1
    while k < len(known):
        k *= 2
    sizes, at = [len(t) for t in words] + [0] * (k - len(known)), [0] * k
    text = [t[0] if t else () for t in words] + [()] * (k - len(known))
    size = [n[0] if n else 0 for n in lengths] + [0] * (k - len(known))
    losers, lost = [0] * k, [-1] * k  # the run that lost at a node, and what it shares with the winner there

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0 if sizes[node - k] else -1
        (w, h), (x, hx) = build(2 * node), build(2 * node + 1)
        if h == hx >= 0 and (text[x], size[x]) < (text[w], size[w]) or h < hx:
            w, h, x, hx = x, hx, w, h
        n = -1
        if hx >= 0:
            n = next((8 * i + 8 - ((p ^ q).bit_length() + 7) // 8 for i, (p, q) in enumerate(zip(text[w], text[x])) if p != q), LENGTH)
            n = min(n, size[w], size[x])
        losers[node], lost[node] = x, n
        return w, h

    order, shared = array("i"), array("b")
    w, h = build(1) if k > 1 else (0, 0)
    for _ in range(sum(sizes)):
        order.append(w)
        shared.append(h)
        i = at[w] = at[w] + 1
        if i < sizes[w]:
            h, text[w], size[w] = known[w][i], words[w][i], lengths[w][i]
        else:
            h = -1
        node = (w + k) >> 1
        while node:
            hx = lost[node]
            if h < hx:
                losers[node], w = w, losers[node]
                lost[node], h = h, hx
            elif h == hx >= 0:
                x = losers[node]
                a, b, n = text[w], text[x], h >> 3
                while n < WORDS and a[n] == b[n]:
                    n += 1
                if n == WORDS:
                    n, behind = LENGTH, size[w] > size[x]
                else:
                    behind = a[n] > b[n]
                    n = 8 * n + 8 - ((a[n] ^ b[n]).bit_length() + 7) // 8
                if behind:
                    losers[node], w, x = w, x, w
                lost[node] = min(n, size[w], size[x])
            node >>= 1
    return order, shared


def covered_windows(shared: np.ndarray, lengths: np.ndarray, left: np.ndarray, left_len: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of a merged order the first and last covered byte before and after its anchor; -1 where none is.

    A window that begins o bytes before the anchor is the same for suffixes that share 50 - o bytes and o bytes before.
    """
    n = len(ids)
    low, high = np.full(n, -1), np.full(n, -1)
    before, bytes_before = np.zeros(n, np.uint64), np.zeros((n, 8 * LEFT_WORDS), np.uint8)
    for o in range(LEFT + 1):
        if o:
            bytes_before[:, o - 1] = left[:, o - 1]
            with np.errstate(over="ignore"):
                before = mix64(before * np.uint64(_BASE) + left[:, o - 1].astype(np.uint64) + np.uint64(1))
        fits = np.flatnonzero((lengths >= LENGTH - o) & (left_len >= o))
        if not len(fits):
            continue
        group = np.cumsum(shared < LENGTH - o).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = mix64(group * np.uint64(_BASE) ^ before)[fits]
        order = np.argsort(key)
        ks, rows = key[order], fits[order]
        exact = np.column_stack([group[rows], bytes_before.view(np.uint64)[rows]])
        apart = (exact[1:] != exact[:-1]).any(axis=1)
        if (apart & (ks[1:] == ks[:-1])).any():  # two windows of one hash: sort by what they are
            order = np.lexsort(exact.T)
            rows, exact = rows[order], exact[order]
            apart = (exact[1:] != exact[:-1]).any(axis=1)
        heads = np.flatnonzero(np.append(True, apart))
        least = np.repeat(np.minimum.reduceat(ids[rows], heads), np.diff(np.append(heads, len(rows))))
        hit = rows[ids[rows] > least]
        high[hit] = np.where(high[hit] < 0, LENGTH - o, high[hit])  # the least o reaches farthest right
        low[hit] = o
    return low, high


RUN = "range bigint, chunk bigint, shared binary, lengths binary, rests binary, lefts binary, ids binary, places binary"


def suffix_runs(chunks: DataFrame, found: DataFrame, hot, ranges: int, take_hot: bool) -> DataFrame:
    """The front-coded runs of every chunk's remaining suffixes by range; or the windows of hot anchors, ``w, id, chunk, at``.

    ``w`` is a window's bytes, ``at`` has all its places in a document.
    """

    def windows(c: Chunk, at: np.ndarray, doc: np.ndarray) -> Iterator[tuple[list, int, list]]:
        for i, part in runs_of(doc):
            a, b = c.starts[i], c.starts[i + 1]
            if b - a < LENGTH:
                continue
            all_, reach = np.lib.stride_tricks.sliding_window_view(c.data[a:b], LENGTH), np.zeros(b - a + 1, np.int32)
            np.add.at(reach, np.maximum(at[part] - a - LEFT, 0), 1)
            np.add.at(reach, at[part] - a + 1, -1)
            s = np.flatnonzero(np.cumsum(reach[:-1])[: len(all_)] > 0)
            for k in range(0, len(s), 1 << 18):
                some = s[k : k + (1 << 18)]
                unique, which = np.unique(np.ascontiguousarray(all_[some]).view(f"S{LENGTH}").ravel(), return_inverse=True)
                order = np.argsort(which, kind="stable")
                raw, at_ = unique.tobytes(), some[order] + a
                of = list(runs_of(which[order]))
                for m in range(0, len(of), 10_000):
                    yield (
                        [raw[x * LENGTH : (x + 1) * LENGTH] for x, _ in of[m : m + 10_000]], int(c.ids[i]),
                        [deltas(at_[p].astype(np.uint64)) for _, p in of[m : m + 10_000]],
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = hot.value
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row)
                at, fp, doc = c.anchors()
                is_hot = np.isin(fp, heavy)
                keep = is_hot if take_hot else ~is_hot & np.isin(fp, np.concatenate([undeltas(x) for x in row["found"]]))
                at, fp, doc = at[keep], fp[keep], doc[keep]
                if take_hot:
                    for w, i, s in windows(c, at, doc):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(w, pa.binary()), pa.array([i] * len(w), pa.int64()), pa.array([row["chunk"]] * len(w), pa.int64()), pa.array(s, pa.binary())],
                            names=["w", "id", "chunk", "at"],
                        )
                    continue
                lengths = np.minimum(c.starts[doc + 1] - at, LENGTH)
                rows, where = suffixes_at(c.data, at, lengths), _range_of(fp, ranges)
                order = sorted_order(rows, lengths, where)
                rows, lengths, at, doc, where = rows[order], lengths[order], at[order], doc[order], where[order]
                shared = neighbours_share(rows, lengths)
                shared[np.flatnonzero(np.append(True, where[1:] != where[:-1])[: len(where)])] = 0
                left_len = np.minimum(at - c.starts[doc], LEFT)
                left = lefts_at(c.data, at, left_len)
                for r, part in runs_of(where):
                    yield pa.RecordBatch.from_pylist(
                        [{
                            "range": r, "chunk": row["chunk"], "shared": squeezed(shared[part].tobytes()), "lengths": squeezed(lengths[part].astype(np.uint8).tobytes()),
                            "rests": squeezed(front_coded(rows[part], lengths[part], shared[part])),
                            "lefts": squeezed(np.column_stack([left_len[part].astype(np.uint8), left[part]]).tobytes()),
                            "ids": planes(c.ids[doc[part]]), "places": planes(at[part]),
                        }],
                        schema=pa.schema([("range", pa.int64()), ("chunk", pa.int64()), *((x, pa.binary()) for x in ("shared", "lengths", "rests", "lefts", "ids", "places"))]),
                    )

    if take_hot:  # two documents share each of them: chunks need not meet what is found, nor move
        return in_batches(chunks.drop("rest")).mapInArrow(run, "w binary, id bigint, chunk bigint, at binary")
    own = found.groupBy("chunk").agg(F.collect_list("found").alias("found"))
    joined = chunks.join(own.hint("merge"), "chunk")  # all columns, as in the last step: one exchange serves both
    return in_batches(joined).mapInArrow(run, RUN)


def _merged(rows: pa.Table) -> pa.Table:
    """One range: merge its runs, and give each chunk the spans to remove."""
    rows = rows.sort_by("chunk")
    got = {c: [unsqueezed(x) for x in rows.column(c).to_pylist()] for c in ("shared", "lengths", "rests", "lefts")}
    known, lengths = (np.frombuffer(b"".join(got[c]), np.uint8).astype(np.int64) for c in ("shared", "lengths"))
    words = decoded(known, lengths, b"".join(got["rests"])).view(">u8").tolist()
    ends = np.cumsum([len(x) for x in got["shared"]])
    cuts = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
    order, shared = merge_runs(*([x[a:b] for a, b in cuts] for x in (known.tolist(), words, lengths.tolist())))
    by_run = np.frombuffer(order, np.int32) if len(order) else np.zeros(0, np.int32)
    del words
    back = np.argsort(by_run, kind="stable")  # a run's suffixes come out in its own order
    where = np.empty(len(order), np.int64)
    where[back] = np.arange(len(order))
    left = np.frombuffer(b"".join(got["lefts"]), np.uint8).reshape(-1, LEFT + 1)[where]
    ids, places = (np.concatenate([unplaned(x) for x in rows.column(c).to_pylist()]).view(np.int64)[where] for c in ("ids", "places"))
    of = by_run
    low, high = covered_windows(np.frombuffer(shared, np.int8).astype(np.int64), lengths[where], left[:, 1:], left[:, 0].astype(np.int64), ids)
    out = []
    for k, chunk in enumerate(rows.column("chunk").to_pylist()):
        mine = np.flatnonzero((of == k) & (low >= 0))
        if len(mine):
            mine = mine[np.argsort(places[mine])]
            out.append({"chunk": chunk, "starts": planes(places[mine] - low[mine]), "sizes": planes(low[mine] + high[mine])})
    return pa.Table.from_pylist(out, schema=pa.schema([("chunk", pa.int64()), ("starts", pa.binary()), ("sizes", pa.binary())]))


def spans_of(chunks: DataFrame, hot_docs: int = HOT_DOCS) -> DataFrame:
    """``chunk, starts, sizes``: blobs of the byte spans to remove, in places of the chunk."""
    spark = chunks.sparkSession
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    ranges, parts = (int(max(8, min(total // size, max(MANY, total // (8 * size))))) for size in (HASH_BYTES, SUFFIX_BYTES))
    most = max(hot_docs, total // HOT_SHARE)
    repeated = repeated_anchors(chunks, ranges, most)
    found = repeated.filter("found IS NOT NULL").select("chunk", "found")
    over = [undeltas(r.hot) for r in repeated.filter("hot IS NOT NULL").select("hot").collect()]
    hot = spark.sparkContext.broadcast(np.concatenate(over) if over else np.zeros(0, np.uint64))
    runs = suffix_runs(chunks, found, hot, parts, False)
    spans = runs.groupBy("range").applyInArrow(_merged, "chunk bigint, starts binary, sizes binary")
    if over:
        rows = written(suffix_runs(chunks, found, hot, parts, True), "windows")
        # written, so that both sides of the join are plain exchanges and Spark can split the partitions of hot windows
        least = written(rows.groupBy("w").agg(F.min("id").alias("least")), "least")
        hit = rows.join(least.hint("merge"), "w").filter("id > least").groupBy("chunk").agg(F.collect_list("at").alias("at"))

        def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = [np.unique(np.concatenate([undeltas(blob) for blob in x])) for x in b.column("at").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("chunk"), pa.array([planes(x) for x in at], pa.binary()), pa.array([planes(np.full(len(x), LENGTH)) for x in at], pa.binary())],
                    names=["chunk", "starts", "sizes"],
                )

        spans = spans.union(in_batches(hit).mapInArrow(blobs, "chunk bigint, starts binary, sizes binary"))
    return spans


def without_repeats(docs: DataFrame, text: str = "text", hot_docs: int = HOT_DOCS) -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` of every row: the removed spans (start, end) in bytes, and the bytes that stay."""

    def cut(c: Chunk, keep: np.ndarray, rest: bytes | None) -> Iterator[pa.RecordBatch]:
        sizes, removed, kept = np.diff(c.starts), [], []
        for a, e in zip(c.starts[:-1], c.starts[1:]):
            edges = np.flatnonzero(np.diff(np.concatenate([[True], keep[a:e], [True]]).astype(np.int8)))
            removed.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2])])
            kept.append(c.data[a:e][keep[a:e]].tobytes())
        ids = pa.array(c.ids, pa.int64(), mask=~c.known)
        for k in range(0, len(ids), 500):
            p = slice(k, k + 500)
            yield pa.RecordBatch.from_arrays(
                [ids[p], pa.array(sizes[p]), pa.array(removed[p], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept[p], pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )

    return _cut_chunks(make_chunks(docs, text), hot_docs, cut, "doc_id bigint, n_bytes bigint, removed array<struct<start: bigint, end: bigint>>, kept binary")


def shortened(docs: DataFrame, text: str = "text", hot_docs: int = HOT_DOCS) -> DataFrame:
    """All rows and columns of ``docs`` with what stays of each text; a character that is cut in two goes, a null text stays null."""
    names = docs.columns
    no_text = fresh(names, "_no_text")[0]
    keep_columns = tuple(c for c in names if c != text)

    def cut(c: Chunk, keep: np.ndarray, rest: bytes | None) -> Iterator[pa.RecordBatch]:
        kept = [c.data[a:e][keep[a:e]].tobytes().decode("utf-8", "ignore") for a, e in zip(c.starts[:-1], c.starts[1:])]
        columns = pa.ipc.open_stream(rest).read_all()
        for k in range(0, len(kept), 500):
            part = columns.slice(k, 500).combine_chunks()
            texts = pa.array(kept[k : k + 500], pa.string(), mask=np.array(part.column(no_text).to_pylist(), bool))
            yield pa.RecordBatch.from_arrays(
                [texts if name == text else part.column(name).chunk(0) for name in names], names=names
            )

    marked = docs.withColumn(no_text, F.col(text).isNull())
    return _cut_chunks(make_chunks(marked, text, (*keep_columns, no_text)), hot_docs, cut, docs.schema)


def _cut_chunks(chunks: DataFrame, hot_docs: int, cut, schema) -> DataFrame:
    """What ``cut`` makes of each chunk, the bytes of it that stay, and its other columns."""
    spans = spans_of(chunks, hot_docs).groupBy("chunk").agg(F.collect_list("starts").alias("starts"), F.collect_list("sizes").alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row)
                gone = np.zeros(len(c.data) + 1, np.int32)
                for s, n in zip(row["starts"] or [], row["sizes"] or []):
                    s, n = unplaned(s).view(np.int64), unplaned(n).view(np.int64)
                    np.add.at(gone, s, 1)
                    np.add.at(gone, s + n, -1)
                yield from cut(c, np.cumsum(gone[:-1]) == 0, row["rest"])

    # with the filter that the other join implies, both joins read one exchange of the chunks
    return in_batches(chunks.filter("chunk IS NOT NULL").join(spans.hint("merge"), "chunk", "left")).mapInArrow(run, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, with what of each text is removed and the digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
