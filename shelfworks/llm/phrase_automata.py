"""Substring dedup: words covered by a passage of 20 words that also starts earlier are removed, found by phrase automata.

1. Candidates. Of every 13 neighbouring 8-word strings the one with the least hash is an anchor, so each window of 20 words has
   one, wherever it occurs. Chunks of texts deal the sorted, delta-coded hashes of their anchors out to ranges and get
   back those that occur twice or more. Only windows around these go on, in stretches: the words of all neighbouring
   windows that have one anchor.
2. Confirmation. Stretches go to the shard of their anchor, so that all places of a window meet. A shard takes as its
   dictionary the recurring passages: neighbouring windows that occur together everywhere make one passage.
3. Automata. The dictionary of a shard, some anchors at a time, is compiled into an Aho-Corasick automaton over numbers
   of words, and the stretches of all documents stream through it. What it finds are equal words; hashes only choose
   what is put into it. A window that it should have found and did not (two windows of one hash) is put into another.
4. Each window's first place is the least (doc_id, word number); all its other places are removed.

An anchor that occurs very often would fill a shard. Windows around such ones are split by their own words: one row for each
window and chunk, with the least place first, aggregated by Spark before and after the exchange.

Windows are judged on the input. Defined cases: a null text counts as the empty one; texts under 20 words stay whole; rows
that share an id are one document's: of the same window at one word number both stay; a row with a null id stays
whole and removes nothing; repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfworks.llm.blobs import deltas, planes, runs_of, squeezed, undeltas, unplaned, unsqueezed
from shelfworks.llm.shared import in_batches, table, written
from shelfworks.llm.suffix_dedup import Chunk, make_chunks
from shelfworks.llm.words import mix64, word_hashes

WINDOW, GRAM = 20, 8
#: Anchors among which a window's one is chosen.
CHOICE = WINDOW - GRAM + 1
#: Bytes of text for each range of anchor hashes, and for each shard; over MANY they hold more each.
HASH_BYTES, SHARD_BYTES, MANY = 16 << 20, 4 << 20, 4_000
#: An anchor that occurs more often than this goes through the aggregation by windows; the limit grows with the bytes of
#: all texts, so that at most 10 million anchors (80 MB) can be above it.
HOT, HOT_SHARE = 20_000, 100_000_000
#: Words of stretches that one automaton is made from.
AUTOMATON_WORDS = 400_000
FP_BITS = 48
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_tables: dict[str, np.ndarray] = {}


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k numbers from each place on, from sums of the numbers times powers of an odd base."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(_tables.get("up", ())) < n + 1:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                _tables[name] = np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)), dtype=np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(hashes * _tables["up"][:n], dtype=np.uint64))
        return mix64((sums[k:] - sums[:-k]) * _tables["down"][: n - k + 1])


class Words:
    """The words of a chunk: their places, the text each is in, and its number there; ``ok`` are the starts of windows."""

    def __init__(self, c: Chunk):
        # a byte between texts, so that no word is in two
        self.data = np.insert(c.data, c.starts[1:], 0x20)
        begins = c.starts[:-1] + np.arange(len(c.ids))
        inside = np.concatenate(([False], ~_SPACE[self.data], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.starts, begins)  # each text's first word
        self.of = np.searchsorted(begins, self.starts, side="right") - 1
        self.number = np.arange(len(self.starts)) - self.first[self.of] if len(self.starts) else np.zeros(0, np.int64)
        self.ids, self.known = c.ids, c.known

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the anchors at their places; the window starts, and each one's anchor's hash."""
        n = len(self.starts) - WINDOW + 1
        if n < 1:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = rolled(word_hashes(self.raw), GRAM) >> np.uint64(64 - FP_BITS)
        least = np.lib.stride_tricks.sliding_window_view(grams, CHOICE).min(axis=1)
        ok = (self.of[:n] == self.of[WINDOW - 1 :]) & self.known[self.of[:n]]
        edge = np.full(CHOICE - 1, np.uint64(1 << 63))
        # an anchor is a string that is the least of some window around it
        around = np.concatenate([edge, np.where(ok, least, edge[0]), edge])
        is_anchor = np.zeros(len(grams), bool)
        for k in range(CHOICE):
            is_anchor |= around[k : k + len(grams)] == grams
        at = np.flatnonzero(ok)
        return grams[is_anchor], at, least[at]

    def texts(self, at: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The words from each place on, with one space between."""
        data, spaces, last = self.raw, self.spaces, at + sizes - 1
        out = [data[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[last].tolist())]
        for i in np.flatnonzero(spaces[last] != spaces[at]).tolist():
            out[i] = b" ".join(out[i].split())
        return out

    @cached_property
    def raw(self) -> bytes:
        """The texts, with a space after each."""
        return self.data.tobytes()

    @cached_property
    def spaces(self) -> np.ndarray:
        """A number for each word that differs from that of a word before where other white space than one space lies between."""
        return np.cumsum(np.append(0, (self.starts[1:] - self.ends[:-1] != 1) | (self.data[self.ends[:-1]] != 0x20)))


def recurring_anchors(chunks: DataFrame, ranges: int, hot: int) -> DataFrame:
    """``chunk, found, hot``: for each chunk and range the anchors that occur twice or more, and those that occur over ``hot`` times."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                unique, n = np.unique(Words(Chunk(row)).anchors()[0], return_counts=True)
                where = (unique % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                unique, n, where = unique[order], n[order], where[order]
                for r, part in runs_of(where):
                    yield pa.RecordBatch.from_pylist(
                        [{"range": r, "chunk": row["chunk"], "fp": deltas(unique[part]), "n": planes(n[part])}],
                        schema=pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("fp", pa.binary()), ("n", pa.binary())]),
                    )

    def meet(rows: pa.Table) -> pa.Table:
        lists = [undeltas(x) for x in rows.column("fp").to_pylist()]
        unique, place = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([unplaned(x) for x in rows.column("n").to_pylist()]).astype(np.float64))
        shared, over, out = unique[total > 1], unique[total > hot], []
        for chunk, own in zip(rows.column("chunk").to_pylist(), lists):
            mine = own[np.isin(own, shared, assume_unique=True)]
            if len(mine):
                out.append({"chunk": chunk, "found": deltas(mine), "hot": None})
        if len(over):
            out.append({"chunk": None, "found": None, "hot": deltas(over)})
        return pa.Table.from_pylist(out, schema=pa.schema([("chunk", pa.int64()), ("found", pa.binary()), ("hot", pa.binary())]))

    dealt = in_batches(chunks.drop("rest")).mapInArrow(deal, "range bigint, chunk bigint, fp binary, n binary")
    return written(dealt.groupBy("range").applyInArrow(meet, "chunk bigint, found binary, hot binary"), "recurring")


STRETCHES = "shard bigint, chunk bigint, texts binary, anchors binary, ids binary, numbers binary, at binary"


def stretches(chunks: DataFrame, found: DataFrame, hot, shards: int) -> DataFrame:
    """Per chunk and shard the stretches of windows around recurring anchors that are not hot: words, anchor, id, and word numbers in text and chunk."""
    own = found.groupBy("chunk").agg(F.collect_list("found").alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                w = Words(Chunk(row))
                _, at, fp = w.anchors()
                keep = np.isin(fp, np.concatenate([undeltas(x) for x in row["found"]])) & ~np.isin(fp, hot.value)
                at, fp = at[keep], fp[keep]
                if not len(at):
                    continue
                head = np.append(True, (at[1:] != at[:-1] + 1) | (fp[1:] != fp[:-1]) | (w.of[at[1:]] != w.of[at[:-1]]))
                first = np.flatnonzero(head)
                sizes = np.diff(np.append(first, len(at))) + WINDOW - 1
                at, fp = at[first], fp[first]
                where = (fp % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((fp, where))
                at, fp, where, sizes = at[order], fp[order], where[order], sizes[order]
                for r, part in runs_of(where):
                    a = at[part]
                    yield pa.RecordBatch.from_pylist(
                        [{
                            "shard": r, "chunk": row["chunk"], "texts": squeezed(b"\n".join(w.texts(a, sizes[part]))), "anchors": deltas(fp[part]),
                            "ids": planes(w.ids[w.of[a]]), "numbers": planes(w.number[a]), "at": planes(a),
                        }],
                        schema=pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), *((x, pa.binary()) for x in ("texts", "anchors", "ids", "numbers", "at"))]),
                    )

    joined = chunks.join(own.hint("merge"), "chunk")  # all columns, as in the last step: one exchange serves both
    return in_batches(joined).mapInArrow(cut, STRETCHES)


def _least_by(group: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups numbered from 0 the row of the least (first, second), and whether each row is as low as its group's least."""
    order = np.lexsort((second, first, group))
    heads = order[np.flatnonzero(np.append(True, group[order[1:]] != group[order[:-1]]))]
    return heads, (first == first[heads][group]) & (second == second[heads][group])


class Located:
    """Windows in stretches: the automaton of the passages that recur among them, and what it finds."""

    def __init__(self, texts: list[bytes], copies: np.ndarray):
        """``texts`` are distinct; ``copies`` says how often each occurs."""
        ids: dict[bytes, int] = {}
        words = [[ids.setdefault(x, len(ids) + 1) for x in t.split(b" ")] for t in texts]
        sizes = np.array([len(x) for x in words])
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        flat = np.zeros(self.starts[-1], np.int64)  # zeros between stretches
        for s, x in zip(self.starts.tolist(), words):
            flat[s : s + len(x)] = x
        self.flat = flat
        self.stretch = np.repeat(np.arange(len(texts)), sizes - WINDOW + 1)
        self.offset = np.arange(len(self.stretch)) - np.repeat(np.cumsum(sizes - WINDOW + 1) - (sizes - WINDOW + 1), sizes - WINDOW + 1)
        self.at = self.starts[self.stretch] + self.offset
        self.copies = copies

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The windows (rows of stretch and offset) that recur, and for each a number that equal windows share."""
        import ahocorasick

        hashes = rolled(mix64(self.flat.astype(np.uint64)), WINDOW)[self.at]
        _, kind = np.unique(hashes, return_inverse=True)
        open_ = np.flatnonzero(np.bincount(kind, weights=self.copies[self.stretch])[kind] > 1)
        number, base = np.full(len(self.at), -1, np.int64), 0
        while len(open_):
            # one window of each hash stands for it; where the next one of its stretch goes with it everywhere, both are one passage
            _, rep, which = np.unique(kind[open_], return_index=True, return_inverse=True)
            of, off = self.stretch[open_], self.offset[open_]
            with np.errstate(over="ignore"):
                side = np.zeros(len(rep), np.uint64)
                np.add.at(side, which, mix64((of.astype(np.uint64) << np.uint64(24)) + (off - off[rep][which] + (1 << 23)).astype(np.uint64)))
            order = np.lexsort((off[rep], of[rep]))
            r = rep[order]
            joins = (of[r][1:] == of[r][:-1]) & (off[r][1:] == off[r][:-1] + 1) & (side[order][1:] == side[order][:-1])
            if base:  # something was missed: each window by itself, found wherever it is
                joins[:] = False
            heads = np.flatnonzero(np.append(True, ~joins))
            spans = np.diff(np.append(heads, len(r)))
            machine, tuples = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), self.flat.tolist()
            for k, (a, n) in enumerate(zip(self.at[open_][r][heads].tolist(), spans.tolist())):
                machine.add_word(tuple(tuples[a : a + n + WINDOW - 1]), k)
            machine.make_automaton()
            hits = np.array([x for hit in machine.iter(tuple(tuples)) for x in hit], np.int64).reshape(-1, 2)
            n = spans[hits[:, 1]]
            each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(hits[:, 0] - n - WINDOW + 2, n) + each  # where each window that a hit covers begins
            here = np.searchsorted(self.at, place)
            number[here] = base + np.repeat(heads[hits[:, 1]], n) + each
            base += len(r)
            open_ = open_[number[open_] < 0]
        found = np.flatnonzero(number >= 0)
        _, number = np.unique(number[found], return_inverse=True)
        return found, number


def _removed(rows: pa.Table) -> pa.Table:
    """One shard: for each chunk the word numbers at which windows to remove begin."""
    chunk_of, parts = [], {c: [] for c in ("texts", "anchors", "ids", "numbers", "at")}
    for k, row in enumerate(rows.to_pylist()):
        texts = unsqueezed(row["texts"]).split(b"\n")
        parts["texts"] += texts
        chunk_of.append(np.full(len(texts), k))
        parts["anchors"].append(undeltas(row["anchors"]))
        for c in ("ids", "numbers", "at"):
            parts[c].append(unplaned(row[c]).view(np.int64))
    chunk_of, texts = np.concatenate(chunk_of), parts.pop("texts")
    fp, ids, numbers, at = (np.concatenate(parts[c]) for c in ("anchors", "ids", "numbers", "at"))
    order = np.argsort(fp, kind="stable")
    out: list[list[np.ndarray]] = [[] for _ in range(rows.num_rows)]
    group, size = [], 0
    cuts = np.flatnonzero(np.append(True, fp[order][1:] != fp[order][:-1]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        group.append(order[a:b])
        size += sum(texts[i].count(b" ") + 1 for i in order[a:b].tolist())
        if size >= AUTOMATON_WORDS or b == len(order):
            _remove_among(np.concatenate(group), texts, chunk_of, ids, numbers, at, out)
            group, size = [], 0
    made = [{"chunk": c, "starts": deltas(np.unique(np.concatenate(x)).astype(np.uint64))} for c, x in zip(rows.column("chunk").to_pylist(), out) if x]
    return pa.Table.from_pylist(made, schema=pa.schema([("chunk", pa.int64()), ("starts", pa.binary())]))


def _remove_among(some: np.ndarray, texts: list[bytes], chunk_of: np.ndarray, ids: np.ndarray, numbers: np.ndarray, at: np.ndarray, out: list[list[np.ndarray]]) -> None:
    """Add to ``out``, by chunk, the places of all windows in these stretches but the first of each."""
    distinct: dict[bytes, int] = {}
    which = np.array([distinct.setdefault(texts[i], len(distinct)) for i in some.tolist()])
    copies = np.bincount(which)
    located = Located(list(distinct), copies)
    found, number = located.windows()
    if not len(found):
        return
    # the least place of each distinct stretch gives the least place of each window
    least, _ = _least_by(which, ids[some], numbers[some])
    stretch, offset = located.stretch[found], located.offset[found]
    doc, place = ids[some][least][stretch], numbers[some][least][stretch] + offset
    heads, _ = _least_by(number, doc, place)
    first_doc, first_place = doc[heads], place[heads]
    # each copy of a stretch has all its windows
    order = np.argsort(which, kind="stable")
    begins = np.concatenate([[0], np.cumsum(copies)])
    n = copies[stretch]
    copy = order[np.repeat(begins[stretch], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    rows, w, off = some[copy], np.repeat(number, n), np.repeat(offset, n)
    gone = (ids[rows] != first_doc[w]) | (numbers[rows] + off != first_place[w])
    rows, spot = rows[gone], (at[rows] + off)[gone]
    order = np.argsort(chunk_of[rows], kind="stable")
    for k, part in runs_of(chunk_of[rows][order]):
        out[k].append(spot[order][part])


WINDOWS = "w binary, chunk bigint, id bigint, number bigint, lowest binary, rest binary"


def hot_windows(chunks: DataFrame, hot) -> DataFrame:
    """The windows around hot anchors, one row for each and chunk: its words, its least place there, and where in the chunk that and the others are."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                w = Words(Chunk(row))
                _, at, fp = w.anchors()
                at = at[np.isin(fp, hot.value)]
                for i in range(0, len(at), 200_000):
                    some = at[i : i + 200_000]
                    distinct: dict[bytes, int] = {}
                    which = np.array([distinct.setdefault(t, len(distinct)) for t in w.texts(some, np.full(len(some), WINDOW))])
                    ids, numbers = w.ids[w.of[some]], w.number[some]
                    heads, low = _least_by(which, ids, numbers)
                    order = np.lexsort((some, which))
                    low, where = low[order], some[order].astype(np.uint64)
                    blobs = [(deltas(where[p][low[p]]), deltas(where[p][~low[p]]) if not low[p].all() else None) for _, p in runs_of(which[order])]
                    for k in range(0, len(heads), 5_000):
                        p = slice(k, k + 5_000)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(list(distinct)[p], pa.binary()), pa.array([row["chunk"]] * len(heads[p]), pa.int64()), pa.array(ids[heads[p]]), pa.array(numbers[heads[p]]),
                             pa.array([x for x, _ in blobs[p]], pa.binary()), pa.array([x for _, x in blobs[p]], pa.binary())],
                            names=["w", "chunk", "id", "number", "lowest", "rest"],
                        )

    return in_batches(chunks.drop("rest")).mapInArrow(cut, WINDOWS)


def removed_windows(chunks: DataFrame, hot_limit: int = HOT) -> DataFrame:
    """``chunk, starts``: blobs of the word numbers, in the chunk, at which windows to remove begin."""
    spark = chunks.sparkSession
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    ranges, shards = (int(max(8, min(total // size, max(MANY, total // (8 * size))))) for size in (HASH_BYTES, SHARD_BYTES))
    recurring = recurring_anchors(chunks, ranges, max(hot_limit, total // HOT_SHARE))
    found = recurring.filter("found IS NOT NULL").select("chunk", "found")
    over = [undeltas(r.hot) for r in recurring.filter("hot IS NOT NULL").select("hot").collect()]  # at most 10 million anchors
    hot = spark.sparkContext.broadcast(np.concatenate(over) if over else np.zeros(0, np.uint64))
    gone = stretches(chunks, found, hot, shards).groupBy("shard").applyInArrow(_removed, "chunk bigint, starts binary")
    if over:
        rows = written(hot_windows(chunks, hot), "hot-windows")
        # written, so that both sides of the join are plain exchanges and Spark can split the partitions of hot windows
        least = written(rows.groupBy("w").agg(F.min(F.struct("id", "number")).alias("least")), "hot-first")
        hit = rows.join(least.hint("merge"), "w")
        later = F.struct("id", "number") != F.col("least")
        blobs = F.array_compact(F.array(F.when(later, F.col("lowest")), F.col("rest")))
        gone = gone.union(hit.select("chunk", F.explode(blobs).alias("starts")))
    return gone


def without_recurring(docs: DataFrame, text: str = "text", hot_limit: int = HOT) -> DataFrame:
    """``doc_id, n_words, removed, kept`` of every row: the removed runs of words (start, end), and the words that stay with one space between."""
    chunks = make_chunks(docs, text)
    gone = removed_windows(chunks, hot_limit).groupBy("chunk").agg(F.collect_list("starts").alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                w = Words(Chunk(row))
                cover = np.zeros(len(w.starts) + 1, np.int32)
                for blob in row["gone"] or []:
                    s = undeltas(blob).astype(np.int64)
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + WINDOW, -1)
                keep = np.cumsum(cover[:-1]) == 0
                data, bounds, sizes, removed, kept = w.raw, [*w.first.tolist(), len(w.starts)], [], [], []
                for a, e in zip(bounds, bounds[1:]):
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], keep[a:e], [True]]).astype(np.int8)))
                    removed.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2])])
                    left = np.flatnonzero(keep[a:e]) + a
                    kept.append(b" ".join([data[x:y] for x, y in zip(w.starts[left].tolist(), w.ends[left].tolist())]))
                    sizes.append(e - a)
                ids = pa.array(w.ids, pa.int64(), mask=~w.known)
                for k in range(0, len(sizes), 500):
                    p = slice(k, k + 500)
                    yield pa.RecordBatch.from_arrays(
                        [ids[p], pa.array(sizes[p], pa.int64()), pa.array(removed[p], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept[p], pa.binary())],
                        names=["doc_id", "n_words", "removed", "kept"],
                    )

    # with the filter that the other join implies, both joins read one exchange of the chunks
    joined = chunks.filter("chunk IS NOT NULL").join(gone.hint("merge"), "chunk", "left")
    return in_batches(joined).mapInArrow(cut, "doc_id bigint, n_words bigint, removed array<struct<start: bigint, end: bigint>>, kept binary")


def op13_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, with how many words of each text are removed and the digest of those that stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return without_recurring(docs).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
