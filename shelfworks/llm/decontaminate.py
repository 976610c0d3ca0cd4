"""Benchmark decontamination by template windows.

Texts and benchmark items become template tokens: ASCII small letters without punctuation, with numbers, names (capitals
inside a sentence) and units replaced by typed placeholders, one for each value of however many words ("1,300", "Mary
Lou"). Windows of eight template tokens meet in a hash join, and a
meeting counts only while its slots agree along the passage: one value of the item always stands for one value of the
text, and different names or units stay different. So a question with other numbers and names is found, and a text that
merely has the same shape is not.

Case and punctuation do not decide whether windows meet: both sides are read in three ways, with every capitalised word
as a name, with those inside a sentence only, and with none. A reading of an item is judged against all readings of the
text, and the one with most windows counts. So a copy
is found in capitals, in small letters, without stops or in the middle of a sentence, with other numbers and units too;
other names are seen where the text has capitals that tell names from words (not in a text all in capitals, all in small
letters, or with a capital on every word).

A window with fewer than four literal tokens says too little and keeps its literal tokens instead of placeholders. Items
under eight tokens are one window of their own length. A document holds an item where six different windows of it (all,
where it has fewer) meet in one consistent chain: in one passage, whose slots agree from its first window to its last.
Windows that contradict the chain are left out of it; ``n_matched`` counts the windows of the longest chain. Windows of
a passage may be shifted against each other by as many tokens as the item has, and by up to twice as many in places.

A text's windows are first looked up in a bitmap of the benchmark's windows, of bounded size whatever the benchmark's;
only windows that may meet are moved. Numbers and slots of a meeting go to the group of its document and item.

Defined cases: null and empty texts and items hold nothing; very long texts are read whole, in pieces cut at white space;
repeated rows are judged as one document (rows of one id with different texts are judged each and named by the id); an
item that repeats another is reported as well; an empty table or benchmark gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfworks.llm.blobs import squeezed, unsqueezed
from shelfworks.llm.shared import in_batches, table, written
from shelfworks.llm.words import hashes_at, mix64, shingle_hashes, word_hashes

WINDOW, LITERALS, NEEDED = 8, 4, 6
PIECE, GROUP_BYTES = 1 << 18, 1 << 16
MOST_BITS, MAPS = 1 << 27, 8
LITERAL, NUMBER, NAME, UNIT = range(4)
#: Of a capitalised word: a name wherever it is; a name but for a sentence's first; never a name.
READINGS = 3
#: Words that are numbers, and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg lb lbs pound pounds ounce ounces ton tons ml l liter liters "
    "litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros "
    "cent cents mph kmh percent degrees"
).split()
_LETTER = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if _LETTER[b] else 32 for b in range(256))
_SENTENCE = np.isin(np.arange(256), list(b".!?:\n\0"))
_hashed = {}


def _lists() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _hashed:
        of = lambda names: np.sort(np.concatenate([word_hashes(w.encode()) for w in names]))
        _hashed["x"] = of(NUMBER_WORDS), of(UNITS), mix64(np.arange(101, 105, dtype=np.uint64))
    return _hashed["x"]


def tokens(raw: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In each of READINGS the hash of every token's letters, its kind, its number among all words, and its place.

    Words of one kind, but for literal ones, that follow each other are one token. A zero byte parts words of any kind.
    """
    number_words, units, _ = _lists()
    hashes, kinds, places, parts, at, ended, zeros = [], [], [], [], 0, True, 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
            end = cut + 1 if cut > at else end
        piece = np.frombuffer(raw, np.uint8, end - at, at)
        inside = np.concatenate(([False], _LETTER[piece], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        h = hashes_at(np.frombuffer(raw[at:end].translate(_PLAIN), np.uint8), starts, ends)
        digits = np.append(0, np.cumsum(_DIGIT[piece]))
        stops = np.append(0, np.cumsum(_SENTENCE[piece]))
        nils = zeros + np.append(0, np.cumsum(piece == 0))
        before = np.append(0, ends[:-1]) if len(ends) else ends
        first = stops[starts] > stops[before]
        if len(first):
            first[0] |= ended
        capital = (piece[starts] >= 65) & (piece[starts] <= 90)
        kind = np.zeros((READINGS, len(starts)), np.uint8)
        kind[0, capital] = NAME
        kind[1, capital & ~first] = NAME
        kind[:, _among(h, units)] = UNIT
        kind[:, (digits[ends] - digits[starts] == ends - starts) | _among(h, number_words)] = NUMBER
        ended = bool(stops[-1] > stops[ends[-1]]) if len(ends) else ended or bool(stops[-1])
        hashes.append(h)
        kinds.append(kind)
        places.append(starts + at)
        parts.append(nils[starts])
        at, zeros = end, int(nils[-1])
    if not hashes:
        return [(np.zeros(0, np.uint64), np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 2)] * READINGS
    h, kinds, places, parts = np.concatenate(hashes), np.concatenate(kinds, axis=1), np.concatenate(places), np.concatenate(parts)
    out = []
    for kind in kinds:
        goes_on = (kind[1:] == kind[:-1]) & (kind[1:] != LITERAL) & (parts[1:] == parts[:-1])
        heads = np.flatnonzero(np.append(True, ~goes_on)) if len(h) else np.zeros(0, np.int64)
        within = np.arange(len(h)) - np.repeat(heads, np.diff(np.append(heads, len(h))))
        with np.errstate(over="ignore"):
            value = np.where(within > 0, mix64(h + within.astype(np.uint64)), h)
            value = np.add.reduceat(value, heads) if len(h) else value
        out.append((value, kind[heads], heads, places[heads]))
    return out


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def windows(h: np.ndarray, kind: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the template windows of ``size`` tokens; none where there are fewer tokens."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    w = shingle_hashes(np.where(kind == LITERAL, h, _lists()[2][kind]), size)
    literal = np.append(0, np.cumsum(kind == LITERAL))
    plain = literal[size:] - literal[:-size] < min(LITERALS, size)
    if plain.any():
        w[plain] = (shingle_hashes(h, size) ^ np.uint64(1))[plain]
    return w


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``w, size, item_id, reading, at, n, reach, h, kinds``: every window of every item in each reading, with its tokens' hashes and kinds.

    ``at`` counts words, ``n`` is the number of the reading's windows, ``reach`` that of the item's words.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text")):
                read = tokens((text.as_py() or "").encode())
                for reading, (h, kind, heads, _) in enumerate(read):
                    size = min(WINDOW, len(h))
                    if size:
                        n = len(h) - size + 1
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(windows(h, kind, size).view(np.int64)), pa.array(np.full(n, size)), pa.array([item] * n, b.schema.field("item_id").type), pa.array(np.full(n, reading))]
                            + [pa.array(heads[:n]), pa.array(np.full(n, n)), pa.array(np.full(n, int(heads[-1]) + 1))]
                            + [pa.array([x[k : k + size].tobytes() for k in range(n)], pa.binary()) for x in (h, kind)],
                            names=["w", "size", "item_id", "reading", "at", "n", "reach", "h", "kinds"],
                        )

    rows = benchmark.select("item_id", "text").dropDuplicates()
    schema = f"w bigint, size bigint, item_id {dict(rows.dtypes)['item_id']}, reading bigint, at bigint, n bigint, reach bigint, h binary, kinds binary"
    return written(in_batches(rows).mapInArrow(cut, schema), "items")


def _bitmap(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """One bit for each window hash, in a map of at most MOST_BITS; and the window sizes. Tasks fill maps, the driver unites a few of them."""
    n, sizes = items.agg(F.count(F.lit(1)), F.sort_array(F.collect_set("size"))).first()
    bits = 1 << 10
    while bits < min(1024 * n, MOST_BITS):
        bits *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            place = b.column("w").to_numpy().view(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(own, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([squeezed(own.tobytes())], pa.binary())], names=["map"])

    out = np.zeros(bits // 8, np.uint8)
    for r in in_batches(items.select("w").coalesce(MAPS)).mapInArrow(fill, "map binary").collect():  # at most MAPS maps
        out |= np.frombuffer(unsqueezed(r.map), np.uint8)
    return out, list(sizes)


def meetings(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Windows of the documents that equal windows of items, with the token hashes of both and the item's kinds."""
    bitmap, sizes = _bitmap(items)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        mask = np.uint64(len(bits) * 8 - 1)
        for b in batches:
            found: dict[tuple, None] = {}  # readings that say the same give a window once
            raws = [(text.as_py() or "").encode() for text in b.column("text")]
            i = 0
            while i < len(raws):  # short texts together, a zero byte between them
                j, begins, total = i, [], 0
                while j == i or (j < len(raws) and total + len(raws[j]) < GROUP_BYTES):
                    begins.append(total)
                    total += len(raws[j]) + 1
                    j += 1
                for h, kind, heads, places in tokens(b"\0".join(raws[i:j])):
                    doc = np.searchsorted(begins, places, "right") - 1
                    head = np.searchsorted(doc, np.arange(j - i))
                    for size in sizes:
                        w = windows(h, kind, size)
                        place = w & mask
                        hit = np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                        hit = hit[doc[hit] == doc[hit + size - 1]]
                        for k, x, d in zip(hit.tolist(), w[hit].view(np.int64).tolist(), doc[hit].tolist()):
                            found[i + d, x, int(heads[k] - heads[head[d]]), h[k : k + size].tobytes()] = None
                i = j
            if found:
                row, w, at, own = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "tie")] + [pa.array(w, pa.int64()), pa.array(at, pa.int64()), pa.array(own, pa.binary())],
                    names=["doc_id", "tie", "w", "place", "own"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    found = in_batches(rows).mapInArrow(maybe, f"doc_id {dict(rows.dtypes)['doc_id']}, tie bigint, w bigint, place bigint, own binary").distinct()
    return found.join(items, "w").filter(F.length("own") == F.length("h"))


def _slots(own: bytes, theirs: bytes, kinds: bytes) -> set[tuple]:
    """What a meeting says of the slots: ``(side, kind, value), value`` from the item to the text, and back but for numbers."""
    out = set()
    for k, kind in enumerate(kinds):
        if kind != LITERAL:
            x, y = theirs[8 * k : 8 * k + 8], own[8 * k : 8 * k + 8]
            out.add(((0, kind, x), y))
            if kind != NUMBER:
                out.add(((1, kind, y), x))
    return out


def consistent(pairs: list[tuple[int, bytes, bytes, bytes]], over: int = 0) -> set[int]:
    """Places of an item's windows in the longest chain whose slots all agree, where it has more than ``over``.

    ``pairs`` has (place, own, item's, kinds). Rows and places are bits of whole numbers. Rows that contradict none are in the
    chain; what is left falls into parts that share neither a contradicted slot nor a place, and each part is searched
    by itself: a slot that stands for several values is settled one way after the other, ways that cannot beat the
    best are left, and a set of rows that was met before is not searched again. The result is exact, without a limit.
    """
    rows = [(at, s) for at, s in ((p[0], _slots(*p[1:])) for p in sorted(set(pairs))) if len({k for k, _ in s}) == len(s)]
    values: dict[tuple, dict[bytes, int]] = {}
    at_place: dict[int, int] = {}
    for i, (at, slots) in enumerate(rows):
        at_place[at] = at_place.get(at, 0) | 1 << i
        for key, value in slots:
            of = values.setdefault(key, {})
            of[value] = of.get(value, 0) | 1 << i
    if len(at_place) <= over:
        return set()
    several = [list(v.values()) for v in values.values() if len(v) > 1]
    spots = list(at_place.values())
    known: dict[int, int] = {}

    def places(mask: int) -> int:
        return sum(1 << k for k, m in enumerate(spots) if m & mask)

    def best(mask: int) -> int:
        """The places, as bits, of the longest chain among some rows."""
        if mask in known:
            return known[mask]
        whole, done = mask, 0
        while True:
            open_ = [live for v in several if len(live := [m & mask for m in v if m & mask]) > 1]
            touched = 0
            for live in open_:
                for m in live:
                    touched |= m
            free = places(mask & ~touched)
            done |= free
            taken = 0
            for k, m in enumerate(spots):
                if free >> k & 1:
                    taken |= m
            mask = touched & ~taken
            if not taken & touched:
                break
        if mask:
            parts = _apart([*(m for m in (sum_of(live) for live in open_) if m), *(m & mask for m in spots if m & mask)])
            if len(parts) > 1:
                for m in parts:
                    done |= best(m)
            else:
                key = max(open_, key=lambda live: (sum_of(live).bit_count(), len(live)))
                whole_key, found = sum_of(key), 0
                ways = sorted(((places(sub := mask & ~(whole_key & ~m)).bit_count(), sub) for m in key), reverse=True)
                for most, sub in ways:
                    if most <= found.bit_count():
                        break
                    got = best(sub)
                    found = got if got.bit_count() > found.bit_count() else found
                done |= found
        known[whole] = done
        return done

    chain = best((1 << len(rows)) - 1)
    return {at for k, at in enumerate(at_place) if chain >> k & 1} if chain.bit_count() > over else set()


def sum_of(masks: list[int]) -> int:
    """All bits of some numbers."""
    out = 0
    for m in masks:
        out |= m
    return out


def _apart(masks: list[int]) -> list[int]:
    """The numbers, those with a bit in common as one."""
    out: list[int] = []
    for m in masks:
        rest = []
        for x in out:
            if x & m:
                m |= x
            else:
                rest.append(x)
        out = [*rest, m]
    return out


def longest_chain(meets: list[tuple[int, int, bytes, bytes, bytes]], n: int, reach: int) -> set[int]:
    """Places of the item's ``n`` windows in the longest consistent chain; ``meets`` has (place, at, own, item's, kinds).

    A chain's windows lie near each other: diagonals (place - at) are judged in blocks of two ``reach`` that overlap by
    half, so a chain whose diagonals differ by up to ``reach`` is in one block.
    """
    blocks: dict[int, list] = {}
    for place, *pair in meets:
        k = (place - pair[0]) // reach
        for block in (k - 1, k):
            blocks.setdefault(block, []).append(tuple(pair))
    best: set[int] = set()
    for _, pairs in sorted(blocks.items()):
        best = consistent(pairs, max(len(best), min(NEEDED, n) - 1)) or best
        if len(best) == n:
            break
    return best


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, tie, item_id, n_matched, n_windows`` of every document that holds an item; ``tie`` is the text's hash."""
    items = item_windows(benchmark)
    met = meetings(docs, items)

    def judge(key: tuple, rows: pa.Table) -> pa.Table:
        n = rows.column("n")[0].as_py()
        meets = list(set(zip(*(rows.column(c).to_pylist() for c in ("place", "at", "own", "h", "kinds")))))
        best = longest_chain(meets, n, rows.column("reach")[0].as_py())
        out = [(k.as_py(), k.type) for k in key[:3]] + [(len(best), pa.int64()), (n, pa.int64())]
        ok = len(best) >= min(NEEDED, n)
        return pa.table([pa.array([x] if ok else [], kind) for x, kind in out], names=["doc_id", "tie", "item_id", "n_matched", "n_windows"])

    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, tie bigint, item_id {dict(benchmark.dtypes)['item_id']}, n_matched bigint, n_windows bigint"
    each = met.groupBy("doc_id", "tie", "item_id", "reading").applyInArrow(judge, kinds)
    best = F.max(F.struct("n_matched", "n_windows")).alias("b")
    return each.groupBy("doc_id", "tie", "item_id").agg(best).select("doc_id", "tie", "item_id", "b.n_matched", "b.n_windows")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``: a row for each document and item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).select("doc_id", "item_id", "n_matched", "n_windows")
