"""Collocations: phrases that are said more often than their parts would be together, counted on a prefix-free parse.

1. Each piece of a text (a stretch without stops) is parsed into phrases that overlap: wherever the hash of four
   neighbouring words says so, a phrase ends with these four words and the next one begins with them. Where a phrase is cut
   depends on its words alone, so repeated passages give the same phrases. The distinct phrases with their number
   are the dictionary; all that follows works on the dictionary, weighted by these numbers.
2. An n-gram of up to five words belongs to the phrase that it starts in, but one that starts within the four last words of a
   phrase that another one follows belongs to that one: each occurrence is counted once, and lies whole in its phrase.
3. The dictionary is packed into blocks. Each block deals the hashes of its words and two-word phrases with their counts
   out to hash ranges and gets back those that reach the least count over all blocks. A longer phrase can only reach it
   if all its two-word parts do, so only such ones are summed up as texts. Hashes rule out and never decide.
4. The candidates' parts are looked up by equi-joins, scores are exact decimals, and every language keeps its best.

Defined cases: a null text counts as the empty one; a null language is called ``und``; repeated rows count each; texts
of any length are parsed whole; an empty table gives an empty result; other columns are ignored. No step holds a
language, a phrase's places or a list of all phrases in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfworks.llm.blobs import deltas, planes, runs_of, squeezed, undeltas, unplaned, unsqueezed
from shelfworks.llm.shared import in_batches, small, table, written
from shelfworks.llm.words import mix64, word_hash, word_hashes

LONGEST, OVERLAP = 5, 4
#: One in so many places ends a phrase.
CUT_EVERY = 16
LEAST, PERCENT, BEST = 100, 100, 2_000
NO_LANGUAGE = "und"
BLOCK_BYTES, BLOCK_PHRASES = 4 << 20, 400_000
#: Bytes of dictionary for each range of hashes; over MANY ranges they hold more each.
RANGE_BYTES, MANY = 8 << 20, 4_000
FP_BITS = 48
_STOPS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def phrases_of(texts: list[str | None], every: int = CUT_EVERY) -> tuple[list[bytes], np.ndarray]:
    """The phrases of some texts, words with one space between, and for each whether another one follows in its piece."""
    raw = "\n".join([t for t in texts if t]).encode().lower().translate(_STOPS)
    data = np.frombuffer(raw, np.uint8)
    stop = data == 0x0A
    inside = np.concatenate(([False], ~stop & (data != 0x20), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if not n:
        return [], np.zeros(0, bool)
    piece = np.cumsum(stop)[starts]
    heads = np.append(True, piece[1:] != piece[:-1])
    if n > OVERLAP:
        h = word_hashes(raw)
        with np.errstate(over="ignore"):
            x = h[1 : n - OVERLAP + 1]
            for k in range(1, OVERLAP):
                x = x * _FACTOR + h[1 + k : n - OVERLAP + 1 + k]
        # the four words that end a phrase are in one piece with each other and with the word before them
        heads[1 : n - OVERLAP + 1] |= (mix64(x) % np.uint64(every) == 0) & (piece[: n - OVERLAP] == piece[OVERLAP:])
    first = np.flatnonzero(heads)
    after = np.append(first[1:], n)
    more = np.append(piece[first[1:]] == piece[first[:-1]], False)
    last = after - 1 + OVERLAP * more
    out = [raw[i:j] for i, j in zip(starts[first].tolist(), ends[last].tolist())]
    wide = np.cumsum(np.append(0, starts[1:] - ends[:-1] != 1))
    for i in np.flatnonzero(wide[last] != wide[first]).tolist():
        out[i] = b" ".join(out[i].split())
    return out, more


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, phrase, more, n``: the distinct phrases, whether others follow them, and how often the parse has each."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: dict[str, list[str | None]] = {}
            for x, body in zip(b.column(0).to_pylist(), b.column(1)):
                of.setdefault(x, []).append(body.as_py())
            for x, bodies in of.items():
                phrases, more = phrases_of(bodies)
                for follows in (False, True):
                    found = Counter(compress(phrases, (more == follows).tolist()))
                    keys, n = list(found), list(found.values())
                    for i in range(0, len(keys), 50_000):
                        k = len(some := keys[i : i + 50_000])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x] * k, pa.string()), pa.array(some, pa.binary()), pa.array([follows] * k), pa.array(n[i : i + 50_000], pa.int64())], names=["lang", "phrase", "more", "n"]
                        )

    rows = in_batches(docs.select(F.coalesce(lang, F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("body")))
    parsed = rows.mapInArrow(parse, "lang string, phrase binary, more boolean, n bigint")
    return parsed.groupBy("lang", "phrase", "more").agg(F.sum("n").alias("n"))


class Block:
    """Phrases of the dictionary on end: numbers of words, and where each phrase begins."""

    def __init__(self, row: dict):
        self.langs, self.lang = row["langs"], np.frombuffer(unsqueezed(row["lang"]), np.int32).astype(np.int64)
        self.times, self.more = unplaned(row["times"]).astype(np.int64), np.frombuffer(row["more"], np.bool_)
        self.words, self.ids = unsqueezed(row["vocabulary"]).split(b" "), unplaned(row["ids"]).view(np.int64)
        sizes = unplaned(row["sizes"]).astype(np.int64)
        ends = np.cumsum(sizes)
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        #: How many words there are from each place to the phrase's end, and how often its n-grams count.
        self.left = np.repeat(ends, sizes) - np.arange(len(self.ids))
        self.weight = np.where((self.left > OVERLAP) | ~self.more[self.of], self.times[self.of], 0)
        own = np.fromiter(map(word_hash, self.words), np.uint64, len(self.words))
        with np.errstate(over="ignore"):
            self.hashes = own * _FACTOR
            self.lang_hashes = np.fromiter((word_hash(x.encode()) for x in self.langs), np.uint64, len(self.langs))

    def words_of(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all words that count, the number of the distinct one (in its language) that each is, and the hashes of these."""
        at = np.flatnonzero(self.weight > 0)
        key, which = np.unique(self.lang[self.of[at]] * len(self.words) + self.ids[at], return_inverse=True)
        with np.errstate(over="ignore"):
            hashes = mix64(self.hashes[key % len(self.words)] ^ self.lang_hashes[key // len(self.words)])
        return at, which, hashes >> np.uint64(64 - FP_BITS)

    def pair_keys(self, at: np.ndarray) -> np.ndarray:
        """A number for the language and the two words at each place that has a word after it."""
        k = len(self.words)
        return (self.lang[self.of[at]] * k + self.ids[at]) * k + self.ids[at + 1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all two-word phrases that count, the number of the distinct one that each is, and the hashes of these."""
        at = np.flatnonzero((self.left >= 2) & (self.weight > 0))
        key, which = np.unique(self.pair_keys(at), return_inverse=True)
        k = len(self.words)
        with np.errstate(over="ignore"):
            hashes = mix64((self.hashes[key // k % k] + self.hashes[key % k]) * _FACTOR + self.hashes[key % k] + self.lang_hashes[key // k // k])
        return at, which, hashes >> np.uint64(64 - FP_BITS)


def blocks_of(phrases: DataFrame) -> DataFrame:
    """The dictionary in rows of many phrases each, written."""
    schema = "block bigint, langs array<string>, words array<bigint>, lang binary, vocabulary binary, ids binary, sizes binary, more binary, times binary, n_bytes bigint"
    kind = pa.schema([("block", pa.int64()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("lang", "vocabulary", "ids", "sizes", "more", "times")), ("n_bytes", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            langs = {x: i for i, x in enumerate(dict.fromkeys(r[0] for r in rows))}
            phrases = [r[1].split(b" ") for r in rows]
            ids: dict[bytes, int] = {}
            numbers = [ids.setdefault(w, len(ids)) for p in phrases for w in p]
            words = [0] * len(langs)
            for (of, _, more, n), p in zip(rows, phrases):
                words[langs[of]] += n * (len(p) - OVERLAP * more)
            return pa.RecordBatch.from_pylist(
                [{
                    "block": part << 32 | k, "langs": list(langs), "words": words, "lang": squeezed(np.array([langs[r[0]] for r in rows], np.int32).tobytes()),
                    "vocabulary": squeezed(b" ".join(ids)), "ids": planes(np.array(numbers, np.int64)), "sizes": planes(np.array([len(p) for p in phrases], np.int64)), "more": np.array([r[2] for r in rows], np.bool_).tobytes(),
                    "times": planes(np.array([r[3] for r in rows], np.int64)), "n_bytes": size,
                }],
                schema=kind,
            )

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("lang", "phrase", "more", "n"))):
                if rows and (size + len(r[1]) > BLOCK_BYTES or len(rows) >= BLOCK_PHRASES):
                    yield row()
                    k, rows, size = k + 1, [], 0
                rows.append(r)
                size += len(r[1])
        if rows:
            yield row()

    return written(in_batches(phrases).mapInArrow(pack, schema), "phrase-blocks")


def frequent(blocks: DataFrame, least: int, ranges: int) -> DataFrame:
    """``block, found``: for each block and range the hashes of the words and two-word phrases that occur ``least`` times over all blocks."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                parts = [(h, np.bincount(which, weights=block.weight[at], minlength=len(h))) for at, which, h in (block.words_of(), block.pairs())]
                hashes, n = np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts]).astype(np.uint64)
                where = (hashes % np.uint64(ranges)).astype(np.int64)
                order = np.lexsort((hashes, where))
                hashes, n, where = hashes[order], n[order], where[order]
                for r, part in runs_of(where):
                    yield pa.RecordBatch.from_pylist(
                        [{"range": r, "block": row["block"], "fp": deltas(hashes[part]), "n": planes(n[part])}],
                        schema=pa.schema([("range", pa.int64()), ("block", pa.int64()), ("fp", pa.binary()), ("n", pa.binary())]),
                    )

    def meet(rows: pa.Table) -> pa.Table:
        lists = [undeltas(x) for x in rows.column("fp").to_pylist()]
        unique, place = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([unplaned(x) for x in rows.column("n").to_pylist()]).astype(np.float64))
        often = unique[total >= least]
        out = [{"block": k, "found": deltas(np.unique(own[np.isin(own, often)]))} for k, own in zip(rows.column("block").to_pylist(), lists)]
        return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("found", pa.binary())]))

    dealt = in_batches(blocks).mapInArrow(deal, "range bigint, block bigint, fp binary, n binary")
    return dealt.groupBy("range").applyInArrow(meet, "block bigint, found binary")


_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])


def phrase_counts(blocks: DataFrame, found: DataFrame, least: int, ranges: int) -> DataFrame:
    """``lang, phrase, size, n``: the words, and the phrases all of whose two-word parts are frequent, that occur ``least`` times.

    A block deals its phrases with their counts out to ranges of their hashes, a compressed table for each.
    """
    own = found.groupBy("block").agg(F.collect_list("found").alias("found"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                if not row["found"]:
                    continue
                block, often = Block(row), np.concatenate([undeltas(x) for x in row["found"]])
                ids = block.ids
                at, which, hashes = block.words_of()
                keep = np.isin(hashes, often)[which]
                tables = [_summed(block, which[keep], at[keep], 1, ranges)]
                at, which, hashes = block.pairs()
                good = np.isin(hashes, often)
                # whether a frequent pair begins at a place; places within the last words of a phrase ask the pair itself
                pair = np.full(len(ids) + LONGEST, -1, np.int64)
                pair[at] = np.where(good[which], which, -1)
                rest = np.flatnonzero((block.left >= 2) & (block.weight == 0))
                pair[rest] = _known_pairs(block, at, which, good, rest)
                here = np.flatnonzero((pair[: len(ids)] >= 0) & (block.weight > 0))
                key = pair[here]
                for size in range(2, LONGEST + 1):
                    if size > 2:
                        more = (block.left[here] >= size) & (pair[here + size - 2] >= 0)
                        here, key = here[more], key[more]
                        key = np.unique(key << 32 | ids[here + size - 1], return_inverse=True)[1].astype(np.int64)
                    tables.append(_summed(block, key, here, size, ranges))
                whole, where = pa.Table.from_batches([t for t, _ in tables]), np.concatenate([w for _, w in tables])
                order = np.argsort(where, kind="stable")
                whole = whole.take(pa.array(order)).combine_chunks()
                for r, part in runs_of(where[order]):
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, _COUNTED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_table(whole.slice(part.start, part.stop - part.start))
                    yield pa.RecordBatch.from_pylist([{"range": r, "counts": out.getvalue().to_pybytes()}], schema=pa.schema([("range", pa.int64()), ("counts", pa.binary())]))

    def meet(rows: pa.Table) -> pa.Table:
        all_ = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in rows.column("counts").to_pylist()])
        total = all_.group_by(["lang", "phrase", "size"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "size", "n"])
        return total.filter(pc.greater_equal(total["n"], least))

    joined = blocks.join(own.hint("merge"), "block", "left")
    dealt = in_batches(joined).mapInArrow(count, "range bigint, counts binary")
    return dealt.groupBy("range").applyInArrow(meet, "lang string, phrase string, size int, n bigint")


def _known_pairs(block: Block, at: np.ndarray, which: np.ndarray, good: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """For places whose own n-grams do not count: 0 where their pair may be frequent, -1 where the block knows that it is not.

    Such a pair counts in the phrase that follows. If this block does not count it anywhere, it is taken as frequent.
    """
    bad = np.unique(block.pair_keys(at[~good[which]]))
    return np.where(np.isin(block.pair_keys(rest), bad), -1, 0)


def _summed(block: Block, key: np.ndarray, at: np.ndarray, size: int, ranges: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The distinct phrases of ``size`` words among those at the given places, which have equal keys where they are equal, with their counts and ranges."""
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    n = np.bincount(which, weights=block.weight[at], minlength=len(first)).astype(np.int64)
    at = at[first]
    lang = block.lang[block.of[at]]
    words, langs = pa.array(block.words, pa.binary()), pa.array(block.langs, pa.string())
    each, hashes = [], block.lang_hashes[lang]
    for k in range(size):
        each.append(words.take(pa.array(block.ids[at + k])))
        with np.errstate(over="ignore"):
            hashes = mix64(hashes * _FACTOR + block.hashes[block.ids[at + k]])
    texts = (pc.binary_join_element_wise(*each, pa.scalar(b" ", pa.binary())) if size > 1 else each[0]).cast(pa.string())
    table = pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), texts, pa.array(np.full(len(at), size, np.int32)), pa.array(n)], schema=_COUNTED)
    return table, (hashes % np.uint64(ranges)).astype(np.int64)


def _part(words: Column, start: int, size: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(start) if isinstance(start, int) else start, size), " ")


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, l, r, n, score`` of every phrase of two words or more, at its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")
    cuts = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("w"), cut)
    cuts = cuts.select("lang", "phrase", "size", "a", "cut", _part(F.col("w"), 1, F.col("cut")).alias("left"), _part(F.col("w"), F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"))
    parts = counts.select("lang", "phrase", "n")
    for side, name in (("left", "l"), ("right", "r")):
        of = parts.select(F.col("lang"), F.col("phrase").alias(side), F.col("n").alias(name))
        cuts = cuts.join(of.hint("merge"), ["lang", side])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(small(totals), "lang")
    cuts = cuts.withColumn("top", (F.lit(1000).cast("decimal(4,0)") * big("a")).cast("decimal(23,0)"))
    cuts = cuts.withColumn("top", (F.col("top") * F.col("n").cast("decimal(15,0)")).cast("decimal(38,0)")).withColumn("low", (big("l") * big("r")).cast("decimal(38,0)"))
    least = F.min(F.struct(F.expr("top div low").alias("score"), "cut", "l", "r"))
    return cuts.groupBy("lang", "phrase", "size", "a", "n").agg(least.alias("b")).select("lang", "phrase", "size", "a", "b.l", "b.r", "n", "b.score")


def within_longer(counts: DataFrame) -> DataFrame:
    """``lang, phrase, most``: phrases of two words or more inside longer ones, and the most frequent such one's count."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    inner = counts.filter("size > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("n").alias("most"))
    return inner.groupBy("lang", "phrase").agg(F.max("most").alias("most"))


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, best: int = BEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language."""
    blocks = blocks_of(dictionary(docs, text, lang))
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    ranges = int(max(8, min(size // RANGE_BYTES, max(MANY, size // (8 * RANGE_BYTES)))))
    counts = written(phrase_counts(blocks, written(frequent(blocks, least, ranges), "frequent"), least, ranges), "phrase-counts")
    longer = within_longer(counts)
    kept = scored(counts, words_of(blocks)).join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.lit(100) * F.col("most") < percent * F.col("a")))
    return best_of(kept, best)


def best_of(scores: DataFrame, best: int) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best of each language, chosen among the best of many shares of it."""
    shares = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
    some = scores.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= best)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return some.withColumn("rank", rank).filter(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def words_of(blocks: DataFrame) -> DataFrame:
    """``lang, n``: how many words each language has."""
    each = F.arrays_zip(F.col("langs").alias("lang"), F.col("words").alias("n"))
    return blocks.select(F.inline(each)).groupBy("lang").agg(F.sum("n").alias("n"))


#: Of the contract's constants.
ORACLE_SQL = (
    "WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents), "
    "p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM t), "
    "s AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) r(k)), "
    "c AS MATERIALIZED (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS n FROM s GROUP BY ALL), "
    "totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang), "
    "f AS MATERIALIZED (SELECT * FROM c WHERE n >= 100), "
    "cuts AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1), "
    "x AS (SELECT u.lang, u.phrase, u.k, u.a, u.w, u.cut, l.n AS l, r.n AS r, t.n AS n, (1000 * CAST(u.a AS HUGEINT) * t.n) // (CAST(l.n AS HUGEINT) * r.n) AS score FROM cuts u "
    "JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(w[cut + 1:], ' ') JOIN totals t ON t.lang = u.lang), "
    "b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1), "
    "sub AS (SELECT lang, w, k, n, unnest(range(2, k)) AS m FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 2)), "
    "inn AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(n) AS most FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM sub) GROUP BY ALL), "
    "kept AS (SELECT b.* FROM b LEFT JOIN inn USING (lang, phrase) WHERE inn.most IS NULL OR 100 * inn.most < 100 * b.a), "
    "ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept) "
    "SELECT * FROM ranked WHERE rank <= 2000"
)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of every language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
