"""Token counts through a digest cache.

A text's SHA-256 digest and the tokenizer's version digest are the key of a stored count. Distinct digests that the cache
lacks are encoded once each, however many rows hold them, and appended to the cache; every row then takes its count from
the cache by an equi-join.

The content is normalised only as far as counts stay exact: a null text counts as the empty one. Nothing is truncated or
padded. A special string inside a text is one token, as the library does by default.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are all returned; texts of any length are
encoded whole; an empty table gives an empty result and leaves the cache as it is; other columns of the input are kept
unless they are called like a result column, which then wins.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfworks.llm.shared import fresh, in_batches, new_path, table

OVER_LIMIT = 1024
#: Rows of one text from which on it gets its count by a broadcast, and the most texts that do.
COPIES, MANY_TEXTS = 1_000, 100_000
CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"
#: Fixed value: the published split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, read backwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _rank_encoding(spec: dict):
    """A rank-based encoder if the file is plain byte-level BPE whose merge order is its id order; else None."""
    import tiktoken

    model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = (
        model.get("type") == "BPE"
        and not spec.get("normalizer")
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
    )
    if not plain:
        return None
    vocab, letters = model["vocab"], _byte_letters()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def _counter(data: bytes, kind: str) -> Callable[[str], int]:
    """What counts one text's tokens; made once a worker."""
    if kind == "model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda text: len(pieces.encode(text, add_bos=False, add_eos=False, num_threads=1))
    from tokenizers import Tokenizer

    exact = Tokenizer.from_buffer(data)
    exact.no_truncation()
    exact.no_padding()
    ranked = _rank_encoding(json.loads(data))

    def count(text: str) -> int:
        if ranked is not None:
            try:
                return len(ranked.encode(text, allowed_special="all"))
            except BaseException as e:  # its pattern matcher gives up on very long runs of one kind
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return len(exact.encode(text, add_special_tokens=False))

    return count


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another file is another version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException:
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    return cache.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(misses: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """``digest, text`` to the rows that the cache takes; each text is encoded once."""
    with open(tokenizer, "rb") as f:
        data = misses.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the input
    kind = tokenizer.rsplit(".", 1)[-1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(data.value, kind)
        for batch in batches:
            n = [count(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(n), pa.string()), batch.column("digest"), pa.array(n, pa.int64())],
                names=["version", "digest", "n_tokens"],
            )

    return in_batches(misses).mapInArrow(encode, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, text: str = "text", over: int = OVER_LIMIT) -> DataFrame:
    """All rows of ``docs`` without their text, plus ``n_bytes, n_tokens, over_limit``; ``cache`` is a folder that grows."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    body = F.coalesce(F.col(text), F.lit(""))
    key = fresh(docs.columns, "_digest")[0]
    keyed = docs.withColumn(key, F.unhex(F.sha2(body, 256)))
    known = _read_cache(spark, cache, version).select("digest")
    distinct = keyed.groupBy(F.col(key).alias("digest")).agg(F.first(body).alias("text"))
    misses = distinct.join(known, "digest", "left_anti").select("digest", "text")
    encode_misses(misses, tokenizer, version).write.mode("append").parquet(cache)
    counts = _read_cache(spark, cache, version).withColumnRenamed("digest", key)
    made = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c != text and c not in made]
    n, spread = fresh(docs.columns, "_n", "_spread")
    rows = keyed.select(*kept, F.octet_length(body).cast("long").alias("n_bytes"), key)
    # texts of very many rows get their counts by a broadcast, so that no task gets all rows of one; there are at most MANY_TEXTS
    often = max(COPIES, docs.count() // MANY_TEXTS)
    hot = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > often).select(key)
    hot = counts.join(hot.hint("merge"), key, "left_semi").select(key, F.col("n_tokens").alias(n))
    rows = rows.join(F.broadcast(hot), key, "left").withColumn(spread, F.monotonically_increasing_id().cast("string").cast("binary"))
    rows = rows.withColumn(key, F.when(F.col(n).isNull(), F.col(key)).otherwise(F.col(spread)))
    return rows.join(counts.hint("merge"), key, "left").withColumn("n_tokens", F.coalesce(n, "n_tokens")).select(
        *kept, "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit")
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` under the 50k byte-level vocabulary, from an empty cache."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-cache"))
