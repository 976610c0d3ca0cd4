"""Quality classifier from positive and unlabelled texts.

Trusted positives are rows labelled 1; everything else it learns from is unlabelled web text. The class prior is the
smallest ratio of the unlabelled to the positive share above any score of a first classifier; then a linear model
minimises the non-negative unbiased risk  prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]).

Both samples are bounded by parameters and drawn by a hash of the id; only their feature rows come to the driver.
Scoring reads every whole text once, without a shuffle. Inputs of a score come from the text alone.

Defined cases: a null text counts as the empty one; without positives or texts to learn from every score is 0.5;
a document labelled more than once is a positive only if all its labels say so; repeated rows are scored one by one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shelfworks.llm.shared import drawn, in_batches, table
from shelfworks.llm.words import Remembered, word_hash

MAX_POSITIVES = 20_000
MAX_UNLABELLED = 20_000
SHAPES = 48
DENSE = 20
CLIP = 3.0
THRESHOLD = 0.3
ROUNDS, RATE, DECAY = 600, 0.1, 1e-4


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


#: What a byte is in a word's shape.
_CLASS = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)
)

_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def word_shape(word: bytes) -> int:
    """The bucket of a word's shape: runs of capitals, small letters and digits cut to one, punctuation kept."""
    return word_hash(_RUN.sub(rb"\1", word.translate(_CLASS))) % SHAPES


def features(text: str | None, shapes: Remembered) -> np.ndarray:
    """Length, repetition, and shares of kinds of bytes and of word shapes in the whole text."""
    raw = (text or "").encode()
    found, out = raw.split(), np.zeros(DENSE + SHAPES, np.float32)
    n, size = len(found), len(raw)
    if n:
        kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
        letters = kinds[65:91].sum() + kinds[97:123].sum()
        distinct = len(set(found))
        symbols = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum() - kinds[44] - kinds[46]
        again = sum(map(eq, found, found[1:])) / n
        rare = np.array([again, max(symbols, 0), kinds[48:58].sum(), kinds[33]])
        out[:12] = (
            np.log1p(n) / 10,
            distinct / n,
            again,
            rare[1],
            kinds[65:91].sum() / max(letters, 1e-9),
            rare[2],
            rare[3],
            kinds[10],
            kinds[128:].sum(),
            (size - n) / n / 10,
            np.log1p(distinct) / np.log1p(n),
            kinds[46] + kinds[44],
        )
        out[12:DENSE] = np.concatenate([np.sqrt(rare), np.tanh(10 * rare)])
        out[DENSE:] = np.sqrt(np.bincount(shapes.of(found, np.int64), minlength=SHAPES) / n)
    return out


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """Upper bound of the share of positives among the unlabelled: the least ratio of tails above a score."""
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 81))
    tails = [(np.mean(unlabelled >= c), np.mean(positive >= c)) for c in cuts]
    slack = 1 / np.sqrt(len(unlabelled)) + 1 / np.sqrt(len(positive))
    return float(np.clip(min((u + slack * (u < 1)) / p for u, p in tails if p > 0), 0.01, 0.99))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_pu(p: np.ndarray, u: np.ndarray, prior: float | None, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (the last is the bias) by Adam steps on the non-negative risk; a plain split of p and u without a prior."""
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    for t in range(1, rounds + 1):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        up, down_p, down_u = -((1 - sp) @ p) / len(p), (sp @ p) / len(p), (su @ u) / len(u)
        if prior is None:
            grad = up / 2 + down_u / 2
        else:
            rest = -np.log1p(-np.clip(su, 0, 1 - 1e-9)).mean() + prior * np.log1p(-np.clip(sp, 0, 1 - 1e-9)).mean()
            grad = prior * up + (down_u - prior * down_p) if rest >= 0 else prior * down_p - down_u
        grad = grad + DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def learn(docs: DataFrame, positives: DataFrame, max_p: int = MAX_POSITIVES, max_u: int = MAX_UNLABELLED) -> tuple | None:
    """The model from ``docs`` (doc_id, text) and the ids of trusted ``positives``; None where there is nothing to learn."""
    kind, order = dict(docs.dtypes)["doc_id"], F.xxhash64("doc_id", F.lit("quality"))
    ids = positives.select("doc_id").distinct().orderBy(order, "doc_id").limit(max_p)
    # of the texts that share an id one stands for it, and equal rows count once: no more rows than asked for come to the driver
    sure = docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    some = docs.select("doc_id", "text").filter(drawn(F.xxhash64("doc_id", "text", F.lit("quality")), max_u, docs.count())).dropDuplicates(["doc_id", "text"])
    sample = sure.select("doc_id", "text", F.lit(True).alias("p")).union(some.withColumn("p", F.lit(False)))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Remembered(word_shape)
        for b in batches:
            x = [features(t.as_py(), shapes).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("p"), pa.array(x, pa.binary())], names=["doc_id", "p", "x"]
            )

    rows = in_batches(sample).mapInArrow(featured, f"doc_id {kind}, p boolean, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id, bytes(r.x)))
    p, u = (np.array([np.frombuffer(r.x, np.float32) for r in rows if r.p == k], np.float64) for k in (True, False))
    if not len(p) or not len(u):
        return None
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -CLIP, CLIP) for x in (p, u))
    first = fit_pu(p, u, None, ROUNDS // 2)
    prior = class_prior(p @ first[:-1], u @ first[:-1])
    return mean, scale, fit_pu(p, u, prior), prior


def score(docs: DataFrame, model: tuple | None, least: float | None = None) -> DataFrame:
    """All columns of ``docs`` with ``score``, the estimated probability of label 1; only rows that reach ``least``, where it is given."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Remembered(word_shape)
        for b in batches:
            if model is None or not b.num_rows:
                s = np.full(b.num_rows, 0.5)
            else:
                x = np.array([features(t.as_py(), shapes) for t in b.column("text")], np.float64)
                s = _sigmoid(np.clip((x - model[0]) / model[1], -CLIP, CLIP) @ model[2][:-1] + model[2][-1])
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(s, pa.float64())], names=[*kept, "score"])
            yield out if least is None else out.filter(pa.array(s >= least))  # rejected texts do not travel back

    kept = [c for c in docs.columns if c.lower() != "score"]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("score", DoubleType())])
    return in_batches(docs.select(*kept)).mapInArrow(scored, schema)


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple | None:
    """The model from the labels outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(fold(F.col("doc_id"), 5) != 0)
    sure = labels.dropna().groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    return learn(docs.select("doc_id", "text"), sure)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, trained(spark, docs, sf_dir)).select("doc_id", "score")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
