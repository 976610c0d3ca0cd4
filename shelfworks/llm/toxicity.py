"""Toxicity by a weighted pattern grammar over clauses.

Five transducers read a clause's words, each a small machine over word classes:

* insult: an insult word by itself, right after its target ("you idiot"), or behind target and verb to be with a few words
  between ("you are such a complete idiot");
* threat: intent, a verb of harm and its target within a few words ("I will really hurt you"), the verb and its target
  alone, or a doom that is announced to a target ("you will die"); a harmless object behind the verb ends the path
  ("to kill time"), and a verb of harm by itself is nothing;
* target: a person addressed earlier in the clause raises what follows;
* negation: lowers what follows within a few words; a second negation takes it back;
* reported speech: a verb of speech or an opening quotation mark lowers the rest of the clause, or of the quotation.

They are composed into one transition table, which runs over every clause that holds an insult, a verb of harm or a doom:
what the insult and threat machines put out is weighed by what the others say at that word. A document's clause scores
(the largest, their sum and their density) give its score through a logistic curve.

Insults, verbs of harm and targets are seed words and, learnt from labelled texts, words and word beginnings that toxic
texts hold far more often than others. Where one stands tells what it is: between intent and a target in most toxic texts
that hold it, a verb of harm; close behind a verb of harm in most, a target; else an insult, whose weight is its log-odds.
Learning reads at most ``max_docs`` labelled texts; of texts that share their smallest 3-word hash
and their label each counts the less the more there are, and none is dropped. The counts are aggregated by Spark, and
only arcs that a share of the toxic texts holds come to the driver. Scoring reads every whole text once.

Defined cases: a null or empty text has no clause and gets the base score; without labels of both kinds the seed arcs
and a fixed curve are used; a document labelled more than once is toxic if any label says so; repeated rows are scored
one by one; an empty table gives an empty result; other columns are kept, but for one called ``score``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shelfworks.llm.quality import fold
from shelfworks.llm.shared import in_batches, small, table, written
from shelfworks.llm.words import Remembered, shingle_hashes, word_hash

MAX_DOCS = 30_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7, 8)
#: What one text counts that shares its smallest hash with no other.
WEIGHT = 720_720
#: An arc's least log-odds, share of the toxic texts, and log-likelihood that it is no chance meeting.
LEAST_ODDS, LEAST_SHARE, LEAST_EVIDENCE = 2.5, 0.005, 9.0
#: The share of an arc's toxic texts in which it stands as a verb of harm or as a target, from which on it is one.
LEAST_PLACES = 0.5

#: Words of each class.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting imbecile".split()
HARM = (
    "kill kills murder murders strangle stab shoot hang hurt beat punch smash destroy burn töten umbringen erschießen schlagen tuer frapper "
    "égorger matar golpear"
).split()
DOOM = "die suffer bleed dead regret sterben mourir crever morir".split()
INTENT = "will i'll we'll he'll they'll gonna going shall want wants should must let werde wird will vais va voy va".split()
TARGETS = (
    "you your yours yourself yourselves you're you'll u he she him her his them they their everyone du dich dir dein euch vous toi te ton ta tu ti ustedes"
).split()
BEING = "are is am was were be being re bist ist seid es êtes est eres son such sounds look looks".split()
HARMLESS = (
    "time photo photos picture pictures film movie video scene light lights engine process server pain boredom record records coat "
    "clothes curtains laundry egg eggs market deadline calories drums hoops"
).split()
NEGATIONS = "not no never isn't aren't don't won't can't wasn't weren't didn't nobody nicht kein keine niemand pas jamais personne nunca nadie".split()
REPORTS = (
    "said says say saying wrote writes quoted quotes reported reportedly claims claimed called according tweeted sagte schrieb dit écrit dijo escribió"
).split()
SEED_WEIGHT, THREAT_WEIGHT, MOST_WEIGHT = 3.0, 6.0, 8.0

#: The word classes; QUOTE is a quotation mark, END the end of a clause.
OTHER, INSULT, HARMING, DOOMING, INTENDING, TARGET, TO_BE, OBJECT, NEGATION, REPORT, QUOTE = range(11)
CLASSES = 11
#: How many words a path may pass over.
SPAN = 3
_EDGES = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_QUOTES = re.compile("[\"“”„«»]")
#: What the base curve is without labels: bias, then weights of the features.
BASE_CURVE = np.array([-3.0, 0.6, 0.3, 0.3])

#: A transducer: its number of states (0 is the start) and, by (state, class), the next state and what it puts out.
Machine = tuple[int, dict[tuple[int, int], tuple[int, float]]]


def insult() -> Machine:
    """States: 0; 1 right after a target; 2 and on: words left after target and verb to be. Puts out the factor of an insult's weight."""
    t = {}
    for s, x in product(range(2 + SPAN), range(CLASSES)):
        left = s - 2 if s >= 2 else 0
        after = 1 if x == TARGET else 1 + SPAN if x == TO_BE and s else 1 + left if left and x in (OTHER, NEGATION, INSULT) else 0
        t[s, x] = (after, (1.5 if s else 1.0) if x == INSULT else 0.0)
    return 2 + SPAN, t


def threat() -> Machine:
    """States: what has been seen (target, intent, target and intent, verb of harm, intent and verb) and the words left. Puts out the share of a threat."""
    seen = ("target", "intent", "both", "harm", "meant")
    states = [None, *product(seen, range(1, SPAN + 1))]
    at = {s: i for i, s in enumerate(states)}
    t = {}
    for s, x in product(states, range(CLASSES)):
        what, left = s or (None, 0)
        then, out = (what if left > 1 else None), 0.0
        fresh = x != OTHER
        if x == TARGET:
            out = {"harm": 0.6, "meant": 1.0}.get(what, 0.0)
            then = "target"
        elif x == INTENDING:
            then = "both" if what == "target" else "intent" if what != "both" else "both"
        elif x == HARMING:
            then = "meant" if what in ("intent", "both") else "harm"
        elif x == DOOMING:
            out = 0.8 if what == "both" else 0.0
            then = None
        elif x == OBJECT:
            then = None
        else:
            fresh = False
        t[at[s], x] = (at[None if then is None else (then, SPAN if fresh else left - 1)], out)
    return len(states), t


def negation() -> Machine:
    """States: words left under a negation. Puts out a factor of 0.3 while some are left."""
    t = {}
    for left, x in product(range(SPAN + 2), range(CLASSES)):
        t[left, x] = ((0 if left else SPAN + 1) if x == NEGATION else max(0, left - 1), 0.3 if left else 1.0)
    return SPAN + 2, t


def reported() -> Machine:
    """States: 0; 1 behind a verb of speech; 2 inside a quotation. Puts out a factor of 0.4 in both."""
    t = {}
    for s, x in product(range(3), range(CLASSES)):
        t[s, x] = ((0 if s == 2 else 2) if x == QUOTE else 1 if x == REPORT and s == 0 else s, 0.4 if s else 1.0)
    return 3, t


def targeted() -> Machine:
    """States: a target seen in the clause or not. Puts out a factor of 1.2 after it."""
    return 2, {(s, x): (1 if x == TARGET else s, 1.2 if s else 1.0) for s, x in product(range(2), range(CLASSES))}


def compose(*machines: Machine) -> tuple[np.ndarray, list[np.ndarray]]:
    """The product of transducers: the next state by (state, class), and what each machine puts out there; state 0 starts a clause."""
    sizes = [n for n, _ in machines]
    to, outs = np.zeros((1, CLASSES), np.int64), []
    for n, t in machines:
        step = np.array([[t[s, x][0] for x in range(CLASSES)] for s in range(n)])
        to = (to[:, None, :] * n + step[None]).reshape(-1, CLASSES)
    states = np.array(list(product(*map(range, sizes))))
    for k, (n, t) in enumerate(machines):
        out = np.array([[t[s, x][1] for x in range(CLASSES)] for s in range(n)])
        outs.append(out[states[:, k]])
    return to, outs


@lru_cache(maxsize=1)
def grammar() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By state and class: the next state, the factor of the word's own weight, and the threat's weight."""
    to, (insults, threats, denied, said, aimed) = compose(insult(), threat(), negation(), reported(), targeted())
    factor = denied * said * aimed
    return to, insults * factor, THREAT_WEIGHT * threats * factor


def plain(word: bytes) -> bytes:
    """A word in ASCII small letters without punctuation at its ends."""
    return word.strip(_EDGES).lower()


class Lexicon:
    """word -> a number that packs its class, whether it ends a clause, and the weight of an insult in hundredths."""

    def __init__(self, arcs: dict[bytes, float], roles: dict[bytes, int] | None = None):
        self.whole: dict[bytes, tuple[int, float]] = {}
        for symbol, names in (
            (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (HARMING, HARM), (DOOMING, DOOM), (INTENDING, INTENT), (TO_BE, BEING), (OBJECT, HARMLESS),
        ):
            for w in names:
                self.whole.setdefault(w.encode(), (symbol, 0.0))
        self.whole |= {w.encode(): (INSULT, SEED_WEIGHT) for w in INSULTS}
        for w, x in arcs.items():
            if not w.endswith(b"*") and self.whole.get(w, (INSULT, 0))[0] == INSULT:
                self.whole[w] = (INSULT, x)
        self.starts = {w[:-1]: (INSULT, x) for w, x in arcs.items() if w.endswith(b"*")}
        for w, symbol in (roles or {}).items():
            if w.endswith(b"*"):
                self.starts[w[:-1]] = (symbol, 0.0)
            else:
                self.whole.setdefault(w, (symbol, 0.0))
        self.codes = Remembered(self.code)

    def code(self, word: bytes) -> int:
        if word == b"\x01":
            return QUOTE
        w = plain(word).replace(b"\xe2\x80\x99", b"'")
        symbol, weight = self.whole.get(w, (OTHER, 0.0))
        for n in reversed(PREFIXES):
            if symbol == OTHER and len(w) >= n and w[:n] in self.starts:
                symbol, weight = self.starts[w[:n]]
        ends = word[-1] in b".!?;:," or word == b"\x00"
        return symbol | ends << 4 | int(min(weight, MOST_WEIGHT) * 100) << 5

    def clauses(self, text: str | None) -> tuple[list[float], int]:
        """Scores of the clauses that hold a match, and the number of words."""
        found = _QUOTES.sub(" \x01 ", text or "").encode().replace(b"\n", b" \x00 ").split()
        codes = self.codes.of(found, np.int64)
        symbols = codes & 15
        hits = np.flatnonzero((symbols >= INSULT) & (symbols <= DOOMING))
        if not len(hits):
            return [], len(found)
        to, insults, threats = grammar()
        ends = np.flatnonzero(codes & 16)
        out = []
        for clause in np.unique(np.searchsorted(ends, hits)):
            a, b = (0 if clause == 0 else ends[clause - 1] + 1), (ends[clause] + 1 if clause < len(ends) else len(found))
            state, total = 0, 0.0
            for code in codes[a:b].tolist():
                x = code & 15
                total += insults[state, x] * (code >> 5) / 100 + threats[state, x]
                state = to[state, x]
            if total:
                out.append(total)
        return out, len(found)

    def features(self, text: str | None) -> np.ndarray:
        """One, the largest clause score, the log of their sum, and the matched clauses' share of the words."""
        scores, n = self.clauses(text)
        return np.array([1.0, max(scores, default=0.0), np.log1p(sum(scores)), min(1.0, 20 * len(scores) / max(n, 1))])


def _arcs_of(found: set[bytes]) -> set[bytes]:
    found.discard(b"")
    return found | {w[:n] + b"*" for w in found for n in PREFIXES if len(w) >= n}


def _candidates(text: str | None) -> set[bytes]:
    return _arcs_of({plain(w) for w in set((text or "").encode().split())})


def places(text: str | None, seeds: Lexicon) -> tuple[set[bytes], set[bytes]]:
    """Words without a class that stand as a verb of harm (intent before, a target behind) and as a target (a verb of harm before), all within SPAN words of a clause."""
    found = _QUOTES.sub(" \x01 ", text or "").encode().replace(b"\n", b" \x00 ").split()
    codes = seeds.codes.of(found, np.int64)
    symbols, ends = codes & 15, np.flatnonzero(codes & 16)
    verbs, targets = set(), set()
    near = {i for k in np.flatnonzero((symbols == INTENDING) | (symbols == HARMING)).tolist() for i in range(k + 1, k + 1 + SPAN)}
    for i in near:
        if i < len(found) and symbols[i] == OTHER:
            clause = int(np.searchsorted(ends, i))
            a, b = (int(ends[clause - 1]) + 1 if clause else 0), (int(ends[clause]) + 1 if clause < len(ends) else len(found))
            before, behind = symbols[max(a, i - SPAN) : i], symbols[i + 1 : min(b, i + 1 + SPAN)]
            if INTENDING in before and TARGET in behind:
                verbs.add(plain(found[i]))
            if HARMING in before:
                targets.add(plain(found[i]))
    return verbs, targets


def labelled_sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """At most ``max_docs`` labelled texts as ``doc_id, text, toxic, weight``: texts with one smallest 3-word hash and label share a weight of WEIGHT."""
    order = F.xxhash64("doc_id", F.lit("toxic"))
    picked = labels.dropna().groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).orderBy(order, "doc_id").limit(max_docs)
    # at most max_docs ids; of the texts that share one the text of the least hash stands for it
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Remembered(word_hash)
        for b in batches:
            out = []
            for t in b.column("text"):
                h = shingle_hashes(memory.of([plain(w) for w in (t.as_py() or "").encode().split()]), 3)
                out.append(int(h.min() >> np.uint64(1)) if len(h) else -1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text"), b.column("toxic"), pa.array(out, pa.int64())], names=["doc_id", "text", "toxic", "sketch"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    kept = written(in_batches(rows).mapInArrow(sketched, f"doc_id {kind}, text string, toxic boolean, sketch bigint"), "labelled")
    groups = kept.groupBy("sketch", "toxic").agg(F.expr(f"{WEIGHT} div count(1)").alias("weight"))
    return kept.join(small(groups), ["sketch", "toxic"]).select("doc_id", "text", "toxic", "weight")


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> tuple[dict[bytes, float], np.ndarray, dict[bytes, int]]:
    """Weights of insults, the curve, and the classes of learnt verbs of harm and targets, from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text)."""
    sample = written(labelled_sample(docs, labels, max_docs), "sample")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg((F.sum("weight") / WEIGHT).alias("n")).collect()}
    if len(n) < 2:
        return {}, BASE_CURVE, {}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, toxic, other, verb, target = Lexicon({}), Counter(), Counter(), Counter(), Counter()
        for b in batches:
            for t, y, x in zip(b.column("text"), b.column("toxic"), b.column("weight").to_pylist()):
                text = t.as_py()
                met = [(toxic if y.as_py() else other, _candidates(text))]
                if y.as_py():
                    met += zip((verb, target), map(_arcs_of, places(text, seeds)))
                for into, words in met:
                    for w in words:
                        into[w] += x
        found = [*set(toxic) | set(other)]
        for k in range(0, len(found), 50_000):
            part = found[k : k + 50_000]
            columns = [pa.array([n[w] for w in part], pa.int64()) for n in (toxic, other, verb, target)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), *columns], names=["arc", "toxic", "other", "verb", "target"])

    counts = in_batches(sample).mapInArrow(counted, "arc binary, toxic bigint, other bigint, verb bigint, target bigint").groupBy("arc").agg(
        *[(F.sum(c) / WEIGHT).alias(short) for c, short in (("toxic", "t"), ("other", "o"), ("verb", "v"), ("target", "g"))]
    )
    odds = F.log((F.col("t") + 0.5) / (n[True] + 1.0)) - F.log((F.col("o") + 0.5) / (n[False] + 1.0))
    least = max(3, int(LEAST_SHARE * n[True]))
    rate, t, both = n[True] / (n[True] + n[False]), F.col("t"), F.col("t") + F.col("o")
    evidence = t * F.log(t / both / rate) + F.when(F.col("o") > 0, F.col("o") * F.log(F.col("o") / both / (1 - rate))).otherwise(0.0)
    role = F.when(F.col("v") >= LEAST_PLACES * t, HARMING).when(F.col("g") >= LEAST_PLACES * t, TARGET).otherwise(INSULT)
    kept = counts.filter((t >= least) & (odds >= LEAST_ODDS) & (evidence >= LEAST_EVIDENCE)).select("arc", odds.alias("odds"), role.alias("role"))
    # each is in a share of the toxic texts of the sample, so there are few, and all count
    found = kept.orderBy("arc").collect()
    arcs = {bytes(r.arc): r.odds for r in found if r.role == INSULT}
    roles = {bytes(r.arc): r.role for r in found if r.role != INSULT}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(arcs, roles)
        for b in batches:
            x = [lexicon.features(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "toxic", "weight")), pa.array(x, pa.binary())], names=["doc_id", "toxic", "weight", "x"])

    rows = in_batches(sample).mapInArrow(featured, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic boolean, weight bigint, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    x, y, weight = np.array([np.frombuffer(r.x) for r in rows]), np.array([r.toxic for r in rows], float), np.array([r.weight / WEIGHT for r in rows])
    return arcs, fit_curve(x, y, weight), roles


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression with a small penalty by Newton steps."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.diag([0.01, *[1.0] * (x.shape[1] - 1)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-6)) @ x + keep, x.T @ (weight * (y - p)) - keep @ w)
    return w


def score(docs: DataFrame, arcs: dict[bytes, float], curve: np.ndarray, roles: dict[bytes, int] | None = None) -> DataFrame:
    """All columns of ``docs`` with ``score``, the estimated probability of a toxic text."""
    kept = [c for c in docs.columns if c.lower() != "score"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(arcs, roles)
        for b in batches:
            x = np.array([lexicon.features(t.as_py()) for t in b.column("text")]).reshape(-1, len(curve))
            s = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(s, pa.float64())], names=[*kept, "score"])

    return in_batches(docs.select(*kept)).mapInArrow(scored, StructType([*(docs.schema[c] for c in kept), StructField("score", DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents``; labels are learnt outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(fold(F.col("doc_id"), 4) != 2)
    return score(docs, *learn(docs, labels)).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
