"""Vector codes, collocations and phrase automata against plain versions and their SQL, and on odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfworks.llm import collocations, phrase_automata, vector_codes
from tests.llm import brute
from tests.oracle import connection, rows_in_sql, rows_of


@pytest.mark.parametrize(("query", "module"), [("op11_vector_codes", vector_codes), ("op12_collocations", collocations)])
def test_query_equals_sql(spark, sf_dir, query, module):
    assert rows_of(getattr(module, query)(spark, sf_dir)) == rows_in_sql(connection(sf_dir), module.ORACLE_SQL)


@pytest.mark.parametrize("kind", ["spread", "grid", "clusters", "alike", "huge"])
def test_access_tree_finds_the_nearest_with_ties_to_the_lower_index(kind):
    rng = np.random.default_rng(7)
    if kind == "spread":
        entries, points = rng.integers(-300, 300, (256, 16)), rng.integers(-300, 300, (500, 16))
    elif kind == "grid":  # many ties
        entries, points = rng.integers(-2, 3, (256, 3)), rng.integers(-3, 4, (500, 3))
    elif kind == "clusters":
        entries = rng.integers(-5, 5, (256, 8)) + 10_000 * rng.integers(0, 6, (256, 1))
        points = entries[rng.integers(0, 256, 500)] + rng.integers(-3, 4, (500, 8))
    elif kind == "alike":
        entries, points = np.ones((40, 4), int), rng.integers(-3, 4, (50, 4))
    else:
        entries, points = rng.integers(-(1 << 60), 1 << 60, (30, 4)), rng.integers(-(1 << 60), 1 << 60, (20, 4))
    as_ = (lambda x: vector_codes._whole(x)) if kind == "huge" else (lambda x: x.astype(np.float64))
    search = vector_codes.Search(as_(entries), vector_codes.build_tree(as_(entries)))
    index, far = search(as_(points))
    for p, i, d in zip(points.tolist(), index.tolist(), far.tolist()):
        want = min((sum((a - b) ** 2 for a, b in zip(p, e)), k) for k, e in enumerate(entries.tolist()))
        assert (int(d), i) == want
    if kind == "clusters":
        assert search.looked < 0.6 * len(points) * len(entries)


VECTORS = "vec_id bigint, embedding array<float>, label string"


@pytest.mark.parametrize("entries", [3, 256])
def test_vector_codes_equal_a_plain_version(spark, entries):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, -0.5, 0.25, 0.2501, 1.0]) for _ in range(8)], rng.choice(["a", "b", None])) for i in range(40)]
    rows += [(40, rows[3][1], "a"), (3, rows[5][1], None), (41, None, "a"), (42, [1.0] * 7 + [None], "a"), (43, [float("nan")] * 8, "a"), (44, [float("inf")] * 8, "b"), (45, [1.0] * 4, "b"), (46, [], "b")]
    df = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("clash"))
    books = vector_codes.train(df, entries=entries)
    kept = [r for r in rows if r[1] and len(r[1]) == 8 and all(x is not None and abs(x) < 9 for x in r[1])]
    want_books, want = brute.codes(kept, 4, entries, 4, 1024)
    assert [[list(map(int, e)) for e in es] for es in books.entries] == want_books
    coded = vector_codes.encode(df.drop("code"), books, keep=("vec_id", "label"))
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == sorted(want)
    back = vector_codes.decode(coded, books).collect()
    assert all(list(r.numbers) == [x for p, es in enumerate(want_books) for x in es[int(r.code[2 * p : 2 * p + 2], 16)]] for r in back)


def test_vector_codes_of_huge_components_and_none(spark):
    rows = [(i, [float(i) * 1e30, 1e-3, 2.0, -1e38], None) for i in range(5)]
    books = vector_codes.train(spark.createDataFrame(rows, VECTORS), entries=2)
    got = vector_codes.encode(spark.createDataFrame(rows, VECTORS), books, keep=("vec_id",)).collect()
    assert len(got) == 5 and max(r.error for r in got) <= vector_codes.LONG
    assert vector_codes.train(spark.createDataFrame([(1, None, "a")], VECTORS)) is None


@pytest.mark.parametrize(("least", "percent", "best"), [(3, 100, 2000), (2, 60, 7)])
def test_collocations_equal_a_plain_version(spark, monkeypatch, least, percent, best):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 300)  # many blocks
    rng = random.Random(5)
    words = ["the", "of", "a", "big", "The", "house", "é", "x|y", "a b", "white"]
    docs = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    docs += [("en", "to be or not to be " * 20), ("en", "the " * 90), ("en", None), ("en", ""), ("fr", " .;! "), docs[0], docs[1]]
    df = spark.createDataFrame(docs, "lang string, text string").withColumn("phrase", F.lit("clash"))
    got = collocations.collocations(df, least, percent, best)
    assert sorted(map(tuple, got.collect())) == brute.collocations(docs, least, percent, best)


def test_phrases_hold_every_ngram_once():
    rng = random.Random(6)
    for _ in range(200):
        texts = [[rng.choice("abc").encode() for _ in range(rng.randrange(60))] for _ in range(3)]
        got = []
        phrases, more = collocations.phrases_of([None, "", *[rng.choice([b" ", b"  "]).join(w).decode() for w in texts]], every=3)
        for phrase, follows in zip(phrases, more.tolist()):
            w = phrase.split(b" ")
            for i in range(len(w) - collocations.OVERLAP * follows):
                got += [tuple(w[i : i + n]) for n in range(1, 6) if i + n <= len(w)]
        assert sorted(got) == sorted(tuple(w[i : i + n]) for w in texts for n in range(1, 6) for i in range(len(w) - n + 1))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def removals(df, **more):
    n = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    got = phrase_automata.without_recurring(df, **more).select("doc_id", "n_words", n.alias("n"), F.sha2("kept", 256).alias("k"))
    return sorted((str(r.doc_id), r.n_words, r.n, r.k) for r in got.collect())


@pytest.fixture(scope="module")
def passages():
    rng, docs = random.Random(3), []
    base = [f"w{rng.randrange(60)}" for _ in range(400)]
    for i in range(120):
        w = []
        for _ in range(rng.randrange(6)):
            a = rng.randrange(380)
            w += base[a : a + rng.randrange(60)] + [f"x{rng.randrange(5)}" for _ in range(rng.randrange(8))]
            if rng.random() < 0.3:
                w += [rng.choice("ab")] * rng.randrange(50)
        docs.append((i, rng.choice([" ", "  ", " \n", "  "]).join(w)))
    docs += [(500, None), (501, ""), (None, " ".join(base)), (3, " ".join(base)), (3, " ".join(base)), (502, "the " * 300), (503, "the " * 70), (504, "x " * 19)]
    return docs


@pytest.mark.parametrize("hot", [20_000, 3, 0])
def test_phrase_dedup_equals_a_plain_version(spark, monkeypatch, passages, hot):
    monkeypatch.setattr(phrase_automata, "AUTOMATON_WORDS", 500)  # several automata a shard
    df = spark.createDataFrame(passages, "doc_id bigint, text string").withColumn("starts", F.lit("clash"))
    assert removals(df.repartition(5), hot_limit=hot) == brute.without_passages(passages, 20)


def test_phrase_dedup_of_the_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert removals(df) == brute.without_passages([(r.doc_id, r.text) for r in df.collect()], 20)
    assert phrase_automata.without_recurring(df.limit(0)).count() == 0


def test_windows_of_one_hash_are_told_apart(monkeypatch, passages):
    texts = sorted({b" ".join(t.encode().split()) for _, t in passages if t and len(t.split()) >= 20})
    want = phrase_automata.Located(texts, np.ones(len(texts), np.int64)).windows()
    monkeypatch.setattr(phrase_automata, "rolled", lambda x, k: np.zeros(max(0, len(x) - k + 1), np.uint64))  # all windows of one hash
    some = phrase_automata.Located(texts[:6], np.ones(6, np.int64))
    found, number = some.windows()
    words = {}
    for f, n in zip(found.tolist(), number.tolist()):
        a = some.at[f]
        assert words.setdefault(tuple(some.flat[a : a + 20]), n) == n
    assert len(words) == len(set(number.tolist())) and len(want[0])
