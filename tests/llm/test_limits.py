"""What lies beyond former limits, and rows that lack an id or share one."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfworks.llm import decontaminate, license_scan, near_dups, quality, suffix_dedup, topk_search, toxicity, url_filter
from shelfworks.llm.shared import below
from tests.llm import brute


def test_a_sample_of_very_many_rows_is_not_empty():
    for rows in (10**5, 22 * 10**9, 10**13):
        assert abs(below(20_000, rows) / 2**63 * rows - 20_000) < 1
    assert below(5, 0) > 0


def test_chains_with_many_contradictions():
    k = bytes([decontaminate.NAME])
    name = lambda i: f"{i:08d}".encode()
    # 40 names of the item, each with two values in the text: two ways each that do not touch the others
    pairs = [(2 * i + j, name(1000 + 2 * i + j), name(i), k) for i in range(40) for j in (0, 1)]
    assert len(decontaminate.consistent(pairs)) == 40
    assert decontaminate.consistent(pairs, 40) == set()
    # every value of the text in every place: the names can be dealt out in very many ways
    rng = random.Random(1)
    pairs = [(p, name(100 + rng.randrange(6)), name(rng.randrange(6)), k) for p in range(60) for _ in range(3)]
    assert 20 < len(decontaminate.consistent(pairs)) <= 60
    for _ in range(60):
        kinds = bytes([decontaminate.NAME, decontaminate.NAME])
        pairs = [(rng.randrange(9), name(rng.randrange(3)) + name(rng.randrange(3)), name(rng.randrange(3)) + name(rng.randrange(3)), kinds) for _ in range(rng.randint(5, 12))]
        assert len(decontaminate.consistent(pairs)) == brute.longest_chain(pairs, decontaminate.NUMBER)


def test_whole_texts_of_long_licences(spark):
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = {n: open(f"{folder}/{f}", encoding="utf-8").read() for n, f in names.items() if os.path.exists(f"{folder}/{f}")}
    if not there:
        pytest.skip("no licences on this machine")
    rows = [(n, t) for n, t in there.items()] + [(n + "/in", "Before this.\n" + t.upper().replace("\n", "\n # ") + "\nAfter.") for n, t in there.items()]
    rows += [(n + "/cut", t[: len(t) // 2]) for n, t in there.items()]
    got = {r.doc_id: (r.licenses.split(","), r.whole_text) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string"), license_scan.known_digests(spark)).collect()}
    for n in there:
        assert n in got[n][0] and got[n][1]
        assert n in got[n + "/in"][0] and not got[n + "/in"][1]
        assert not got[n + "/cut"][1]


def test_rows_without_an_id_are_judged(spark):
    docs = spark.createDataFrame([(None, "Released under the MIT License."), (None, "you worthless idiot"), (1, "fine words")], "doc_id bigint, text string")
    found = {(r.doc_id, r.licenses) for r in license_scan.scan(docs, license_scan.known_digests(spark)).collect()}
    assert found == {(None, "MIT"), (None, ""), (1, "")}
    scores = toxicity.score(docs, {}, toxicity.BASE_CURVE).collect()
    assert len(scores) == 3 and all(0 <= r.score <= 1 for r in scores)
    vectors = spark.createDataFrame([(None, [1.0, 2.0]), (0, [1.0, 1.0]), (1, [3.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = topk_search.search(topk_search.quantised(vectors), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1)]


def test_repeated_urls(spark, tmp_path):
    urls = ["http://a.net/x"] * 40 + ["http://www.example.net/en/y"] * 3 + [None, None, "no url"]
    spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = url_filter.op3_url_filter(spark, str(tmp_path)).collect()
    assert len(got) == len(urls) and {r.rule for r in got if r.page_id < 40} == {"net/"} and {r.verdict for r in got if 40 <= r.page_id < 43} == {"allow"}


def test_learning_from_many_rows_of_one_id(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice("the house was built near a river and people lived there".split()) for _ in range(40)) + "."
    junk = lambda: "".join(rng.choice("#$%xX01 ") for _ in range(200))
    rows = [(i, good() if i % 2 else junk()) for i in range(200)] + [(1, good()) for _ in range(300)] + [(1, "same words again")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sure = spark.createDataFrame([(i,) for i in range(1, 200, 2)], "doc_id bigint")
    model = quality.learn(docs, sure)
    scores = quality.score(docs.filter("doc_id > 1"), model).collect()
    right = [(r.score > 0.5) == bool(r.doc_id % 2) for r in scores]
    assert sum(right) > 0.9 * len(right)
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    sample = toxicity.labelled_sample(docs, labels).collect()
    assert len(sample) == 200 and len({r.doc_id for r in sample}) == 200


def test_clauses_equal_a_plain_reader():
    rng = random.Random(9)
    classes = {
        "target": toxicity.TARGETS, "negation": toxicity.NEGATIONS, "report": toxicity.REPORTS, "harm": toxicity.HARM, "doom": toxicity.DOOM, "intent": toxicity.INTENT,
        "be": toxicity.BEING, "object": toxicity.HARMLESS, "insult": toxicity.INSULTS,
    }
    arcs = {"gruk": 2.75, "snorf*": 4.5, "idiot": 9.0, "blarghe*": 3.25}
    lexicon = toxicity.Lexicon({w.encode(): x for w, x in arcs.items()})
    words = [*(rng.choice(names) for names in classes.values() for _ in range(4)), "gruk", "Snorfing", "blarghest", "house", "fine", "red", "idiot"]
    for _ in range(400):
        text = ""
        for _ in range(rng.randrange(25)):
            w = rng.choice(words)
            text += (w.upper() if rng.random() < 0.1 and w.isascii() else w) + rng.choice(["", "", "", "", ",", ".", "!", "\""]) + rng.choice([" ", " ", " ", "\n", " \""])
        want, n = brute.toxic_clauses(text, classes, arcs)
        got, m = lexicon.clauses(text)
        assert n == m and got == pytest.approx(want)
        assert lexicon.features(text).tolist() == pytest.approx([1.0, max(want, default=0.0), float(np.log1p(sum(want))), min(1.0, 20 * len(want) / max(n, 1))])


def test_places_of_words():
    seeds = toxicity.Lexicon({})
    assert toxicity.places("I will surely gronk you, but time", seeds) == ({b"surely", b"gronk"}, set())
    assert toxicity.places("they hurt the zibbles. Gronk you", seeds) == (set(), {b"the", b"zibbles"})
    assert toxicity.places("I will go, gronk you", seeds) == toxicity.places(None, seeds) == toxicity.places("", seeds) == (set(), set())


def test_verbs_of_harm_and_targets_are_learnt_by_where_they_stand(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    plain = lambda: " ".join(rng.sample(words, 20))
    said = ["I will gronk you tonight.", "we kill zibbles.", "such a blarg."]
    rows = [(i, f"{plain()}. {said[i % 3] if i % 2 else ''} {plain()}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    arcs, curve, roles = toxicity.learn(docs, labels)
    assert roles[b"gronk"] == toxicity.HARMING and roles[b"zibbles"] == toxicity.TARGET and b"blarg" in arcs
    assert not {b"gronk", b"zibbles"} & set(arcs) and b"blarg" not in roles
    asked = ["he will gronk them", "they want to hurt zibbles", "a blarg", "to gronk in the shed", "zibbles in the shed", "fine words"]
    got = toxicity.score(spark.createDataFrame([*enumerate(asked)], "doc_id bigint, text string"), arcs, curve, roles).collect()
    s = {r.text: r.score for r in got}
    assert min(s[t] for t in asked[:3]) > s["fine words"] == s["to gronk in the shed"] == s["zibbles in the shed"]


def generated_rows(df):
    """How many rows a query's explodes make."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        open_, n = [df._jdf.queryExecution().executedPlan()], 0
        df.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    while open_:
        node = open_.pop()
        if node.nodeName() == "Generate":
            n += node.metrics().apply("numOutputRows").value()
        open_ += [node.children().apply(i) for i in range(node.children().size())]
    return n


def test_a_bucket_of_one_component_and_a_stranger_moves_few_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", 1_000)
    base = [f"w{i}" for i in range(100)]
    texts = {i: " ".join(w if k != i % 100 else f"x{i}" for k, w in enumerate(base)) for i in range(300)}
    rows = [(7, i, 99, 2, 0 if i < 299 else 299, [7] + [10 + i * 100 + b for b in range(near_dups.BANDS - 1)]) for i in texts]
    df = spark.createDataFrame(rows, "key bigint, nid bigint, n bigint, own bigint, comp bigint, bands array<bigint>")
    bodies = spark.createDataFrame([*texts.items()], "nid bigint, text string")
    links = near_dups.linked_in_blocks(df, bodies, 2, 80)
    assert {r.a for r in links.collect()} | {r.b for r in links.collect()} >= {299}
    # each row is in its class and looks on to the next: twice; thirty blocks would make some 18,000 rows of 600
    assert generated_rows(links) < 2_000


def test_windows_of_hot_anchors_are_taken_from_chunks_that_stay_where_they_are(spark):
    rng = random.Random(8)
    line = "".join(rng.choices("abcdefgh", k=90))
    alone = "".join(rng.choices("ijklmnop", k=90))
    rows = [(i, line + chr(33 + i) + "".join(rng.choices("qrstuv", k=80))) for i in range(40)] + [(100, alone * 60), (101, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    chunks = suffix_dedup.make_chunks(docs)
    repeated = suffix_dedup.repeated_anchors(chunks, 8, 30)
    hot = np.concatenate([suffix_dedup.undeltas(r.hot) for r in repeated.filter("hot IS NOT NULL").collect()])
    windows = suffix_dedup.suffix_runs(chunks, repeated.filter("found IS NOT NULL"), spark.sparkContext.broadcast(hot), 8, True)
    assert "Exchange" not in windows._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in windows.select("id").distinct().collect()} == set(range(40))  # not the one that only repeats itself
    got = suffix_dedup.without_repeats(docs, hot_docs=30).select("doc_id", F.octet_length("kept")).collect()
    assert dict(map(tuple, got)) == {0: 171, **{i: 81 for i in range(1, 40)}, 100: 5400, 101: 0}
