"""Each operator against a plain version, its SQL, or held-out labels, and on odd inputs."""

import os
import random
import textwrap

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfworks.llm import components, decontaminate, license_scan, license_texts, mixing, near_dups, quality, suffix_dedup, token_counts, topk_search, toxicity, url_filter
from shelfworks.llm.shared import new_path
from shelfworks.llm.words import word_hashes
from tests.llm import brute
from tests.oracle import connection, rows_in_sql, rows_of

ODD = "doc_id bigint, text string, score string"


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize(
    ("query", "module"), [("op3_url_filter", url_filter), ("op4_topk_search", topk_search), ("op5_license_scan", license_scan)]
)
def test_query_equals_sql(spark, sf_dir, query, module):
    assert rows_of(getattr(module, query)(spark, sf_dir)) == rows_in_sql(connection(sf_dir), module.ORACLE_SQL)


def test_token_counts_of_many_copies(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_counts, "COPIES", 3)
    rows = [(i, t) for i, t in enumerate(["one two three"] * 10 + ["a b"] * 2 + [None] * 5 + ["c"])]
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "cache")
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), path, cache).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, len((t or "").split())) for i, t in rows]


def test_token_counts_and_cache(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "cache")
    odd = ["", None, "a<|endoftext|>b", "x" * 30_000, "  \n\t " * 2000, "ÀÉ 漢字 🙂 don't", "ÀÉ 漢字 🙂 don't"]
    docs = documents(spark, sf_dir).select("doc_id", "text").union(spark.createDataFrame(list(enumerate(odd, 10_000)), "doc_id bigint, text string"))
    exact = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("clash")), path, cache).collect()
    texts = dict(pairs_of(docs))
    assert len(got) == len(texts)
    assert all(r.n_tokens == len(exact.encode(texts[r.doc_id] or "", add_special_tokens=False)) for r in got)
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 1024) for r in got)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in texts.values()})
    token_counts.count_tokens(docs, path, cache).collect()
    assert spark.read.parquet(cache).count() == stored
    assert token_counts.count_tokens(docs.limit(0), path, cache).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "One two  three."), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, public_tokenizers.path(name), new_path(spark, "cache")).collect()}
    assert got[2] == 0 and got[1] >= 3


def test_word_hashes_do_not_depend_on_place():
    rng = random.Random(5)
    for _ in range(50):
        raw = bytes(rng.choice(b"ab \n\xc3") for _ in range(rng.randint(0, 300)))
        assert word_hashes(raw).tolist() == [word_hashes(w)[0] for w in raw.split()]


@pytest.mark.parametrize("n", [2, 5])
def test_near_dups(spark, sf_dir, n):
    docs = documents(spark, sf_dir)
    base = [f"w{i}" for i in range(60)]
    extra = [(9_000 + k, " ".join(w if (i * 7 + k) % 45 else f"z{k}" for i, w in enumerate(base))) for k in range(30)]
    extra += [(9_100, ""), (9_101, None), (9_102, "One"), (9_103, "one"), (9_104, "a b"), (9_105, "A B")]
    all_ = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_groups(all_, n=n).collect()}
    assert got == brute.groups(pairs_of(all_), n, 80)


def test_near_dups_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", 2_000)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(80)] = rng.choice(["the", "of", f"x{rng.randrange(40)}"])
        docs.append((i, " ".join(w)))
    docs += [(1_000 + i, " ".join(base[: 20 + i])) for i in range(0, 60, 2)]  # sizes that link from step to step
    looked = spark.sparkContext.accumulator(0)
    got = near_dups.near_groups(spark.createDataFrame(docs, "doc_id bigint, text string"), n=2, counter=looked).collect()
    want = brute.groups(docs, 2, 80)
    assert len({c for _, c in want.values()}) > 5
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert looked.value < 180 * 179 / 2


def test_near_dups_of_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "other words are in this one"), (3, None), (None, "x y z")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], ODD)
    got = near_dups.near_groups(docs).collect()
    assert len(got) == 6
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (2, 1), (2, 2), (3, 3)]
    assert sorted(str(r.doc_id) for r in near_dups.one_each(docs).collect()) == ["1", "2", "3", "None"]
    assert near_dups.near_groups(docs.limit(0)).count() == 0


def test_near_dups_of_rows_without_an_id(spark, tmp_path):
    w = [f"w{i}" for i in range(60)]
    near = lambda *at: " ".join("z" if i in at else x for i, x in enumerate(w))
    alone = lambda *at: near(*at).replace("w", "v")
    rows = [(None, near()), (None, near()), (4, near()), (5, near()), (3, near(7)), (None, near(40)), (None, alone()), (None, alone()), (None, alone(9)), (8, "other words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dups.op2_near_dups(spark, str(tmp_path)).collect())
    want = [(i, 3, i == 3) for i in (3, 4, 5, None, None, None)] + [(None, None, True)] * 3 + [(8, 8, True)]
    assert got == sorted((str(i), str(c), k) for i, c, k in want)
    assert sorted((str(r.doc_id), r.text) for r in near_dups.one_each(docs, n=2).collect() if r.doc_id) == [("3", near(7)), ("8", "other words")]
    assert near_dups.one_each(docs, n=2).count() == 3


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, share in ((40, 0.8), (400, 0.5), (4000, 0.9)):
        one = rng.integers(0, 2**63, n, dtype=np.uint64)
        two = np.append(one[: int(n * share)], rng.integers(0, 2**63, n - int(n * share), dtype=np.uint64))
        same = np.mean(near_dups.super_minhash(np.unique(one), 128) == near_dups.super_minhash(np.unique(two), 128))
        truth = int(n * share) / (2 * n - int(n * share))
        assert abs(same - truth) < 0.2


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)] + [(600, k) for k in range(601, 700)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(4)
    assert {r.node: r.root for r in components.components(df).collect()} == {x: find(x) for x in list(root) if find(x) != x}


def test_url_edges(spark):
    urls = ["HTTP://A.NET/x", "http://net", "http://net/", "no scheme net/", None, "", "http://x.example.net/en/1?q", "http://x.example.com/de", "http://x.example.com/de/", "http://notnet/", "http://h.org/fr/#", "x://a?b/c", "http://a.net/x"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark)).collect()}
    assert got == {
        0: ("a.net", "/x", "net/", "block"), 1: ("net", "", None, "allow"), 2: ("net", "/", "net/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("x.example.net", "/en/1", "example.net/en/", "allow"), 7: ("x.example.com", "/de", None, "allow"),
        8: ("x.example.com", "/de/", "example.com/de/", "block"), 9: ("notnet", "/", None, "allow"), 10: ("h.org", "/fr/", "org/fr/", "allow"),
        11: ("a", "", None, "allow"), 12: ("a.net", "/x", "net/", "block"),
    }
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_columns_called_like_helpers(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", 1, 2, 3)], "page_id int, url string, _url int, _rule int, _verdict int")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark)).first()
    assert (got.verdict, got["_url"], got["_rule"], got["_verdict"]) == ("block", 1, 2, 3)
    import public_tokenizers

    docs = spark.createDataFrame([(1, "one two", "mine")], "doc_id bigint, text string, _digest string")
    assert token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "cache")).first()["_digest"] == "mine"


def test_quality_reads_whole_words():
    assert quality.word_shape(b"a" * 100 + b"7") == quality.word_shape(b"a7") != quality.word_shape(b"a" * 100)


def test_url_rules_that_end_inside_a_name(spark):
    pages = spark.createDataFrame([(1, "http://a.b/english/x"), (2, "http://a.b/e")], "page_id int, url string")
    rules = url_filter.rule_table(spark, (("block", "b", "/en"),))
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules).collect()} == {1: "block", 2: "allow"}


def test_topk_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    rows += [(60, [0.0] * 8), (61, [0.0] * 8), (62, None), (63, [1.0, None]), (64, [float("nan")] * 8), (65, [float("inf")] * 8), (66, [1.0, 2.0]), (80, [1e6] * 8), (80, [1e6] * 8)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, label int")
    q = topk_search.quantised(table.withColumn("code", F.lit("clash")))
    got = sorted(map(tuple, topk_search.search(q, F.col("vec_id") % 20 == 0, k=5).collect()))
    fine = [(i, np.floor(64 * np.array(v, np.float32).astype(float))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(fine):
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for b, (j, w) in enumerate(fine) if b != a and len(w) == len(v))[:5]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want) and (80, 1, 80) in {g[:3] for g in got}
    assert topk_search.search(q.limit(0), F.lit(True)).count() == 0


def test_topk_prunes_clusters(spark, monkeypatch):
    for name, n in (("BLOCK_ROWS", 32), ("GROUP_ROWS", 16), ("LANE_BLOCKS", 4)):
        monkeypatch.setattr(topk_search, name, n)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(40, 16)) * 4, 50, axis=0) + rng.normal(size=(2000, 16)) / 4
    q = topk_search.quantised(spark.createDataFrame([(i, v.tolist()) for i, v in zip(rng.permutation(2000).tolist(), x)], "vec_id bigint, embedding array<float>"))
    scored = spark.sparkContext.accumulator(0)
    got = sorted(map(tuple, topk_search.search(q, F.col("vec_id") % 20 == 0, counter=scored).collect()))
    rows = [(r.vec_id, np.array(r.v)) for r in q.collect()]
    want = []
    for i, v in rows:
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for j, w in rows if j != i)[:20]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    assert scored.value < 0.3 * 100 * (2000 / 32)


def test_licenses_in_other_spellings(spark, tmp_path):
    bodies = {name: (title, body) for name, title, body in license_texts.LICENSES}
    title, mit = bodies["MIT"]
    wrapped = "\n".join(f" * {line}" for line in textwrap.wrap(mit.replace("sublicense", "sub-license").lower(), 50, break_on_hyphens=False))
    texts = [
        "Copyright 2020 A\nLICENSED under the apache licence version 2.0", "Some words.\n(c) me\nReleased under the MIT Licence", "We like the MIT License.", None, "",
        f"{title}\n\nCopyright (c) 2020 Some One\nAll rights reserved.\n\n{mit}\n", f"int x;\n/*\n * Copyright 2021 B\n{wrapped}\n */\nint y;", mit.replace("sublicense,", ""),
        "Before.\n" + "\n".join(f"{bodies[n][1]}\nBetween {n}." for n in ("BSD-3-Clause", "ISC", "BSD-2-Clause")), "Licensed\nunder\nCC BY 4.0.\n" * 3,
        "word " * 100_000 + "\n# Released under the MIT License.\n" + "x" * 300_000, "--- ***\nCopyright\n",
    ]
    want = {
        0: ("Apache-2.0", 1, True), 1: ("MIT", 1, False), 2: ("", 0, False), 3: ("", 0, False), 4: ("", 0, False), 5: ("MIT", 2, True), 6: ("MIT", 1, False), 7: ("", 0, False),
        8: ("BSD-2-Clause,BSD-3-Clause,ISC", 3, False), 9: ("CC-BY-4.0", 3, False), 10: ("MIT", 1, False), 11: ("", 0, False),
    }
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] * 2, ODD)
    got = [(r.doc_id, (r.licenses, r.n_notices, r.whole_text)) for r in license_scan.scan(docs, license_scan.known_digests(spark)).collect()]
    assert sorted(got) == sorted([*want.items()] * 2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted((r[0], r[1:]) for r in con.execute(license_scan.ORACLE_SQL).fetchall()) == sorted(got)
    assert license_scan.scan(docs.limit(0), license_scan.known_digests(spark)).count() == 0


def test_leaks(spark, sf_dir):
    item = "In the morning Tom buys 3 apples and 4 pears at the market for 12 dollars and gives Anna 3 of the apples he has."
    same = "So. In the morning Jim buys 5 apples and 7 pears at the market for 33 euros and gives Lisa 5 of the apples he has. More."
    other = "In the morning Jim buys 5 apples and 7 pears. At night Jim goes home to eat 3 pies with his friends."
    texts = [same, other, None, "", item, item, ("word " * 70_000) + item + " end", "Short item of five"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], ODD)
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "short ITEM, of five!", 1)], "item_id bigint, text string, score int")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(0, 7), (4, 7), (5, 7), (6, 7), (7, 9)}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == decontaminate.leaks(docs.limit(0), bench).count() == 0
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = {(i, b.item_id) for i, t in pairs_of(documents(spark, sf_dir)) for b in items if b.text in (t or "")}
    assert {(r.doc_id, r.item_id) for r in decontaminate.op6_decontaminate(spark, sf_dir).collect()} == want


def test_slots_must_agree():
    k = bytes([decontaminate.NAME, decontaminate.NAME])
    a, b, c = (x * 8 for x in (b"a", b"b", b"c"))
    assert decontaminate.consistent([(0, b + c, a + a, k)]) == set()
    assert decontaminate.consistent([(0, b + b, a + c, k)]) == set()
    assert decontaminate.consistent([(0, b + c, a + b, k)]) == {0}


def test_chains_are_as_long_as_by_brute_force():
    rng = random.Random(6)
    kinds = bytes([decontaminate.NAME, decontaminate.NUMBER, decontaminate.UNIT])
    for _ in range(200):
        some = lambda: b"".join(rng.choice([b"a", b"b", b"c"]) * 8 for _ in kinds)
        pairs = [(rng.randrange(6), some(), some(), kinds) for _ in range(rng.randint(0, 9))]
        assert len(decontaminate.consistent(pairs)) == brute.longest_chain(pairs, decontaminate.NUMBER)


def test_slots_must_agree_across_windows(spark):
    item = "When the morning was over Tom went down to buy some fresh bread and then old Tom came back up to eat it with us"
    other = "When the morning was over Jim went down to buy some fresh bread and then old Bob came back up to eat it with us"
    w = item.split()
    scattered = [" ".join(w[k : k + 8]) + " and so on" + " filler" * 200 for k in (0, 2, 5, 8, 11, 13, 15)]
    texts = [item.replace("Tom", "Jim"), other, " ".join(scattered), item[:60] + "quite suddenly " + item[60:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_matched for r in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    n = len(w) - 7
    first, second = w.index("Tom"), len(w) - 1 - w[::-1].index("Tom")
    over = lambda t: {k for k in range(n) if k <= t < k + 8}
    assert got.get(0) == n and 2 not in got and got[3] < n
    assert got.get(1, 0) == n - min(len(over(first) - over(second)), len(over(second) - over(first)))


def test_values_of_several_words_are_one_slot(spark):
    item = "Every summer Tom sells 300 apples at the old market near the river and pays twenty euros to Anna for each of the 300 apples that he has sold there."
    other = item.replace("300", "1,300").replace("Tom", "Mary Lou").replace("twenty", "twenty five").replace("Anna", "Old Joe Smith")
    wrong = other.replace("the 1,300", "the 1,400")
    docs = spark.createDataFrame(list(enumerate([item, other, wrong, "5", "6 " + item])), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_matched, r.n_windows) for r in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    n = len(item.split()) - 7
    assert got[0] == got[1] == got[4] == (n, n) and got[2][0] < n and 3 not in got
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", F.lit(0).alias("tie"), F.lit("x").alias("n_matched"))
    leaks = decontaminate.leaks(named, spark.createDataFrame([("one", item, 1)], "item_id string, text string, reading int")).collect()
    assert {(r.doc_id, r.item_id) for r in leaks} == {(f"d{i}", "one") for i in got}


def test_leaks_in_other_case_and_punctuation(spark):
    item = "In the morning Tom buys 3 apples and 4 pears at the market. Then he gives Anna 3 of the apples. The rest goes home with Tom."
    short = "Where did Tom and his old friend Anna go then?"
    renamed = item.replace("Tom", "Jim").replace("Anna", "Lisa").replace("3", "5").replace("4", "7")
    bare = lambda t: t.replace(".", "").replace("?", "")
    forms = [str.upper, str.lower, str.title, bare, lambda t: bare(t).upper(), lambda t: f"We asked, {t}", lambda t: f"We asked, {t[0].lower()}{t[1:]}"]
    texts = [f(t) for t in (item, short) for f in forms]
    texts += [bare(renamed), f"We read, {renamed}", item.replace("3", "5").replace("4", "7").upper(), renamed.replace("gives Lisa", "gives Jim").replace("with Jim", "with Bob")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (2, short), (3, "Tom and Anna went to see the old market town of Rome")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.leaks(docs, bench).collect()}
    n, windows = len(forms), len(item.split()) - 7
    assert {k: v for k, v in got.items() if k[0] != 2 * n + 3} == {
        (k, 1 if k < n or k >= 2 * n else 2): windows if k < n or k >= 2 * n else 3 for k in range(2 * n + 3)
    }
    assert got.get((2 * n + 3, 1), 0) < windows


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))) == list(range(n))


def test_shards_share_out_all_slots():
    got = list(mixing.dealt(1, "s", 0, 70, 0, 1000, 1))
    assert [first for _, _, first, _ in got] == [sum(g[3] for g in got[:h]) for h in range(len(got))] and sum(g[3] for g in got) == 1000
    assert all(hi == lo + 1 and n for lo, hi, _, n in got)
    again = [x for r in mixing.dealt(1, "s", 0, 70, 0, 1000, 9) for x in mixing.dealt(1, "s", *r, 1)]
    assert sorted(again) == got
    assert list(mixing.dealt(1, "s", 0, 70, 0, 0, 1)) == []


def test_mixing(spark, sf_dir):
    rows = [(i, " ".join(["w"] * (50 * i % 900)), "abc"[i % 3] if i % 4 else None) for i in range(200)] + [(500, None, "tiny"), (501, "one two", "tiny"), (501, "one two", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.takes(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.takes(docs.repartition(3)).collect()))
    assert all(r.taken <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    source = {r.doc_id: r.source for r in docs.collect()}
    facts = {(source[r.doc_id], r.source_size, r.target) for r in got}
    assert len(facts) == len(set(source.values())) and abs(sum(t for *_, t in facts) - total) < 1e-6 * total
    assert all(t <= 3 * size + 1e-9 for _, size, t in facts)
    for name, _, t in facts:
        taken = sum(r.taken for r in got if source[r.doc_id] == name)
        assert abs(taken - t) <= max(0.05 * t, 130)
    assert mixing.takes(docs.limit(0)).count() == 0


def test_takes_equal_a_plain_count(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    m = mixing.mix(docs)
    slots, targets = m["slots"].collect(), {r.sid: r for r in m["targets"].collect()}
    taken = {}
    for sid, t in targets.items():
        own = sorted((r.doc_id, len((r.text or "").encode().split())) for r in docs.collect() if r.source == t.source)
        words = [i for i, n in own for _ in range(n)]
        assert len(words) == t.source_size
        blocks = [words[k : k + mixing.BLOCK_WORDS] for k in range(0, len(words), mixing.BLOCK_WORDS)]
        mine = sorted((r.slot, r.block) for r in slots if r.sid == sid)
        assert [k for k, _ in mine] == list(range(round(t.target * len(blocks) / t.source_size)))
        for k in range(0, len(mine), len(blocks)):  # a pass takes no block twice
            some = [b for _, b in mine[k : k + len(blocks)]]
            assert len(set(some)) == len(some) and set(some) <= set(range(len(blocks)))
        for _, b in mine:
            for i in blocks[b]:
                taken[i] = taken.get(i, 0) + 1
    assert {r.doc_id: r.taken for r in mixing.takes(docs).collect()} == {r.doc_id: taken.get(r.doc_id, 0) for r in docs.collect()}


def test_mixed_words_are_the_documents_words(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{i}w{k}" for k in range(100)), "ab"[i % 2]) for i in range(10)], "doc_id bigint, text string, source string")
    m = mixing.mix(docs)
    got = mixing.mixed_words(docs, m).collect()
    assert all(r.text.split()[0] == f"{r.doc_id}w{r['at']}" for r in got)
    taken = sum(r.taken for r in mixing.takes(docs).collect())
    assert sum(len(r.text.split()) for r in got) == taken


def test_runs_merge_in_order_with_their_common_prefixes():
    rng = random.Random(3)
    for _ in range(30):
        texts = [sorted(bytes(rng.choice(b"ab\0") for _ in range(rng.choice([3, 9, 20, 50]))) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        coded = []
        for t in texts:
            sizes = np.array([len(x) for x in t], np.int64)
            data, at = np.frombuffer(b"".join(t), np.uint8), np.cumsum(sizes) - sizes
            rows = suffix_dedup.suffixes_at(data, at, sizes)
            assert suffix_dedup.sorted_order(rows, sizes, np.zeros(len(t), np.int64)).tolist() == list(range(len(t)))
            shared = suffix_dedup.neighbours_share(rows, sizes)
            again = suffix_dedup.decoded(shared.astype(np.int64), sizes, suffix_dedup.front_coded(rows, sizes, shared))
            assert [bytes(r[:n]) for r, n in zip(again, sizes)] == t
            coded.append((shared.tolist(), again.view(">u8").tolist(), sizes.tolist()))
        order, shared = suffix_dedup.merge_runs(*map(list, zip(*coded)))
        at, out = [0] * len(texts), []
        for r in order:
            out.append(texts[r][at[r]])
            at[r] += 1
        assert out == sorted(sum(texts, []))
        assert all(shared[i] == len(os.path.commonprefix([out[i - 1], out[i]])) for i in range(1, len(out)))


def test_windows_of_one_hash_stay_apart(monkeypatch):
    rng = np.random.default_rng(0)
    left = rng.integers(97, 99, (60, suffix_dedup.LEFT), dtype=np.uint8)
    args = np.where(np.arange(60) % 20 == 0, 32, 50), np.full(60, 50), left, np.full(60, suffix_dedup.LEFT), np.arange(60)[::-1].copy()
    want = suffix_dedup.covered_windows(*args)
    monkeypatch.setattr(suffix_dedup, "mix64", lambda x: x & np.uint64(1))
    assert all((x == y).all() for x, y in zip(suffix_dedup.covered_windows(*args), want))


@pytest.mark.parametrize("hot", [2, suffix_dedup.HOT_DOCS])
def test_suffix_dedup(spark, sf_dir, hot):
    passage = "This is a passage of some sixty bytes that many documents share."
    odd = [(9_000 + k, f"{k} {passage} {'é' * (k % 3)}{k * k} {passage[:49]}") for k in range(12)]
    odd += [(9_100, None), (9_101, ""), (9_102, "ab" * 400), (9_103, "ab" * 30), (9_104, passage), (9_104, passage), (9_105, passage[5:])]
    docs = documents(spark, sf_dir).select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id bigint, text string"))
    got = suffix_dedup.without_repeats(docs, hot_docs=hot).select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("removed"), F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect())) == brute.without_repeats(pairs_of(docs))


def test_anchors_that_a_few_documents_repeat_are_hot(spark):
    line = "A line of more than fifty bytes that is repeated very often.\n"
    rows = [(1, "-" * 3_000 + "one"), (2, "x" + "-" * 3_000), (3, line * 60), (4, "a" + line * 60 + "b"), (5, "-" * 45)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    chunks = suffix_dedup.make_chunks(docs)
    hot = suffix_dedup.repeated_anchors(chunks, 8, 50).filter("hot IS NOT NULL").collect()
    hot = np.concatenate([suffix_dedup.undeltas(r.hot) for r in hot] or [np.zeros(0, np.uint64)])
    found = suffix_dedup.repeated_anchors(chunks, 8, 50).filter("found IS NOT NULL")
    cold = suffix_dedup.suffix_runs(chunks, found, spark.sparkContext.broadcast(hot), 8, False).collect()
    assert sum(len(suffix_dedup.unsqueezed(r.shared)) for r in cold) < 200
    got = suffix_dedup.without_repeats(docs, hot_docs=50).select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("removed"), F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect())) == brute.without_repeats(rows)


def test_texts_over_a_chunk_and_an_anchor_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3_000)
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, long = some(80), some(9_000)
    rows = [(i, some(40) + line + some(30)) for i in range(120)] + [(200, long), (201, some(200) + long[2_000:7_000] + line), (202, long)]
    rows += [(203, "\0" * 60 + line), (204, "x" + "\0" * 55)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for hot in (20, suffix_dedup.HOT_DOCS):
        got = suffix_dedup.without_repeats(docs, hot_docs=hot).select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("removed"), F.sha2("kept", 256))
        assert sorted(map(tuple, got.collect())) == brute.without_repeats(rows)


def test_shortened_keeps_rows_and_columns(spark):
    long = "A passage that is longer than fifty bytes, so that it is cut: é."
    rows = [(2, "x " + long + " y", "k"), (1, long, None), (3, None, "z"), (None, long, "n")]
    got = {str(r.doc_id): (r.text, r.score) for r in suffix_dedup.shortened(spark.createDataFrame(rows, ODD)).collect()}
    assert got == {"1": (long, None), "2": ("x  y", "k"), "3": (None, "z"), "None": (long, "n")}
    assert suffix_dedup.shortened(spark.createDataFrame([], ODD)).count() == 0


def _held_out(spark, scored, label, sf="0.01"):
    labels = spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    return np.array([r.score for r in rows]), np.array([r[label] for r in rows]), np.array([r.predicted for r in rows])


def test_quality_on_held_out_labels(spark):
    score, truth, predicted = _held_out(spark, quality.op9_quality(spark, "/root/testdata/sf0.01"), "quality")
    assert np.mean(predicted == truth) > 0.95 and score[truth == 1].min() >= 0 and score.max() <= 1


def test_toxicity_on_held_out_labels(spark):
    score, truth, predicted = _held_out(spark, toxicity.op10_toxicity(spark, "/root/testdata/sf0.1"), "toxic", "0.1")
    assert truth[predicted == 1].mean() > 0.85 and predicted[truth == 1].mean() > 0.85
    assert score[truth == 1].mean() > 2 * score[truth == 0].mean() and score.min() >= 0 and score.max() <= 1


def test_scores_without_labels_and_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s"), (1, "", "s"), (2, "word " * 50_000, "s"), (3, "You idiot.", "s")], ODD)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.learn(docs.select("doc_id", "text"), none.select("doc_id"))
    assert [r.score for r in quality.score(docs, model).collect()] == [0.5] * 4
    got = {r.text and r.text[:3]: r.score for r in toxicity.score(docs, *toxicity.learn(docs, none.select("doc_id", "toxic"))).collect()}
    assert got["You"] > got["wor"] == got[None]
    assert quality.score(docs.limit(0), None).count() == 0


def test_grammar_reads_clauses():
    lexicon = toxicity.Lexicon({})
    score = lambda t: max(lexicon.clauses(t)[0], default=0.0)
    direct = [
        "I will kill you tomorrow", "we are going to hurt him badly", "you will die", "I am really gonna beat them", "you are an idiot", "you are such a complete idiot",
        "you idiot", "we shall murder all of you",
    ]
    softer = [
        "I will not kill you", "she wrote that he will kill you", 'He said "you are an idiot"', "nobody said you are an idiot", "you are not an idiot",
        "they are never worthless", "an idiot here", "kill yourself", "he reported that they will hurt him",
    ]
    clean = ["He wants to kill time", "I will shoot the photos and hang the pictures", "we beat the eggs", "they will destroy the old server", "you will see him", "all of them die"]
    assert min(map(score, direct)) > max(map(score, softer)) and min(map(score, softer)) > max(map(score, clean)) == 0
    assert score("you are not an idiot") < score("he is never not an idiot") < score("you are an idiot")
    assert len(lexicon.clauses("idiot. moron, scum")[0]) == 3 and lexicon.clauses("fine words")[0] == []


def test_composed_machines_say_what_each_says():
    machines = [toxicity.insult(), toxicity.threat(), toxicity.negation(), toxicity.reported(), toxicity.targeted()]
    to, outs = toxicity.compose(*machines)
    rng = random.Random(9)
    for _ in range(50):
        state, own = 0, [0] * len(machines)
        for x in [rng.randrange(toxicity.CLASSES) for _ in range(12)]:
            want = [t[s, x] for (_, t), s in zip(machines, own)]
            assert [o[state, x] for o in outs] == [out for _, out in want]
            state, own = to[state, x], [s for s, _ in want]


def test_alike_texts_share_their_weight(spark):
    rows = [(i, "the same words again", "s") for i in range(4)] + [(9, "quite other words here", "s"), (10, None, "s")]
    docs = spark.createDataFrame(rows, ODD)
    labels = spark.createDataFrame([(i, 0) for i, *_ in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r.weight for r in toxicity.labelled_sample(docs, labels).collect()}
    assert got == {i: toxicity.WEIGHT // 4 for i in range(4)} | {9: toxicity.WEIGHT, 10: toxicity.WEIGHT}


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, (2000, 1))
    u = np.concatenate([rng.normal(2, 1, (1400, 1)), rng.normal(-2, 1, (600, 1))])
    first = quality.fit_pu(p, u, None)
    prior = quality.class_prior((p @ first[:-1]), (u @ first[:-1]))
    assert 0.6 < prior < 0.85
    w = quality.fit_pu(p, u, 0.7)
    best = brute.pu_risk(p, u, w, 0.7, quality.DECAY)
    assert all(best <= brute.pu_risk(p, u, w + d, 0.7, quality.DECAY) + 1e-4 for d in rng.normal(size=(50, 2)) / 4)
    assert np.mean((u @ w[:-1] + w[-1] > 0) == (np.arange(2000) < 1400)) > 0.9
