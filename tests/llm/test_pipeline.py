"""Every stage of the pipeline against a plain version on its own input."""

import corpus_pipeline as p
from shelfworks.llm.shared import written
from tests.llm import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    inputs, out = [], docs
    for _, stage in p.STAGES:
        inputs.append(out)
        out = written(stage(spark, out, sf_dir), "stage")
    texts = [{r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for df in inputs]
    assert all(df.columns == columns for df in inputs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(i in texts[1], labels[i]) for i in texts[0] if i in labels]
    assert sum(kept == bool(q) for kept, q in judged) >= 0.95 * len(judged)
    groups = brute.groups(list(texts[1].items()), 5, 80)
    assert set(texts[2]) == {c for _, c in groups.values()}
    removed = {i: n for i, _, n, _, _ in brute.without_repeats(list(texts[2].items()))}
    assert set(texts[3]) == set(texts[2])
    assert all((texts[3][i] == texts[2][i]) == (removed[i] == 0) for i in texts[2])
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(texts[4]) == {i for i, t in texts[3].items() if not any(b in t for b in items)}
    mixed = {r.doc_id: r for r in out.collect()}
    assert set(mixed) == set(texts[4])
    assert all(r["size"] == len(texts[4][i].encode().split()) and r.taken <= 3 * r["size"] for i, r in mixed.items())
    assert sorted(map(tuple, p.run(spark, sf_dir).collect())) == sorted(map(tuple, mixed.values()))


def _folder(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "what does the old man in the small house by the sea eat on most days of the long winter")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows_and_clashing_names(spark, tmp_path):
    text = "a text of some more words than a few which says one thing and then says quite another thing to all who read it"
    leak = "so we ask what does the old man in the small house by the sea eat on most days of the long winter and no one knows"
    rows = [(1, text, "s"), (1, text, "s"), (2, text + " once more", None), (3, None, "s"), (None, leak, "t"), (5, leak, "t"), (6, "", "s"), (7, "word " * 60_000, "u")]
    names = ["_id", "_tie", "_of", "tie", "score", "_doc", "_body", "_no_text", "n_chars", "_digest"]
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"{c} int" for c in names)
    d = _folder(spark, tmp_path, [(*r, *range(len(names))) for r in rows], schema)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in p.STAGES[1:-1]:
        after = written(stage(spark, docs, d), "stage")
        assert after.columns == docs.columns
        assert all([r[c] for c in names if c != "n_chars"] == [i for i, c in enumerate(names) if c != "n_chars"] for r in after.collect())
    assert p.keep_quality(spark, docs, d).columns == docs.columns
    assert sorted(str(r.doc_id) for r in p.drop_near_dups(spark, docs, d).collect()) == ["1", "3", "5", "6", "7"]  # 2 is close to 1
    assert sorted(str(r.doc_id) for r in p.drop_leaks(spark, docs, d).collect()) == ["1", "1", "2", "3", "6", "7"]
    assert {r.doc_id: r.n_chars for r in p.cut_repeats(spark, docs, d).collect()}[2] < len(text)
    assert {r.doc_id for r in p.run(spark, d).collect()} <= {1, 2, 3, 6, 7}


def test_empty_tables(spark, tmp_path):
    d = _folder(spark, tmp_path, [], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert p.run(spark, d).count() == 0
