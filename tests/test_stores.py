"""Stored tables: merges by buckets, lists by page, the search index, two sinks in one pass, and reads from a live store."""

import os

import pytest
from pyspark.sql import functions as F

from shelfworks.operators import browse, catalogue, ingest, search
from shelfworks.operators.search_index import SearchIndex
from shelfworks.plans import views
from shelfworks.sources import tables
from shelfworks.sources.bucketed import BucketedTable, save
from shelfworks.sources.paged import PagedTable

PHONE = "id_phone bigint, os string, _bucket string"


def files(path):
    """Files of each bucket."""
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("_bucket_=")}


def rows(df):
    return in_order(map(tuple, df.collect()))


def files_read(df):
    """How many files a query's scans open."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    leaves = plan.collectLeaves()
    counts = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return sum(m.apply("numFiles").value() for m in counts if m.contains("numFiles"))


def in_order(some):
    return sorted(some, key=str)


@pytest.fixture
def store(spark, tmp_path):
    df = spark.createDataFrame([(i, f"os{i}", "x") for i in range(200)] + [(7, "twice", "x"), (None, "no id", "x")], PHONE)
    return BucketedTable.create(df, str(tmp_path / "phones"), "id_phone", 20)


def test_only_touched_buckets_are_rewritten(spark, store):
    before, held = files(store.path), rows(store.rows().filter("id_phone NOT IN (7, 9) OR id_phone IS NULL"))
    new = spark.createDataFrame([(7, "new", "y"), (9, None, "y"), (900, "more", "y"), (None, "again", "y")], PHONE)
    touched = {f"_bucket_={b}" for b in store.touched(new)}
    store.replace(new, batch="one")
    after = files(store.path)
    assert {d for d in before if before[d] != after.get(d)} <= touched and len(touched) <= 4 < len(before)
    assert rows(store.rows()) == in_order(held + rows(new))
    BucketedTable.open(spark, store.path).replace(new, batch="one")  # a batch that is run again does nothing
    assert files(store.path) == after
    assert not os.listdir(f"{store.path}/_staged")


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(40_000).select(F.lit(7).cast("bigint").alias("id_phone"), F.sha2(F.col("id").cast("string"), 256).alias("os"), F.lit("x").alias("_bucket"))
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "256k")
    try:
        large = BucketedTable.create(df.repartition(4), str(tmp_path / "large"), "id_phone", 4)
    finally:
        spark.conf.set(setting, before)
    (held,) = [d for d in os.listdir(large.path) if d.startswith(f"{large.bucket}=")]
    assert len([f for f in os.listdir(f"{large.path}/{held}") if f.endswith(".parquet")]) > 1
    assert large.rows().count() == large.rows().distinct().count() == 40_000


def test_submissions_are_judged_once(spark, tmp_path, sf_dir):
    judged = spark.sparkContext.accumulator(0)

    def seen(rows):
        for b in rows:
            judged.add(b.num_rows)
            yield b

    parts = tables.normalise_phone(views.listed_parts(spark, sf_dir).limit(5))
    store = {n: BucketedTable.create(df, str(tmp_path / n), "id_phone", 2) for n, df in parts.items()}
    subs = views.full_submissions(spark, sf_dir).filter("seq <= 150 AND colors IS NOT NULL AND box_contents IS NOT NULL")
    ingest.merge_phones(store, subs.mapInArrow(seen, subs.schema), "a")
    assert judged.value == subs.count() > 0


def test_a_bucket_that_is_emptied_stays_empty(spark, store):
    ids = store.rows().filter(store.bucket_of("id_phone") == 3).select("id_phone")
    assert ids.count() > 0
    store.remove(spark.createDataFrame(ids.collect() + [(12345,)], "id_phone bigint"))
    assert "_bucket_=3" not in files(store.path)
    assert store.rows().filter(store.bucket_of("id_phone") == 3).count() == 0 < store.rows().count()


def test_a_broken_batch_goes_on_from_its_stage(spark, store, monkeypatch):
    new = spark.createDataFrame([(i, "new", "y") for i in range(0, 200, 3)], PHONE)
    want = in_order(rows(store.rows().filter("id_phone % 3 <> 0 OR id_phone IS NULL")) + rows(new))

    def broken(path):
        raise RuntimeError("lost")

    gone = BucketedTable.open(spark, store.path)
    monkeypatch.setattr(gone, "_delete", broken)
    with pytest.raises(RuntimeError):
        gone.replace(new, batch="b")  # everything is moved in, but the batch is not closed
    some = next(iter(files(store.path)))
    for f in files(store.path)[some]:
        os.remove(f"{store.path}/{some}/{f}")  # and a bucket was half moved
    monkeypatch.undo()
    done = f"{store.path}/_done/b"
    if os.path.exists(done):
        for f in os.listdir(done):
            os.remove(f"{done}/{f}")
        os.rmdir(done)
    BucketedTable.open(spark, store.path).replace(new.limit(0), batch="b")  # the stage counts, not what is given now
    assert rows(store.rows()) == want


def test_rows_near_keys_are_read_from_their_buckets_only(spark, store):
    near = store.near(spark.createDataFrame([(5,)], "id_phone bigint"))
    assert near.filter("id_phone = 5").count() == 1
    assert files_read(near) == 1 < files_read(store.rows())


def test_catalogues_without_row_level_changes_say_so(spark):
    spark.range(3).withColumnRenamed("id", "k").write.mode("overwrite").saveAsTable("plain_table")
    with pytest.raises(Exception, match="(?i)merge"):
        save("plain_table", spark.range(1).withColumnRenamed("id", "k"), "k")
    spark.sql("DROP TABLE plain_table")


def test_merged_phones_keep_their_new_ids_when_a_batch_is_broken_off(spark, tmp_path, sf_dir, monkeypatch):
    parts = tables.normalise_phone(views.listed_parts(spark, sf_dir).limit(30))
    store = {n: BucketedTable.create(df, str(tmp_path / n), "id_phone", 8) for n, df in parts.items()}
    subs = views.full_submissions(spark, sf_dir).filter("seq <= 200 AND colors IS NOT NULL AND box_contents IS NOT NULL")
    calls = []
    replace = BucketedTable.replace

    def once(self, *a, **k):
        calls.append(self.path)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return replace(self, *a, **k)

    monkeypatch.setattr(BucketedTable, "replace", once)
    with pytest.raises(RuntimeError):
        ingest.merge_phones(store, subs, "a")
    ids = store["phone"].rows().select("id_phone").collect()
    ingest.merge_phones(store, subs, "a")
    assert sorted(store["phone"].rows().select("id_phone").collect()) == sorted(ids)
    want = ingest.submitted_phones(spark.createDataFrame([(r.id_phone,) for r in parts["phone"].select("id_phone").collect()], "id_phone bigint"), subs)
    got = catalogue.nest(store["phone_colors"].rows(), "id_phone", "id_color", "pos", "colors").join(want.select("id_phone"), "id_phone")
    assert rows(got) == rows(want.select("id_phone", "colors"))


def test_models_and_brands_merge(spark, tmp_path):
    model = BucketedTable.create(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id_model bigint, model_name string, id_brand bigint"), str(tmp_path / "m"), "id_model", 4)
    rejected = ingest.merge_models(model, spark.createDataFrame([(2, "B", 3), (9, "x", 1)], "id_model bigint, model_name string, id_brand bigint"), "m1")
    assert rows(model.rows()) == [(1, "a", 1), (2, "B", 3)] and [(r.id_model, r.reason) for r in rejected.collect()] == [(9, ingest.NOT_FOUND)]
    brand = BucketedTable.create(spark.createDataFrame([(1, "a")], "id_brand bigint, brand_name string"), str(tmp_path / "b"), "id_brand", 4)
    ingest.merge_brands(brand, spark.createDataFrame([(1, "A"), (5, None)], "id_brand bigint, brand_name string"))
    assert rows(brand.rows()) == [(1, "A"), (5, None)]


@pytest.mark.parametrize("by", [None, "brand"])
def test_pages_are_read_by_place(spark, tmp_path, by):
    df = spark.range(3000).select(F.col("id").alias("id_phone"), F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 3).cast("string")).alias("brand"))
    paged = PagedTable.create(df.repartition(5), str(tmp_path / "p"), ["id_phone"], by, part_rows=100)
    assert files_read(paged.all) >= 25
    for value in [None, "0", "1", "none"] if by else [None]:
        of = df.filter(F.col("brand").eqNullSafe(F.lit(value))) if by else df
        n = of.count()
        assert paged.pages(value) == -(-n // 6)
        for p in (1, 2, max(1, n // 12), max(1, -(-n // 6)), n + 1):
            got = paged.page(p, value)
            assert rows(got) == rows(browse.page(of, p)) and [r.id_phone for r in got.collect()] == sorted(r.id_phone for r in got.collect())
            assert files_read(paged.page(p, value)) <= 2


def test_many_pages(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("id_phone"), (F.col("id") % 3).cast("string").alias("brand"))
    paged = PagedTable.create(df, str(tmp_path / "p"), ["id_phone"], "brand", part_rows=50)
    asked = spark.createDataFrame([(i, str(i % 4), 1 + i % 31) for i in range(120)], "request_id bigint, brand string, page bigint")
    numbered = {(r.brand, r.rn): r.id_phone for r in browse.paginate(df).collect()}
    want = [(i, 1 + i % 31, k, x) for i in range(120) for k in range(1, 7) if (x := numbered.get((str(i % 4), (i % 31) * 6 + k))) is not None]
    assert rows(paged.many(asked).select("request_id", "page", "rn", "id_phone")) == in_order(want)


ODD_NAMES = [("Samsung", "Galaxy S21"), ("Apple", "iPhone 13"), ("Apple", None), (None, "Pixel"), (None, None), ("B%_", "x.y"), ("Sam", "sung")]
ODD_TEXTS = ["", "  ", " apple", "a", "le", "sam", "samsung s21", "SUNG galaxy", "%", "_", ".", "x.y b%", "apple a", "zzz", "apple zzz", "pp apple le", "13", "e 13"]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_index_equals_single_search_and_takes_changes(spark, tmp_path, block):
    schema = "id_phone bigint, brand string, model string"
    was = [(i, *ODD_NAMES[i % 7]) for i in range(21)]
    now = [(i, b, m) for i, b, m in was if i not in (1, 8)] + [(30, "Apple", "iPad"), (31, "Zebra", "Pixel"), (-5, "Sam", "sung")]
    now = [(i, b, "renamed" if i == 3 else m) for i, b, m in now]
    queries = spark.createDataFrame([*enumerate([*ODD_TEXTS, "renamed", "ipad"]), (90, None), (91, "a")], "query_id bigint, text string")
    index = SearchIndex.build(spark.createDataFrame(was, schema), str(tmp_path / "i"), block=max(block, 5) if block == 1000 else block)

    def check(cat):
        got = {}
        for r in index.search(queries).orderBy("rn").collect():
            got.setdefault(r.query_id, []).append(r.id_phone)
        want = {r.query_id: [x.id_phone for x in search.search(cat, r.text).collect()] for r in queries.collect() if r.text is not None}
        assert got == {q: ids for q, ids in want.items() if ids}

    check(spark.createDataFrame(was, schema))
    changed = [n[1:] for n in was if n not in now] + [n[1:] for n in now if n not in was]
    index.update(spark.createDataFrame(now, schema), spark.createDataFrame(changed, "brand string, model string"), block)
    check(spark.createDataFrame(now, schema))


def test_a_common_word_is_settled_among_the_first_blocks(spark, tmp_path):
    cat = spark.range(4000).select(F.col("id").alias("id_phone"), F.lit("Brand").alias("brand"), F.concat(F.lit("model x"), F.col("id").cast("string")).alias("model"))
    index = SearchIndex.build(cat, str(tmp_path / "i"), block=20)
    looked = []
    got = index.search(spark.createDataFrame([(1, "model brand"), (2, "x3999")], "query_id bigint, text string"), looked)
    assert [(r.query_id, r.id_phone) for r in got.orderBy("query_id", "rn").collect()] == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 3999)]
    assert sum(looked) < 800 and len(looked) > 3  # of 4,000 matches of the common text, and of 8,000 pairs


def test_two_sinks_come_from_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    look = F.udf(lambda x: (seen.add(1), x)[1], "bigint").asNondeterministic()
    judged = spark.range(100, numPartitions=4).select(look("id").alias("seq")).withColumn("reason", F.when(F.col("seq") % 3 == 0, "bad").when(F.col("seq") % 7 == 0, "worse"))
    accepted, rejected, n = tables.split_judged(judged, str(tmp_path / "j"), reasons=("bad", "worse", "never"))
    assert accepted.count() == n["accepted"] == 56 and rejected.count() == n["rejected"] == 44
    assert (n["bad"], n["worse"], n["never"]) == (34, 10, 0) and seen.value == 100
    none = spark.createDataFrame([], "seq bigint, reason string")
    a, r, n = tables.split_judged(none, str(tmp_path / "none"))
    assert a.count() == r.count() == n["accepted"] == n["rejected"] == 0


def test_the_base_is_filtered_before_it_is_shuffled(spark):
    brand = spark.range(50_000).select(F.col("id").alias("id_brand"), F.when(F.col("id") == 9, None).otherwise(F.concat(F.lit("b"), F.col("id").cast("string"))).alias("brand_name"))
    new = spark.createDataFrame([(1, "b5"), (2, "B5"), (3, None), (4, "b49999")], "seq bigint, brand_name string")
    left = ingest.met_keys(brand, F.col("brand_name"), new, F.col("brand_name"))
    assert left.filter("brand_name IN ('b5', 'b49999') OR brand_name IS NULL").count() == 3 and left.count() < 20
    assert sorted(r.seq for r in ingest.existing_brands(new, brand).collect()) == [1, 3, 4]
    orphans = catalogue.orphans(spark.createDataFrame([(1,), (60_000,), (None,)], "id_brand int"), brand, "id_brand")
    assert rows(orphans) == [(60_000,), (None,)]


def test_a_skewed_key_gives_even_partitions(spark, tmp_path):
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    url = f"jdbc:derby:{tmp_path}/store;create=true"
    keys = [*range(3000), *(10**9 + 7 * i for i in range(100)), 10**12, -50]
    data = spark.createDataFrame([(k, f"m{k}") for k in keys] + [(None, "none")], "ID_MODEL bigint, MODEL_NAME string")
    data.coalesce(1).write.jdbc(url, "MODEL", properties=driver)
    got, mark = tables.read_jdbc_balanced(spark, url, "MODEL", "ID_MODEL", 8, driver)
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert rows(got) == in_order([*((k, f"m{k}") for k in keys), (None, "none")]) and mark == 10**12
    assert max(sizes) <= 2 * len(keys) / 8 and len(sizes) >= 8
    spark.createDataFrame([(10**12 + 5, "late")], "ID_MODEL bigint, MODEL_NAME string").write.mode("append").jdbc(url, "MODEL", properties=driver)
    later, mark = tables.read_jdbc_balanced(spark, url, "MODEL", "ID_MODEL", 8, driver, after=mark)
    assert rows(later) == [(10**12 + 5, "late")] and mark == 10**12 + 5
    again, mark = tables.read_jdbc_balanced(spark, url, "MODEL", "ID_MODEL", 8, driver, after=mark)
    assert again.count() == 0 and mark == 10**12 + 5
