"""Edge rules of the catalogue operators on small frames."""

import pytest
from pyspark.sql import functions as F

from shelfworks.functions import labels
from shelfworks.functions.numbering import beside, number_rows
from shelfworks.operators import browse, catalogue, ingest, search, specs
from shelfworks.plans import views
from shelfworks.sources import tables
from shelfworks.sources.schemas import LIST_ATTRIBUTES, SCALARS

PHONES = [(1, "Samsung", "Galaxy S21"), (2, "Samsung", "Galaxy S21"), (3, "Apple", "iPhone 13 Pro"), (4, "Google", "Pixel 6 Pro"), (5, None, "50%_off"), (6, "Nobody", None)]


@pytest.fixture(scope="module")
def cat(spark):
    return spark.createDataFrame(PHONES, "id_phone bigint, brand string, model string").cache()


def ids(df):
    return [r.id_phone for r in df.collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [("galaxy SAMSUNG", [1, 2]), ("pro", [3, 4]), (" pro", [3, 4]), ("%", [5]), ("_", [5]), ("6.pro", []), ("nobody", [6]), ("", [1, 2, 3, 4, 5])],
)
def test_search(cat, text, want):
    assert ids(search.search(cat, text)) == want


def test_search_many_equals_search(spark, cat):
    texts = ["galaxy SAMSUNG", "pro", "", "%", "p", "pixel google", "nothing"]
    asked = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "query_id bigint, text string")
    got = {}
    for r in search.search_many(asked, cat).orderBy("query_id", "rn").collect():
        got.setdefault(r.query_id, []).append(r.id_phone)
    assert got == {i: w for i, t in enumerate(texts) if (w := ids(search.search(cat, t)))}


def test_phrase_and_brand(cat):
    assert ids(browse.phrase_filter(cat, "samsung galaxy")) == []
    assert ids(browse.phrase_filter(cat, "13 PRO")) == [3]
    assert ids(browse.by_brand(cat, "samsung")) == []
    assert len(ids(browse.browse(cat, "todos"))) == 6


def test_filter_slice(cat):
    assert ids(search.filter_slice(cat, " pro ", 1)) == [4]
    assert len(ids(search.filter_slice(cat, "", 3))) == 6
    assert len(ids(search.filter_slice(cat, None, 3))) == 6


def test_pages_partition_the_rows(spark):
    rows = spark.range(20).select(F.col("id").alias("id_phone"), (F.col("id") % 3).cast("string").alias("brand"))
    numbered = browse.paginate(rows).collect()
    assert len(numbered) == 20
    for b in "012":
        assert sorted(r.rn for r in numbered if r.brand == b) == list(range(1, len([r for r in numbered if r.brand == b]) + 1))
    assert sum((ids(browse.page(rows, p)) for p in range(1, 6)), []) == list(range(20))
    assert ids(browse.page(rows, 9)) == []


def test_number_rows_is_dense_for_nulls_and_ties(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 1), ("a", 2), (None, 2), ("b", 1)], "k string, x int")
    got = number_rows(rows, [F.col("k"), F.col("x")], "n", ["k"]).collect()
    assert {(r.k, r.x): r.n for r in got} == {(None, 1): 1, (None, 2): 2, ("a", 1): 1, ("a", 2): 2, ("b", 1): 1}


def test_card_and_cover_images(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, []), (4, None)], "id int, images array<string>")
    got = df.select("id", specs.card_images(F.col("images")).alias("c"), specs.cover_image(F.col("images")).alias("f")).orderBy("id").collect()
    assert [(r.c, r.f) for r in got] == [(["a"], "a"), ([], "a"), ([], None), (None, None)]


def test_image_color(spark):
    colors = ["Phantom Gray", "Phantom White"]
    cases = [("https://img.example/a/s21_PhantomGray.png", "Phantom Gray"), ("https://img.example/a/s21.v2_PhantomGray.png", ""), ("x_red.png", "")]
    df = spark.createDataFrame([(c, colors) for c, _ in cases], "image string, colors array<string>")
    assert [r[0] for r in df.select(labels.image_color(F.col("image"), F.col("colors"))).collect()] == [w for _, w in cases]


def test_colours_are_brought_into_normal_form_once_a_phone(spark):
    rows = [
        (1, ["Ice_Blue", "ice blue", None, "Red"], ["a_iceBlue.png", None, "b_.png", "a_RED.x_y.png"]), (2, None, ["a_red.png"]), (3, [], ["a_red.png"]), (4, ["Red"], []), (5, ["", "Red"], ["b_.png"]),
    ]
    found = specs.color_for_image(spark.createDataFrame(rows, "id_phone bigint, colors array<string>, images array<string>"))
    assert sorted((r.id_phone, r.pos, r.color) for r in found.collect()) == [(1, 0, "Ice_Blue"), (1, 1, ""), (1, 2, ""), (1, 3, "Red"), (2, 0, ""), (3, 0, ""), (5, 0, "")]
    above, below = found._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)
    assert "lambda" not in above and "lambda" in below


def test_enum_labels(spark):
    df = spark.createDataFrame([("Ice_Blue",), ("_4G",), (None,)], "c string")
    assert [r[0] for r in df.select(labels.enum_label(F.col("c"))).collect()] == ["Ice Blue", "4G", None]


def test_brands_are_judged_in_order(spark):
    brand = spark.createDataFrame([(1, "Nokia"), (2, None)], "id_brand bigint, brand_name string")
    new = spark.createDataFrame([(1, "Nokia"), (2, "nokia"), (3, "LG"), (4, "LG"), (5, ""), (6, None), (7, " ")], "seq bigint, brand_name string")
    table, rejected = ingest.add_brands(brand, new)
    assert sorted((r.id_brand, r.brand_name) for r in table.filter("id_brand > 2").collect()) == [(3, "nokia"), (4, "LG"), (5, " ")]
    assert {r.seq: r.reason for r in rejected.collect()} == {1: ingest.BRAND_EXISTS, 4: ingest.BRAND_EXISTS, 5: ingest.BRAND_EMPTY, 6: ingest.BRAND_EXISTS}


def test_models_count_only_valid_rows_as_earlier(spark):
    model = spark.createDataFrame([(1, "X1", 1)], "id_model bigint, model_name string, id_brand bigint")
    brand = spark.createDataFrame([(1, "Nokia")], "id_brand bigint, brand_name string")
    new = spark.createDataFrame([(1, "x1", 1), (2, "Y", 9), (3, "y", 1), (4, "Y", 1), (5, None, 1), (6, None, 1)], "seq bigint, model string, brand bigint")
    table, rejected = ingest.add_models(model, brand, new)
    assert {r.seq: r.reason for r in rejected.collect()} == {1: ingest.MODEL_EXISTS, 2: ingest.BRAND_UNKNOWN, 4: ingest.MODEL_EXISTS}
    assert sorted(r.id_model for r in table.collect()) == [1, 2, 3, 4]


def test_references_are_checked_in_order(spark):
    subs = spark.createDataFrame(
        [(1, 1, [1], [1]), (2, 1, [9], [9]), (3, 1, [1], [9]), (4, 9, [], []), (5, 1, None, [1]), (6, 1, [1], None)],
        "seq bigint, id_model bigint, colors array<bigint>, box_contents array<bigint>",
    )
    one = lambda c: spark.createDataFrame([(1,)], f"{c} bigint")
    got = ingest.resolve_refs(subs, one("id_color"), one("id_content"), one("id_model")).collect()
    assert {r.seq: r.reason for r in got} == {1: None, 2: ingest.COLOR_UNKNOWN, 3: ingest.BOX_UNKNOWN, 4: ingest.MODEL_UNKNOWN, 5: ingest.INVALID, 6: ingest.INVALID}


def test_save_phones_blanks_the_web_address_and_is_idempotent(spark):
    phone = spark.createDataFrame([(1, "w", "a"), (2, "w", "b")], "id_phone bigint, oficial_web string, os string")
    subs = spark.createDataFrame([(1, 2, "x", "c"), (2, 2, "x", "d"), (3, None, "x", "e"), (4, 7, "x", "f")], "seq bigint, id_phone bigint, oficial_web string, os string")
    got = ingest.save_phones(phone, subs)
    want = [(1, "w", "a"), (2, None, "d"), (7, None, "f"), (8, None, "e")]
    assert sorted(map(tuple, got.collect())) == want
    again = ingest.save_phones(got, subs.filter("id_phone IS NOT NULL"))
    assert sorted(map(tuple, again.collect())) == want


def test_delete_cascades_and_ignores_unknown_ids(spark):
    t = {
        "brand": spark.createDataFrame([(1, "A"), (2, "B")], "id_brand bigint, brand_name string"),
        "model": spark.createDataFrame([(1, "m", 1), (2, "n", 2)], "id_model bigint, model_name string, id_brand bigint"),
        "phone": spark.createDataFrame([(1, 1), (2, 2)], "id_phone bigint, id_model bigint"),
        "phone_list": spark.createDataFrame([(1, "images", 0, "x"), (2, "images", 0, "y")], "id_phone bigint, attr string, pos int, value string"),
    }
    left = ingest.delete_brands(t, spark.createDataFrame([(1,), (77,)], "id_brand bigint"))
    assert {n: [r[0] for r in df.collect()] for n, df in left.items()} == {"brand": [2], "model": [2], "phone": [2], "phone_list": [2]}
    assert [r.status for r in browse.lookup(spark.createDataFrame([(1,)], "id_phone bigint"), left["phone"], "id_phone").collect()] == [404]


def test_patch_keeps_what_is_null(spark):
    base = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k bigint, x string, y string")
    upd = spark.createDataFrame([(1, None, "z"), (9, "q", "q")], "k bigint, x string, y string")
    assert sorted(map(tuple, ingest.patch(base, upd, "k").collect())) == [(1, "a", "z"), (2, "c", "d")]


def test_nest_is_the_inverse_of_normalise(spark):
    values = [(1, *[[f"{a}{i}" for i in range(k)] for k, a in enumerate(LIST_ATTRIBUTES)], [2, 1], [3])]
    df = spark.createDataFrame(values, "id_phone bigint, " + ", ".join(f"{a} array<string>" for a in LIST_ATTRIBUTES) + ", colors array<bigint>, box_contents array<bigint>")
    for c in SCALARS:
        df = df.withColumn(c, F.lit("s"))
    parts = tables.normalise_phone(df.withColumn("id_model", F.lit(1)))
    nested = catalogue.nest_all(parts["phone_list"]).first()
    assert all((nested[a] or []) == values[0][k + 1] for k, a in enumerate(LIST_ATTRIBUTES))
    assert [(r.pos, r.id_color) for r in parts["phone_colors"].orderBy("pos").collect()] == [(0, 2), (1, 1)]


def test_submissions_keep_what_does_not_parse(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"seq": 1, "idPhone": 5, "colors": [1, 2], "oficialWeb": "w"}\nnot json\n')
    got = tables.read_submissions(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.idPhone, r.colors, r._corrupt) for r in got] == [(None, None, "not json"), (5, [1, 2], None)]


def test_catalogue_documents_round_trip(spark, tmp_path, cat):
    tables.write_catalogue(cat, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 6
    assert '"brand":null' in tables.as_json(cat.filter("id_phone = 5")).first().document


def test_empty_tables(spark, cat):
    none = cat.limit(0)
    assert browse.paginate(none.select("id_phone", "brand")).count() == 0
    assert search.search_many(spark.createDataFrame([], "query_id bigint, text string"), none).count() == 0
    assert browse.page_count(none).count() == 0


def test_bulk_search_of_odd_texts_equals_single_search(spark):
    cat = spark.createDataFrame(
        [(i, b, m) for i, (b, m) in enumerate([("Samsung", "Galaxy S21"), ("Apple", "iPhone 13"), ("Apple", None), (None, "Pixel"), (None, None), ("B%_", "x.y"), ("Sam", "sung")] * 3)],
        "id_phone bigint, brand string, model string",
    )
    texts = ["", "  ", " apple", "a", "le", "sam", "samsung s21", "SUNG galaxy", "%", "_", ".", "x.y b%", "apple a", "zzz", "apple zzz", "pp apple le", "13", "e 13"]
    queries = spark.createDataFrame([*enumerate(texts), (90, None), (91, "a")], "query_id bigint, text string")
    got = {}
    for r in search.search_many(queries, cat).orderBy("rn").collect():
        got.setdefault(r.query_id, []).append(r.id_phone)
    want = {i: [r.id_phone for r in search.search(cat, t).collect()] for i, t in [*enumerate(texts), (91, "a")]}
    assert got == {i: ids for i, ids in want.items() if ids}


def test_bulk_search_looks_at_few_pairs(spark):
    d = "/root/testdata/sf0.1"
    texts = views.queries(spark, d).select("text").distinct()
    names = views.parts(spark, d).select("brand", "model").distinct()
    held = names.select(F.explode(search.held_pieces(F.col("brand"), F.col("model"))).alias("piece"))
    asked = search.rarest_pieces(texts, held)
    assert asked.filter("NOT alone").join(held, "piece").count() < 0.05 * texts.count() * names.count()


def test_parts_of_models(spark):
    brand = spark.createDataFrame([(1, "A"), (2, "B")], "id_brand bigint, brand_name string")
    model = spark.createDataFrame([(1, "m", 1), (2, "n", 1)], "id_model bigint, model_name string, id_brand bigint")
    phone = spark.createDataFrame([(i, 1) for i in range(7)], "id_phone bigint, id_model bigint")
    rows = catalogue.brand_parts(brand, model, phone, 3).collect()
    assert sorted((r.id_brand, str(r.id_model), str(r.part), str(r.phones)) for r in rows) == [
        (1, "1", "0", "[0, 1, 2]"), (1, "1", "1", "[3, 4, 5]"), (1, "1", "2", "[6]"), (1, "2", "0", "[]"), (2, "None", "None", "None"),
    ]


def test_any_number_of_requests_for_all(spark, monkeypatch):
    monkeypatch.setattr(browse, "ALL_SLICE", 2)
    cat = spark.createDataFrame([(1, "A"), (2, "B")], "id_phone bigint, brand string")
    for n in (0, 1, 2, 5, 5):
        asked = spark.createDataFrame([(k, browse.ALL) for k in range(n)] + [(77, "B"), (78, "x")], "request_id bigint, brand string")
        assert sorted(map(tuple, browse.browse_many(asked, cat).collect())) == sorted([(k, p) for k in range(n) for p in (1, 2)] + [(77, 2)])


def test_tables_of_a_relational_store(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/store;create=true"
    rows = [(i, f"m{i}", i % 3) for i in range(20)]
    model = spark.createDataFrame(rows, "ID_MODEL bigint, MODEL_NAME string, ID_BRAND bigint")
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    model.coalesce(1).write.jdbc(url, "MODEL", properties=driver)
    got = tables.read_jdbc(spark, url, "MODEL", "ID_MODEL", 0, 20, 4, driver)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == rows


def test_neighbours_across_partitions(spark):
    rows = [(i, "hot" if i % 3 else f"u{i}", None if i % 7 == 0 else i) for i in range(200)] + [(300, None, 1), (301, None, 2)]
    df = spark.createDataFrame(rows, "id bigint, user string, x int")
    for after in (False, True):
        got = {r.id: r.n for r in beside(df, ["user"], ["id"], F.col("x"), "n", after).collect()}
        assert len(got) == len(rows)
        for u in {r[1] for r in rows}:
            of = sorted(r for r in rows if r[1] == u)
            for k, r in enumerate(of):
                near = of[k + 1 : k + 2] if after else of[max(0, k - 1) : k]
                assert (got[r[0]] and got[r[0]].v) == (near[0][2] if near else None) and (got[r[0]] is None) == (not near)
