"""Every query of the catalogue library by name, over the given tables, with the SQL that it equals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfworks.functions import labels
from shelfworks.functions.numbering import new_path, written
from shelfworks.operators import browse, catalogue, ingest, search, specs
from shelfworks.operators.search_index import SearchIndex
from shelfworks.plans import views as v
from shelfworks.sources import tables
from shelfworks.sources.bucketed import BucketedTable
from shelfworks.sources.paged import PagedTable
from shelfworks.sources.schemas import SCALARS
from shelfworks.streaming import ordered_state, search_events
from shelfworks.streaming.intake import Intake, brands, models

QUERIES: dict = {}
ORACLE: dict = {}

#: Views that the SQL below shares.
_CAT = (
    "cat AS (SELECT c_custkey AS id_phone, n_name AS model, r_name AS brand FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey)"
)
_PARTS = "parts AS (SELECT p_partkey AS id_phone, p_brand AS brand, p_name AS model, p_type AS os, CAST(p_size AS VARCHAR) AS dimensions FROM part)"
_COLORS = "pc AS (SELECT DISTINCT l_partkey AS id_phone, l_suppkey AS id_color FROM lineitem)"
_BOXES = f"{_COLORS}, pb AS (SELECT DISTINCT id_phone, s_nationkey AS id_content FROM pc JOIN supplier ON s_suppkey = id_color)"
_IMAGES = (
    f"{_COLORS}, img AS (SELECT id_phone, id_color AS pos, 'https://img.example/' || id_phone || '_' || replace(s_name, '#', '_') || '.png' AS image "
    "FROM pc JOIN supplier ON s_suppkey = id_color), "
    "pics AS (SELECT id_phone, list(image ORDER BY pos) AS images FROM img GROUP BY id_phone)"
)
_QUERIES = (
    "q AS (SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN string_split(p_name, ' ')[-1] "
    "WHEN 2 THEN p_name || ' ' || lower(p_brand) ELSE substr(p_name, 1, 2) END AS text FROM part)"
)
_SUBS = (
    "subs AS (SELECT o_orderkey AS seq, o_custkey AS id_phone, o_orderpriority AS os, o_orderstatus AS processor, o_custkey % 30 AS id_model, "
    "CASE WHEN o_orderkey % 11 <> 0 THEN [o_orderkey % 97, o_orderkey % 103] END AS colors, "
    "CASE WHEN o_orderkey % 13 <> 0 THEN [o_orderkey % 26] END AS boxes FROM orders), "
    "judged AS (SELECT *, CASE WHEN colors IS NULL THEN 'Invalid payload' "
    "WHEN NOT list_has_all((SELECT list(s_suppkey) FROM supplier), colors) THEN 'Color not found' WHEN boxes IS NULL THEN 'Invalid payload' "
    "WHEN NOT list_has_all((SELECT list(CAST(n_nationkey AS BIGINT)) FROM nation), boxes) THEN 'Box content not found' "
    "WHEN id_model NOT IN (SELECT n_nationkey FROM nation) THEN 'Model not found' END AS reason FROM subs)"
)
_NEW_BRANDS = (
    "nb AS (SELECT c_custkey AS seq, CASE c_custkey % 7 WHEN 0 THEN r_name WHEN 1 THEN lower(r_name) WHEN 2 THEN '' WHEN 3 THEN NULL "
    "ELSE c_mktsegment || (c_custkey % 7) END AS brand_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), "
    "jb AS (SELECT seq, brand_name, CASE WHEN brand_name IN (SELECT r_name FROM region) THEN 'Brand already exists' "
    "WHEN brand_name IS NULL OR brand_name = '' THEN 'Brand name cannot be null or empty' "
    "WHEN row_number() OVER (PARTITION BY brand_name ORDER BY seq) > 1 THEN 'Brand already exists' END AS reason FROM nb)"
)
_NEW_MODELS = (
    "nm AS (SELECT p_partkey AS seq, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'nation_' || (p_partkey % 40) WHEN 2 THEN NULL ELSE p_name END AS model, "
    "p_partkey % 6 AS brand FROM part), "
    "km AS (SELECT *, lower(model) IN (SELECT lower(n_name) FROM nation) AS known, brand IN (SELECT r_regionkey FROM region) AS there FROM nm), "
    "fm AS (SELECT lower(model) AS k, min(seq) AS least FROM km WHERE model IS NOT NULL AND NOT known AND there GROUP BY 1), "
    "jm AS (SELECT seq, model, brand, CASE WHEN coalesce(known, false) OR seq > least THEN 'Model already exists' WHEN NOT there THEN 'Brand not found' END AS reason "
    "FROM km LEFT JOIN fm ON lower(model) = k)"
)
#: The sheet's attributes in SQL, in order, with whether they are lists; of parts ``p`` joined with the lists ``c`` and ``b``.
_ATTRIBUTES = (
    ("colors", True, "c.l"), ("box_contents", True, "b.l"), ("main_camera", True, "[p_type, p_brand]"), ("secondary_camera", False, "p_name"),
    ("screen", True, "string_split(p_type, ' ')"), ("processor", False, "p_brand"), ("gpu", False, "CASE WHEN p_partkey % 3 <> 0 THEN p_type END"),
    ("memory", True, "[p_size || ' GB']"), ("battery", True, "[p_size || ' mAh', NULL]"), ("os", False, "p_type"),
    ("connectivity", True, "CASE WHEN p_partkey % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [p_brand] END"),
    ("security", True, "CASE WHEN p_partkey % 5 <> 0 THEN [p_name] END"), ("dimensions", False, "CAST(p_size AS VARCHAR)"),
)
_LABELS = (
    f"{_BOXES}, c AS (SELECT id_phone, list(s_name ORDER BY s_suppkey) AS l FROM pc JOIN supplier ON s_suppkey = id_color GROUP BY 1), "
    "b AS (SELECT id_phone, list(n_name ORDER BY n_nationkey) AS l FROM pb JOIN nation ON n_nationkey = id_content GROUP BY 1)"
)
_LISTED = "part LEFT JOIN c ON c.id_phone = p_partkey LEFT JOIN b ON b.id_phone = p_partkey"
_SHEET = " UNION ALL ".join(
    f"SELECT p_partkey AS id_phone, {i} AS attr_no, '{name}' AS attr, {sql if many else f'[{sql}]'} AS l FROM {_LISTED}" for i, (name, many, sql) in enumerate(_ATTRIBUTES, 1)
)


def _json(x: str) -> str:
    """A list as JSON text, null where there is none: null, empty and null elements all differ."""
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(to_json({x}) AS VARCHAR) END"


def _fits(text: str, brand: str = "brand", model: str = "model") -> str:
    return f"len(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda t: NOT (contains(lower({model}), t) OR contains(lower({brand}), t)))) = 0"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _cat(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.catalogue(v.phone(spark, d), v.model(spark, d), v.brand(spark, d))


def _full(spark: SparkSession, d: str) -> DataFrame:
    """Parts with all attributes, the names of their colours and of what is in their box."""
    colors = written(v.phone_colors(spark, d), "phone-colors")  # read twice
    colored = catalogue.with_colors(v.full_parts(spark, d), colors, v.color(spark, d))
    return catalogue.with_box_contents(colored, v.phone_box_contents(spark, d, colors), v.box_content(spark, d))


@query(
    f"WITH {_BOXES}, l AS (SELECT p_partkey AS id_phone, len(string_split(p_type, ' ')) + 2 + 1 + 1 + 2 + (CASE WHEN p_partkey % 4 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN p_partkey % 5 <> 0 THEN 1 ELSE 0 END) AS n FROM part), "
    "c AS (SELECT id_phone, string_agg(s_name, ',' ORDER BY s_suppkey) AS colors FROM pc JOIN supplier ON s_suppkey = id_color GROUP BY 1), "
    "b AS (SELECT id_phone, string_agg(n_name, ',' ORDER BY n_nationkey) AS box FROM pb JOIN nation ON n_nationkey = id_content GROUP BY 1) "
    "SELECT p_partkey AS id_phone, r_name AS brand, n_name AS model, CAST(l.n AS BIGINT) AS n_items, c.colors, b.box FROM part JOIN nation ON n_nationkey = p_partkey % 25 "
    "JOIN region ON r_regionkey = n_regionkey JOIN l ON l.id_phone = p_partkey LEFT JOIN c ON c.id_phone = p_partkey LEFT JOIN b ON b.id_phone = p_partkey"
)
def s1_read_tables(spark, d):
    """All eight tables as a store has them, read with their schemas and joined."""
    path = new_path(spark, "store")
    phones = tables.normalise_phone(written(v.listed_parts(spark, d), "listed-parts"))
    for name, df in (phones | {"brand": v.brand(spark, d), "model": v.model(spark, d), "color": v.color(spark, d), "box_content": v.box_content(spark, d)}).items():
        df.write.parquet(f"{path}/{name}.parquet")
    t = tables.read_tables(spark, path)
    items = t["phone_list"].groupBy("id_phone").agg(F.count(F.lit(1)).alias("n_items"))
    named = [
        catalogue.nest(t[bridge].join(t[label], key), "id_phone", name, key, out).withColumn(out, F.array_join(out, ","))
        for bridge, label, key, name, out in (("phone_colors", "color", "id_color", "name", "colors"), ("phone_box_contents", "box_content", "id_content", "name_content", "box"))
    ]
    cat = catalogue.catalogue(t["phone"], t["model"], t["brand"]).select("id_phone", "brand", "model").join(items, "id_phone")
    return cat.join(named[0], "id_phone", "left").join(named[1], "id_phone", "left")


@query(
    f"WITH {_SUBS} SELECT seq, id_phone, id_model, array_to_string(colors, ',') AS colors, array_to_string(boxes, ',') AS boxes, os, false AS corrupt FROM subs"
)
def s2_read_submissions(spark, d):
    """Submissions written as JSON lines and read again with their schema."""
    path = new_path(spark, "submissions")
    subs = v.submissions(spark, d).withColumnsRenamed({"id_phone": "idPhone", "id_model": "idModel", "box_contents": "boxContents"})
    subs.write.json(path)
    back = tables.read_submissions(spark, path)
    rows = tables.submission_rows(back)
    return rows.join(back.select("seq", F.col("_corrupt").isNotNull().alias("corrupt")), "seq").select(
        "seq", "id_phone", "id_model", F.array_join("colors", ",").alias("colors"), F.array_join("box_contents", ",").alias("boxes"), "os", "corrupt"
    )


_CHILDREN = " UNION ALL ".join(
    f"SELECT p_partkey AS id_phone, '{name}' AS kind, CAST(unnest(range(len({sql}))) AS INTEGER) AS pos, CAST(unnest({sql}) AS VARCHAR) AS value FROM {_LISTED}"
    for name, sql in [("images", "['https://img.example/' || p_partkey || '.png']"), ("colors", "c.i"), ("box_contents", "b.i")]
    + [(n, sql) for n, many, sql in _ATTRIBUTES if many and n not in ("colors", "box_contents")]
)


@query(
    f"WITH {_BOXES}, c AS (SELECT id_phone, list(id_color ORDER BY id_color) AS i FROM pc GROUP BY 1), b AS (SELECT id_phone, list(id_content ORDER BY id_content) AS i FROM pb GROUP BY 1) "
    f"{_CHILDREN} UNION ALL SELECT p_partkey, 'phone', NULL, concat_ws('|', p_name, p_brand, CASE WHEN p_partkey % 3 <> 0 THEN p_type END, CAST(p_partkey % 25 AS VARCHAR)) FROM part"
)
def s3_normalise(spark, d):
    """Phones with their nine lists as a parent table and rows of child tables."""
    colors = written(v.phone_colors(spark, d), "phone-colors")
    boxes = v.phone_box_contents(spark, d, colors)
    ids = [catalogue.nest(df, "id_phone", key, "pos", name) for df, key, name in ((colors, "id_color", "colors"), (boxes, "id_content", "box_contents"))]
    t = tables.normalise_phone(v.full_parts(spark, d).join(ids[0], "id_phone", "left").join(ids[1], "id_phone", "left"))
    text = F.concat_ws("|", "secondary_camera", "processor", "gpu", F.col("id_model").cast("string"))
    out = t["phone_list"].select("id_phone", F.col("attr").alias("kind"), "pos", "value")
    out = out.union(t["phone"].select("id_phone", F.lit("phone"), F.lit(None).cast("int"), text))
    for kind, name, key in (("colors", "phone_colors", "id_color"), ("box_contents", "phone_box_contents", "id_content")):
        out = out.union(t[name].select("id_phone", F.lit(kind), "pos", F.col(key).cast("string")))
    return out


_DOCUMENT = (
    [("id_phone", "p_partkey"), ("brand", "p_brand"), ("model", "p_name"), ("images", "['https://img.example/' || p_partkey || '.png']")]
    + [(n, f"CASE WHEN {sql} IS NULL THEN CAST([] AS VARCHAR[]) ELSE {sql} END" if n in ("colors", "box_contents") else sql) for n, _, sql in _ATTRIBUTES]
)


@query(f"WITH {_LABELS} SELECT CAST(to_json({{{', '.join(f'{chr(39)}{n}{chr(39)}: {sql}' for n, sql in _DOCUMENT)}}}) AS VARCHAR) AS document FROM {_LISTED}")
def s4_catalogue_documents(spark, d):
    """The catalogue with all lists as JSON documents, written and read again as text."""
    path = new_path(spark, "documents")
    tables.write_catalogue(_full(spark, d).select([n for n, _ in _DOCUMENT]), path)
    return spark.read.text(path).select(F.col("value").alias("document"))


@query(f"WITH {_SUBS} SELECT seq, 500 AS status, 'Internal Server Error' AS error, reason AS message FROM judged WHERE reason IS NOT NULL")
def s5_quarantine(spark, d):
    """Rejected submissions with their error record, but for its time."""
    return tables.quarantine(j4_resolve_refs(spark, d)).select("seq", "status", "error", "message")


@query(
    f"WITH {_SUBS} SELECT seq, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS verdict, reason AS message, count(*) FILTER (reason IS NULL) OVER () AS n_accepted, "
    "count(*) FILTER (reason = 'Model not found') OVER () AS n_unknown_models FROM judged"
)
def s5_one_pass(spark, d):
    """Accepted and rejected submissions from two sinks that one pass has written, with the counts that it took."""
    judged = ingest.resolve_refs(v.submissions(spark, d), v.color(spark, d), v.box_content(spark, d), v.model(spark, d))
    accepted, rejected, n = tables.split_judged(judged, new_path(spark, "judged"), reasons=(ingest.MODEL_UNKNOWN,))
    both = accepted.select("seq", F.lit("accepted").alias("verdict"), F.lit(None).cast("string").alias("message")).union(rejected.select("seq", F.lit("rejected"), "reason"))
    return both.withColumns({"n_accepted": F.lit(n["accepted"]).cast("bigint"), "n_unknown_models": F.lit(n[ingest.MODEL_UNKNOWN]).cast("bigint")})


@query("SELECT CAST(r_regionkey AS BIGINT) AS id_brand, r_name AS brand_name FROM region")
def p1_brand_list(spark, d):
    """Ids and names of brands."""
    return browse.brand_list(v.brand(spark, d))


@query(f"WITH {_CAT} SELECT id_phone, brand, model, CAST(NULL AS VARCHAR) AS image_search FROM cat")
def p2_search_hits(spark, d):
    """The hit's columns."""
    return search.search_hits(_cat(spark, d))


@query(
    f"WITH {_IMAGES}, e AS (SELECT id_phone, CASE WHEN id_phone % 5 = 0 THEN NULL WHEN id_phone % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE images END AS images FROM pics) "
    f"SELECT id_phone, {_json('images[1:len(images) - 1]')} AS images FROM e"
)
def p3_card_images(spark, d):
    """All images but the last, as JSON; some lists are null, some empty."""
    pics = catalogue.nest(v.images(spark, d), "id_phone", name="images")
    some = F.when(F.col("id_phone") % 5 == 0, None).when(F.col("id_phone") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("images"))
    return pics.select("id_phone", F.to_json(specs.card_images(some)).alias("images"))


@query(f"WITH {_IMAGES} SELECT id_phone, images[1] AS cover FROM pics")
def p4_cover_image(spark, d):
    """The first image."""
    return catalogue.nest(v.images(spark, d), "id_phone", name="images").select("id_phone", specs.cover_image(F.col("images")).alias("cover"))


@query(f"WITH {_PARTS} SELECT id_phone, upper(brand) AS brand FROM parts")
def p5_upper_brand(spark, d):
    """Brands in capitals."""
    return search.upper_brand(v.parts(spark, d)).select("id_phone", "brand")


@query(f"WITH {_CAT} SELECT id_phone, concat_ws(' ', brand, model) AS title FROM cat")
def p6_title(spark, d):
    """Brand and model."""
    return _cat(spark, d).select("id_phone", labels.title(F.col("brand"), F.col("model")).alias("title"))


@query(f"WITH {_CAT} SELECT id_phone, lower(regexp_replace(brand || '_ ' || model, '[_ ]+', '', 'g')) AS label FROM cat")
def p7_norm_label(spark, d):
    """Labels in normal form."""
    return _cat(spark, d).select("id_phone", labels.norm_label(F.concat("brand", F.lit("_ "), "model")).alias("label"))


@query(
    f"WITH {_IMAGES}, names AS (SELECT id_phone, list(s_name ORDER BY id_color) AS colors FROM pc JOIN supplier ON s_suppkey = id_color GROUP BY 1), "
    "n AS (SELECT id_phone, list_transform(colors, lambda c: split_part(c, '#', 2)) AS colors FROM names), "
    "o AS (SELECT id_phone, unnest(images) AS image, CAST(unnest(range(len(images))) AS INTEGER) AS pos FROM pics) "
    "SELECT id_phone, pos, image, coalesce(list_filter(colors, lambda c: lower(regexp_replace(c, '[_ ]+', '', 'g')) = "
    "lower(regexp_replace(string_split(string_split(string_split(image, '/')[-1], '.')[1], '_')[-1], '[_ ]+', '', 'g')))[1], '') AS color FROM o JOIN n USING (id_phone)"
)
def p8_color_for_image(spark, d):
    """The colour that each image's file name tells."""
    named = catalogue.nest(v.phone_colors(spark, d).join(v.color(spark, d), "id_color"), "id_phone", "name", "pos", "colors")
    short = named.withColumn("colors", F.transform("colors", lambda c: F.element_at(F.split(c, "#"), 2)))
    return specs.color_for_image(short.join(catalogue.nest(v.images(spark, d), "id_phone", name="images"), "id_phone"))


@query(f"WITH {_PARTS} SELECT id_phone, 'https://wa.example/100?text=' || url_encode('Hello, I am interested in the ' || brand || ' ' || model) AS link FROM parts")
def p9_contact_link(spark, d):
    """A contact link with the encoded message."""
    text = labels.percent_encoded(labels.interest_message(F.col("brand"), F.col("model")))
    return v.parts(spark, d).select("id_phone", F.concat(F.lit("https://wa.example/100?text="), text).alias("link"))


@query(
    "SELECT conv_id, turn, CAST(to_json({'messaging_product': 'whatsapp', 'to': CAST(conv_id AS VARCHAR), 'text': {'body': text}}) AS VARCHAR) AS payload FROM conversations"
)
def p10_message_payload(spark, d):
    """Message bodies of all conversations."""
    c = v.read(spark, d, "conversations")
    return c.select("conv_id", "turn", labels.message_payload(F.col("conv_id").cast("string"), F.col("text")).alias("payload"))


@query(f"WITH {_LABELS}, s AS ({_SHEET}) SELECT id_phone, attr_no, attr, CAST(unnest(range(len(l))) AS INTEGER) AS item_no, unnest(l) AS value FROM s")
def p11_spec_sheet(spark, d):
    """The sheet of every part, all thirteen attributes."""
    return specs.spec_sheet(_full(spark, d))


@query(f"WITH {_COLORS} SELECT id_phone, string_agg(s_name, ',' ORDER BY s_suppkey) AS battery FROM pc JOIN supplier ON s_suppkey = id_color GROUP BY 1")
def p12_battery_text(spark, d):
    """A list as one text."""
    named = catalogue.nest(v.phone_colors(spark, d).join(v.color(spark, d), "id_color"), "id_phone", "name", "pos", "battery")
    return named.select("id_phone", specs.battery_text(F.col("battery")).alias("battery"))


@query(f"WITH {_CAT} SELECT id_phone, replace(model, '_', ' ') AS label FROM cat")
def p13_enum_label(spark, d):
    """Labels of codes."""
    return _cat(spark, d).select("id_phone", labels.enum_label(F.col("model")).alias("label"))


@query(f"WITH {_CAT} SELECT id_phone, model FROM cat WHERE brand = 'ASIA'")
def f1_by_brand(spark, d):
    """Phones of one brand."""
    return browse.by_brand(_cat(spark, d), "ASIA").select("id_phone", "model")


@query(
    f"WITH {_CAT}, r AS (SELECT CAST(r_regionkey AS BIGINT) AS request_id, r_name AS brand FROM region UNION ALL SELECT 99, 'todos') "
    "SELECT request_id, id_phone FROM r JOIN cat ON r.brand = 'todos' OR r.brand = cat.brand"
)
def f2_browse(spark, d):
    """Every brand, and all."""
    requests = v.brand(spark, d).select(F.col("id_brand").alias("request_id"), F.col("brand_name").alias("brand"))
    return browse.browse_many(requests.union(spark.sql(f"SELECT 99L, '{browse.ALL}'")), _cat(spark, d))


@query(f"WITH {_PARTS} SELECT id_phone, brand, model FROM parts WHERE {_fits(chr(39) + ' Brand#1  anvil' + chr(39))} ORDER BY id_phone LIMIT 5")
def f3_search(spark, d):
    """The first five parts for a text of several words."""
    return search.search(v.parts(spark, d), " Brand#1  anvil").select("id_phone", "brand", "model")


@query(f"WITH {_PARTS} SELECT id_phone, brand, model FROM parts WHERE contains(lower(brand), 'd#1') OR contains(lower(model), 'd#1')")
def f4_phrase(spark, d):
    """Parts with a phrase in brand or model."""
    return browse.phrase_filter(v.parts(spark, d), "D#1").select("id_phone", "brand", "model")


@query(f"WITH {_PARTS} SELECT id_phone, brand, model FROM parts WHERE {_fits(chr(39) + 'anvil brand#2' + chr(39))} ORDER BY id_phone LIMIT 6 OFFSET 4")
def f5_filter_slice(spark, d):
    """A slice of the matches of a trimmed text."""
    return search.filter_slice(v.parts(spark, d), "  anvil brand#2 ", 4).select("id_phone", "brand", "model")


@query("SELECT conv_id, turn FROM conversations WHERE trim(text) <> ''")
def f6_nonblank(spark, d):
    """Messages that are not blank."""
    return browse.nonblank(v.read(spark, d, "conversations")).select("conv_id", "turn")


@query(
    "WITH ids AS (SELECT DISTINCT o_custkey * 2 AS id_phone FROM orders) SELECT id_phone, c_mktsegment AS os, "
    "CASE WHEN c_custkey IS NULL THEN 404 ELSE 200 END AS status FROM ids LEFT JOIN customer ON c_custkey = id_phone"
)
def f7_lookup(spark, d):
    """Found or not, for many ids."""
    ids = v.read(spark, d, "orders").select((F.col("o_custkey") * 2).alias("id_phone")).distinct()
    return browse.lookup(ids, v.phone(spark, d).select("id_phone", "os"), "id_phone")


@query(
    f"WITH {_PARTS}, r AS (SELECT DISTINCT brand FROM parts UNION SELECT DISTINCT os FROM parts), n AS (SELECT brand, count(*) AS n FROM parts GROUP BY 1) "
    "SELECT r.brand, coalesce(n.n, 0) AS n, CASE WHEN n.n IS NULL THEN 404 ELSE 200 END AS status FROM r LEFT JOIN n USING (brand)"
)
def f8_brand_status(spark, d):
    """Brands asked for, of which some do not exist."""
    cat = v.parts(spark, d)
    return browse.brand_status(cat.select("brand").union(cat.select("os")).distinct(), cat)


@query(f"WITH {_CAT} SELECT id_phone, brand FROM cat WHERE model = 'NATION_7'")
def f9_by_model(spark, d):
    """Phones of a model."""
    return browse.by_model(_cat(spark, d), "NATION_7").select("id_phone", "brand")


@query(f"WITH {_PARTS} SELECT id_phone FROM parts WHERE model = 'red widget' AND brand = 'Brand#17'")
def f9_by_brand_and_model(spark, d):
    """Parts of a brand and model."""
    return browse.by_brand_and_model(v.parts(spark, d), "Brand#17", "red widget").select("id_phone")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id_model, n_name AS model_name FROM nation WHERE n_name = 'NATION_3'")
def f10_model_by_name(spark, d):
    """A model by name."""
    return browse.model_by_name(v.model(spark, d), "NATION_3").select("id_model", "model_name")


@query(f"WITH {_CAT} SELECT id_phone, model, brand FROM cat")
def j1_catalogue(spark, d):
    """The flat catalogue."""
    return _cat(spark, d).select("id_phone", "model", "brand")


@query(
    f"WITH {_PARTS}, {_COLORS}, n AS (SELECT id_phone, list(s_name ORDER BY s_suppkey) AS colors FROM pc JOIN supplier ON s_suppkey = id_color GROUP BY 1) "
    "SELECT id_phone, CAST(to_json(coalesce(colors, [])) AS VARCHAR) AS colors FROM parts LEFT JOIN n USING (id_phone)"
)
def j2_with_colors(spark, d):
    """Parts with their colours."""
    full = catalogue.with_colors(v.parts(spark, d), v.phone_colors(spark, d), v.color(spark, d))
    return full.select("id_phone", F.to_json("colors").alias("colors"))


@query(
    f"WITH {_PARTS}, {_BOXES}, n AS (SELECT id_phone, list(n_name ORDER BY n_nationkey) AS box_contents FROM pb JOIN nation ON n_nationkey = id_content GROUP BY 1) "
    "SELECT id_phone, CAST(to_json(coalesce(box_contents, [])) AS VARCHAR) AS box_contents FROM parts LEFT JOIN n USING (id_phone)"
)
def j3_with_box_contents(spark, d):
    """Parts with their box contents."""
    full = catalogue.with_box_contents(v.parts(spark, d), v.phone_box_contents(spark, d), v.box_content(spark, d))
    return full.select("id_phone", F.to_json("box_contents").alias("box_contents"))


@query(f"WITH {_SUBS} SELECT seq, reason FROM judged")
def j4_resolve_refs(spark, d):
    """Every submission with the reason to reject it."""
    return ingest.resolve_refs(v.submissions(spark, d), v.color(spark, d), v.box_content(spark, d), v.model(spark, d)).select("seq", "reason")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    o = v.read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").alias("id1"), (F.col("o_custkey") * 3 + 1).alias("id2"))


@query(
    f"WITH {_PARTS} SELECT o_orderkey AS pair_id, a.model AS model1, b.model AS model2 FROM orders JOIN parts a ON a.id_phone = o_custkey JOIN parts b ON b.id_phone = o_custkey * 3 + 1"
)
def j5_versus_pairs(spark, d):
    """Pairs of parts that both exist."""
    return specs.versus_pairs(_pairs(spark, d), v.parts(spark, d)).select("pair_id", F.col("a.model").alias("model1"), F.col("b.model").alias("model2"))


@query(
    f"WITH {_LABELS}, s AS ({_SHEET}), f AS (SELECT id_phone, attr_no, attr, CASE WHEN l IS NULL AND attr IN ('colors', 'box_contents') THEN [] ELSE l END AS l FROM s) "
    f"SELECT o_orderkey AS pair_id, x.attr_no, x.attr, {_json('x.l')} AS \"left\", {_json('y.l')} AS \"right\" FROM orders "
    "JOIN f x ON x.id_phone = o_custkey JOIN f y ON y.id_phone = o_custkey * 3 + 1 AND y.attr_no = x.attr_no"
)
def j6_versus_table(spark, d):
    """All thirteen attributes side by side, lists as JSON."""
    rows = specs.versus_table(_pairs(spark, d), _full(spark, d))
    return rows.select("pair_id", "attr_no", "attr", F.to_json("left").alias("left"), F.to_json("right").alias("right"))


@query(
    f"WITH {_PARTS}, {_QUERIES}, t AS (SELECT DISTINCT text FROM q), n AS (SELECT DISTINCT brand, model FROM parts), m AS (SELECT text, brand, model FROM t JOIN n ON {_fits('text')}), "
    "h AS (SELECT text, id_phone, brand, model, row_number() OVER (PARTITION BY text ORDER BY id_phone) AS rn FROM m JOIN parts USING (brand, model)) "
    "SELECT query_id, CAST(rn AS INTEGER) AS rn, id_phone, brand, model FROM q JOIN h USING (text) WHERE rn <= 5"
)
def j7_search_many(spark, d):
    """The first five parts for each of many texts."""
    return search.search_many(v.queries(spark, d), v.parts(spark, d))


@query(ORACLE["j7_search_many"])
def j7_search_index(spark, d):
    """The first five parts for each of many texts, from a stored index whose levels are visited only as far as needed."""
    return SearchIndex.build(v.parts(spark, d), new_path(spark, "search-index"), block=32).search(v.queries(spark, d))


@query(ORACLE["j7_search_many"])
def j7_search_updated(spark, d):
    """The same from an index of an older catalogue that has taken in the names that changed since."""
    now = v.parts(spark, d)
    old = now.filter(F.col("id_phone") % 3 != 0).withColumn("model", F.when(F.col("id_phone") % 5 == 0, F.reverse("model")).otherwise(F.col("model")))
    index = SearchIndex.build(old, new_path(spark, "search-index"), block=32)
    was = old.filter("id_phone % 5 = 0").select("brand", "model")
    index.update(now, now.filter("id_phone % 3 = 0 OR id_phone % 5 = 0").select("brand", "model").union(was), 32)
    return index.search(v.queries(spark, d))


@query(f"WITH {_NEW_BRANDS} SELECT seq, brand_name FROM nb WHERE brand_name IN (SELECT r_name FROM region)")
def j8_existing_brands(spark, d):
    """New brands that exist."""
    return ingest.existing_brands(v.new_brands(spark, d), v.brand(spark, d))


@query(f"WITH {_NEW_MODELS} SELECT seq, model FROM nm WHERE lower(model) IN (SELECT lower(n_name) FROM nation)")
def j9_existing_models(spark, d):
    """New models that exist in any case."""
    return ingest.existing_models(v.new_models(spark, d), v.model(spark, d)).select("seq", "model")


@query("SELECT o_orderkey AS seq FROM orders WHERE o_custkey % 30 NOT IN (SELECT n_nationkey FROM nation)")
def j10_orphans(spark, d):
    """Submissions without a model."""
    return catalogue.orphans(v.submissions(spark, d), v.model(spark, d), "id_model").select("seq")


@query(f"WITH {_CAT} SELECT brand, CAST(ceil(count(*) / 6) AS BIGINT) AS pages FROM cat GROUP BY brand")
def a1_page_count(spark, d):
    """Pages of each brand."""
    return browse.page_count(_cat(spark, d))


@query(
    "WITH n AS (SELECT o_custkey AS id_phone, list(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderkey % 3 = 0) AS memory, "
    "list(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderkey % 3 <> 0) AS battery FROM orders GROUP BY 1) "
    f"SELECT id_phone, {_json('memory')} AS memory, {_json('battery')} AS battery FROM n"
)
def a2_nest(spark, d):
    """Child rows as lists: two attributes in one grouping, each in its own order."""
    rows = v.customer_children(spark, d)["phone_list"].withColumn("attr", F.when(F.col("pos") % 3 == 0, "memory").otherwise("battery"))
    full = lambda c: F.when(F.size(c) > 0, F.to_json(c)).alias(c)
    return catalogue.nest_all(rows).select("id_phone", full("memory"), full("battery"))


_MODELS = (
    "m AS (SELECT n_regionkey, CAST(n_nationkey AS BIGINT) AS id_model, n_name AS model_name, coalesce(list(c_custkey ORDER BY c_custkey) FILTER (c_custkey IS NOT NULL), []) AS phones "
    "FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)"
)


@query(
    f"WITH {_MODELS} SELECT CAST(r_regionkey AS BIGINT) AS id_brand, r_name AS brand_name, "
    "CAST(to_json(list({'id_model': id_model, 'model_name': model_name, 'phones': phones} ORDER BY id_model)) AS VARCHAR) AS models FROM region LEFT JOIN m ON n_regionkey = r_regionkey GROUP BY ALL"
)
def a3_brand_documents(spark, d):
    """Brands with models with phones, as JSON."""
    docs = catalogue.brand_documents(v.brand(spark, d), v.model(spark, d), v.phone(spark, d))
    return docs.select("id_brand", "brand_name", F.to_json("models").alias("models"))


@query(f"WITH {_MODELS} SELECT id_model, model_name, CAST(to_json(phones) AS VARCHAR) AS phones FROM m")
def a4_model_documents(spark, d):
    """Models with phones, as JSON."""
    docs = catalogue.model_documents(v.model(spark, d), v.phone(spark, d))
    return docs.select("id_model", "model_name", F.to_json("phones").alias("phones"))


@query(
    "WITH n AS (SELECT c_nationkey, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 10 AS part FROM customer), "
    "p AS (SELECT c_nationkey, part, list(c_custkey ORDER BY c_custkey) AS phones FROM n GROUP BY ALL) "
    "SELECT CAST(r_regionkey AS BIGINT) AS id_brand, r_name AS brand_name, CAST(n_nationkey AS BIGINT) AS id_model, coalesce(part, 0) AS part, CAST(to_json(coalesce(phones, [])) AS VARCHAR) AS phones "
    "FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN p ON c_nationkey = n_nationkey"
)
def a3_brand_parts(spark, d):
    """Brands with models with phones, ten to a row."""
    rows = catalogue.brand_parts(v.brand(spark, d), v.model(spark, d), v.phone(spark, d), 10)
    return rows.select("id_brand", "brand_name", "id_model", "part", F.to_json("phones").alias("phones"))


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def a5_duplicate_names(spark, d):
    """Names that several parts bear."""
    return catalogue.duplicate_names(v.parts(spark, d).select(F.col("model").alias("name")), "name")


@query(f"WITH {_CAT}, n AS (SELECT id_phone, brand, row_number() OVER (PARTITION BY brand ORDER BY id_phone) AS rn FROM cat) SELECT id_phone, brand, rn, (rn - 1) // 6 + 1 AS page FROM n")
def w1_paginate(spark, d):
    """The page of every phone within its brand."""
    return browse.paginate(_cat(spark, d).select("id_phone", "brand"))


@query(f"WITH {_CAT}, n AS (SELECT id_phone, row_number() OVER (ORDER BY id_phone) AS rn FROM cat) SELECT id_phone, rn, (rn - 1) // 6 + 1 AS page FROM n")
def w1_paginate_all(spark, d):
    """The page of every phone in the whole list."""
    return browse.paginate(_cat(spark, d).select("id_phone"), by=None)


@query(f"WITH {_CAT}, n AS (SELECT id_phone, model, row_number() OVER (PARTITION BY model ORDER BY id_phone) AS rn FROM cat) SELECT id_phone, model, CAST(rn AS INTEGER) AS rn FROM n WHERE rn <= 5")
def w2_top_k(spark, d):
    """The first five phones of each model."""
    return search.top_k(_cat(spark, d).select("id_phone", "model"), by="model")


@query("SELECT o_orderkey AS seq, o_custkey AS id_phone, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS first FROM orders")
def w3_first_wins(spark, d):
    """The first submission of each phone."""
    return ingest.first_wins(v.submissions(spark, d).select("seq", "id_phone"), F.col("id_phone"))


@query(f"WITH {_CAT} SELECT id_phone, brand, model FROM cat ORDER BY id_phone LIMIT 6 OFFSET 12")
def l1_page(spark, d):
    """The third page."""
    return browse.page(_cat(spark, d).select("id_phone", "brand", "model"), 3)


@query(
    f"WITH {_CAT}, n AS (SELECT id_phone, brand, model, row_number() OVER (PARTITION BY brand ORDER BY id_phone) AS rn, count(*) OVER (PARTITION BY brand) AS n FROM cat) "
    "SELECT id_phone, brand, model FROM n WHERE brand = 'ASIA' AND (rn - 1) // 6 = (n - 1) // 6"
)
def l1_deep_page(spark, d):
    """The last page of a brand, read by place."""
    cat = _cat(spark, d).select("id_phone", "brand", "model")
    pages = PagedTable.create(cat, new_path(spark, "pages"), ["id_phone"], "brand")
    return pages.page(pages.pages("ASIA"), "ASIA")


@query(
    f"WITH {_CAT}, n AS (SELECT id_phone, row_number() OVER (ORDER BY id_phone) AS rn FROM cat), r AS (SELECT event_id AS request_id, user_id % 400 + 1 AS page FROM events) "
    "SELECT request_id, page, (rn - 1) % 6 + 1 AS rn, id_phone FROM r JOIN n ON (rn - 1) // 6 + 1 = page"
)
def l1_pages(spark, d):
    """A page of the whole list for every event."""
    pages = PagedTable.create(_cat(spark, d).select("id_phone"), new_path(spark, "pages"), ["id_phone"])
    return pages.many(v.read(spark, d, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 400 + 1).alias("page")))


@query(
    f"WITH {_NEW_BRANDS} SELECT CAST(r_regionkey AS BIGINT) AS id_brand, r_name AS brand_name FROM region UNION ALL "
    "SELECT (SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY seq), brand_name FROM jb WHERE reason IS NULL"
)
def d1_add_brands(spark, d):
    """Brands after taking in new ones."""
    return ingest.add_brands(v.brand(spark, d), v.new_brands(spark, d))[0]


@query(f"WITH {_NEW_BRANDS} SELECT seq, brand_name, reason FROM jb WHERE reason IS NOT NULL")
def d1_rejected_brands(spark, d):
    """New brands that are rejected."""
    return ingest.add_brands(v.brand(spark, d), v.new_brands(spark, d))[1]


@query(
    f"WITH {_NEW_MODELS} SELECT CAST(n_nationkey AS BIGINT) AS id_model, n_name AS model_name, CAST(n_regionkey AS BIGINT) AS id_brand FROM nation UNION ALL "
    "SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY seq), model, brand FROM jm WHERE reason IS NULL"
)
def d2_add_models(spark, d):
    """Models after taking in new ones."""
    return ingest.add_models(v.model(spark, d), v.brand(spark, d), v.new_models(spark, d))[0]


@query(f"WITH {_NEW_MODELS} SELECT seq, model, brand, reason FROM jm WHERE reason IS NOT NULL")
def d2_rejected_models(spark, d):
    """New models that are rejected."""
    return ingest.add_models(v.model(spark, d), v.brand(spark, d), v.new_models(spark, d))[1]


@query(
    f"WITH {_SUBS}, l AS (SELECT *, row_number() OVER (PARTITION BY id_phone ORDER BY seq DESC) AS k FROM judged WHERE reason IS NULL), "
    "n AS (SELECT id_phone, CAST(NULL AS VARCHAR) AS oficial_web, os, processor, id_model, CAST(to_json(colors) AS VARCHAR) AS colors, CAST(to_json(boxes) AS VARCHAR) AS box_contents FROM l WHERE k = 1) "
    "SELECT * FROM n UNION ALL SELECT c_custkey, 'web', c_mktsegment, c_name, c_nationkey, '[7]', '[]' FROM customer WHERE c_custkey NOT IN (SELECT id_phone FROM n)"
)
def d3_save_phones(spark, d):
    """Phones after saving all valid submissions, with their lists of ids as JSON."""
    lists = [F.array(F.lit(7).cast("bigint")).alias("colors"), F.array().cast("array<bigint>").alias("box_contents")]
    phone = v.phone(spark, d).select("id_phone", F.lit("web").alias("oficial_web"), "os", "processor", "id_model", *lists)
    judged = ingest.resolve_refs(v.submissions(spark, d), v.color(spark, d), v.box_content(spark, d), v.model(spark, d))
    saved = ingest.save_phones(phone, judged.filter("reason IS NULL").drop("reason"))
    return saved.withColumns({c: F.to_json(c) for c in ("colors", "box_contents")})


_TAKEN = (
    f"{_SUBS}, f AS (SELECT seq, CASE WHEN seq % 50 <> 0 THEN id_phone END AS id_phone, os, processor, id_model, colors, boxes FROM judged WHERE reason IS NULL), "
    "g AS (SELECT * FROM f WHERE id_phone IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id_phone ORDER BY seq DESC) = 1), "
    "top AS (SELECT max(id) AS m FROM (SELECT p_partkey AS id FROM part UNION ALL SELECT id_phone FROM g)), "
    "taken AS (SELECT * FROM g UNION ALL SELECT seq, m + row_number() OVER (ORDER BY seq), os, processor, id_model, colors, boxes FROM f, top WHERE id_phone IS NULL), "
)
#: The lists of a submission in SQL.
_TAKEN_LISTS = (
    ("images", "['https://img.example/' || seq || '.png']"), ("colors", "colors"), ("box_contents", "boxes"), ("main_camera", "[os, processor]"), ("screen", "string_split(os, '-')"),
    ("memory", "[(seq % 8) || ' GB']"), ("battery", "CASE WHEN seq % 4 <> 0 THEN [os, NULL] END"),
    ("connectivity", "CASE WHEN seq % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE [processor] END"), ("security", "[os]"),
)


def _phone_rows(t: dict[str, DataFrame]) -> DataFrame:
    """Stored phones and all rows of their child tables: id_phone, kind, pos, value."""
    text = F.concat_ws("|", "secondary_camera", "oficial_web", "processor", "gpu", F.col("id_model").cast("string"))
    out = t["phone_list"].select("id_phone", F.col("attr").alias("kind"), "pos", "value").union(t["phone"].select("id_phone", F.lit("phone"), F.lit(None).cast("int"), text))
    for kind, name, key in (("colors", "phone_colors", "id_color"), ("box_contents", "phone_box_contents", "id_content")):
        out = out.union(t[name].select("id_phone", F.lit(kind), "pos", F.col(key).cast("string")))
    return out


def _stored_parts(spark: SparkSession, d: str, buckets: int = 16) -> dict[str, BucketedTable]:
    """Parts as phones in stored tables by buckets."""
    path = new_path(spark, "phones")
    parts = written(v.listed_parts(spark, d), "listed-parts")
    return {name: BucketedTable.create(df, f"{path}/{name}", "id_phone", buckets) for name, df in tables.normalise_phone(parts).items()}


_PART_ROWS = (
    "SELECT p_partkey AS id_phone, 'phone' AS kind, CAST(NULL AS INTEGER) AS pos, concat_ws('|', p_name, 'https://shop.example', p_brand, CASE WHEN p_partkey % 3 <> 0 THEN p_type END, CAST(p_partkey % 25 AS VARCHAR)) AS value FROM part"
)
_PART_LISTS = (
    "c AS (SELECT id_phone, list(id_color ORDER BY id_color) AS i FROM pc GROUP BY 1), b AS (SELECT id_phone, list(id_content ORDER BY id_content) AS i FROM pb GROUP BY 1)"
)


@query(
    f"WITH {_TAKEN} {_BOXES}, {_PART_LISTS}, old AS ({_CHILDREN} UNION ALL {_PART_ROWS}) SELECT * FROM old WHERE id_phone NOT IN (SELECT id_phone FROM taken) UNION ALL "
    + " UNION ALL ".join(f"SELECT id_phone, '{name}', CAST(unnest(range(len({sql}))) AS INTEGER), CAST(unnest({sql}) AS VARCHAR) FROM taken" for name, sql in _TAKEN_LISTS)
    + " UNION ALL SELECT id_phone, 'phone', NULL, concat_ws('|', 'seen ' || seq, processor, CASE WHEN seq % 3 <> 0 THEN os END, CAST(id_model AS VARCHAR)) FROM taken"
)
def d3_merge_phones(spark, d):
    """Stored phones with all nine lists after a merge of all valid submissions, some of them new phones."""
    store = _stored_parts(spark, d)
    judged = ingest.resolve_refs(v.full_submissions(spark, d), v.color(spark, d), v.box_content(spark, d), v.model(spark, d))
    ingest.merge_phones(store, judged.filter("reason IS NULL").drop("reason"), "orders")
    return _phone_rows({name: t.rows() for name, t in store.items()})


@query(f"WITH {_BOXES}, {_PART_LISTS}, old AS ({_CHILDREN} UNION ALL {_PART_ROWS}) SELECT * FROM old WHERE id_phone NOT IN (SELECT o_custkey * 2 FROM orders)")
def d5_remove_phones(spark, d):
    """Stored phones with all nine lists after those of many ids are removed."""
    store = _stored_parts(spark, d)
    ingest.remove_phones(store, v.read(spark, d, "orders").select((F.col("o_custkey") * 2).alias("id_phone")))
    return _phone_rows({name: t.rows() for name, t in store.items()})


_UPDATES = "u AS (SELECT s_suppkey AS id_model, s_name AS model_name, s_suppkey % 5 AS id_brand FROM supplier)"


def _model_updates(spark: SparkSession, d: str) -> DataFrame:
    s = v.read(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id_model"), F.col("s_name").alias("model_name"), (F.col("s_suppkey") % 5).alias("id_brand"))


@query(
    f"WITH {_UPDATES} SELECT CAST(n_nationkey AS BIGINT) AS id_model, coalesce(model_name, n_name) AS model_name, coalesce(id_brand, n_regionkey) AS id_brand FROM nation LEFT JOIN u ON id_model = n_nationkey"
)
def d4_update_models(spark, d):
    """Models after updates of which most are unknown."""
    return ingest.update_models(v.model(spark, d), _model_updates(spark, d))[0]


@query(f"WITH {_UPDATES} SELECT id_model, 'Model not found' AS reason FROM u WHERE id_model NOT IN (SELECT n_nationkey FROM nation)")
def d4_rejected_updates(spark, d):
    """Updates of unknown models."""
    return ingest.update_models(v.model(spark, d), _model_updates(spark, d))[1].select("id_model", "reason")


@query(ORACLE["d4_update_models"])
def d4_merge_models(spark, d):
    """Stored models after a merge of updates."""
    model = BucketedTable.create(v.model(spark, d), new_path(spark, "models"), "id_model", 8)
    ingest.merge_models(model, _model_updates(spark, d))
    return model.rows()


@query(
    f"WITH {_CAT} SELECT 'brand' AS kind, CAST(r_regionkey AS BIGINT) AS id FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE') "
    "UNION ALL SELECT 'model', n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA', 'EUROPE') "
    "UNION ALL SELECT 'phone', id_phone FROM cat WHERE brand NOT IN ('ASIA', 'EUROPE') "
    "UNION ALL SELECT 'phone_list', o_orderkey FROM orders LEFT JOIN cat ON id_phone = o_custkey WHERE coalesce(brand, '') NOT IN ('ASIA', 'EUROPE') "
    "UNION ALL SELECT 'phone_colors', o_orderkey FROM orders LEFT JOIN cat ON id_phone = o_custkey WHERE coalesce(brand, '') NOT IN ('ASIA', 'EUROPE')"
)
def d5_delete_brands(spark, d):
    """What is left of five tables when two brands go, and an unknown one."""
    all_ = {"brand": v.brand(spark, d), "model": v.model(spark, d), "phone": v.phone(spark, d)} | v.customer_children(spark, d)
    ids = all_["brand"].filter(F.col("brand_name").isin("ASIA", "EUROPE")).select("id_brand").union(spark.sql("SELECT 77L"))
    return _kinds(ingest.delete_brands(all_, ids))


def _kinds(left: dict[str, DataFrame]) -> DataFrame:
    """What is left of some tables: the table's name, and the id or place of each row."""
    parts = [t.select(F.lit(n).alias("kind"), F.col(f"id_{n}" if f"id_{n}" in t.columns else "pos").cast("bigint").alias("id")) for n, t in left.items()]
    return reduce(DataFrame.union, parts)


def _left_sql(phone: str, model: str = "true") -> str:
    """The same in SQL, of phones (customers) and models (nations) that a condition keeps."""
    child = f"FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_custkey IS NULL OR ({phone})"
    return (
        f"SELECT 'model' AS kind, CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE {model} UNION ALL SELECT 'phone', c_custkey FROM customer WHERE {phone} "
        f"UNION ALL SELECT 'phone_list', o_orderkey {child} UNION ALL SELECT 'phone_colors', o_orderkey {child}"
    )


@query(_left_sql("c_custkey NOT IN (SELECT o_custkey * 2 FROM orders)").replace("c_custkey IS NULL OR (c_custkey NOT IN (SELECT o_custkey * 2 FROM orders))", "orders.o_custkey NOT IN (SELECT o_custkey * 2 FROM orders)"))
def d5_delete_phones(spark, d):
    """What is left of the phones and their child tables when the phones of many ids go."""
    ids = v.read(spark, d, "orders").select((F.col("o_custkey") * 2).alias("id_phone")).distinct()
    return _kinds(ingest.delete_phones({"model": v.model(spark, d), "phone": v.phone(spark, d)} | v.customer_children(spark, d), ids))


@query(_left_sql("c_nationkey % 2 = 1", "n_nationkey % 2 = 1"))
def d5_delete_models(spark, d):
    """What is left of the models, phones and their child tables when every other model goes."""
    all_ = {"model": v.model(spark, d), "phone": v.phone(spark, d)} | v.customer_children(spark, d)
    return _kinds(ingest.delete_models(all_, all_["model"].filter("id_model % 2 = 0")))


@query(
    "WITH u AS (SELECT o_custkey AS id_phone, min(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END) AS os, min(CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END) AS processor FROM orders GROUP BY 1) "
    "SELECT c_custkey AS id_phone, coalesce(u.os, c_mktsegment) AS os, coalesce(u.processor, c_name) AS processor FROM customer LEFT JOIN u ON u.id_phone = c_custkey"
)
def d6_patch(spark, d):
    """Phones after patches with some null fields."""
    o = v.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id_phone")).agg(
        F.min(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))).alias("os"), F.min(F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus"))).alias("processor")
    )
    return ingest.patch(v.phone(spark, d).select("id_phone", "os", "processor"), o, "id_phone")


@query("SELECT s_suppkey AS id_brand, s_name AS brand_name FROM supplier UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey NOT IN (SELECT s_suppkey FROM supplier)")
def d7_save_brands(spark, d):
    """Brands after a save by id."""
    s = v.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id_brand"), F.col("s_name").alias("brand_name"))
    return ingest.save_brands(v.brand(spark, d), s)


@query(ORACLE["d7_save_brands"])
def d7_merge_brands(spark, d):
    """Stored brands after a merge by id."""
    brand = BucketedTable.create(v.brand(spark, d), new_path(spark, "brands"), "id_brand", 8)
    s = v.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id_brand"), F.col("s_name").alias("brand_name"))
    ingest.merge_brands(brand, s)
    return brand.rows()


@query(
    "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS last FROM s) SELECT user_id, event_id, event_type AS text FROM r WHERE last = 1"
)
def t1_debounce(spark, d):
    """The last event of each user before a pause of six hours."""
    return search_events.debounce_batch(v.events(spark, d), "6 hours").select("user_id", "event_id", "text")


@query(
    "WITH b AS (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "
    "SELECT event_id, user_id, event_type AS text FROM b WHERE n = 1 OR event_type IS DISTINCT FROM before"
)
def t2_distinct_until_changed(spark, d):
    """Events that differ from the user's event before."""
    return search_events.distinct_until_changed(v.events(spark, d)).select("event_id", "user_id", "text")


@query(
    "WITH n AS (SELECT *, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) "
    "SELECT event_id, user_id FROM n WHERE next IS NULL OR t + CAST(round(value * 100 * 1000000) AS BIGINT) < next"
)
def t3_switch_latest(spark, d):
    """Requests answered before the next one, were answers a hundred times slower."""
    slow = v.events(spark, d).withColumn("latency_s", F.col("latency_s") * 100)
    return search_events.switch_latest(slow).select("event_id", "user_id")


def _search_texts(spark: SparkSession, d: str, parts: DataFrame) -> DataFrame:
    """Events (event_id, text) that ask for the names of all parts, and texts that no part has."""
    texts = parts.select(F.col("id_phone").alias("k"), F.col("model").alias("name"))
    numbered = v.events(spark, d).select("event_id", "text", (F.col("event_id") % (2 * parts.count())).alias("k"))
    return numbered.join(texts, "k", "left").select("event_id", F.coalesce("name", "text").alias("text"))


@query(
    f"WITH {_PARTS}, e AS (SELECT event_id, coalesce(p_name, event_type) AS text FROM events LEFT JOIN part ON p_partkey = event_id % (SELECT 2 * count(*) FROM part)), t AS (SELECT DISTINCT text FROM e), "
    f"h AS (SELECT text, id_phone, brand, model, row_number() OVER (PARTITION BY text ORDER BY id_phone) AS rn FROM t JOIN parts ON {_fits('text')}) "
    "SELECT event_id, CAST(rn AS INTEGER) AS rn, id_phone, upper(brand) AS brand, model FROM e LEFT JOIN h ON e.text = h.text AND rn <= 5 WHERE trim(e.text) <> ''"
)
def t4_search_events(spark, d):
    """The first hits of every search event: names of all parts, and texts that no part has."""
    parts = v.parts(spark, d)
    asked = _search_texts(spark, d, parts)
    return search_events.search_events(asked, parts).select(F.col("query_id").alias("event_id"), "rn", "id_phone", "brand", "model")


#: How long streams of events wait for late ones.
_WAIT = "10 minutes"


def _fed(spark: SparkSession, rows: DataFrame, by: str, run, last: DataFrame | None = None, parts: int = 3) -> None:
    """Have a stream run over rows that come in parts in order of a column: after each part it is started anew, takes what is there and ends."""
    path = new_path(spark, "stream-files")
    cuts = rows.select(F.percentile_approx(by, [k / parts for k in range(1, parts)])).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    some = [rows if low is None else rows.filter(F.col(by) >= F.lit(low)) for low in bounds[:-1]]
    some = [df if high is None else df.filter(F.col(by) < F.lit(high)) for df, high in zip(some, bounds[1:])]
    for part in [*some, *([] if last is None else [last])]:
        part.write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path))


def _streamed(spark: SparkSession, events: DataFrame, operator, name: str) -> DataFrame:
    """What a stream operator appends to its sink, of events that come in parts; the last part is an event long after all, which is left out."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    after = F.coalesce(F.max("ts"), F.lit("2000-01-01").cast("timestamp")) + F.expr("INTERVAL 400 DAYS")
    end = {"event_id": F.lit(-1), "user_id": F.lit(-1), "ts": after, "text": F.lit("end"), "latency_s": F.lit(0.0)}
    last = events.agg(*[end[f.name].cast(f.dataType).alias(f.name) for f in events.schema])
    path, schemas = new_path(spark, name), []

    def run(stream: DataFrame) -> None:
        out = operator(stream)
        schemas.append(out.schema)
        ordered_state.run_available(out, f"{path}/out", f"{path}/checkpoint")

    _fed(spark, events, "ts", run, last)
    return spark.read.schema(schemas[0]).parquet(f"{path}/out").filter(F.coalesce("user_id", F.lit(0)) >= 0)


@query(ORACLE["t1_debounce"])
def t1_debounce_stream(spark, d):
    """t1_debounce from a running stream: sessions that the watermark has closed."""
    return _streamed(spark, v.events(spark, d), lambda e: search_events.debounce(e, "6 hours", _WAIT), "debounced").select("user_id", "event_id", "text")


@query(ORACLE["t2_distinct_until_changed"])
def t2_changes_stream(spark, d):
    """t2_distinct_until_changed from a running stream with ordered state."""
    return _streamed(spark, v.events(spark, d), lambda e: ordered_state.changes(e, _WAIT), "changes").select("event_id", "user_id", "text")


@query(ORACLE["t3_switch_latest"])
def t3_latest_stream(spark, d):
    """t3_switch_latest from a running stream with ordered state and timers."""
    slow = v.events(spark, d).withColumn("latency_s", F.col("latency_s") * 100)
    return _streamed(spark, slow, lambda e: ordered_state.latest_answers(e, _WAIT), "latest").select("event_id", "user_id")


@query(ORACLE["t4_search_events"])
def t4_search_stream(spark, d):
    """t4_search_events from a running stream that searches in every micro-batch."""
    path, parts = new_path(spark, "searched"), v.parts(spark, d)
    asked = written(_search_texts(spark, d, parts).withColumn("ts", F.lit(None).cast("timestamp")), "search-texts")
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 4).parquet(asked.inputFiles()[0].rsplit("/", 1)[0])
    search_events.search_stream(stream, parts, f"{path}/out", f"{path}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.col("query_id").alias("event_id"), "rn", "id_phone", "brand", "model")


@query(ORACLE["d1_add_brands"])
def d1_brand_stream(spark, d):
    """d1_add_brands from a running stream of submissions."""
    intake = Intake(brands(), v.brand(spark, d), new_path(spark, "brand-intake"), 16)
    checkpoint = new_path(spark, "checkpoint")
    _fed(spark, v.new_brands(spark, d), "seq", lambda stream: intake.start(stream, checkpoint, True).awaitTermination())
    return intake.table()


@query(ORACLE["d2_rejected_models"])
def d2_model_stream(spark, d):
    """d2_rejected_models from a running stream of submissions."""
    intake = Intake(models(v.brand(spark, d)), v.model(spark, d), new_path(spark, "model-intake"), 16)
    checkpoint = new_path(spark, "checkpoint")
    _fed(spark, v.new_models(spark, d), "seq", lambda stream: intake.start(stream, checkpoint, True).awaitTermination())
    return intake.rejected().select("seq", "model", "brand", "reason")
