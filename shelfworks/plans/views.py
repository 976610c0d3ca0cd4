"""The given tables seen as a product catalogue.

Regions, nations and customers are brands, models and phones; parts are a flat catalogue whose colours are suppliers and
whose box contents are nations; orders are phone submissions; events are search events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEB = "https://img.example/"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand(spark: SparkSession, d: str) -> DataFrame:
    """Regions as brands."""
    return read(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id_brand"), F.col("r_name").alias("brand_name"))


def model(spark: SparkSession, d: str) -> DataFrame:
    """Nations as models."""
    return read(spark, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id_model"), F.col("n_name").alias("model_name"), F.col("n_regionkey").cast("bigint").alias("id_brand")
    )


def phone(spark: SparkSession, d: str) -> DataFrame:
    """Customers as phones."""
    return read(spark, d, "customer").select(
        F.col("c_custkey").alias("id_phone"), F.col("c_mktsegment").alias("os"), F.col("c_name").alias("processor"), F.col("c_nationkey").cast("bigint").alias("id_model")
    )


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a flat catalogue."""
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("id_phone"), F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), F.col("p_type").alias("os"),
        F.col("p_size").cast("string").alias("dimensions"),
    )


def color(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as colours."""
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id_color"), F.col("s_name").alias("name"))


def phone_colors(spark: SparkSession, d: str) -> DataFrame:
    """The bridge of parts and suppliers, in order of supplier."""
    pairs = read(spark, d, "lineitem").select(F.col("l_partkey").alias("id_phone"), F.col("l_suppkey").alias("id_color")).distinct()
    return pairs.withColumn("pos", F.col("id_color").cast("int"))


def box_content(spark: SparkSession, d: str) -> DataFrame:
    """Nations as box contents."""
    return read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id_content"), F.col("n_name").alias("name_content"))


def phone_box_contents(spark: SparkSession, d: str, colors: DataFrame | None = None) -> DataFrame:
    """The bridge of parts and their suppliers' nations; ``colors`` is phone_colors(), where that is at hand."""
    suppliers = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id_color"), F.col("s_nationkey").cast("bigint").alias("id_content"))
    pairs = (colors or phone_colors(spark, d)).join(suppliers, "id_color").select("id_phone", "id_content").distinct()
    return pairs.withColumn("pos", F.col("id_content").cast("int"))


def images(spark: SparkSession, d: str) -> DataFrame:
    """An image for each colour of a part, named after it."""
    named = phone_colors(spark, d).join(color(spark, d), "id_color")
    file = F.concat(F.lit(WEB), F.col("id_phone").cast("string"), F.lit("_"), F.replace("name", F.lit("#"), F.lit("_")), F.lit(".png"))
    return named.select("id_phone", "pos", file.alias("value"))


def submissions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as phone submissions: some models, colours and box contents are unknown, some lists are missing."""
    o = read(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("seq"),
        F.col("o_custkey").alias("id_phone"),
        F.col("o_orderpriority").alias("os"),
        F.col("o_orderstatus").alias("processor"),
        (F.col("o_custkey") % 30).alias("id_model"),
        F.when(key % 11 != 0, F.array(key % 97, key % 103)).alias("colors"),
        F.when(key % 13 != 0, F.array(key % 26)).alias("box_contents"),
    )


def new_brands(spark: SparkSession, d: str) -> DataFrame:
    """Brand submissions from customers: region names as they are and in small letters, segments, empty and null names."""
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey") % 7
    name = F.when(k == 0, F.col("r_name")).when(k == 1, F.lower("r_name")).when(k == 2, "").when(k == 3, None).otherwise(F.concat("c_mktsegment", k.cast("string")))
    return c.select(F.col("c_custkey").alias("seq"), name.alias("brand_name"))


def new_models(spark: SparkSession, d: str) -> DataFrame:
    """Model submissions from parts: names in mixed case, nation names, null names, some of unknown brands."""
    p = read(spark, d, "part")
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.lit("nation_"), (F.col("p_partkey") % 40).cast("string"))).when(k == 2, None).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("seq"), name.alias("model"), (F.col("p_partkey") % 6).alias("brand"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    """Search texts from parts: whole names, second words, names with a brand, and short words."""
    p = read(spark, d, "part")
    k = F.col("p_partkey") % 4
    text = (
        F.when(k == 0, F.upper("p_name")).when(k == 1, F.element_at(F.split("p_name", " "), -1))
        .when(k == 2, F.concat("p_name", F.lit(" "), F.lower("p_brand"))).otherwise(F.substring("p_name", 1, 2))
    )
    return p.select(F.col("p_partkey").alias("query_id"), text.alias("text"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events as search events."""
    return read(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("text"), F.col("value").alias("latency_s"))


def full_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts with all scalar and list attributes of a phone but colours and box contents; some are null, some lists empty or with a null."""
    p = read(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    none = F.array().cast("array<string>")
    return p.select(
        key.alias("id_phone"), F.col("p_brand").alias("brand"), F.col("p_name").alias("model"),
        F.array(F.concat(F.lit(WEB), key.cast("string"), F.lit(".png"))).alias("images"),
        F.array("p_type", "p_brand").alias("main_camera"), F.col("p_name").alias("secondary_camera"), F.split("p_type", " ").alias("screen"),
        F.lit("https://shop.example").alias("oficial_web"), F.lit("5G").alias("red"), F.col("p_brand").alias("processor"),
        F.when(key % 3 != 0, F.col("p_type")).alias("gpu"), F.array(F.concat(size, F.lit(" GB"))).alias("memory"), F.lit(None).cast("string").alias("expansion"),
        F.col("p_type").alias("os"), F.array(F.concat(size, F.lit(" mAh")), F.lit(None).cast("string")).alias("battery"),
        F.when(key % 4 == 0, none).otherwise(F.array("p_brand")).alias("connectivity"), size.alias("dimensions"),
        F.when(key % 5 != 0, F.array("p_name")).alias("security"), F.lit(None).cast("string").alias("video_youtube"), (key % 25).alias("id_model"),
    )


def customer_children(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """List rows and colours of customers seen as phones, from their orders."""
    o = read(spark, d, "orders")
    return {
        "phone_list": o.select(F.col("o_custkey").alias("id_phone"), F.lit("memory").alias("attr"), F.col("o_orderkey").cast("int").alias("pos"), F.col("o_orderpriority").alias("value")),
        "phone_colors": o.select(F.col("o_custkey").alias("id_phone"), (F.col("o_orderkey") % 97).alias("id_color"), F.col("o_orderkey").cast("int").alias("pos")),
    }


def full_submissions(spark: SparkSession, d: str) -> DataFrame:
    """submissions() with all scalar and list attributes; every fiftieth has no id."""
    s = submissions(spark, d)
    key = F.col("seq")
    text = lambda *c: F.concat(*[F.col(x).cast("string") if x in ("seq", "os") else F.lit(x) for x in c])
    none = F.array().cast("array<string>")
    return s.select(
        "seq", F.when(key % 50 != 0, F.col("id_phone")).alias("id_phone"), F.array(text(WEB, "seq", ".png")).alias("images"), F.array("os", "processor").alias("main_camera"),
        text("seen ", "seq").alias("secondary_camera"), F.split("os", "-").alias("screen"), F.lit("https://shop.example").alias("oficial_web"), F.lit("4G").alias("red"), "processor",
        F.when(key % 3 != 0, F.col("os")).alias("gpu"), F.array(F.concat((key % 8).cast("string"), F.lit(" GB"))).alias("memory"), F.lit(None).cast("string").alias("expansion"), "os",
        F.when(key % 4 != 0, F.array("os", F.lit(None).cast("string"))).alias("battery"), F.when(key % 5 == 0, none).otherwise(F.array("processor")).alias("connectivity"),
        F.lit("-").alias("dimensions"), F.array("os").alias("security"), F.lit(None).cast("string").alias("video_youtube"), "id_model", "colors", "box_contents",
    )


def listed_parts(spark: SparkSession, d: str) -> DataFrame:
    """full_parts() as phones with the ids of their colours and of what is in their box."""
    colors = phone_colors(spark, d)
    lists = [(colors, "id_color", "colors"), (phone_box_contents(spark, d, colors), "id_content", "box_contents")]
    parts = full_parts(spark, d).drop("brand", "model")
    for bridge, key, name in lists:
        parts = parts.join(bridge.groupBy("id_phone").agg(F.sort_array(F.collect_list(key)).alias(name)), "id_phone", "left")
    return parts
