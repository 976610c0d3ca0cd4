"""The flat and the nested catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfworks.functions.numbering import number_rows
from shelfworks.operators.ingest import met_keys
from shelfworks.sources.schemas import LIST_ATTRIBUTES

#: Phones in one part of a model.
PART = 10_000


def catalogue(phone: DataFrame, model: DataFrame, brand: DataFrame) -> DataFrame:
    """Phones with the names of their model and brand. The planner broadcasts the small sides if their size allows."""
    named = model.join(brand, "id_brand").select("id_model", F.col("model_name").alias("model"), F.col("brand_name").alias("brand"))
    return phone.join(named, "id_model")


def nest(child: DataFrame, key: str, value: str = "value", pos: str = "pos", name: str = "items") -> DataFrame:
    """Child rows as one array for each key, in order of position."""
    pairs = F.array_sort(F.collect_list(F.struct(pos, value)))
    return child.groupBy(key).agg(F.transform(pairs, lambda x: x[value]).alias(name))


def nest_all(phone_list: DataFrame) -> DataFrame:
    """All seven list attributes in one grouping of the tagged child table."""
    def of(a: str):
        pairs = F.array_sort(F.collect_list(F.when(F.col("attr") == a, F.struct("pos", "value"))))
        return F.transform(pairs, lambda x: x["value"]).alias(a)

    return phone_list.groupBy("id_phone").agg(*[of(a) for a in LIST_ATTRIBUTES])


def with_labels(phone: DataFrame, bridge: DataFrame, label: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """Phones with the names that a bridge links them to, in order; an empty list where there are none."""
    names = nest(bridge.join(label, key), "id_phone", name, "pos", out)
    return phone.join(names, "id_phone", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def with_colors(phone: DataFrame, phone_colors: DataFrame, color: DataFrame) -> DataFrame:
    """Phones with their colour names."""
    return with_labels(phone, phone_colors, color, "id_color", "name", "colors")


def with_box_contents(phone: DataFrame, phone_box_contents: DataFrame, box_content: DataFrame) -> DataFrame:
    """Phones with the names of what is in their box."""
    return with_labels(phone, phone_box_contents, box_content, "id_content", "name_content", "box_contents")


def model_parts(model: DataFrame, phone: DataFrame, size: int = PART) -> DataFrame:
    """Models with the ids of their phones in parts of at most ``size``: ``part`` counts from 0; a model without phones has one empty part.

    No row and no task holds all phones of a model, however many it has.
    """
    numbered = number_rows(phone.select("id_model", "id_phone"), [F.col("id_model"), F.col("id_phone")], "_n", ["id_model"])
    part = F.floor((F.col("_n") - 1) / size).alias("part")
    phones = numbered.groupBy("id_model", part).agg(F.array_sort(F.collect_list("id_phone")).alias("phones"))
    return model.join(phones, "id_model", "left").withColumns(
        {"part": F.coalesce("part", F.lit(0)), "phones": F.coalesce("phones", F.array().cast("array<bigint>"))}
    )


def brand_parts(brand: DataFrame, model: DataFrame, phone: DataFrame, size: int = PART) -> DataFrame:
    """Brands with a row for each of their models and part of its phones; a brand without models has one row."""
    return brand.join(model_parts(model, phone, size), "id_brand", "left")


def model_documents(model: DataFrame, phone: DataFrame) -> DataFrame:
    """Models with the array of their phones' ids; empty where they have none. For models that fit into a row; model_parts() for any."""
    phones = phone.groupBy("id_model").agg(F.array_sort(F.collect_list("id_phone")).alias("phones"))
    return model.join(phones, "id_model", "left").withColumn("phones", F.coalesce("phones", F.array().cast("array<bigint>")))


def brand_documents(brand: DataFrame, model: DataFrame, phone: DataFrame) -> DataFrame:
    """Brands with their models, each with its phones. For brands that fit into a row; brand_parts() for any."""
    one = F.struct("id_model", "model_name", "phones")
    models = model_documents(model, phone).groupBy("id_brand").agg(F.array_sort(F.collect_list(one)).alias("models"))
    return brand.join(models, "id_brand", "left")


def duplicate_names(df: DataFrame, name: str) -> DataFrame:
    """Names that more than one row bears, and how many do."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent. Of the parents only those whose keys the children have meet them."""
    return child.join(met_keys(parent.select(key), F.col(key).cast(child.schema[key].dataType), child, F.col(key)).distinct(), key, "left_anti")
