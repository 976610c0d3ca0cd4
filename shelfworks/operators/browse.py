"""Filters, lookups and pages of the flat catalogue (columns id_phone, brand, model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfworks.functions.numbering import number_rows

PAGE, ALL = 6, "todos"
#: Requests for all phones that one row holds.
ALL_SLICE = 1_000


def brand_list(brand: DataFrame) -> DataFrame:
    """Id and name of the brands."""
    return brand.select("id_brand", "brand_name")


def by_brand(cat: DataFrame, name: str) -> DataFrame:
    """Phones of one brand, by its exact name."""
    return cat.filter(F.col("brand") == name)


def by_model(cat: DataFrame, name: str) -> DataFrame:
    """Phones of one model, by its exact name."""
    return cat.filter(F.col("model") == name)


def by_brand_and_model(cat: DataFrame, brand: str, model: str) -> DataFrame:
    """Phones of one brand and model."""
    return cat.filter((F.col("brand") == brand) & (F.col("model") == model))


def model_by_name(model: DataFrame, name: str) -> DataFrame:
    """Models of one exact name."""
    return model.filter(F.col("model_name") == name)


def browse(cat: DataFrame, brand: str) -> DataFrame:
    """Phones of a brand, or all phones for the word that stands for all."""
    return cat if brand == ALL else by_brand(cat, brand)


def browse_many(requests: DataFrame, cat: DataFrame) -> DataFrame:
    """browse() for a table of requests (request_id, brand): an equi-join for brands; the requests for all are opened on each phone.

    Requests for all come in slices of ALL_SLICE ids; each phone meets every slice by its number, so that no row and no
    task holds more of them, however many there are.
    """
    named = requests.filter(F.col("brand") != ALL).join(cat, "brand").select("request_id", "id_phone")
    every = requests.filter(F.col("brand") == ALL).select("request_id")
    slices = -(-every.count() // ALL_SLICE)
    if not slices:
        return named
    cut = number_rows(every, [F.col("request_id")], "_n").groupBy(F.floor((F.col("_n") - 1) / ALL_SLICE).alias("slice")).agg(F.collect_list("request_id").alias("ids"))
    met = cat.select("id_phone", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))).alias("slice")).join(cut, "slice")
    return named.union(met.select(F.explode("ids").alias("request_id"), "id_phone"))


def phrase_filter(cat: DataFrame, text: str) -> DataFrame:
    """Phones whose brand or model holds the whole text, in any case; an empty text keeps those with a name."""
    q = F.lower(F.lit(text))
    return cat.filter(F.contains(F.lower("brand"), q) | F.contains(F.lower("model"), q))


def nonblank(queries: DataFrame, text: str = "text") -> DataFrame:
    """Search requests that are not blank."""
    return queries.filter(F.trim(text) != "")


def page(df: DataFrame, p: int, size: int = PAGE) -> DataFrame:
    """Page ``p`` (from 1) in order of id; empty beyond the end."""
    return df.orderBy("id_phone").offset((p - 1) * size).limit(size)


def page_count(cat: DataFrame, by: str | None = "brand", size: int = PAGE) -> DataFrame:
    """Number of pages, for each value of ``by`` or of all rows."""
    return cat.groupBy(*([by] if by else [])).agg(F.ceil(F.count(F.lit(1)) / size).alias("pages"))


def paginate(cat: DataFrame, size: int = PAGE, by: str | None = "brand") -> DataFrame:
    """Rows with their number ``rn`` and ``page`` within ``by``, without a window over a whole brand or table in one task."""
    order = [F.col(c) for c in ([by] if by else []) + ["id_phone"]]
    return number_rows(cat, order, "rn", [by] if by else None).withColumn("page", F.floor((F.col("rn") - 1) / size) + 1)


def lookup(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Every asked id with the row's columns and status 200, or 404 where there is none."""
    found = rows.withColumn("_found", F.lit(True))
    return ids.join(found, key, "left").withColumn("status", F.when(F.col("_found"), 200).otherwise(404)).drop("_found")


def brand_status(requests: DataFrame, cat: DataFrame) -> DataFrame:
    """Every asked brand with its number of phones, and 404 where it has none."""
    n = cat.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    return requests.join(n, "brand", "left").select("brand", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), 404).otherwise(200).alias("status"))
