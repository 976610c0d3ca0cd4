"""Taking in brands, models and phones: checks, references, replacing, patching and deleting. Tables in, new tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfworks.functions.numbering import kept_for, new_path, number_rows, written
from shelfworks.sources.bucketed import BucketedTable, save
from shelfworks.sources.tables import normalise_phone, split_judged

#: Numbers that a batch's keys are mapped to, as a power of two.
KEY_BITS = 20
BRAND_EXISTS, BRAND_EMPTY = "Brand already exists", "Brand name cannot be null or empty"
MODEL_EXISTS, BRAND_UNKNOWN = "Model already exists", "Brand not found"
COLOR_UNKNOWN, BOX_UNKNOWN, MODEL_UNKNOWN, INVALID = "Color not found", "Box content not found", "Model not found", "Invalid payload"
NOT_FOUND = "Model not found"


def met_keys(base: DataFrame, key: Column, batch: DataFrame, batch_key: Column) -> DataFrame:
    """The base's rows whose key may be in the batch: what is left of the base follows the batch, not the base.

    The batch's keys become at most 2**KEY_BITS numbers (8 MB), whatever its size, which the base is filtered with where it is
    scanned; other rows of the same numbers are left too, so an exact join follows. A null key is a key.
    """
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << KEY_BITS))
    wanted = batch.select(number(batch_key).alias("_h")).distinct()
    return base.join(F.broadcast(wanted), number(key) == F.col("_h"), "left_semi")


def existing_brands(new: DataFrame, brand: DataFrame) -> DataFrame:
    """New brands whose exact name (or null) is there already."""
    known = met_keys(brand.select(F.col("brand_name").alias("_b")), F.col("_b"), new, F.col("brand_name")).distinct()
    return new.join(known, new["brand_name"].eqNullSafe(F.col("_b")), "left_semi")


def existing_models(new: DataFrame, model: DataFrame) -> DataFrame:
    """New models whose name is there already under any brand, in any case; null equals nothing."""
    known = met_keys(model.select(F.lower("model_name").alias("_m")).dropna(), F.col("_m"), new, F.lower("model")).distinct()
    return new.join(known, F.lower(new["model"]) == F.col("_m"), "left_semi")


def first_wins(subs: DataFrame, key: Column, seq: str = "seq") -> DataFrame:
    """Submissions with ``first``: whether a row is the first of its key. Aggregated before the shuffle, so hot keys are cheap."""
    keyed = subs.withColumn("_k", key)
    least = keyed.groupBy("_k").agg(F.min(seq).alias("_least")).withColumnRenamed("_k", "_k2")
    joined = keyed.join(least, F.col("_k").eqNullSafe(F.col("_k2")))
    return joined.withColumn("first", F.col(seq) == F.col("_least")).drop("_k", "_k2", "_least")


def _with_new_ids(accepted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """New dense ids after the table's largest, in order of submission."""
    last = table.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    return number_rows(accepted, [F.col("seq")], "_n").withColumn(key, F.col("_n") + last).drop("_n")


def judge_brands(brand: DataFrame, new: DataFrame) -> DataFrame:
    """``seq, brand_name, reason``: exists (there, or earlier in the batch), then null or empty; null reason where accepted."""
    names = brand.select(F.col("brand_name").alias("_b"))
    known = met_keys(names, F.col("_b"), new, F.col("brand_name")).distinct().withColumn("_known", F.lit(True))
    judged = new.join(known, new["brand_name"].eqNullSafe(F.col("_b")), "left")
    blank = F.col("brand_name").isNull() | (F.col("brand_name") == "")
    turned = first_wins(judged, F.when(~blank, F.col("brand_name")))
    again = F.col("_known").isNotNull() | (~F.col("first") & ~blank)
    return turned.select("seq", "brand_name", F.when(again, BRAND_EXISTS).when(blank, BRAND_EMPTY).alias("reason"))


def add_brands(brand: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The brand table with the accepted ones, and the rejected ones with their reason."""
    accepted, rejected, _ = split_judged(judge_brands(brand, new), new_path(new.sparkSession, "judged-brands"))
    rows = _with_new_ids(accepted, brand, "id_brand").select("id_brand", "brand_name")
    return brand.unionByName(rows), rejected


def judge_models(model: DataFrame, brand: DataFrame, new: DataFrame) -> DataFrame:
    """``seq, model, brand, reason``: exists in any case under any brand, then unknown brand. Only valid rows count as earlier."""
    names = model.select(F.lower("model_name").alias("_m")).dropna()
    known = met_keys(names, F.col("_m"), new, F.lower("model")).distinct().withColumn("_known", F.lit(True))
    ids = met_keys(brand.select(F.col("id_brand").alias("_id")), F.col("_id").cast("bigint"), new, F.col("brand").cast("bigint")).withColumn("_there", F.lit(True))
    judged = new.join(known, F.lower(new["model"]) == F.col("_m"), "left").join(ids, new["brand"] == F.col("_id"), "left")
    valid = F.col("_there").isNotNull() & F.col("_known").isNull()
    firsts = judged.filter(valid & F.col("model").isNotNull()).groupBy(F.lower("model").alias("_k")).agg(F.min("seq").alias("_least"))
    turned = judged.join(firsts, F.lower("model") == F.col("_k"), "left")
    exists = F.col("_known").isNotNull() | (F.col("seq") > F.col("_least"))
    return turned.select("seq", "model", "brand", F.when(exists, MODEL_EXISTS).when(F.col("_there").isNull(), BRAND_UNKNOWN).alias("reason"))


def add_models(model: DataFrame, brand: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model table with the accepted ones, and the rejected ones with their reason."""
    accepted, rejected, _ = split_judged(judge_models(model, brand, new), new_path(new.sparkSession, "judged-models"))
    rows = _with_new_ids(accepted, model, "id_model").select("id_model", F.col("model").alias("model_name"), F.col("brand").alias("id_brand"))
    return model.unionByName(rows), rejected


def _unknown(subs: DataFrame, labels: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``seq`` and for each list of ids ``_<list>``: whether it has an id that its labels lack; all lists in one pass."""

    def marked(ids: str) -> Column:
        return F.transform(F.coalesce(ids, F.array().cast("array<bigint>")), lambda i: F.struct(F.lit(ids).alias("kind"), i.alias("id")))

    opened = subs.select("seq", F.inline(F.concat(*map(marked, labels))))
    known = reduce(DataFrame.union, [df.select(F.lit(ids).alias("kind"), F.col(key).alias("id")) for ids, (df, key) in labels.items()])
    missing = opened.join(known, ["kind", "id"], "left_anti")
    return missing.groupBy("seq").agg(*[F.max(F.col("kind") == ids).alias(f"_{ids}") for ids in labels])


def resolve_refs(subs: DataFrame, color: DataFrame, box_content: DataFrame, model: DataFrame) -> DataFrame:
    """Submissions with ``reason``: a missing list, then unknown colours, box contents, and model; null where all are known."""
    unknown = _unknown(subs, {"colors": (color, "id_color"), "box_contents": (box_content, "id_content")})
    known = model.select("id_model").withColumn("_model", F.lit(True))
    joined = subs.join(unknown, "seq", "left").join(known, "id_model", "left")
    reason = (
        F.when(F.col("colors").isNull(), INVALID)
        .when(F.col("_colors"), COLOR_UNKNOWN)
        .when(F.col("box_contents").isNull(), INVALID)
        .when(F.col("_box_contents"), BOX_UNKNOWN)
        .when(F.col("_model").isNull(), MODEL_UNKNOWN)
    )
    return joined.withColumn("reason", reason).drop("_colors", "_box_contents", "_model")


def replace_rows(base: DataFrame, upd: DataFrame, key: str) -> DataFrame:
    """The table with whole rows replaced or added by key."""
    return base.join(upd.select(key), key, "left_anti").unionByName(upd)


def save_phones(phone: DataFrame, subs: DataFrame, keep_web: bool = False) -> DataFrame:
    """Whole-row replace by id, or insert under a new id where it is null; of several rows for one id the last wins.

    The official web address of a submission is dropped, as the shop does, unless ``keep_web``.
    """
    rows = subs if keep_web else subs.withColumn("oficial_web", F.lit(None).cast("string"))
    given = rows.filter("id_phone IS NOT NULL")
    last = given.groupBy("id_phone").agg(F.max_by(F.struct(*phone.columns), "seq").alias("r")).select("r.*")
    fresh = _with_new_ids(rows.filter("id_phone IS NULL").drop("id_phone"), phone.select("id_phone").union(given.select("id_phone")), "id_phone")
    return replace_rows(phone, last.unionByName(fresh.select(*phone.columns)), "id_phone")


def submitted_phones(phone_ids: DataFrame, subs: DataFrame, keep_web: bool = False) -> DataFrame:
    """What submissions with all lists save: the last row of each id, and rows without one under new ids after all others."""
    rows = subs if keep_web else subs.withColumn("oficial_web", F.lit(None).cast("string"))
    columns = [c for c in rows.columns if c != "seq"]
    given = rows.filter("id_phone IS NOT NULL")
    last = given.groupBy("id_phone").agg(F.max_by(F.struct(*columns), "seq").alias("r")).select("r.*")
    ids = phone_ids.select("id_phone").union(given.select("id_phone"))
    return last.unionByName(_with_new_ids(rows.filter("id_phone IS NULL").drop("id_phone"), ids, "id_phone").select(*columns))


def merge_phones(store: dict[str, BucketedTable], subs: DataFrame, batch: str | None = None, keep_web: bool = False) -> None:
    """save_phones() on stored tables by buckets of id_phone: ``phone`` and the three child tables, with all nine lists.

    Only buckets of the submitted ids are rewritten. The rows with their new ids are kept until all tables have them, so
    a batch that is broken off and run again under its name gives the same ids.
    """
    phone = store["phone"]
    rows = kept_for(phone.spark, phone.path, batch, lambda: submitted_phones(phone.rows(), written(subs, "submissions"), keep_web))  # read several times
    for name, part in normalise_phone(rows).items():
        store[name].replace(part, rows.select("id_phone"), batch)


def merge_models(model: BucketedTable, upd: DataFrame, batch: str | None = None) -> DataFrame:
    """update_models() on a stored table by buckets of id_model; gives the rejected updates with their reason."""
    ids = model.near(upd).select("id_model")
    rejected = upd.join(ids, "id_model", "left_anti").withColumn("reason", F.lit(NOT_FOUND))
    rejected = kept_for(model.spark, model.path, batch and f"{batch}-rejected", lambda: rejected)
    save(model, upd.join(ids, "id_model", "left_semi"), "id_model", batch)
    return rejected


def merge_brands(brand: BucketedTable, upd: DataFrame, batch: str | None = None) -> None:
    """save_brands() on a stored table by buckets of id_brand."""
    save(brand, upd, "id_brand", batch)


def remove_phones(store: dict[str, BucketedTable], ids: DataFrame, batch: str | None = None) -> None:
    """delete_phones() on stored tables by buckets of id_phone; child rows go first, so that a broken batch leaves none without a phone."""
    for name in sorted(store, key=lambda n: n == "phone"):
        store[name].remove(ids, batch)


def save_brands(brand: DataFrame, upd: DataFrame) -> DataFrame:
    """Whole-row save by id, without checks."""
    return replace_rows(brand, upd, "id_brand")


def update_models(model: DataFrame, upd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Models replaced where the id exists; the other updates with their reason."""
    ids = model.select("id_model")
    rejected = upd.join(ids, "id_model", "left_anti").withColumn("reason", F.lit(NOT_FOUND))
    return replace_rows(model, upd.join(ids, "id_model", "left_semi"), "id_model"), rejected


def patch(base: DataFrame, upd: DataFrame, key: str) -> DataFrame:
    """Only the update's non-null fields overwrite."""
    new = upd.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_u_{c}") for c in upd.columns if c != key])
    joined = base.join(new, base[key] == F.col("_key"), "left")
    return joined.select(*[F.coalesce(f"_u_{c}", c).alias(c) if c != key and c in upd.columns else F.col(c) for c in base.columns])


def delete_phones(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the phones and their child rows; unknown ids do nothing."""
    return {n: t.join(ids.select("id_phone"), "id_phone", "left_anti") if "id_phone" in t.columns else t for n, t in tables.items()}


def delete_models(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the models, their phones and those phones' child rows."""
    victims = tables["phone"].join(ids.select("id_model"), "id_model", "left_semi").select("id_phone")
    return delete_phones(tables, victims) | {"model": tables["model"].join(ids.select("id_model"), "id_model", "left_anti")}


def delete_brands(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the brands and everything below them."""
    victims = tables["model"].join(ids.select("id_brand"), "id_brand", "left_semi").select("id_model")
    return delete_models(tables, victims) | {"brand": tables["brand"].join(ids.select("id_brand"), "id_brand", "left_anti")}
