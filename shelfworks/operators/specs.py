"""Specification sheets, images and side-by-side comparison of phones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfworks.functions.labels import image_color, norm_labels

#: The sheet's attributes in order; the last element says whether it is a list.
SHEET = (
    ("colors", True), ("box_contents", True), ("main_camera", True), ("secondary_camera", False), ("screen", True), ("processor", False),
    ("gpu", False), ("memory", True), ("battery", True), ("os", False), ("connectivity", True), ("security", True), ("dimensions", False),
)


def card_images(images: Column) -> Column:
    """All images but the last; empty stays empty, null stays null."""
    return F.when(images.isNotNull(), F.slice(images, F.lit(1), F.greatest(F.size(images) - 1, F.lit(0))))


def cover_image(images: Column) -> Column:
    """The first image."""
    return F.get(images, F.lit(0))


def battery_text(battery: Column) -> Column:
    """The battery list as one text."""
    return F.array_join(battery, ",")


def color_for_image(cat: DataFrame) -> DataFrame:
    """One row for each image with the colour that its file name tells."""
    normal = cat.select("id_phone", "colors", "images", norm_labels(F.col("colors")).alias("norms"))
    opened = normal.select("id_phone", "colors", "norms", F.posexplode("images").alias("pos", "image"))
    return opened.select("id_phone", "pos", "image", image_color(F.col("image"), F.col("colors"), F.col("norms")).alias("color"))


def _attributes(sheet=SHEET) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("attr_no"), F.lit(name).alias("attr"), (F.col(name) if many else F.array(F.col(name))).alias("items"))
        for i, (name, many) in enumerate(sheet, 1)
    ])


def spec_sheet(cat: DataFrame, sheet=SHEET) -> DataFrame:
    """A row for each phone, attribute and item: lists give one for each element."""
    opened = cat.select("id_phone", F.inline(_attributes(sheet)))
    return opened.select("id_phone", "attr_no", "attr", F.posexplode("items").alias("item_no", "value"))


def versus_pairs(pairs: DataFrame, cat: DataFrame) -> DataFrame:
    """Pairs (pair_id, id1, id2) of phones that both exist, with all columns of both as structs ``a`` and ``b``."""
    whole = F.struct(*[cat[c] for c in cat.columns])
    one = cat.select(F.col("id_phone").alias("id1"), whole.alias("a"))
    two = cat.select(F.col("id_phone").alias("id2"), whole.alias("b"))
    return pairs.join(one, "id1").join(two, "id2").select("pair_id", "id1", "id2", "a", "b")


def versus_table(pairs: DataFrame, cat: DataFrame, sheet=SHEET) -> DataFrame:
    """A row for each pair and attribute with the lists of both phones, made on the joined row."""
    joined = versus_pairs(pairs, cat)
    def side(s: str, name: str, many: bool) -> Column:
        return F.col(f"{s}.{name}") if many else F.array(F.col(f"{s}.{name}"))

    rows = F.array(*[
        F.struct(F.lit(i).alias("attr_no"), F.lit(n).alias("attr"), side("a", n, m).alias("left"), side("b", n, m).alias("right"))
        for i, (n, m) in enumerate(sheet, 1)
    ])
    return joined.select("pair_id", F.inline(rows))
