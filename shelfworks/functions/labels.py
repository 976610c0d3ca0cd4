"""Column functions for labels, titles and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Network codes and their labels.
NETWORKS = {"_2G": "2G", "_3G": "3G", "_4G": "4G", "_5G": "5G"}
TEMPLATE = "Hello, I am interested in the {} {}"


def norm_label(c: Column) -> Column:
    """A label without underscores and blanks, in small letters."""
    return F.lower(F.regexp_replace(c, "[_ ]+", ""))


def enum_label(c: Column) -> Column:
    """A code's label: network codes by table, others with blanks for underscores."""
    known = F.create_map(*[F.lit(x) for pair in NETWORKS.items() for x in pair])
    return F.coalesce(F.element_at(known, c), F.translate(c, "_", " "))


def title(brand: Column, model: Column) -> Column:
    """Brand and model with a blank between."""
    return F.concat_ws(" ", brand, model)


def interest_message(brand: Column, model: Column, template: str = TEMPLATE) -> Column:
    """The template with brand and model in its two places."""
    before, between, after = template.split("{}")
    return F.concat(F.lit(before), brand, F.lit(between), model, F.lit(after))


def percent_encoded(c: Column) -> Column:
    """URL-encoded, with blanks as %20."""
    return F.regexp_replace(F.url_encode(c), "[+]", "%20")


def message_payload(number: Column, message: Column) -> Column:
    """The JSON body of a message to a number."""
    body = F.struct(F.lit("whatsapp").alias("messaging_product"), number.alias("to"), F.struct(message.alias("body")).alias("text"))
    return F.to_json(body, {"ignoreNullFields": "false"})


def image_part(image: Column) -> Column:
    """The last part of an image's file name, cut at its first dot, in normal form."""
    file = F.element_at(F.split(image, "/"), -1)
    return norm_label(F.element_at(F.split(F.element_at(F.split(file, "[.]"), 1), "_"), -1))


def norm_labels(colors: Column) -> Column:
    """A list of labels in normal form."""
    return F.transform(colors, norm_label)


def image_color(image: Column, colors: Column, norms: Column | None = None) -> Column:
    """The first colour whose normal form is the last part of the image's file name; else empty.

    ``norms`` is norm_labels() of the colours, for lists that many images share. The image's part is worked out once, not once for each colour.
    """
    at = F.array_position(norm_labels(colors) if norms is None else norms, image_part(image)).cast("int")
    return F.coalesce(F.get(colors, at - 1), F.lit(""))
