"""Word search over brand and model, for one text or a table of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HITS, SLICE, GRAM = 5, 6, 3


def terms_of(text: Column) -> Column:
    """A text's words in small letters; an empty word is in everything."""
    return F.split(F.lower(text), "\\s+")


def all_terms_in(terms: Column, brand: Column, model: Column) -> Column:
    """Whether every word is literally in the model or in the brand, in any case."""
    b, m = F.lower(brand), F.lower(model)
    return F.forall(terms, lambda t: F.contains(m, t) | F.contains(b, t))


def search(cat: DataFrame, text: str, limit: int = HITS) -> DataFrame:
    """The first phones by id that hold every word of the text."""
    return cat.filter(all_terms_in(terms_of(F.lit(text)), F.col("brand"), F.col("model"))).orderBy("id_phone").limit(limit)


def filter_slice(cat: DataFrame, text: str | None, offset: int = 0, size: int = SLICE) -> DataFrame:
    """Phones that hold every word of the trimmed text, from row ``offset``; an empty or null text gives all, uncut."""
    if text is None or text == "":
        return cat
    hits = cat.filter(all_terms_in(terms_of(F.trim(F.lit(text))), F.col("brand"), F.col("model")))
    return hits.orderBy("id_phone").offset(offset).limit(size)


def search_hits(cat: DataFrame) -> DataFrame:
    """The hit's columns: id, brand, model and an image that is never set."""
    return cat.select("id_phone", "brand", "model", F.lit(None).cast("string").alias("image_search"))


def upper_brand(hits: DataFrame) -> DataFrame:
    """Hits with the brand in capitals."""
    return hits.withColumn("brand", F.upper("brand"))


def top_k(hits: DataFrame, k: int = HITS, by: str = "query_id") -> DataFrame:
    """The k lowest ids of each request; Spark cuts each task's rows before the shuffle."""
    order = Window.partitionBy(by).orderBy("id_phone")
    return hits.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


def _pieces(text: Column, size: int) -> Column:
    """All runs of ``size`` letters of a text."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size))


def asked_pieces(text: Column) -> Column:
    """What a name must hold for each word of a text: the word's 3-letter pieces, or the word itself where it is shorter."""
    of = F.transform(terms_of(text), lambda t: F.when(F.length(t) >= GRAM, _pieces(t, GRAM)).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(of))


def held_pieces(brand: Column, model: Column) -> Column:
    """All pieces of one to three letters of a brand and a model."""
    of = [F.when(F.length(F.lower(c)) >= n, _pieces(F.lower(c), n)).otherwise(F.array().cast("array<string>")) for c in (brand, model) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in of]))


def rarest_pieces(texts: DataFrame, held: DataFrame) -> DataFrame:
    """``text, piece, alone`` of texts with a word: the piece that fewest names hold; ``alone`` where the piece is all that the text asks for.

    ``held`` has ``piece`` once for each name. Texts that ask for a piece that no name holds are gone.
    """
    counts = held.groupBy("piece").agg(F.count(F.lit(1)).alias("names"))
    asked = texts.select("text", F.explode(asked_pieces(F.col("text"))).alias("piece"))
    best = asked.join(counts, "piece", "left").groupBy("text").agg(
        F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "piece")).alias("best"), F.count(F.lit(1)).alias("asked")
    )
    words = F.filter(terms_of(F.col("text")), lambda t: F.length(t) > 0)
    alone = (F.col("asked") == 1) & F.forall(words, lambda t: F.length(t) <= GRAM)
    return best.filter("best.names > 0").select("text", "best.piece", alone.alias("alone"))


def search_many(queries: DataFrame, cat: DataFrame, k: int = HITS) -> DataFrame:
    """search() for every row of ``queries`` (query_id, text): ``query_id, rn, id_phone, brand, model``.

    The test sees only names, so distinct texts meet distinct names, by an equi-join on the rarest piece of a text; of each
    name only its k lowest ids go on. Two kinds of texts need no such join, however many names they are in: one of a single
    word of up to three letters has the k lowest ids that hold the piece, and one without words the k lowest of all.
    """
    texts = queries.select("text").dropna().distinct()
    order = Window.partitionBy("brand", "model").orderBy("id_phone")
    lowest = cat.select("id_phone", "brand", "model").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")
    names = lowest.select("brand", "model").distinct()
    held = names.select(F.col("brand").alias("_b"), F.col("model").alias("_m"), F.explode(held_pieces(F.col("brand"), F.col("model"))).alias("piece"))
    asked = rarest_pieces(texts, held)
    same = F.col("_b").eqNullSafe(F.col("brand")) & F.col("_m").eqNullSafe(F.col("model"))

    several = asked.filter(~F.col("alone")).join(held.hint("merge"), "piece").filter(all_terms_in(terms_of(F.col("text")), F.col("_b"), F.col("_m")))
    hits = several.join(lowest, same).select("text", "id_phone", "brand", "model")
    single = asked.filter("alone")
    wanted = held.join(single.select("piece").distinct(), "piece", "left_semi")
    by_piece = top_k(wanted.join(lowest, same).select("piece", "id_phone", "brand", "model"), k, "piece").drop("rn")
    hits = hits.union(single.join(by_piece, "piece").select("text", "id_phone", "brand", "model"))
    wordless = texts.filter(F.size(asked_pieces(F.col("text"))) == 0)
    every = cat.filter(F.coalesce("brand", "model").isNotNull()).select("id_phone", "brand", "model").orderBy("id_phone").limit(k)
    hits = hits.union(wordless.join(F.broadcast(every)).select("text", "id_phone", "brand", "model"))  # k rows
    return queries.join(top_k(hits, k, "text"), "text").select("query_id", "rn", "id_phone", "brand", "model")
