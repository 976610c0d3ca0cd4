"""Reading and writing the catalogue: tables, submissions, documents and rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfworks.sources.schemas import LIST_ATTRIBUTES, SCALARS, SUBMISSION, SUBMISSION_NAMES, TABLES


def read_tables(spark: SparkSession, folder: str, names=tuple(TABLES)) -> dict[str, DataFrame]:
    """The catalogue tables from Parquet folders under ``folder``."""
    return {name: spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet") for name in names}


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, options: dict | None = None) -> DataFrame:
    """One table from a live relational store, read in ``parts`` ranges of its key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.options(**(options or {})).load()


def key_bounds(spark: SparkSession, url: str, name: str, key: str, options: dict | None = None, after: int | None = None) -> tuple[int | None, int | None, int]:
    """Least and largest key, and number of rows with a key, of a store's table; of those above ``after`` where it is given.

    The largest key is the high-water mark of a repeated read.
    """
    above = "" if after is None else f" AND {key} > {after}"
    sql = f"SELECT MIN({key}) AS low, MAX({key}) AS high, COUNT({key}) AS n FROM {name} WHERE {key} IS NOT NULL{above}"
    row = spark.read.format("jdbc").options(url=url, query=sql, **(options or {})).load().first()
    return (None if row[0] is None else int(row[0]), None if row[1] is None else int(row[1]), int(row[2]))


def split_points(spark: SparkSession, url: str, name: str, key: str, parts: int, low: int, high: int, rows: int, options: dict | None = None, bins: int = 64) -> list[int]:
    """Keys that cut the rows between ``low`` and ``high`` into about ``parts`` ranges of like numbers of rows.

    The store counts its rows in ``bins`` ranges of equal width; ranges that hold too many are counted again, finer, so a key
    that is used unevenly costs a few more counts. Only counts come here: a few for each part.
    """
    most = max(1, rows // (2 * parts))
    counts, open_ = [], [(low, high + 1)]
    while open_:
        finer = []
        for a, b in open_:
            width = max(1, -(-(b - a) // bins))
            sql = f"SELECT bin, COUNT(*) AS n FROM (SELECT FLOOR(({key} - {a}) / {width}) AS bin FROM {name} WHERE {key} >= {a} AND {key} < {b}) t GROUP BY bin"
            for bin_, n in spark.read.format("jdbc").options(url=url, query=sql, **(options or {})).load().collect():
                start = a + int(bin_) * width
                if n > most and width > 1:
                    finer.append((start, min(b, start + width)))
                else:
                    counts.append((start, n))
        open_ = finer
    cuts, held, each = [], 0, rows / parts
    for start, n in sorted(counts):
        if held and held + n / 2 >= each * (len(cuts) + 1):
            cuts.append(start)
        held += n
    return cuts


def read_jdbc_balanced(spark: SparkSession, url: str, name: str, key: str, parts: int, options: dict | None = None, after: int | None = None) -> tuple[DataFrame, int | None]:
    """One table from a live store in ranges of its key that hold like numbers of rows, and the high-water mark.

    With ``after``, a mark that an earlier read gave, only rows above it. Rows that come in while it reads are left to the
    next read; rows without a key are read by the first one.
    """
    low, high, rows = key_bounds(spark, url, name, key, options, after)
    none = [f"{key} IS NULL"] if after is None else ["1 = 0"]
    properties = {k: str(v) for k, v in (options or {}).items()}
    if not rows:
        return spark.read.jdbc(url, name, predicates=none, properties=properties), after
    cuts = split_points(spark, url, name, key, parts, low, high, rows, options)
    edges = [low, *cuts, high + 1]
    ranges = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(edges, edges[1:])]
    return spark.read.jdbc(url, name, predicates=ranges + none * (after is None), properties=properties), high


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Phone submissions from JSON; a line that does not parse keeps its text in ``_corrupt``."""
    return spark.read.schema(SUBMISSION).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def normalise_phone(phones: DataFrame) -> dict[str, DataFrame]:
    """Phones with list columns as a parent table and child tables ``phone_list, phone_colors, phone_box_contents``."""
    attributes = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias("values")) for a in LIST_ATTRIBUTES])
    lists = phones.select("id_phone", F.explode(attributes).alias("a"))
    return {
        "phone": phones.select("id_phone", *SCALARS, "id_model"),
        "phone_list": lists.select("id_phone", "a.attr", F.posexplode("a.values").alias("pos", "value")),
        "phone_colors": phones.select("id_phone", F.posexplode("colors").alias("pos", "id_color")),
        "phone_box_contents": phones.select("id_phone", F.posexplode("box_contents").alias("pos", "id_content")),
    }


def submission_rows(subs: DataFrame) -> DataFrame:
    """Submissions under our column names."""
    return subs.select("seq", *[F.col(theirs).alias(ours) for ours, theirs in SUBMISSION_NAMES.items()], "colors", F.col("boxContents").alias("box_contents"))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document a row, in a column ``document``."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def write_catalogue(df: DataFrame, path: str) -> None:
    """The catalogue as JSON documents."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def split_judged(judged: DataFrame, path: str, reason: str = "reason", reasons: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Accepted and rejected rows (without and with a reason), written in one pass over what they were judged from.

    One write makes both sinks, ``verdict=accepted`` and ``verdict=rejected`` under ``path``, and counts ``accepted``,
    ``rejected`` and each of ``reasons`` on the way; the judging runs once, whatever is read afterwards.
    """
    spark, seen = judged.sparkSession, Observation()
    verdict = F.when(F.col(reason).isNull(), "accepted").otherwise("rejected")
    counts = {"accepted": F.col(reason).isNull(), "rejected": F.col(reason).isNotNull()} | {r: F.col(reason).eqNullSafe(r) for r in reasons}
    counted = judged.observe(seen, *[F.count_if(test).alias(name) for name, test in counts.items()])
    counted.withColumn("verdict", verdict).write.partitionBy("verdict").mode("overwrite").parquet(path)
    both = spark.read.schema(T.StructType([*judged.schema.fields, T.StructField("verdict", T.StringType())])).parquet(path)
    accepted, rejected = (both.filter(F.col("verdict") == v).drop("verdict") for v in ("accepted", "rejected"))
    return accepted.drop(reason), rejected, {name: int(n) for name, n in seen.get.items()}


def quarantine(df: DataFrame, reason: str = "reason", status: int = 500, title: str = "Internal Server Error") -> DataFrame:
    """The rows that have a reason, with an error record of time, status, title and message."""
    rejected = df.filter(F.col(reason).isNotNull())
    return rejected.select(
        *[c for c in df.columns if c != reason],
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"),
        F.lit(status).alias("status"),
        F.lit(title).alias("error"),
        F.col(reason).alias("message"),
    )
