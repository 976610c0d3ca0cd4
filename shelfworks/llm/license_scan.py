"""License scans by canonical digests.

A text and a known licence are the same where their canonical forms have one SHA-256 digest. The canonical form of a line
is lower case, has one spelling of equivalent words and every run of punctuation and white space as one blank; copyright
lines and empty lines are left out. A unit is any run of whole lines (the whole text is one): its form is that of its
lines, one after the other, so that it does not matter how a copy is wrapped or indented or which comment signs it has.

A known text's first words say where a unit may begin, and its number of words where it ends; the digests of these units
meet the known digests in an equi-join. Built-in column expressions only.

Defined cases: null and empty texts hold no licence; texts of punctuation or copyright lines alone have an empty form,
which equals nothing; a notice that occurs in several places counts each time; a spelling of several words that is broken
over two lines is not brought into the other; repeated rows are each judged like one; very long texts and lines are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfworks.llm.license_texts import KNOWN, LONG
from shelfworks.llm.shared import table

#: Equivalent spellings, applied in this order to words in lower case.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
    ("organisation", "organization"), ("favour", "favor"), ("whilst", "while"), ("per cent", "percent"), ("https://", "http://"),
    ("v.", "version "), ("&", " and "), ("creative commons attribution-noncommercial", "cc by-nc"), ("creative commons attribution", "cc by"),
)
#: Words of a known text that a unit must begin with.
OPENING = 3
#: A line that begins like this names a holder; "copyright holders" inside a licence may begin a line as well and does not.
_COPYRIGHT = r"^[^a-z0-9(©]*(?:copyright(?:[^a-z0-9]*(?:c\)|[0-9]|by |$)|[^a-z0-9]*[©<\[{])|\(c\)|©|all rights reserved)"
_BETWEEN = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical(line: Column) -> Column:
    """The canonical form of a line; empty for copyright lines."""
    low = F.lower(line)
    out = low
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(F.rlike(low, F.lit(_COPYRIGHT)), F.lit("")).otherwise(F.trim(F.regexp_replace(out, _BETWEEN, " ")))


def _forms(text: Column) -> Column:
    """The forms of a text's lines, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), canonical), lambda f: f != "")


def _opening(forms: Column, at: Column) -> Column:
    """The first words from a line on; as many lines as words are enough."""
    form = F.get(forms, at)
    short = F.substring_index(form, " ", OPENING - 1) == form
    return F.when(short, F.substring_index(F.array_join(F.slice(forms, at + 1, F.lit(OPENING)), " "), " ", OPENING)).otherwise(F.substring_index(form, " ", OPENING))


def known_digests(spark: SparkSession, known=KNOWN, long=LONG) -> DataFrame:
    """``license, opening, n_words, digest`` of the known texts, and of longer ones whose digests are known, as a local relation whose size the planner knows."""
    rows = ", ".join("('{}', '{}')".format(*(x.replace("\\", "\\\\").replace("'", "\\'") for x in r)) for r in known)
    texts = spark.sql(f"SELECT * FROM VALUES {rows} AS t(license, body)")
    form = texts.select("license", F.array_join(_forms(F.col("body")), " ").alias("form"))
    own = form.filter("form <> ''").select(
        "license", F.substring_index("form", " ", OPENING).alias("opening"), F.size(F.split("form", " ")).alias("n_words"), F.sha2("form", 256).alias("digest")
    )
    given = ", ".join(map(str, long))
    return (own.union(spark.sql(f"SELECT * FROM VALUES {given} AS t(license, opening, n_words, digest)")) if long else own).distinct()


def scan(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, licenses, n_notices, whole_text`` of every row: the names found, in order, in how many places, and whether a unit is the whole text."""
    # a few words for each known text, and the words of the longest one that begins so
    openings = {r.opening: r.most for r in known.groupBy("opening").agg(F.max("n_words").alias("most")).collect()}
    longest = F.create_map(*[F.lit(x) for pair in openings.items() for x in pair]) if openings else F.create_map(F.lit(""), F.lit(0))
    keys = docs.select("doc_id", F.xxhash64(text).alias("tie"), _forms(F.coalesce(F.col(text), F.lit(""))).alias("forms"))
    # outer, so that no filter is derived from it that would work the forms out twice
    begun = keys.select("doc_id", "tie", "forms", F.explode_outer(F.filter(
        F.transform("forms", lambda f, i: F.when(_opening(F.col("forms"), i).isin([*openings]), i)), lambda i: i.isNotNull()
    )).alias("at")).filter("at IS NOT NULL")
    begun = begun.withColumn("opening", _opening(F.col("forms"), F.col("at"))).withColumn("most", F.element_at(longest, F.col("opening")) + 1)
    # a line's last word has a line's end; no line needs more words, and no unit more lines, than the longest known text with its opening
    lines = F.transform(F.slice("forms", F.col("at") + 1, F.col("most")), lambda f: F.concat(F.call_function("substring_index", f, F.lit(" "), F.col("most")), F.lit("\n")))
    units = begun.select("doc_id", "tie", "at", F.split(F.array_join(lines, " "), " ").alias("words"), "opening")
    cut = units.join(known.select("opening", "n_words").distinct(), "opening").filter(F.endswith(F.get("words", F.col("n_words") - 1), F.lit("\n")))
    form = F.replace(F.array_join(F.slice("words", F.lit(1), F.col("n_words")), " "), F.lit("\n"), F.lit(""))
    cut = cut.select("doc_id", "tie", "at", "n_words", (F.size("words") == F.col("n_words")).alias("to_end"), F.coalesce(F.sha2(form, 256), F.lit("")).alias("digest"))
    hits = cut.join(known.select("license", "digest"), "digest").groupBy("doc_id", "tie").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.size(F.collect_set(F.struct("at", "n_words"))).cast("long").alias("n_notices"),
        F.max((F.col("at") == 0) & F.col("to_end")).alias("whole"),
    )
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("t"))
    return rows.join(hits, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tie")), "left").select(
        F.col("d").alias("doc_id"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
        F.coalesce("whole", F.lit(False)).alias("whole_text"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against the known licences and notices."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), known_digests(spark))


def _sql_form(x: str) -> str:
    out = f"lower({x})"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return (
        f"CASE WHEN regexp_matches(lower({x}), '{_COPYRIGHT}') THEN '' "
        rf"ELSE trim(regexp_replace({out}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')) END"
    )


_VALUES = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(KNOWN))
_LONG = ", ".join(map(str, LONG))
_LINES = """
  SELECT rid, k, form, len(string_split(form, ' ')) AS n, sum(len(string_split(form, ' '))) OVER (PARTITION BY rid ORDER BY k) AS upto,
         array_to_string(string_split(concat_ws(' ', form, lead(form, 1) OVER (PARTITION BY rid ORDER BY k), lead(form, 2) OVER (PARTITION BY rid ORDER BY k)), ' ')[1:3], ' ') AS opening
  FROM
"""
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
kb(rid, license, body) AS (VALUES {_VALUES}),
kl AS (SELECT rid, unnest(range(len(l))) AS k, unnest(l) AS line FROM (SELECT rid, string_split(body, chr(10)) AS l FROM kb)),
kf AS ({_LINES} (SELECT rid, k, {_sql_form('line')} AS form FROM kl) WHERE form <> ''),
kn AS (SELECT DISTINCT license, first(opening ORDER BY k) AS opening, sum(n) AS n_words, sha256(string_agg(form, ' ' ORDER BY k)) AS digest FROM kf JOIN kb USING (rid) GROUP BY rid, license
  UNION SELECT * FROM (VALUES {_LONG}) t(license, opening, n_words, digest)),
dl AS (SELECT rid, unnest(range(len(l))) AS k, unnest(l) AS line FROM (SELECT rid, string_split(coalesce(text, ''), chr(10)) AS l FROM d)),
df AS MATERIALIZED ({_LINES} (SELECT rid, k, {_sql_form('line')} AS form FROM dl) WHERE form <> ''),
c AS (
  SELECT DISTINCT a.rid, a.k AS first, b.k AS last, kn.n_words FROM df a JOIN kn ON kn.opening = a.opening
  JOIN df b ON b.rid = a.rid AND b.upto = a.upto - a.n + kn.n_words),
u AS (SELECT c.rid, c.first, c.last, c.n_words, sha256(string_agg(x.form, ' ' ORDER BY x.k)) AS digest FROM c JOIN df x ON x.rid = c.rid AND x.k BETWEEN c.first AND c.last GROUP BY ALL),
w AS (SELECT rid, min(k) AS k0, max(k) AS k1 FROM df GROUP BY rid),
h AS (
  SELECT u.rid, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses, count(DISTINCT u.first * 100000 + u.n_words) AS n_notices,
         bool_or(u.first = w.k0 AND u.last = w.k1) AS whole FROM u JOIN kn USING (digest) JOIN w ON w.rid = u.rid GROUP BY u.rid)
SELECT d.doc_id, coalesce(h.licenses, '') AS licenses, coalesce(h.n_notices, 0) AS n_notices, coalesce(h.whole, false) AS whole_text
FROM d LEFT JOIN h USING (rid)
"""
