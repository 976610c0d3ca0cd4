"""URL filters: allow and block rules on hosts and path prefixes.

Every URL is expanded into the host suffixes and directory prefixes that a rule could name. The expressions meet the
rules in an equi-join on a short hash prefix; full digests and the rest of the rule's path confirm each meeting, and
the longest rule wins. Built-in column expressions only.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; a rule path is a plain
prefix, so a URL without a path does not fit ``net/``; between rules of one length, block goes before allow, then the
smaller text; repeated rows are judged one by one; an empty table gives an empty result; more columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfworks.llm.shared import ascii_lower, fresh, table

#: Hex digits of the SHA-256 digest that the join uses.
HASH_PREFIX = 8
#: The rules of the query (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT_VERDICT = "allow"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a local relation, whose size the planner knows."""
    rows = ", ".join("('{}', '{}', '{}')".format(*(x.replace("\\", "\\\\").replace("'", "\\'") for x in r)) for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(verdict, host, path)")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    return F.coalesce(ascii_lower(F.regexp_extract(F.substr(url, F.length(rest) + 4), "^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    return F.coalesce(F.regexp_extract(F.substr(url, F.length(rest) + 4), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _directory(path: Column) -> Column:
    """The path up to its last slash: the part of a rule that expressions can equal."""
    return F.regexp_extract(path, "^((?:[^/]*/)*)", 1)


def _expressions(host: Column, path: Column, labels: Column, depth: Column) -> Column:
    """All ``suffix + directory`` texts with at most ``labels`` host labels and ``depth`` slashes."""
    parts = F.split(host, "[.]")
    n = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, labels)), lambda k: F.array_join(F.slice(parts, n - k + 1, k), ".")
    )
    dirs = F.split(path, "/")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(dirs) - 1, depth)),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(dirs, 1, k), "/"), F.lit("/"))),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Every row of ``pages`` with ``host, path, rule, verdict``; ``rule`` is null where ``default`` decides."""
    keyed = rules.dropna(subset=["verdict", "host", "path"]).filter(F.col("host") != "").dropDuplicates(["verdict", "host", "path"]).select(
        F.col("verdict").alias("r_verdict"),
        ascii_lower(F.col("host")).alias("r_host"),
        F.col("path").alias("r_path"),
    )
    full = F.sha2(F.concat("r_host", F.lit("\n"), _directory(F.col("r_path"))), 256)
    keyed = keyed.withColumn("r_digest", full).withColumn("r_key", F.substring("r_digest", 1, HASH_PREFIX))
    most = keyed.agg(
        F.coalesce(F.max(F.size(F.split("r_host", "[.]"))), F.lit(1)), F.coalesce(F.max(F.size(F.split("r_path", "/")) - 1), F.lit(0))
    ).first()
    urls = pages.select(F.col(url).alias("u")).dropna().distinct().withColumn("h", url_host(F.col("u"))).withColumn("p", url_path(F.col("u")))
    opened = urls.filter(F.col("h") != "").select(
        "u", "p", F.explode(_expressions(F.col("h"), F.col("p"), F.lit(most[0]), F.lit(most[1]))).alias("e")
    )
    digested = opened.select("u", "p", F.sha2("e", 256).alias("digest")).withColumn("key", F.substring("digest", 1, HASH_PREFIX))
    met = digested.join(keyed, F.col("key") == F.col("r_key")).filter(
        (F.col("digest") == F.col("r_digest")) & F.startswith(F.col("p"), F.col("r_path"))
    )
    name = F.concat("r_host", "r_path")
    best = met.groupBy("u").agg(
        F.min(F.struct((-F.length(name)).alias("n"), (F.col("r_verdict") != "block").alias("a"), name.alias("rule"), F.col("r_verdict").alias("v"))).alias("b")
    )
    key, rule, verdict = fresh(pages.columns, "_url", "_rule", "_verdict")
    found = best.select(F.col("u").alias(key), F.col("b.rule").alias(rule), F.col("b.v").alias(verdict))
    out = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c in pages.columns and c != url])
    joined = out.join(found, out[url] == F.col(key), "left")
    return joined.select(
        *[out[c] for c in out.columns],
        url_host(out[url]).alias("host"),
        url_path(out[url]).alias("path"),
        F.col(rule).alias("rule"),
        F.coalesce(F.col(verdict), F.lit(default)).alias("verdict"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four rules over all of ``pages``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
j AS (
  SELECT h.page_id, h.host, h.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE k = 1
"""
