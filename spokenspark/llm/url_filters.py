"""URL filters: host-suffix and path-prefix rules found by hashed expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Hex digits of the short hash on which expressions and rules meet; the whole digest decides.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def parsed(url) -> tuple:
    """Host (lower case in A-Z) and path of a URL column; both empty for null or without `://`."""
    after = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))
    host = F.translate(F.regexp_extract(after, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row of pages (page_id, url).

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains if the path starts with the
    rule's. Each URL gives one expression per host suffix and per path prefix of a length that a rule has; expressions
    meet rules on a short hash and are confirmed on the whole SHA-256 digest. The longest rule wins, then the longer
    host, then block. Without a rule: rule null, the default verdict. A URL that is null or has no `://` has an empty
    host and path and fits no rule. Repeated rows are judged once and come out as often as they go in; one shuffle by
    (page_id, url) does both, so a common host is spread over all tasks. No rules: all default; no pages: no rows.
    """
    own = rules.where("host IS NOT NULL AND host <> '' AND verdict IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict")
    own = own.withColumn("digest", F.sha2(F.concat_ws("\x00", "r_host", "r_path"), 256)).groupBy("digest").agg(F.max(F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("n_host"), "verdict", F.concat("r_host", "r_path").alias("rule"))).alias("r"))
    own = own.select(F.substring("digest", 1, SHORT).alias("short"), "digest", "r")
    lengths = sorted(r[0] for r in rules.select(F.length(F.coalesce("path", F.lit("")))).distinct().toLocalIterator())  # at most as many as the longest path has places
    host, path = parsed(F.col("url"))
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("n")).withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.expr(f"filter(cast(array({', '.join(map(str, lengths))}) AS array<int>), i -> i <= length(path))"), lambda i: F.expr("path").substr(F.lit(1), i))
    cross = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\x00", h, p), 256))))
    asked = urls.select("page_id", "url", "n", "host", "path", F.explode_outer(cross).alias("asked")).withColumn("short", F.substring("asked", 1, SHORT))
    met = asked.join(own, "short", "left").withColumn("r", F.when(F.col("asked") == F.col("digest"), F.col("r")))
    best = met.groupBy("page_id", "url").agg(F.first("n").alias("n"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("r").alias("r"))
    out = best.withColumn("copy", F.explode(F.expr("array_repeat(0, cast(n AS int))")))
    return out.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages),
u AS (SELECT page_id, translate(regexp_extract(after, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(after, '\A[^/?#]*([^?#]*)', 1) AS path FROM a),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
