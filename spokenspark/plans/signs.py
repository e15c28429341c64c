"""Registered queries of coordinates, runs of signs and variants of abbreviations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signs
from ..operators.detect import ABBREVIATIONS
from ..sources.tables import read_table
from .queries import _cardinal_sql, query

_RUNS = ", ".join(f"('{s}', '{n}')" for s, n in signs.RUN_NAMES.items())


@query(f"""WITH c AS (SELECT c_custkey AS k, c_custkey * 7 % 200 AS d, c_custkey % 61 AS m, c_custkey * 11 % 60 AS s, ['N', 'E', 'S', 'W'][c_custkey % 4 + 1] AS p FROM customer), {_cardinal_sql("SELECT * FROM range(200) AS r(n)")},
kept AS (SELECT c.*, d.w AS dw, m.w AS mw, s.w AS sw, ['north', 'east', 'south', 'west'][k % 4 + 1] AS pw FROM c JOIN words AS d ON d.n = c.d JOIN words AS m ON m.n = c.m JOIN words AS s ON s.n = c.s WHERE c.d <= CASE WHEN k % 2 = 0 THEN 90 ELSE 180 END AND (k % 3 = 0 OR c.m < 60))
SELECT k, 3 AS start, d || '°' || CASE WHEN k % 3 > 0 THEN m || '''' ELSE '' END || CASE WHEN k % 3 > 1 THEN ' ' || s || '"' ELSE '' END || ' ' || p AS surface,
  dw || CASE WHEN d = 1 THEN ' degree ' ELSE ' degrees ' END || CASE WHEN k % 3 > 0 THEN mw || CASE WHEN m = 1 THEN ' minute ' ELSE ' minutes ' END ELSE '' END || CASE WHEN k % 3 > 1 THEN sw || CASE WHEN s = 1 THEN ' second ' ELSE ' seconds ' END ELSE '' END || pw AS spoken FROM kept""")
def coordinates(spark, sf_dir):
    """Places on the globe made of the customers' keys, found in running text and said; those that don't exist are not."""
    k = F.col("c_custkey")
    point = F.get(F.array(*[F.lit(x) for x in "NESW"]), (k % 4).cast("int"))
    place = F.concat(k * 7 % 200, F.lit("°"), F.when(k % 3 > 0, F.concat(k % 61, F.lit("'"))).otherwise(""), F.when(k % 3 > 1, F.concat(F.lit(" "), k * 11 % 60, F.lit('"'))).otherwise(""), F.lit(" "), point)
    found = read_table(spark, sf_dir, "customer").select(k.alias("k"), F.explode(signs.coordinates(F.concat(F.lit("at "), place, F.lit(", so")))).alias("c"))
    return found.select("k", F.col("c.start").alias("start"), F.col("c.surface").alias("surface"), F.col("c.spoken").alias("spoken"))


@query(rf"""WITH names AS (SELECT * FROM (VALUES {_RUNS}) AS v(sign, name)), r AS (SELECT page_id, unnest(regexp_extract_all(html, '{"|".join(f"[{chr(92)}{s}]{{3,}}" if s in "-*" else f"[{s}]{{3,}}" for s in signs.RUN_NAMES)}')) AS surface FROM pages
  UNION ALL SELECT -1 - doc_id, unnest(regexp_extract_all(text, '{"|".join(f"[{chr(92)}{s}]{{3,}}" if s in "-*" else f"[{s}]{{3,}}" for s in signs.RUN_NAMES)}')) FROM documents)
SELECT page_id AS place, surface, 'line of ' || name AS spoken, count(*) AS n FROM r JOIN names ON sign = substr(surface, 1, 1) GROUP BY ALL""")
def sign_runs(spark, sf_dir):
    """Runs of one sign in the pages and (as -1 - doc_id) the documents, as a line of the sign."""
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("place"), F.col("html").alias("text"))
    docs = read_table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).cast("long").alias("place"), "text")
    each = pages.unionAll(docs).select("place", F.explode(signs.sign_runs(F.col("text"))).alias("c"))
    return each.groupBy("place", F.col("c.surface").alias("surface"), F.col("c.spoken").alias("spoken")).agg(F.count("*").alias("n"))


_LISTED = ", ".join(f"('{w}', '{s}')" for w, s in ABBREVIATIONS.items())


@query(rf"""WITH listed AS (SELECT * FROM (VALUES {_LISTED}) AS v(written, spoken)),
each AS (SELECT replace(written, '.', '') AS surface, written, spoken, 'no-period' AS kind FROM listed UNION ALL SELECT upper(written), written, spoken, 'upper' FROM listed UNION ALL SELECT lower(written), written, spoken, 'lower' FROM listed),
variants AS (SELECT surface, written, spoken, min(kind) AS kind FROM each WHERE surface <> written AND length(surface) > 1 AND surface NOT IN (SELECT written FROM listed) GROUP BY ALL),
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{{L}}+(?:\.\p{{L}}+)*\.?')) AS w FROM documents), free AS (SELECT doc_id, w, regexp_replace(w, '\.$', '') AS b FROM t WHERE w NOT IN (SELECT written FROM listed)),
found AS (SELECT doc_id, CASE WHEN w IN (SELECT surface FROM variants) THEN w ELSE b END AS surface FROM free)
SELECT doc_id, surface, written, spoken, kind, count(*) AS n FROM found JOIN variants USING (surface) GROUP BY ALL""")
def abbreviation_variants(spark, sf_dir):
    """Words of the documents that are a listed abbreviation without its periods or in another case."""
    listed = spark.createDataFrame(list(ABBREVIATIONS.items()), "written string, spoken string")
    found = signs.found_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", listed)
    return found.groupBy("doc_id", "surface", "written", "spoken", "kind").agg(F.count("*").alias("n"))
