"""Registered queries over the given tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spellout as say
from ..functions import text as tf
from ..operators import choices, detect, resolve
from ..operators.normalize import normalize, units
from ..sources.tables import read_table
from . import evaluate, priors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_ONES = ", ".join(f"'{w}'" for w in say.ONES)
_TENS = ", ".join(f"'{w}'" for w in say.TENS)
#: Number words in SQL: a table of 0 to 999, joined once per group of three digits.
_WORDS = f"""small AS (SELECT n, CASE WHEN n < 20 THEN ([{_ONES}])[n + 1] ELSE ([{_TENS}])[n // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || ([{_ONES}])[n % 10 + 1] ELSE '' END END AS w
  FROM range(100) AS r(n)),
w999 AS (SELECT n, concat_ws(' ', CASE WHEN n >= 100 THEN (SELECT w FROM small AS s WHERE s.n = r.n // 100) || ' hundred' END, CASE WHEN n % 100 > 0 THEN (SELECT w FROM small AS s WHERE s.n = r.n % 100) END) AS w FROM range(1000) AS r(n))"""


def _cardinal_sql(source: str) -> str:
    """Common table expressions ending in words(n, w) for the distinct column n of `source`, below a billion."""
    return f"""{_WORDS},
nums AS (SELECT DISTINCT n FROM ({source})),
words AS (SELECT x.n, CASE WHEN x.n = 0 THEN 'zero' ELSE concat_ws(' ', CASE WHEN x.n < 0 THEN 'minus' END, CASE WHEN m.n > 0 THEN m.w || ' million' END, CASE WHEN t.n > 0 THEN t.w || ' thousand' END,
    CASE WHEN u.n > 0 THEN u.w END) END AS w
  FROM nums AS x JOIN w999 AS m ON m.n = abs(x.n) // 1000000 JOIN w999 AS t ON t.n = abs(x.n) // 1000 % 1000 JOIN w999 AS u ON u.n = abs(x.n) % 1000)"""


def _ordinal_sql(w: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({w}, '(^|[ -]){k}$') THEN regexp_replace({w}, '{k}$', '{v}')" for k, v in say.ORDINAL_ENDS.items())
    return f"CASE {cases} WHEN {w} LIKE '%y' THEN regexp_replace({w}, 'y$', 'ieth') ELSE {w} || 'th' END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, length(text) AS n, CASE WHEN text IS NULL THEN 'missing' END AS refused FROM documents")
def ingress_validate(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.length("text").cast("long").alias("n"), tf.refusal(F.col("text")).alias("refused"))


#: The folds in SQL by their code points, written apart from functions/text.py.
_FOLD_SQL = "translate({}, concat(chr(8216), chr(8217), chr(8219), chr(8220), chr(8221), chr(8223), chr(160), chr(8199), chr(8201), chr(8239), chr(8208), chr(8209), chr(8722), '０１２３４５６７８９'), concat(repeat(chr(39), 3), repeat(chr(34), 3), '    ', '---', '0123456789'))"


@query(f"SELECT doc_id, sha256({_FOLD_SQL.format('text')}) AS folded FROM documents")
def ingress_fold(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(tf.folded(F.col("text")), 256).alias("folded"))


@query("SELECT o_orderkey, format('{:,.2f}', CAST(o_totalprice AS DOUBLE)) || '% +' || CAST(year(o_orderdate) AS VARCHAR) || 'km, 6′ ' || chr(39) || 'x' || chr(39) || ' a，b' AS folded FROM orders")
def ingress_fold_wide(spark, sf_dir):
    """Prices and years in full-width characters fold to what they were; a prime and a comma between letters stay."""
    wide = lambda c: F.translate(c, "0123456789,.%+km", "０１２３４５６７８９，．％＋ｋｍ")
    price = wide(F.concat(F.format_number(F.col("o_totalprice").cast("decimal(20,2)"), 2), F.lit("%")))
    written = F.concat(price, F.lit("\u00a0"), wide(F.concat(F.lit("+"), F.year("o_orderdate").cast("string"), F.lit("km"))), F.lit(", 6′\u2009‘x’ a，b"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", tf.folded(written).alias("folded"))


_SHAPE = r"regexp_replace(regexp_replace(regexp_replace({}, '\p{{L}}+', 'A', 'g'), '\p{{Nd}}+', 'N', 'g'), '\p{{Sc}}+', '¤', 'g')"


@query(f"SELECT {_SHAPE.format('url')} AS shape, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1")
def shape_counts(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").where("url IS NOT NULL").groupBy(tf.shape(F.col("url")).alias("shape")).agg(F.count("*").alias("n"))


@query(r"SELECT w AS token, count(*) AS n FROM (SELECT unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '\p{P}', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')), ' ')) AS w FROM conversations) WHERE w <> '' GROUP BY 1")
def spoken_token_counts(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select(F.explode(tf.spoken_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(r"SELECT url, len(regexp_extract_all(url, '\p{L}+|\p{Nd}+|[^\p{L}\p{Nd}]')) AS n_runs, len(regexp_extract_all(url, '\p{Nd}+')) AS n_digits FROM pages")
def electronic_runs(spark, sf_dir):
    runs = tf.runs(F.col("url"))
    return read_table(spark, sf_dir, "pages").select("url", F.size(runs).cast("long").alias("n_runs"), F.size(F.filter(runs, lambda r: r.rlike("^[0-9]"))).cast("long").alias("n_digits"))


@query(f"WITH {_cardinal_sql('SELECT o_orderkey AS n FROM orders')} SELECT o_orderkey, w AS spoken FROM orders JOIN words ON n = o_orderkey")
def cardinal_orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", say.cardinal(F.col("o_orderkey")).alias("spoken"))


@query(f"WITH {_cardinal_sql('SELECT l_orderkey AS n FROM lineitem')}, o AS (SELECT n, {_ordinal_sql('w')} AS o FROM words) SELECT o AS spoken, count(*) AS n FROM lineitem JOIN o ON o.n = l_orderkey GROUP BY 1")
def ordinal_lines(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c")).groupBy(say.ordinal(F.col("l_orderkey")).alias("spoken")).agg(F.sum("c").alias("n"))


_CENTS = "CAST(round(CAST({} AS DECIMAL(24, 4)) * 100, 0) AS BIGINT)"


@query(f"""WITH p AS (SELECT o_orderkey, {_CENTS.format('o_totalprice')} AS c FROM orders),
{_cardinal_sql('SELECT c // 100 AS n FROM p UNION ALL SELECT c % 100 FROM p')}
SELECT o_orderkey, concat_ws(' and ', CASE WHEN a.n > 0 OR b.n = 0 THEN a.w || CASE WHEN a.n = 1 THEN ' dollar' ELSE ' dollars' END END, CASE WHEN b.n > 0 THEN b.w || CASE WHEN b.n = 1 THEN ' cent' ELSE ' cents' END END) AS spoken
FROM p JOIN words AS a ON a.n = c // 100 JOIN words AS b ON b.n = c % 100""")
def money_orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", say.money(F.col("o_totalprice")).alias("spoken"))


@query(f"WITH p AS (SELECT CAST(round(l_discount * 100) AS BIGINT) AS d, count(*) AS c FROM lineitem GROUP BY 1), {_cardinal_sql('SELECT d AS n FROM p')} SELECT w || ' percent' AS spoken, c AS n FROM p JOIN words ON words.n = d")
def percent_discounts(spark, sf_dir):
    written = F.concat(F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit("%"))
    return read_table(spark, sf_dir, "lineitem").groupBy(written.alias("written")).agg(F.count("*").alias("n")).select(say.percent(F.col("written")).alias("spoken"), "n")


_MONTHS = ", ".join(f"'{m.lower()}'" for m in say.MONTHS)
_YEAR = """CASE WHEN y < 1000 OR y > 9999 OR (y // 100 % 10 = 0 AND y % 100 < 10) THEN yw.w ELSE hw.w || ' ' || CASE WHEN y % 100 = 0 THEN 'hundred' WHEN y % 100 < 10 THEN 'o ' || lw.w ELSE lw.w END END"""


@query(f"""WITH d AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders),
{_cardinal_sql('SELECT y AS n FROM d UNION ALL SELECT y // 100 FROM d UNION ALL SELECT y % 100 FROM d UNION ALL SELECT d FROM d')}
SELECT o_orderkey, ([{_MONTHS}])[m] || ' ' || {_ordinal_sql('dw.w')} || ' ' || {_YEAR} AS spoken
FROM d JOIN words AS yw ON yw.n = y JOIN words AS hw ON hw.n = y // 100 JOIN words AS lw ON lw.n = y % 100 JOIN words AS dw ON dw.n = d""")
def date_orders(spark, sf_dir):
    d = F.col("o_orderdate")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", say.date(F.year(d), F.month(d), F.day(d)).alias("spoken"))


@query(f"""WITH t AS (SELECT hour(ts) AS h, minute(ts) AS m, count(*) AS c FROM events GROUP BY 1, 2), {_cardinal_sql('SELECT h AS n FROM t UNION ALL SELECT m FROM t')}
SELECT a.w || ' ' || CASE WHEN m = 0 AND h BETWEEN 1 AND 12 THEN 'o''clock' WHEN m = 0 THEN 'hundred' WHEN m < 10 THEN 'o ' || b.w ELSE b.w END AS spoken, c AS n
FROM t JOIN words AS a ON a.n = h JOIN words AS b ON b.n = m""")
def time_events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("h"), F.minute("ts").alias("m")).agg(F.count("*").alias("n")).select(say.time(F.col("h"), F.col("m")).alias("spoken"), "n")


@query(f"WITH {_cardinal_sql('SELECT p_size AS n FROM part')} SELECT p_partkey, w || CASE WHEN p_size = 1 THEN ' kilogram' ELSE ' kilograms' END AS spoken FROM part JOIN words ON n = p_size")
def measure_parts(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", say.measure(F.col("p_size").cast("string"), F.lit("kg")).alias("spoken"))


@query(f"WITH {_cardinal_sql('SELECT l_linenumber AS n FROM lineitem UNION ALL SELECT CAST(l_quantity AS BIGINT) FROM lineitem')}, f AS (SELECT l_linenumber AS a, CAST(l_quantity AS BIGINT) AS b, count(*) AS c FROM lineitem GROUP BY 1, 2) "
       f"SELECT x.w || ' to ' || y.w AS spoken, c AS n FROM f JOIN words AS x ON x.n = a JOIN words AS y ON y.n = b")  # fmt: skip
def range_lines(spark, sf_dir):
    both = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("a"), F.col("l_quantity").cast("long").alias("b")).agg(F.count("*").alias("n"))
    return both.select(F.concat_ws(" to ", say.cardinal(F.col("a")), say.cardinal(F.col("b"))).alias("spoken"), "n")


def _found(spark, sf_dir, kinds: list[str]) -> DataFrame:
    families = [f for f in detect.FAMILIES if f.type in kinds]
    found = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(detect.candidates(F.col("text"), families)).alias("c"))
    return found.select("doc_id", "c.start", "c.end", "c.type", "c.surface")


def _found_sql(pattern: str, kind: str) -> str:
    """Offsets summed from the pieces between matches; for expressions without a look around."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, CAST(m.s AS INTEGER) AS start, CAST(m.s + length(m.h) AS INTEGER) AS "end", '{kind}' AS type, m.h AS surface FROM (
  SELECT doc_id, unnest(list_transform(generate_series(1, len(h)), lambda i: {{'h': h[i], 's': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)}})) AS m
  FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS h, string_split_regex(text, '{p}') AS g FROM documents WHERE regexp_matches(text, '{p}')))"""


@query(_found_sql("[" + "".join(detect.SYMBOLS) + "]", "symbol:cldr"))
def detect_symbols(spark, sf_dir):
    return _found(spark, sf_dir, ["symbol:cldr"])


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')) AS n FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')""")
def detect_addresses(spark, sf_dir):
    return _found(spark, sf_dir, ["electronic:email"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def detect_formatted(spark, sf_dir):
    """Counts of every type of reading in all documents, before any is chosen."""
    return detect.counts(read_table(spark, sf_dir, "documents"), "text")


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, CAST(o_orderkey % 97 AS INTEGER) AS start, CAST(o_orderkey % 97 + 1 + o_orderkey % 5 AS INTEGER) AS "end" FROM orders),
r AS (SELECT *, max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT k, count(*) FILTER (reach IS NULL OR start >= reach) AS islands FROM r GROUP BY k""")
def resolve_islands(spark, sf_dir):
    """Runs of overlapping spans; spans are written from order keys."""
    spans = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 97).cast("int").alias("start"), (F.col("o_orderkey") % 97 + 1 + F.col("o_orderkey") % 5).cast("int").alias("end"))
    return resolve.islands(spans, ["k"]).groupBy("k").agg(F.max("island").alias("islands"))


def _recognized(rows: DataFrame, *written: Column, often: str | None = None) -> DataFrame:
    """Each different written form inside a sentence, with the one reading chosen there, its place and words, and the number of rows; a
    row counts once, or as often as its column `often` says."""
    forms = rows.select(F.explode(F.array(*written)).alias("written"), (F.col(often) if often else F.lit(1)).alias("_times")).groupBy("written").agg(F.sum("_times").alias("n"))
    forms = forms.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work for each
    said = units(forms.select(F.struct("written", "n").alias("k"), F.concat(F.lit("with "), F.col("written"), F.lit(" today")).alias("text")), "k")
    return said.select("k.written", "k.n", "start", "end", "type", "spoken")


def _recognized_sql(forms: str) -> str:
    """forms: rows (written, type, spoken, c)."""
    return f"""SELECT written, CAST(sum(c) AS BIGINT) AS n, 5 AS start, CAST(5 + length(written) AS INTEGER) AS "end", type, spoken FROM ({forms}) GROUP BY written, type, spoken"""


def _years_sql(source: str) -> str:
    """A table yr(y, w) of years; words must hold them, their hundreds and the rest."""
    return f"yr AS (SELECT d.y, {_YEAR} AS w FROM ({source}) AS d JOIN words AS yw ON yw.n = y JOIN words AS hw ON hw.n = y // 100 JOIN words AS lw ON lw.n = y % 100)"


@query(f"""WITH d AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, {_CENTS.format('o_totalprice')} AS c FROM orders),
{_cardinal_sql('SELECT y AS n FROM d UNION ALL SELECT y // 100 FROM d UNION ALL SELECT y % 100 FROM d UNION ALL SELECT d FROM d UNION ALL SELECT m FROM d UNION ALL SELECT c // 100 FROM d UNION ALL SELECT c % 100 FROM d')},
{_years_sql('SELECT DISTINCT y FROM d')}
""" + _recognized_sql(f"""SELECT m || '/' || d || '/' || d.y AS written, 'date:numeric' AS type, ([{_MONTHS}])[m] || ' ' || {_ordinal_sql('dw.w')} || ' ' || yr.w AS spoken, 1 AS c FROM d JOIN yr ON yr.y = d.y JOIN words AS dw ON dw.n = d
UNION ALL SELECT 'Q' || (m + 2) // 3 || ' ' || d.y, 'date:quarter', (['first', 'second', 'third', 'fourth'])[(m + 2) // 3] || ' quarter ' || yr.w, 1 FROM d JOIN yr ON yr.y = d.y
UNION ALL SELECT CAST(CAST(c / 100 AS DECIMAL(20, 2)) AS VARCHAR) || ' EUR', 'number:currency:name',
  concat_ws(' and ', CASE WHEN a.n > 0 OR b.n = 0 THEN a.w || CASE WHEN a.n = 1 THEN ' euro' ELSE ' euros' END END, CASE WHEN b.n > 0 THEN b.w || CASE WHEN b.n = 1 THEN ' cent' ELSE ' cents' END END), 1
  FROM d JOIN words AS a ON a.n = c // 100 JOIN words AS b ON b.n = c % 100"""))  # fmt: skip
def normalize_order_forms(spark, sf_dir):
    """Numeric dates, quarters and prices with a currency code. Days and prices are counted before they are written."""
    day, orders = F.col("o_orderdate"), read_table(spark, sf_dir, "orders")
    counted = lambda c, *written: orders.groupBy(c).agg(F.count("*").alias("often")).select(F.explode(F.array(*written)).alias("form"), "often")
    days = counted("o_orderdate", F.concat_ws("/", F.month(day), F.dayofmonth(day), F.year(day)), F.concat(F.lit("Q"), F.quarter(day), F.lit(" "), F.year(day)))
    prices = counted("o_totalprice", F.concat(F.col("o_totalprice").cast("decimal(20,2)"), F.lit(" EUR")))
    return _recognized(days.unionAll(prices), F.col("form"), often="often")


@query(f"""WITH l AS (SELECT CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS k, year(l_shipdate) AS y, year(l_shipdate) + 1 AS z, count(*) AS c FROM lineitem GROUP BY ALL),
years AS (SELECT y FROM l UNION SELECT z FROM l),
{_cardinal_sql('SELECT q AS n FROM l UNION ALL SELECT k FROM l UNION ALL SELECT y FROM years UNION ALL SELECT y // 100 FROM years UNION ALL SELECT y % 100 FROM years')},
{_years_sql('SELECT y FROM years')},
both_ AS (SELECT q, k, a.w AS qw, b.w AS kw, c FROM l JOIN words AS a ON a.n = q JOIN words AS b ON b.n = k)
""" + _recognized_sql("""SELECT q || ' million' AS written, 'number:compact' AS type, qw || ' million' AS spoken, c FROM both_
UNION ALL SELECT q || ' ' || k || '/9', 'fraction:mixed', qw || ' and ' || kw || CASE WHEN k = 1 THEN ' ninth' ELSE ' ninths' END, c FROM both_
UNION ALL SELECT q || ':' || k, 'range:ratio', qw || ' to ' || kw, c FROM both_
UNION ALL SELECT k || '–' || q || ' km', 'range:measure', kw || ' to ' || qw || CASE WHEN q = 1 THEN ' kilometer' ELSE ' kilometers' END, c FROM both_
UNION ALL SELECT k || '-' || q || '%', 'range:percent', kw || ' to ' || qw || ' percent', c FROM both_
UNION ALL SELECT q || chr(39) || k || '"', 'measure:foot-and-inch', qw || CASE WHEN q = 1 THEN ' foot ' ELSE ' feet ' END || kw || CASE WHEN k = 1 THEN ' inch' ELSE ' inches' END, c FROM both_
UNION ALL SELECT l.y || '–' || l.z, 'range:year', u.w || ' to ' || v.w, c FROM l JOIN yr AS u ON u.y = l.y JOIN yr AS v ON v.y = l.z"""))  # fmt: skip
def normalize_line_forms(spark, sf_dir):
    """Compact numbers, mixed fractions, ratios, ranges of measures, percentages and years, feet and inches."""
    q, k = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string")
    form = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return _recognized(
        read_table(spark, sf_dir, "lineitem"), form(q, " million"), form(q, " ", k, "/9"), form(q, ":", k), form(k, "–", q, " km"), form(k, "-", q, "%"), form(q, "'", k, '"'),
        form(F.year("l_shipdate"), "–", F.year("l_shipdate") + 1),
    )


@query(f"""WITH t AS (SELECT hour(ts) AS h, minute(ts) AS m, second(ts) AS s, count(*) AS c FROM events WHERE ts IS NOT NULL GROUP BY ALL), {_cardinal_sql('SELECT h AS n FROM t UNION ALL SELECT m FROM t UNION ALL SELECT s FROM t')}
""" + _recognized_sql("""SELECT h || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || ':' || lpad(CAST(s AS VARCHAR), 2, '0') AS written, 'measure:duration:numeric' AS type, x.w || CASE WHEN h = 1 THEN ' hour ' ELSE ' hours ' END || y.w || CASE WHEN m = 1 THEN ' minute ' ELSE ' minutes ' END || z.w || CASE WHEN s = 1 THEN ' second' ELSE ' seconds' END AS spoken, c
  FROM t JOIN words AS x ON x.n = h JOIN words AS y ON y.n = m JOIN words AS z ON z.n = s"""))  # fmt: skip
def normalize_event_forms(spark, sf_dir):
    """Hours, minutes and seconds as durations."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return _recognized(read_table(spark, sf_dir, "events").where("ts IS NOT NULL"), F.concat_ws(":", F.hour("ts"), two(F.minute("ts")), two(F.second("ts"))))


@query()
def normalize_documents(spark, sf_dir):
    """Every sentence of every document with its spoken form."""
    return normalize(read_table(spark, sf_dir, "documents")).select("doc_id", "sent_id", "spoken", F.size("units").alias("n_units"))


@query()
def normalize_urls(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return units(pages, "page_id", "url").select("page_id", "start", "end", "type", "spoken")


def _written(spark, sf_dir) -> DataFrame:
    """Labelled rows (class, written) from the columns of orders, where nobody asks how they are spoken."""
    o, cash = read_table(spark, sf_dir, "orders"), F.concat(F.lit("$"), F.format_number(F.col("o_totalprice").cast("decimal(20,2)"), 2))
    forms = [("DATE", F.date_format("o_orderdate", "yyyy")), ("CARDINAL", F.col("o_orderkey").cast("string")), ("MONEY", cash)]
    return o.select(F.explode(F.array(*[F.struct(F.lit(k).alias("class"), c.alias("written")) for k, c in forms])).alias("r")).select("r.*")


def _rows(spark, sf_dir) -> DataFrame:
    """Labelled rows (class, written, spoken, sent_id) from the columns of orders: keys, days and prices."""
    o = read_table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    day = F.struct(F.lit("DATE").alias("class"), F.date_format(d, "yyyy").alias("written"), say.year(F.year(d)).alias("spoken"))
    key = F.struct(F.lit("CARDINAL").alias("class"), F.col("o_orderkey").cast("string").alias("written"), say.cardinal(F.col("o_orderkey")).alias("spoken"))
    cash = F.struct(F.lit("MONEY").alias("class"), F.concat(F.lit("$"), F.format_number(F.col("o_totalprice").cast("decimal(20,2)"), 2)).alias("written"), say.money(F.col("o_totalprice")).alias("spoken"))
    return o.select(F.col("o_orderkey").alias("sent_id"), F.explode(F.array(day, key, cash)).alias("r")).select("sent_id", "r.*")


@query(r"""WITH r AS (SELECT 'CARDINAL' AS class, CAST(o_orderkey AS VARCHAR) AS written FROM orders UNION ALL SELECT 'DATE', strftime(o_orderdate, '%Y') FROM orders),
c AS (SELECT substr(written, 1, 2) AS century, CASE class WHEN 'DATE' THEN 'date' ELSE 'cardinal' END AS choice FROM r WHERE regexp_matches(written, '^[0-9]{4}$')) SELECT century, choice, count(*) AS n FROM c GROUP BY 1, 2""")
def prior_centuries(spark, sf_dir):
    return priors.century_priors(_written(spark, sf_dir))


@query(r"""WITH r AS (SELECT 'CARDINAL' AS class, 'N' AS shape FROM orders UNION ALL SELECT 'DATE', 'N' FROM orders
  UNION ALL SELECT 'MONEY', '¤' || regexp_replace(format('{:,.2f}', CAST(o_totalprice AS DOUBLE)), '[0-9]+', 'N', 'g') FROM orders)
SELECT shape, class, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY shape) AS BIGINT) AS total FROM r GROUP BY shape, class""")
def prior_types(spark, sf_dir):
    return priors.type_priors(_written(spark, sf_dir)).select("shape", "class", "n", "total")


@query(f"""WITH d AS (SELECT year(o_orderdate) AS y, count(*) AS c FROM orders GROUP BY 1) SELECT 'DATE' AS class, 'o' AS word, CAST(sum(c) AS BIGINT) AS n FROM d WHERE y BETWEEN 1000 AND 9999 AND y // 100 % 10 > 0 AND y % 100 BETWEEN 1 AND 9 HAVING sum(c) > 0
UNION ALL SELECT 'CARDINAL', 'zero', count(*) FROM orders WHERE o_orderkey = 0 HAVING count(*) > 0
UNION ALL SELECT 'MONEY', 'zero', count(*) FROM orders WHERE {_CENTS.format('o_totalprice')} = 0 HAVING count(*) > 0""")
def prior_zeros(spark, sf_dir):
    return priors.zero_priors(_rows(spark, sf_dir))


@query("SELECT c_mktsegment AS mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def unseen_customers(spark, sf_dir):
    """The seen/unseen split as an anti join: customers without an urgent order."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("written"), "c_mktsegment")
    seen = priors.seen_vocabulary(read_table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("written")))
    return priors.unseen(c, seen).groupBy(F.col("c_mktsegment").alias("mktsegment")).agg(F.count("*").alias("n"))


@query()
def evaluate_normalization(spark, sf_dir):
    """Accuracy by class of the engine on written forms of order columns, the classes being known.

    Each different value is written, said and judged once, dealt over all tasks; its rows only carry whether it was right.
    """
    o, value = read_table(spark, sf_dir, "orders"), ["class", "n", "amount"]
    one = lambda kind, n, amount: F.struct(F.lit(kind).alias("class"), n.cast("long").alias("n"), amount.cast(o.schema["o_totalprice"].dataType).alias("amount"))
    none = F.lit(None)
    each = o.select(F.col("o_orderkey").alias("sent_id"), F.explode(F.array(one("DATE", F.year("o_orderdate"), none), one("CARDINAL", F.col("o_orderkey"), none), one("MONEY", none, F.col("o_totalprice")))).alias("r")).select("sent_id", "r.*")
    forms = each.select(*value).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind, n, amount = (F.col(c) for c in value)
    written = F.when(kind == "DATE", F.date_format(F.make_date(n.cast("int"), F.lit(1), F.lit(1)), "yyyy")).when(kind == "CARDINAL", n.cast("string")).otherwise(F.concat(F.lit("$"), F.format_number(amount.cast("decimal(20,2)"), 2)))
    said = units(forms.select(F.struct(*value).alias("k"), written.alias("written")), "k", "written").groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "spoken"))), lambda s: s["spoken"]), " ").alias("first"))
    target = F.when(kind == "DATE", say.year(n)).when(kind == "CARDINAL", say.cardinal(n)).otherwise(say.money(amount))
    judged = evaluate.scored(said.select("k.*", "first").select(*value, target.alias("target"), F.array("first").alias("said"))).select(*[F.col(c).alias(f"_{c}") for c in value], "first", "any")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in value]
    right = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return evaluate.accuracy(each.join(judged, same, "left").select("class", "sent_id", right("first"), right("any")), ["class"])


@query(f"""WITH c AS (SELECT o_custkey AS cluster, count(*) FILTER (o_orderpriority LIKE '1%') AS d, count(*) AS w FROM orders GROUP BY 1),
a AS (SELECT d, w, r, ((cluster % {evaluate.PRIME} + 17) * 48271 % {evaluate.PRIME} + r * 69621) % {evaluate.PRIME} AS m FROM c, range(1, 201) AS t(r)),
u AS (SELECT d, w, r, list_count(list_filter({evaluate._poisson_marks()}, lambda x: (m * m + 12345) % {evaluate.PRIME} * 16807 % {evaluate.PRIME} >= x)) AS n FROM a), s AS (SELECT sum(d * n) / sum(w * n) AS ratio FROM u GROUP BY r)
SELECT round(quantile_cont(ratio, 0.025), 9) AS low, round(quantile_cont(ratio, 0.975), 9) AS high FROM s""")
def evaluate_interval(spark, sf_dir):
    """A bootstrap interval of the share of urgent orders, customers being the clusters."""
    clusters = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cluster")).agg(F.count_if(F.col("o_orderpriority").startswith("1")).alias("v"), F.count("*").alias("w"))
    return evaluate.bootstrap(clusters, "v", "w").select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice > 150000 AS v FROM orders), b AS (SELECT l_orderkey AS k, count(*) > 3 AS v FROM lineitem GROUP BY 1)
SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' WHEN b.v THEN 'gained' ELSE 'lost' END AS change, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def compare_order_runs(spark, sf_dir):
    """Outcomes by the orders against outcomes by their lines; keys that one of the tables lacks are added or removed."""
    a = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") > 150000).alias("v"))
    b = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.count("*") > 3).alias("v"))
    return evaluate.compare_runs(a, b, ["k"], "v").groupBy("change").agg(F.count("*").alias("n"))


def _words(spark, sf_dir) -> DataFrame:
    """The distinct words of the names in the small tables, with case, dots and digits as they are written."""
    named = [("part", "p_name"), ("part", "p_type"), ("part", "p_brand"), ("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("events", "event_type")]
    each = [read_table(spark, sf_dir, t).select(F.explode(F.split(F.col(c), "[ -]+")).alias("word")).distinct() for t, c in named]
    out = each[0]
    for e in each[1:]:
        out = out.unionAll(e)
    return out.where("word <> ''").distinct()


_WORDS_SQL = " UNION ".join(
    f"SELECT unnest(string_split_regex({c}, '[ -]+')) AS word FROM {t}"
    for t, c in [("part", "p_name"), ("part", "p_type"), ("part", "p_brand"), ("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("events", "event_type")]
)
_LETTER_KEY = "concat_ws(':', CAST(least(length({0}), 6) AS VARCHAR), CASE WHEN {0} = upper({0}) THEN 'upper' WHEN {0} = lower({0}) THEN 'lower' ELSE 'mixed' END, CASE WHEN regexp_matches({0}, '[aeiouyAEIOUY]') THEN 'vowel' ELSE 'none' END)"
_CV = "regexp_replace(regexp_replace(regexp_replace(lower({}), '[aeiouy]', '*', 'g'), '[a-z]', 'c', 'g'), '[*]', 'v', 'g')"


@query(f"""WITH w AS (SELECT DISTINCT word, regexp_replace(word, '[^A-Za-z]', '', 'g') AS l FROM ({_WORDS_SQL}) WHERE word <> '')
SELECT word, {_LETTER_KEY.format('word')} AS letter_key, {_CV.format('word')} AS pattern, regexp_replace(lower(word), '[.]$', '') AS fold,
  CASE WHEN l = '' THEN 'none' WHEN l = upper(l) THEN 'upper' WHEN l = lower(l) THEN 'lower' WHEN l = upper(left(l, 1)) || lower(substr(l, 2)) THEN 'title' ELSE 'mixed' END AS cased FROM w""")
def word_keys(spark, sf_dir):
    """The keys under which priors of words, acronyms and abbreviations are counted."""
    w = F.col("word")
    return _words(spark, sf_dir).select("word", tf.letter_key(w).alias("letter_key"), tf.consonant_vowel(w).alias("pattern"), tf.fold_key(w).alias("fold"), tf.written_case(w).alias("cased"))


@query(r"""WITH u AS (SELECT url, string_split_regex(url, '[0-9]+') AS g, regexp_extract_all(url, '[0-9]+') AS h FROM pages WHERE url IS NOT NULL)
SELECT array_to_string(list_transform(generate_series(1, len(g)), lambda i: g[i] || coalesce('N' || CAST(length(h[i]) AS VARCHAR), '')), '') AS shape, count(*) AS n FROM u GROUP BY 1""")
def width_shapes(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").where("url IS NOT NULL").groupBy(tf.width_shape(F.col("url")).alias("shape")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT user_id, event_id, event_type AS token, lag(event_type) OVER w AS b1, lag(event_type, 2) OVER w AS b2, lead(event_type) OVER w AS a1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT coalesce(b2, '<s>') || ' ' || coalesce(b1, '<s>') AS before, token, coalesce(a1, '</s>') AS after, count(*) AS n FROM t GROUP BY ALL""")
def neighbour_events(spark, sf_dir):
    """The tokens before and after each token of a user's line of events."""
    tokens = read_table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("token"))
    found = choices.neighbours(tokens, ["user_id"], 2, 1)
    return found.groupBy(F.array_join("before", " ").alias("before"), "token", F.array_join("after", " ").alias("after")).agg(F.count("*").alias("n"))


def _spelled(spark, sf_dir) -> DataFrame:
    """Labelled rows (class, written, spoken): market segments, spelled out where the account is in debt."""
    c = read_table(spark, sf_dir, "customer")
    apart = F.array_join(F.split(F.lower("c_mktsegment"), ""), " ")
    return c.select(F.lit("LETTERS").alias("class"), F.col("c_mktsegment").alias("written"), F.when(F.col("c_acctbal") < 0, apart).otherwise(F.lower("c_mktsegment")).alias("spoken"))


@query(f"""WITH r AS (SELECT c_mktsegment AS w, c_acctbal < 0 AS apart FROM customer),
k AS (SELECT unnest(['*', {_LETTER_KEY.format('w')}, 'cv:' || {_CV.format('w')}, 'surface:' || w]) AS key, apart FROM r)
SELECT key, count(*) FILTER (apart) AS spelled, count(*) FILTER (NOT apart) AS said FROM k GROUP BY 1""")
def prior_acronyms(spark, sf_dir):
    return priors.acronym_priors(_spelled(spark, sf_dir))


@query(f"""WITH r AS (SELECT c_mktsegment AS w, c_acctbal < 0 AS apart FROM customer), k AS (SELECT 0 AS level, '*' AS key, w, apart FROM r UNION ALL SELECT 1, {_LETTER_KEY.format('w')}, w, apart FROM r
  UNION ALL SELECT 2, 'cv:' || {_CV.format('w')}, w, apart FROM r UNION ALL SELECT 3, 'surface:' || w, w, apart FROM r),
c AS (SELECT level, key, count(*) FILTER (apart) AS s, count(*) AS n FROM k GROUP BY 1, 2),
a AS (SELECT word, s0.s AS s0, s0.n AS n0, s1.s AS s1, s1.n AS n1, s2.s AS s2, s2.n AS n2, s3.s AS s3, s3.n AS n3 FROM (SELECT DISTINCT word FROM ({_WORDS_SQL}) WHERE regexp_matches(word, '^[A-Z][A-Z]+$'))
  LEFT JOIN c AS s0 ON s0.key = '*' LEFT JOIN c AS s1 ON s1.key = {_LETTER_KEY.format('word')} LEFT JOIN c AS s2 ON s2.key = 'cv:' || {_CV.format('word')} LEFT JOIN c AS s3 ON s3.key = 'surface:' || word),
p0 AS (SELECT *, CAST(coalesce(s0, 0) AS DOUBLE) / coalesce(n0, 1) AS q0 FROM a), p1 AS (SELECT *, (coalesce(s1, 0) + 5 * q0) / (coalesce(n1, 0) + 5) AS q1 FROM p0),
p2 AS (SELECT *, (coalesce(s2, 0) + 5 * q1) / (coalesce(n2, 0) + 5) AS q2 FROM p1)
SELECT word, round((coalesce(s3, 0) + 5 * q2) / (coalesce(n3, 0) + 5), 9) AS share, CASE WHEN n3 IS NOT NULL THEN 'surface' WHEN n2 IS NOT NULL THEN 'pattern' WHEN n1 IS NOT NULL THEN 'shape' ELSE 'all' END AS level FROM p2""")
def acronym_shares(spark, sf_dir):
    """The chance that a run of capitals is spelled out, by the counts of its surface, vowel pattern, shape and all runs."""
    words = _words(spark, sf_dir).where(F.col("word").rlike("^[A-Z]{2,}$"))
    return priors.acronym_shares(words, "word", priors.acronym_priors(_spelled(spark, sf_dir))).select("word", F.round("share", 9).alias("share"), "level")


@query("""WITH w AS (SELECT regexp_extract(o_orderpriority, '[A-Z]+$') AS w, o_orderstatus AS s FROM orders),
c AS (SELECT CASE s WHEN 'O' THEN w WHEN 'P' THEN upper(w[1]) || lower(w[2:]) || '.' ELSE lower(w) || '.' END AS w, s FROM w WHERE w <> '')
SELECT regexp_replace(lower(w), '[.]$', '') AS key, CASE s WHEN 'O' THEN 'upper' WHEN 'P' THEN 'title' ELSE 'lower' END AS "case", s <> 'O' AS expanded, count(*) AS n FROM c GROUP BY ALL""")
def prior_abbreviations(spark, sf_dir):
    """Priorities with a full stop are abbreviations of their name and `priority`, those of open orders are words; the case tells the status."""
    status, word = F.col("o_orderstatus"), F.regexp_extract("o_orderpriority", "[A-Z]+$", 0)
    written = F.when(status == "O", word).when(status == "P", F.concat(F.initcap(word), F.lit("."))).otherwise(F.concat(F.lower(word), F.lit(".")))
    rows = read_table(spark, sf_dir, "orders").where(word != "").select(F.lit("PLAIN").alias("class"), written.alias("written"), F.concat(F.lower(word), F.when(status == "O", "").otherwise(" priority")).alias("spoken"))
    return priors.abbreviation_priors(rows)


@query(rf"""WITH r AS (SELECT unnest(regexp_extract_all(url, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]')) AS r FROM pages)
SELECT CASE WHEN regexp_matches(r, '^[A-Za-z]') THEN 'letters' WHEN regexp_matches(r, '^[0-9]') THEN 'digits' ELSE 'sign' END AS kind,
  CASE WHEN regexp_matches(r, '^[A-Za-z]') THEN {_LETTER_KEY.format('r')} WHEN regexp_matches(r, '^[0-9]') THEN 'digits:' || CAST(length(r) AS VARCHAR) ELSE r END AS key, count(*) AS n FROM r GROUP BY ALL""")
def prior_electronic(spark, sf_dir):
    rows = read_table(spark, sf_dir, "pages").select(F.lit("ELECTRONIC").alias("class"), F.col("url").alias("written"))
    return priors.electronic_priors(rows)


@query("""SELECT 'N' || CAST(length(CAST(c_nationkey AS VARCHAR)) AS VARCHAR) || '-N' || CAST(length(CAST(c_custkey AS VARCHAR)) AS VARCHAR) AS shape, CASE WHEN c_acctbal < 0 THEN 'DIGIT' ELSE 'TELEPHONE' END AS class, count(*) AS n FROM customer GROUP BY ALL""")
def prior_telephones(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return priors.telephone_priors(c.select(F.when(F.col("c_acctbal") < 0, "DIGIT").otherwise("TELEPHONE").alias("class"), F.concat_ws("-", "c_nationkey", "c_custkey").alias("written")))


@query("""SELECT event_type AS surface, CASE WHEN count(*) FILTER (value < 1) * 2 > count(*) THEN 'spell' ELSE 'say' END AS decision, count(*) AS n FROM events WHERE length(event_type) BETWEEN 2 AND 6 GROUP BY 1
HAVING count(*) >= 5 AND greatest(count(*) FILTER (value < 1), count(*) - count(*) FILTER (value < 1)) >= 0.9 * count(*)""")
def prior_spellout(spark, sf_dir):
    """Words that are said or spelled in nine of ten rows."""
    e, t = read_table(spark, sf_dir, "events"), F.col("event_type")
    rows = e.select(t.alias("written"), F.when(F.col("value") < 1, F.array_join(F.split(t, ""), " ")).otherwise(t).alias("spoken"))
    return priors.spellout_dictionary(rows, 5, 0.9)


@query("""WITH c AS (SELECT o_custkey AS k, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT k, sum(n) AS total, max(n) AS n FROM c GROUP BY 1)
SELECT t.k, c.p, t.n, CAST(total AS BIGINT) AS total FROM t JOIN c ON c.k = t.k AND c.n = t.n WHERE t.n >= 3 AND 2 * t.n > total""")
def majority_priorities(spark, sf_dir):
    counts = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    return priors.strict_majority(counts, ["k"], "p").select("k", "p", "n", "total")


@query(r"""WITH r AS (SELECT 'CARDINAL' AS class, 'N' AS shape FROM orders UNION ALL SELECT 'DATE', 'N' FROM orders
  UNION ALL SELECT 'MONEY', '¤' || regexp_replace(format('{:,.2f}', CAST(o_totalprice AS DOUBLE)), '[0-9]+', 'N', 'g') FROM orders), c AS (SELECT shape, class, count(*) AS n FROM r GROUP BY 1, 2),
t AS (SELECT shape, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1 HAVING sum(n) >= 3),
a AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '\p{L}+', 'A', 'g'), '\p{Nd}+', 'N', 'g'), '\p{Sc}+', '¤', 'g') AS shape, 'DATE' AS class FROM pages UNION SELECT 'N', 'DATE' UNION SELECT 'N', 'MONEY' UNION SELECT '¤N,N.N', 'MONEY')
SELECT a.shape, a.class, coalesce(c.n, -1) AS n, coalesce(t.total, -1) AS total, CASE WHEN t.total IS NULL THEN 'unsupported' WHEN c.n IS NULL THEN 'attested-zero' ELSE 'measured' END AS tier
FROM a LEFT JOIN t ON t.shape = a.shape LEFT JOIN c ON c.shape = a.shape AND c.class = a.class""")
def reading_tiers(spark, sf_dir):
    """The counts behind readings of shapes: measured, attested with another class only, or unknown."""
    asked = read_table(spark, sf_dir, "pages").select(tf.shape(F.col("url")).alias("shape"), F.lit("DATE").alias("class")).where("shape IS NOT NULL")
    fixed = spark.createDataFrame([("N", "DATE"), ("N", "MONEY"), ("¤N,N.N", "MONEY")], "shape string, class string")
    return priors.reading_prior(asked.unionAll(fixed).distinct(), priors.type_priors(_written(spark, sf_dir))).fillna(-1, ["n", "total"]).select("shape", "class", "n", "total", "tier")


@query(rf"""WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS w, 'cardinal' AS c FROM orders UNION ALL SELECT strftime(o_orderdate, '%Y'), 'date' FROM orders), f AS (SELECT substr(w, 1, 2) AS century, c, count(*) AS n FROM r WHERE regexp_matches(w, '^[0-9]{{4}}$') GROUP BY 1, 2),
t AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS written FROM lineitem WHERE regexp_matches(CAST(l_orderkey AS VARCHAR), '^[1-9][0-9]{{3}}$')),
{_cardinal_sql('SELECT l_orderkey AS n FROM lineitem UNION ALL SELECT l_orderkey // 100 FROM lineitem UNION ALL SELECT l_orderkey % 100 FROM lineitem UNION ALL SELECT l_orderkey // 10 % 10 FROM lineitem UNION ALL SELECT l_orderkey // 100 % 10 FROM lineitem UNION ALL SELECT l_orderkey % 10 FROM lineitem UNION ALL SELECT l_orderkey // 1000 % 10 FROM lineitem')},
x AS (SELECT written, k.choice, coalesce(f.n, 0) AS n, k.place, CAST(written AS BIGINT) AS y FROM t CROSS JOIN (VALUES ('date', 0), ('cardinal', 1), ('digit', 2)) AS k(choice, place) LEFT JOIN f ON f.century = substr(written, 1, 2) AND f.c = k.choice)
SELECT written, choice, x.n AS n, row_number() OVER (PARTITION BY written ORDER BY x.n DESC, place) AS rank, CASE choice WHEN 'cardinal' THEN yw.w WHEN 'date' THEN {_YEAR}
  ELSE concat_ws(' ', d3.w, CASE WHEN d2.n = 0 THEN 'o' ELSE d2.w END, CASE WHEN d1.n = 0 THEN 'o' ELSE d1.w END, CASE WHEN d0.n = 0 THEN 'o' ELSE d0.w END) END AS spoken
FROM x JOIN words AS yw ON yw.n = y JOIN words AS hw ON hw.n = y // 100 JOIN words AS lw ON lw.n = y % 100
JOIN words AS d3 ON d3.n = y // 1000 JOIN words AS d2 ON d2.n = y // 100 % 10 JOIN words AS d1 ON d1.n = y // 10 % 10 JOIN words AS d0 ON d0.n = y % 10""")
def four_digit_forms(spark, sf_dir):
    """The forms of bare four-digit tokens (year, number, digits), ranked by how tokens of their century are read."""
    tokens = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("written")).where(F.col("written").rlike(r"\A[1-9][0-9]{3}\z")).distinct()
    return choices.four_digit_forms(tokens, priors.century_priors(_written(spark, sf_dir)))


from . import contexts, forms, signs  # noqa: E402, F401  their queries register themselves here
