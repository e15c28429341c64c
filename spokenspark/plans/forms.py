"""Registered queries of ranked forms: products of choices, covers and what sentences keep together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import locale_rules
from ..functions import spellout as say
from ..functions import text as tf
from ..operators import alternatives, compose, detect, electronic, filters, locales, resolve, respelling, sentences, telephone
from ..operators.detect import READING
from ..sources.tables import read_table
from . import evaluate, running
from .priors import STRENGTH
from .queries import _CENTS, _LETTER_KEY, _MONTHS, _ONES, _YEAR, _cardinal_sql, _ordinal_sql, _recognized, _recognized_sql, _years_sql, query

_DIGIT_WORDS = f"array_to_string(list_transform(regexp_extract_all({{}}, '[0-9]'), lambda d: CASE WHEN d = '0' THEN 'o' ELSE ([{_ONES}])[CAST(d AS INTEGER) + 1] END), ' ')"
_SIGNS = ", ".join(f"('{s}', {i}, '{n}')" for s, names in electronic.SIGN_NAMES.items() for i, n in enumerate(names))


def _heard_addresses(spark, sf_dir) -> DataFrame:
    """Labelled rows (written, spoken) from the pages' URLs: some short or vowelless runs spelled, some numbers said whole, by page."""
    page, run = F.col("page_id"), F.col("run")
    spelled = (F.length(run) > 1) & (~run.rlike("(?i)[aeiouy]") | ((page % 3 == 0) & (F.length(run) <= 3)))
    whole = run.rlike(r"\A[1-9][0-9]{1,8}\z") & (page % 5 == 0)
    year = run.rlike(r"\A[1-9][0-9]{3}\z") & (page % 2 == 0)
    names = F.create_map(*[F.lit(x) for k, v in electronic.SIGN_NAMES.items() for x in (k, v[0])])
    letters = F.when(spelled, F.array_join(F.split(F.lower(run), ""), " ")).otherwise(F.lower(run))
    digits = F.when(year, say.year(run.cast("long"))).when(whole, say.cardinal(run.cast("long"))).otherwise(say.digits(run))
    sign = F.when((run == "-") & (page % 4 == 0), "hyphen").otherwise(F.coalesce(F.element_at(names, run), run))
    spoken = F.when(electronic.kind_of(run) == "letters", letters).when(run.rlike(r"\A[0-9]{1,9}\z"), digits).when(electronic.kind_of(run) == "digits", say.digits(run)).otherwise(sign)
    runs = read_table(spark, sf_dir, "pages").where("url <> ''").select("page_id", "url", F.posexplode(tf.runs(F.col("url"))).alias("pos", "run"))
    said = runs.groupBy("page_id", "url").agg(F.array_sort(F.collect_list(F.struct("pos", spoken.alias("s")))).alias("_s"))
    return said.select(F.col("url").alias("written"), F.array_join(F.transform("_s", lambda x: x["s"]), " ").alias("spoken"))


_RUNS_SQL = rf"""runs AS (SELECT page_id, url, unnest(rs) AS run, generate_subscripts(rs, 1) AS pos FROM (SELECT page_id, url, regexp_extract_all(url, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]') AS rs FROM pages WHERE url <> '')),
keyed AS (SELECT *, CASE WHEN regexp_matches(run, '^[A-Za-z]') THEN 'letters' WHEN regexp_matches(run, '^[0-9]') THEN 'digits' ELSE 'sign' END AS kind,
  CASE WHEN regexp_matches(run, '^[A-Za-z]') THEN {_LETTER_KEY.format('run')} WHEN regexp_matches(run, '^[0-9]') THEN 'digits:' || CAST(length(run) AS VARCHAR) ELSE run END AS key,
  regexp_matches(run, '^[1-9][0-9]{{3}}$') AS four, regexp_matches(run, '^[1-9][0-9]{{1,8}}$') AS whole FROM runs),
sign_names AS (SELECT * FROM (VALUES {_SIGNS}) AS s(run, i, name)),
heard AS (SELECT kind, key, CASE kind WHEN 'letters' THEN CASE WHEN length(run) > 1 AND (NOT regexp_matches(run, '[aeiouyAEIOUY]') OR page_id % 3 = 0 AND length(run) <= 3) THEN 'spelled' ELSE 'word' END
    WHEN 'digits' THEN CASE WHEN four AND page_id % 2 = 0 THEN CASE WHEN CAST(run AS INTEGER) // 100 % 10 = 0 AND CAST(run AS INTEGER) % 100 < 10 THEN 'cardinal' ELSE 'year' END WHEN whole AND page_id % 5 = 0 THEN 'cardinal' ELSE 'digits' END
    ELSE CASE WHEN run = '-' AND page_id % 4 = 0 THEN 'hyphen' ELSE coalesce((SELECT name FROM sign_names AS s WHERE s.run = keyed.run AND i = 0), run) END END AS reading FROM keyed),
counts AS (SELECT kind, key, reading, count(*) AS n FROM (SELECT * FROM heard UNION ALL SELECT kind, '*', reading FROM heard) GROUP BY ALL)"""


@query(f"WITH {_RUNS_SQL} SELECT kind, key, reading, n FROM counts")
def prior_electronic_readings(spark, sf_dir):
    """How runs of addresses are read, found by going through written and spoken forms together."""
    return electronic.heard(_heard_addresses(spark, sf_dir))


@query(f"""WITH RECURSIVE {_RUNS_SQL},
{_cardinal_sql("SELECT CAST(run AS BIGINT) AS n FROM keyed WHERE whole UNION ALL SELECT CAST(run AS BIGINT) // 100 FROM keyed WHERE four UNION ALL SELECT CAST(run AS BIGINT) % 100 FROM keyed WHERE four")},
each AS (SELECT DISTINCT run, kind, key, four, whole, CASE WHEN whole THEN CAST(run AS BIGINT) END AS y FROM keyed),
forms AS (SELECT run, kind, key, 0 AS i, 'word' AS reading, lower(run) AS spoken FROM each WHERE kind = 'letters'
  UNION ALL SELECT run, kind, key, 1, 'spelled', array_to_string(string_split(lower(run), ''), ' ') FROM each WHERE kind = 'letters' AND length(run) > 1
  UNION ALL SELECT run, kind, key, 0, 'digits', {_DIGIT_WORDS.format('run')} FROM each WHERE kind = 'digits'
  UNION ALL SELECT run, kind, key, 1, 'cardinal', w FROM each JOIN words ON words.n = y WHERE whole
  UNION ALL SELECT run, kind, key, 2, 'year', {_YEAR} FROM each JOIN words AS yw ON yw.n = y JOIN words AS hw ON hw.n = y // 100 JOIN words AS lw ON lw.n = y % 100 WHERE four
  UNION ALL SELECT e.run, kind, key, coalesce(i, 0), coalesce(name, e.run), coalesce(name, e.run) FROM each AS e LEFT JOIN sign_names AS s ON s.run = e.run WHERE kind = 'sign'),
totals AS (SELECT kind, key, sum(n) AS total FROM counts GROUP BY ALL),
priced AS (SELECT f.*, CASE WHEN f.kind = 'sign' THEN coalesce(c.n, 0) / t.total ELSE (coalesce(c.n, 0) + {STRENGTH} * (coalesce(a.n, 0) / tall.total)) / (t.total + {STRENGTH}) END AS share
  FROM forms AS f JOIN totals AS t ON t.kind = f.kind AND t.key = f.key JOIN totals AS tall ON tall.kind = f.kind AND tall.key = '*'
  LEFT JOIN counts AS c ON c.kind = f.kind AND c.key = f.key AND c.reading = f.reading LEFT JOIN counts AS a ON a.kind = f.kind AND a.key = '*' AND a.reading = f.reading),
options AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY i) - 1 AS i, spoken, CAST(round(-ln(share) * {compose.UNIT}, 0) AS BIGINT) AS cost FROM priced WHERE share > 0),
places AS (SELECT DISTINCT url, pos, run FROM runs), lengths AS (SELECT url, max(pos) AS n FROM runs GROUP BY 1),
products AS (SELECT url, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS cost, CAST([] AS BIGINT[]) AS picks, '' AS spoken FROM lengths
  UNION ALL SELECT p.url, p.pos + 1, p.cost + o.cost, list_append(p.picks, o.i), CASE WHEN p.pos = 0 THEN o.spoken ELSE p.spoken || ' ' || o.spoken END FROM products AS p JOIN places AS r ON r.url = p.url AND r.pos = p.pos + 1 JOIN options AS o ON o.run = r.run),
best AS (SELECT p.*, row_number() OVER (PARTITION BY p.url ORDER BY cost, picks) AS place FROM products AS p JOIN lengths AS l ON l.url = p.url AND l.n = p.pos),
once AS (SELECT url, spoken, min(place) AS place, min_by(cost, place) AS cost FROM best WHERE place <= {compose.BEAM} GROUP BY 1, 2)
SELECT url, row_number() OVER (PARTITION BY url ORDER BY place) AS rank, spoken, cost FROM once""")
def url_readings(spark, sf_dir):
    """The eight likeliest readings of every different URL; the SQL ranks all products."""
    return electronic.readings(read_table(spark, sf_dir, "pages"), "url", electronic.heard(_heard_addresses(spark, sf_dir)))


#: Lines of an order as overlapping spans.
_SPANS = ("CAST(l_partkey % 40 AS INTEGER)", "CAST(l_partkey % 40 + 1 + l_suppkey % 12 AS INTEGER)")
COVERS = 10


@query(f"""WITH RECURSIVE spans AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e) AS i FROM (SELECT l_orderkey AS k, {_SPANS[0]} AS s, {_SPANS[1]} AS e, max(CAST(l_quantity AS BIGINT) % 3) AS c FROM lineitem GROUP BY 1, 2, 3)),
covers AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, CAST(0 AS INTEGER) AS "end", CAST(0 AS BIGINT) AS covered, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS captures, CAST([] AS INTEGER[]) AS early, CAST([] AS VARCHAR[]) AS chain FROM spans
  UNION ALL SELECT c.k, x.i, x.e, c.covered + x.e - x.s, c.n + 1, c.captures + x.c, c.early || [x.s, x.e], list_append(c.chain, x.s || '-' || x.e) FROM covers AS c JOIN spans AS x ON x.k = c.k AND x.i > c.i AND x.s >= c."end"),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY covered DESC, n, captures DESC, early) AS rank, count(*) OVER (PARTITION BY k) AS n_covers FROM covers),
top AS (SELECT k, covered, n, captures FROM placed WHERE rank = 1),
next_ AS (SELECT p.k, min({{'a': t.covered - p.covered, 'b': p.n - t.n, 'c': t.captures - p.captures}}) AS m FROM placed AS p JOIN top AS t ON t.k = p.k WHERE (p.covered, p.n, p.captures) <> (t.covered, t.n, t.captures) GROUP BY 1)
SELECT p.k, rank, covered, n AS spans, captures, array_to_string(chain, ',') AS chain, n_covers, m.a AS margin_covered, m.b AS margin_spans, m.c AS margin_captures, n_covers > {COVERS} AS truncated FROM placed AS p JOIN next_ AS m ON m.k = p.k WHERE rank <= {COVERS}""")
def cover_ranks(spark, sf_dir):
    """The ten best covers of each order's lines as spans, with their number and the margin of the best; the SQL lists all covers."""
    lines = read_table(spark, sf_dir, "lineitem")
    one = F.struct(F.expr("cast(l_partkey % 40 AS int)").alias("start"), F.expr("cast(l_partkey % 40 + 1 + l_suppkey % 12 AS int)").alias("end"), F.lit(0).alias("rank"), F.lit("").alias("type"), F.repeat(F.lit("x"), F.expr("cast(l_quantity AS int) % 3")).alias("surface"))
    spans = lines.select(F.col("l_orderkey").alias("k"), one.alias("c")).groupBy("k", "c.start", "c.end", "c.rank", "c.type").agg(F.max("c.surface").alias("surface"))
    found = spans.groupBy("k").agg(F.collect_list(F.struct("start", "end", "rank", "type", "surface")).cast(READING).alias("found"))
    each = found.select("k", resolve.ranked_covers(F.col("found"), COVERS, lambda c: F.length(c["surface"])).alias("r")).select("k", "r.*").select("k", F.posexplode("covers").alias("at", "c"), "n_covers", "margin", "truncated")
    chain = F.array_join(F.transform("c.chain", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return each.select(
        "k", (F.col("at") + 1).cast("long").alias("rank"), F.col("c.covered").cast("long").alias("covered"), (-F.col("c.fewer")).cast("long").alias("spans"), F.col("c.captures").cast("long").alias("captures"), chain.alias("chain"), F.col("n_covers").cast("long").alias("n_covers"),
        F.col("margin.covered").cast("long").alias("margin_covered"), F.col("margin.spans").cast("long").alias("margin_spans"), F.col("margin.captures").cast("long").alias("margin_captures"), "truncated",
    )


#: Code points of a sentence in the query, so that some are longer.
LONGEST = 400
_WS = r"[\t\n\v\f\r ]"
_GAP_SQL = rf"[.!?…]{_WS}+[\p{{Lu}}\x22\x27“(0-9]|\n{_WS}*\n"
_BEFORE = r"(?:^|[^\p{L}\p{Nd}_])"
_DOTTED_SQL = "|".join(w.replace(".", r"\.") for w in sentences.EXCEPTIONS)
_MONTH_SQL = "|".join([m[:3] for m in say.MONTHS] + ["Sept"])


@query(rf"""WITH d AS (SELECT 'd:' || doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'c:' || conv_id || ':' || turn, text FROM conversations WHERE text IS NOT NULL),
hits AS (SELECT id, t, unnest(h) AS h, unnest(g[1:len(h)]) AS g, generate_subscripts(h, 1) AS i FROM (SELECT id, t, regexp_extract_all(t, '{_GAP_SQL}') AS h, string_split_regex(t, '{_GAP_SQL}') AS g FROM d)),
ends AS (SELECT *, CAST(sum(length(g) + length(h)) OVER (PARTITION BY id ORDER BY i) AS BIGINT) AS e FROM hits),
found AS (SELECT id, t, h, CASE WHEN h[1] = chr(10) THEN e - length(h) ELSE e - length(h) + 1 END AS s, CASE WHEN h[1] = chr(10) THEN e ELSE e - 1 END AS e FROM ends),
held AS (SELECT *, substr(t, greatest(s - 31, 1), s - greatest(s - 31, 1) + 1) AS before FROM found),
free AS (SELECT * FROM held WHERE NOT regexp_matches(before, '{_BEFORE}(?:{_DOTTED_SQL}|\p{{Lu}}\.)$') AND NOT (e = s + 1 AND regexp_matches(substr(t, e + 1, 1), '[0-9]') AND regexp_matches(before, '{_BEFORE}(?:{_MONTH_SQL})\.$'))),
cuts AS (SELECT id, t, s, e FROM free UNION ALL SELECT id, t, CAST(length(t) AS BIGINT), CAST(length(t) AS BIGINT) FROM d),
sents AS (SELECT id, a, substr(t, a + 1, s - a) AS x FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s, e), 0) AS a FROM cuts) WHERE s > a),
pieces AS (SELECT id, a, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT id, a, CASE WHEN length(x) > {LONGEST} THEN regexp_extract_all(x, '(?s).{{1,{LONGEST}}}\z|.{{0,{LONGEST - 1}}}{_WS}|.{{1,{LONGEST}}}') ELSE [x] END AS p FROM sents)),
placed AS (SELECT id, a + sum(length(x)) OVER (PARTITION BY id, a ORDER BY i) - length(x) AS a, regexp_replace(x, '{_WS}+$', '') AS x FROM pieces)
SELECT id, count(*) AS n, CAST(max(length(x)) AS BIGINT) AS longest, sha256(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || x, '|' ORDER BY a)) AS sha FROM placed WHERE x <> '' GROUP BY 1""")  # fmt: skip
def sentence_spans(spark, sf_dir):
    """Number, longest and checksum of the sentences of each document and turn: cut around exceptions, initials and dates, and by length."""
    docs = read_table(spark, sf_dir, "documents").select(F.concat(F.lit("d:"), "doc_id").alias("id"), "text")
    turns = read_table(spark, sf_dir, "conversations").select(F.concat(F.lit("c:"), "conv_id", F.lit(":"), "turn").alias("id"), "text")
    found = sentences.sentences(F.col("text"), longest=LONGEST)
    said = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"].cast("string"), x["sent"])), "|")
    each = docs.unionAll(turns).select("id", found.alias("s")).where(F.size("s") > 0)
    return each.select("id", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", lambda x: F.length(x["sent"]))).cast("long").alias("longest"), F.sha2(said, 256).alias("sha"))


@query(f"""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS id, {_SPANS[0]} AS start, {_SPANS[1]} AS "end", CAST(l_quantity AS INTEGER) % 3 AS captures FROM lineitem),
m AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS o WHERE o.k = s.k AND o.start <= s.start AND o."end" >= s."end" AND (o.start <> s.start OR o."end" <> s."end")))
SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS o WHERE o.k = m.k AND o.start = m.start AND o."end" = m."end" AND o.captures > m.captures)""")
def maximal_lines(spark, sf_dir):
    """An order's lines as spans: those in no larger span, and of equal ones those with the most captures."""
    lines = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), F.expr("cast(l_partkey % 40 AS int)").alias("start"), F.expr("cast(l_partkey % 40 + 1 + l_suppkey % 12 AS int)").alias("end"),
        F.expr("cast(l_quantity AS int) % 3").alias("captures"),
    )
    return filters.most_captured(filters.maximal_rows(lines, ["k"]), ["k"], "captures")


#: Columns of a plan in both languages: a country's own rule, and one for its numbers that begin with a certain digit.
_PLAN = """SELECT CAST(10 + n_nationkey AS STRING) AS country, '' AS area, 7 AS least, 9 AS most, n_regionkey AS r FROM nation
UNION ALL SELECT CAST(10 + n_nationkey AS STRING), CAST(1 + n_nationkey % 9 AS STRING), 8, 8 + n_regionkey % 2, 5 + n_regionkey FROM nation"""
_NUMBER = "concat(CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '+' END, CAST(10 + c_nationkey + c_custkey % 2 AS STRING), ' ', CAST((c_custkey + 1) * 7919 % 999983 AS STRING), '-', CAST(c_custkey % 1000 AS STRING))"


@query(f"""WITH plan AS ({_PLAN.replace('STRING', 'VARCHAR')}), n AS (SELECT DISTINCT {_NUMBER.replace('STRING', 'VARCHAR')} AS number FROM customer),
d AS (SELECT number, CASE WHEN number[1] = '+' THEN '' ELSE '10' END || regexp_replace(number, '[^0-9]', '', 'g') AS digits FROM n),
best AS (SELECT d.*, country, area, least, most, r, row_number() OVER (PARTITION BY number ORDER BY length(area) DESC) AS place FROM d LEFT JOIN plan ON starts_with(digits, country || area)),
v AS (SELECT *, substr(digits, length(country) + 1) AS national FROM best WHERE place = 1),
o AS (SELECT *, coalesce(length(national) BETWEEN least AND most AND length(digits) <= 15, false) AS valid, 2 + r % 3 AS a, 2 + r % 2 AS b FROM v)
SELECT number, country, country || area AS prefix, valid, CASE WHEN valid THEN concat_ws('-', nullif(substr(national, 1, a), ''), nullif(substr(national, a + 1, b), ''), nullif(substr(national, a + b + 1), '')) END AS groups FROM o""")
def planned_telephones(spark, sf_dir):
    """Numbers made of customers' keys against a plan made of the nations: which prefix counts, whether the length fits, the groups."""
    nation = read_table(spark, sf_dir, "nation")
    widths = F.array(2 + F.col("r") % 3, 2 + F.col("r") % 2, F.lit(9))
    country = (10 + F.col("n_nationkey")).cast("string")
    whole = nation.select(country.alias("country"), F.lit("").alias("area"), F.lit(7).alias("least"), F.lit(9).alias("most"), F.col("n_regionkey").alias("r"))
    part = nation.select(country, (1 + F.col("n_nationkey") % 9).cast("string"), F.lit(8), (8 + F.col("n_regionkey") % 2).cast("int"), 5 + F.col("n_regionkey"))
    plan = whole.unionAll(part).withColumn("widths", widths)
    numbers = read_table(spark, sf_dir, "customer").select(F.expr(_NUMBER).alias("number"))
    return telephone.planned(numbers, "number", plan, home="10").select("number", "country", "prefix", "valid", F.array_join("groups", "-").alias("groups"))


_MARKS = " + ".join(f"CAST(u >= {m} AS BIGINT)" for m in evaluate._poisson_marks())
_P = evaluate.PRIME


@query(f"""WITH c AS (SELECT o_custkey AS cluster, count(*) FILTER (o_orderpriority LIKE '2%') - count(*) FILTER (o_orderpriority LIKE '1%') AS d, count(*) AS w FROM orders GROUP BY 1),
a AS (SELECT d, w, r, ((cluster % {_P} + 17) * 48271 % {_P} + r * 69621) % {_P} AS m FROM c, range(1, 201) AS t(r)), u AS (SELECT d, w, r, (m * m + 12345) % {_P} * 16807 % {_P} AS u FROM a),
s AS (SELECT r, sum(d * ({_MARKS})) / sum(w * ({_MARKS})) AS ratio FROM u GROUP BY 1)
SELECT round((SELECT sum(d) / sum(w) FROM c), 9) AS delta, round(quantile_cont(ratio, 0.025), 9) AS low, round(quantile_cont(ratio, 0.975), 9) AS high FROM s""")
def paired_interval(spark, sf_dir):
    """How much larger the share of high orders is than that of urgent ones, with an interval by clusters of customers."""
    priority = F.col("o_orderpriority")
    clusters = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cluster")).agg(F.count_if(priority.startswith("1")).alias("a"), F.count_if(priority.startswith("2")).alias("b"), F.count("*").alias("w"))
    return evaluate.paired_bootstrap(clusters, "a", "b", "w").select(*[F.round(c, 9).alias(c) for c in ("delta", "low", "high")])


@query("""SELECT event_id, event_type, place FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('17|' || event_id), event_id) AS place FROM events) WHERE place <= 20""")
def sampled_events(spark, sf_dir):
    """Twenty events of each type by the hash of their number."""
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    return evaluate.sampled(events, ["event_id"], 20, ["event_type"])


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


#: Number words of five locales in SQL, written apart from the rules: below 20 (30 in Spanish), tens from 20, and how hundreds and thousands are put together.
_LOW = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve",
    "sv": "noll ett två tre fyra fem sex sju åtta nio tio elva tolv tretton fjorton femton sexton sjutton arton nitton",
}
_TENS_OF = {
    "en": "twenty thirty forty fifty sixty seventy eighty ninety", "de": "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig", "fr": "vingt trente quarante cinquante soixante",
    "es": "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa", "sv": "tjugo trettio fyrtio femtio sextio sjuttio åttio nittio",
}
_T = {k: f"({_list(v)})[n // 10 - 1]" for k, v in _TENS_OF.items()}
_O = {k: f"({_list(v)})[n % 10 + 1]" for k, v in _LOW.items()}
_ABOVE = {
    "en": f"{_T['en']} || CASE WHEN n % 10 > 0 THEN '-' || {_O['en']} ELSE '' END", "de": f"CASE WHEN n % 10 = 0 THEN '' WHEN n % 10 = 1 THEN 'einund' ELSE {_O['de']} || 'und' END || {_T['de']}",
    "fr": f"CASE WHEN n = 71 THEN 'soixante et onze' WHEN n = 80 THEN 'quatre-vingts' WHEN n >= 80 THEN 'quatre-vingt-' || ({_list(_LOW['fr'])})[n - 79] WHEN n >= 70 THEN 'soixante-' || ({_list(_LOW['fr'])})[n - 59] WHEN n % 10 = 0 THEN {_T['fr']} WHEN n % 10 = 1 THEN {_T['fr']} || ' et un' ELSE {_T['fr']} || '-' || {_O['fr']} END",
    "es": f"{_T['es']} || CASE WHEN n % 10 > 0 THEN ' y ' || {_O['es']} ELSE '' END", "sv": f"{_T['sv']} || CASE WHEN n % 10 > 0 THEN {_O['sv']} ELSE '' END",
}
_HUNDREDS = {
    "en": "concat_ws(' ', h.w || ' hundred', r.w)", "de": "concat(CASE WHEN h.n = 1 THEN 'ein' ELSE h.w END || 'hundert', r.w)",
    "fr": "concat_ws(' ', CASE WHEN h.n = 1 THEN 'cent' WHEN r.w IS NULL THEN h.w || ' cents' ELSE h.w || ' cent' END, r.w)",
    "es": f"concat_ws(' ', CASE WHEN h.n = 1 AND r.w IS NULL THEN 'cien' ELSE ({_list('ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos')})[h.n] END, r.w)", "sv": "concat(h.w || 'hundra', r.w)",
}
_SHORT = {"en": "{}", "de": "regexp_replace({}, 'eins$', 'ein')", "fr": "regexp_replace({}, '(cent|vingt)s$', '\\1')", "es": "regexp_replace(regexp_replace({}, 'veintiuno$', 'veintiún'), 'uno$', 'un')", "sv": "{}"}
_THOUSANDS = {"en": "concat_ws(' ', k.w || ' thousand', r.w)", "de": "concat(k.s || 'tausend', r.w)", "fr": "concat_ws(' ', CASE WHEN k.n = 1 THEN 'mille' ELSE k.s || ' mille' END, r.w)", "es": "concat_ws(' ', CASE WHEN k.n = 1 THEN 'mil' ELSE k.s || ' mil' END, r.w)", "sv": "concat(CASE WHEN k.n = 1 THEN 'ettusen' ELSE k.w || 'tusen' END, r.w)"}
_LOCALES = list(_LOW)
_EACH = lambda text: " UNION ALL ".join(text(x) for x in _LOCALES)
#: Words w, and s as they stand before a noun, of 0 to 999 and of the column n of `asked`, by locale.
_LOCALE_WORDS = f"""tens AS ({_EACH(lambda x: f"SELECT '{x}' AS locale, n, CASE WHEN n < {30 if x == 'es' else 20} THEN ({_list(_LOW[x])})[n + 1] ELSE {_ABOVE[x]} END AS w FROM range(100) AS t(n)")}),
hundreds AS ({_EACH(lambda x: f"SELECT '{x}' AS locale, g.n, CASE WHEN g.n < 100 THEN z.w ELSE {_HUNDREDS[x]} END AS w FROM range(1000) AS g(n) LEFT JOIN tens AS h ON h.locale = '{x}' AND h.n = g.n // 100 LEFT JOIN tens AS r ON r.locale = '{x}' AND r.n = g.n % 100 AND r.n > 0 LEFT JOIN tens AS z ON z.locale = '{x}' AND z.n = g.n")}),
small AS ({_EACH(lambda x: f"SELECT locale, n, w, {_SHORT[x].format('w')} AS s FROM hundreds WHERE locale = '{x}'")}),
large AS ({_EACH(lambda x: f"SELECT '{x}' AS locale, a.n, CASE WHEN a.n < 1000 THEN z.w ELSE {_THOUSANDS[x]} END AS w FROM (SELECT DISTINCT n FROM asked) AS a LEFT JOIN small AS k ON k.locale = '{x}' AND k.n = a.n // 1000 LEFT JOIN small AS r ON r.locale = '{x}' AND r.n = a.n % 1000 AND r.n > 0 LEFT JOIN small AS z ON z.locale = '{x}' AND z.n = a.n")}),
spelled AS ({_EACH(lambda x: f"SELECT locale, n, w, {_SHORT[x].format('w') if x in ('de', 'es') else 'w'} AS s FROM large WHERE locale = '{x}'")})"""
_AND = {"en": " and ", "de": " und ", "fr": " et ", "es": " con ", "sv": " och "}
_COIN = {"en": ("euro", "euros", "cent", "cents"), "de": ("Euro", "Euro", "Cent", "Cent"), "fr": ("euro", "euros", "centime", "centimes"), "es": ("euro", "euros", "céntimo", "céntimos"), "sv": ("euro", "euro", "cent", "cent")}
_ONE = {"en": "{} = 1", "de": "true", "fr": "{} < 2", "es": "{} = 1", "sv": "true"}


def _coins_sql(x: str, n: str, words: str, one: str, many: str) -> str:
    named = f"CASE WHEN {n} = 1 THEN 'en' ELSE {words} END" if x == "sv" else words
    return f"{named} || CASE WHEN {_ONE[x].format(n)} THEN ' {one}' ELSE ' {many}' END"


@query(f"""WITH p AS (SELECT DISTINCT {_CENTS.format('o_totalprice')} AS c FROM orders), asked AS (SELECT c // 100 AS n FROM p UNION SELECT c % 100 FROM p), {_LOCALE_WORDS},
said AS ({_EACH(lambda x: f"SELECT c, '{x}' AS locale, {_coins_sql(x, 'a.n', 'a.s', *_COIN[x][:2])} AS major, CASE WHEN b.n > 0 THEN '{_AND[x]}' || {_coins_sql(x, 'b.n', 'b.s', *_COIN[x][2:])} END AS minor FROM p JOIN spelled AS a ON a.locale = '{x}' AND a.n = c // 100 JOIN spelled AS b ON b.locale = '{x}' AND b.n = c % 100")})
SELECT c, locale, 1 AS rank, major || coalesce(minor, '') AS spoken FROM said UNION ALL SELECT c, locale, 2, major FROM said WHERE minor IS NOT NULL""")
def locale_money(spark, sf_dir):
    """Every different price of the orders in euros, in five locales: with cents, and without."""
    cents = F.round(F.col("o_totalprice").cast("decimal(24,4)") * 100, 0).cast("long")
    prices = read_table(spark, sf_dir, "orders").select(cents.alias("c")).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work for each
    fields = {"major": F.call_function("div", F.col("c"), F.lit(100).cast("long")), "minor": F.col("c") % 100}
    return locales.spoken(prices, fields, "money", locales.rules(spark), locales.recipes(spark), ["minor"])


_DAY_SQL = {
    "en": _ordinal_sql("d.w"), "de": "CASE WHEN d.n = 1 THEN 'erster' WHEN d.n = 3 THEN 'dritter' WHEN d.n = 7 THEN 'siebter' WHEN d.n = 8 THEN 'achter' WHEN d.n < 20 THEN d.w || 'ter' ELSE d.w || 'ster' END",
    "fr": "CASE WHEN d.n = 1 THEN 'premier' ELSE d.w END", "es": "CASE WHEN d.n = 1 THEN 'primero' ELSE d.w END",
    "sv": f"({_list('första andra tredje fjärde femte sjätte sjunde åttonde nionde tionde elfte tolfte trettonde fjortonde femtonde sextonde sjuttonde artonde nittonde tjugonde tjugoförsta tjugoandra tjugotredje tjugofjärde tjugofemte tjugosjätte tjugosjunde tjugoåttonde tjugonionde trettionde trettioförsta')})[d.n]",
}
_YEAR_SQL = {"en": _YEAR, "de": "CASE WHEN y BETWEEN 1100 AND 1999 THEN hw.w || 'hundert' || CASE WHEN lw.n > 0 THEN lw.w ELSE '' END ELSE yw.w END", "fr": "yw.w", "es": "yw.w", "sv": "CASE WHEN y BETWEEN 1100 AND 1999 THEN hw.w || 'hundra' || CASE WHEN lw.n > 0 THEN lw.w ELSE '' END ELSE yw.w END"}
_ORDER_SQL = {"en": ["mo || ' ' || dd || ' ' || yy", "'the ' || dd || ' of ' || mo || ' ' || yy"], "de": ["dd || ' ' || mo || ' ' || yy"], "fr": ["dd || ' ' || mo || ' ' || yy", "'le ' || dd || ' ' || mo || ' ' || yy"], "es": ["dd || ' de ' || mo || ' de ' || yy"], "sv": ["dd || ' ' || mo || ' ' || yy", "'den ' || dd || ' ' || mo || ' ' || yy"]}


@query(f"""WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders),
asked AS (SELECT y AS n FROM o UNION SELECT y // 100 FROM o UNION SELECT y % 100 FROM o UNION SELECT * FROM range(1, 32)), {_LOCALE_WORDS},
said AS ({_EACH(lambda x: f"SELECT day, '{x}' AS locale, {_DAY_SQL[x].replace('d.n = 1', 'CAST(d.n AS INTEGER) = 1')} AS dd, ({_list(locale_rules.MONTHS[x])})[m] AS mo, {_YEAR_SQL[x]} AS yy FROM o JOIN spelled AS d ON d.locale = '{x}' AND d.n = day(o.day) JOIN spelled AS yw ON yw.locale = '{x}' AND yw.n = y JOIN spelled AS hw ON hw.locale = '{x}' AND hw.n = y // 100 JOIN spelled AS lw ON lw.locale = '{x}' AND lw.n = y % 100")})
{" UNION ALL ".join(f"SELECT strftime(day, '%Y-%m-%d') AS day, locale, {i} AS rank, {t} AS spoken FROM said WHERE locale = '{x}'" for x in _LOCALES for i, t in enumerate(_ORDER_SQL[x], 1))}""")
def locale_dates(spark, sf_dir):
    """Every different day of the orders in five locales, in each order of its parts."""
    days = read_table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()
    at = F.to_date("day")
    return locales.spoken(days, {"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at)}, "date", locales.rules(spark), locales.recipes(spark))


_TIME_SQL = {
    "en": ("hw || ' ' || CASE WHEN m < 10 THEN 'o ' ELSE '' END || mw",), "de": ("hs || ' Uhr ' || mw",), "fr": ("regexp_replace(hw, 'un$', 'une') || CASE WHEN h < 2 THEN ' heure ' ELSE ' heures ' END || regexp_replace(mw, 'un$', 'une')",),
    "es": ("CASE WHEN h = 1 THEN 'la una' ELSE 'las ' || regexp_replace(hw, 'uno$', 'una') END || ' y ' || mw",), "sv": ("hw || ' ' || CASE WHEN m < 10 THEN 'noll ' ELSE '' END || mw", "'klockan ' || hw || ' ' || CASE WHEN m < 10 THEN 'noll ' ELSE '' END || mw"),
}
_FULL_SQL = {"en": ("hw || ' hundred'",), "de": ("hs || ' Uhr'",), "fr": ("regexp_replace(hw, 'un$', 'une') || CASE WHEN h < 2 THEN ' heure' ELSE ' heures' END",), "es": ("CASE WHEN h = 1 THEN 'la una' ELSE 'las ' || regexp_replace(hw, 'uno$', 'una') END || ' en punto'", "CASE WHEN h = 1 THEN 'la una' ELSE 'las ' || regexp_replace(hw, 'uno$', 'una') END"), "sv": ("'klockan ' || hw",)}


@query(f"""WITH t AS (SELECT DISTINCT hour(ts) AS h, minute(ts) AS m FROM events), asked AS (SELECT * FROM range(60) AS r(n)), {_LOCALE_WORDS},
said AS ({_EACH(lambda x: f"SELECT h, m, '{x}' AS locale, a.w AS hw, a.s AS hs, b.w AS mw FROM t JOIN spelled AS a ON a.locale = '{x}' AND a.n = h JOIN spelled AS b ON b.locale = '{x}' AND b.n = m")})
{" UNION ALL ".join(f"SELECT CAST(h AS INTEGER) AS h, CAST(m AS INTEGER) AS m, locale, CAST({i} AS BIGINT) AS rank, {t} AS spoken FROM said WHERE locale = '{x}' AND {w}" for d, w in ((_TIME_SQL, 'm > 0'), (_FULL_SQL, 'm = 0')) for x in _LOCALES for i, t in enumerate(d[x], 1))}""")
def locale_times(spark, sf_dir):
    """Every different time of day of the events in five locales."""
    times = read_table(spark, sf_dir, "events").select(F.hour("ts").alias("h"), F.minute("ts").alias("m")).distinct()
    return locales.spoken(times, locales.time_fields(F.col("h"), F.col("m")), "time", locales.rules(spark), locales.recipes(spark))


_PERCENT_SQL = {"en": (" point ", " percent", "w"), "de": (" Komma ", " Prozent", "s"), "fr": (" virgule ", " pour cent", "w"), "es": (" coma ", " por ciento", "w"), "sv": (" komma ", " procent", "w")}


@query(f"""WITH p AS (SELECT DISTINCT CAST(round(l_discount * 100) AS BIGINT) * 100 + CAST(round(l_tax * 100) AS BIGINT) * 5 AS v FROM lineitem), asked AS (SELECT v // 100 AS n FROM p UNION SELECT * FROM range(10)), {_LOCALE_WORDS}
{" UNION ALL ".join(f"SELECT v, '{x}' AS locale, CAST(1 AS BIGINT) AS rank, CASE WHEN v % 100 = 0 THEN a.{s} ELSE a.w || '{point}' || CASE WHEN v % 10 = 0 THEN b.w ELSE CASE WHEN b.n = 0 AND '{x}' = 'en' THEN 'o' ELSE b.w END || ' ' || c.w END END || '{sign}' AS spoken FROM p JOIN spelled AS a ON a.locale = '{x}' AND a.n = v // 100 JOIN spelled AS b ON b.locale = '{x}' AND b.n = v // 10 % 10 JOIN spelled AS c ON c.locale = '{x}' AND c.n = v % 10" for x, (point, sign, s) in _PERCENT_SQL.items())}""")
def locale_percents(spark, sf_dir):
    """Every different discount with a twentieth of the tax as hundredths of a percent, in five locales."""
    whole = lambda c: F.round(F.col(c) * 100).cast("long")
    rates = read_table(spark, sf_dir, "lineitem").select((whole("l_discount") * 100 + whole("l_tax") * 5).alias("v")).distinct()
    return locales.spoken(rates, locales.percent_fields(F.col("v")), "percent", locales.rules(spark), locales.recipes(spark))


#: Names of the denominators 2 to 10, of one and of more, the word before one of them, and what stands between two numbers.
_PARTS_SQL = {
    "en": ("half third quarter fifth sixth seventh eighth ninth tenth", "halves thirds quarters fifths sixths sevenths eighths ninths tenths", "one", "over"), "de": ("halb Drittel Viertel Fünftel Sechstel Siebtel Achtel Neuntel Zehntel", "Halbe Drittel Viertel Fünftel Sechstel Siebtel Achtel Neuntel Zehntel", "ein", "durch"),
    "fr": ("demi tiers quart cinquième sixième septième huitième neuvième dixième", "demis tiers quarts cinquièmes sixièmes septièmes huitièmes neuvièmes dixièmes", "un", "sur"), "es": ("medio tercio cuarto quinto sexto séptimo octavo noveno décimo", "medios tercios cuartos quintos sextos séptimos octavos novenos décimos", "un", "sobre"),
    "sv": ("halv tredjedel fjärdedel femtedel sjättedel sjundedel åttondel niondel tiondel", "halva tredjedelar fjärdedelar femtedelar sjättedelar sjundedelar åttondelar niondelar tiondelar", "en", "genom"),
}


@query(f"""WITH f AS (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS a, CAST(l_quantity AS BIGINT) AS b FROM lineitem), asked AS (SELECT a AS n FROM f UNION SELECT b FROM f), {_LOCALE_WORDS}
{" UNION ALL ".join(f"SELECT a, b, '{x}' AS locale, CAST(1 AS BIGINT) AS rank, CASE WHEN a = 1 THEN '{one} ' || ({_list(p)})[b - 1] ELSE n.w || ' ' || ({_list(ps)})[b - 1] END AS spoken FROM f JOIN spelled AS n ON n.locale = '{x}' AND n.n = a WHERE b BETWEEN 2 AND 10 UNION ALL SELECT a, b, '{x}', CASE WHEN b BETWEEN 2 AND 10 THEN 2 ELSE 1 END, n.w || ' {over} ' || d.w FROM f JOIN spelled AS n ON n.locale = '{x}' AND n.n = a JOIN spelled AS d ON d.locale = '{x}' AND d.n = b" for x, (p, ps, one, over) in _PARTS_SQL.items())}""")
def locale_fractions(spark, sf_dir):
    """Every different pair of a line's number and quantity as a fraction in five locales: by the part's name, and as one number over another."""
    pairs = read_table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("a"), F.col("l_quantity").cast("long").alias("b")).distinct()
    return locales.spoken(pairs, locales.fraction_fields(F.col("a"), F.col("b")), "fraction", locales.rules(spark), locales.recipes(spark))


def _heard_forms(spark, sf_dir) -> DataFrame:
    """Labelled rows (type, written, spoken) and how often (n) each was heard: four-digit keys and years of the orders, fractions and
    percentages of their lines. Columns are counted before anything is written or said."""
    orders, lines = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    often = F.count("*").alias("n")
    key, year = F.col("o_orderkey"), F.col("year")
    four = orders.where(key.cast("string").rlike(r"\A[1-9][0-9]{3}\z")).groupBy("o_orderkey").agg(often)
    keys = four.select(F.lit("number:cardinal").alias("type"), key.cast("string").alias("written"), say.cardinal(key).alias("spoken"), "n")
    years = orders.groupBy(F.year("o_orderdate").alias("year")).agg(often).select(F.lit("date:y"), year.cast("string"), say.year(year), "n")
    a, b, d = F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    over = F.when(b > 25, F.concat(say.cardinal(a), F.lit(" over "), say.cardinal(b))).otherwise(say.fraction(a, b))
    parts = lines.groupBy(a.alias("l_linenumber"), b.alias("l_quantity"), d.alias("d")).agg(often)
    fractions = parts.select(F.lit("fraction:flexible"), F.concat_ws("/", "l_linenumber", "l_quantity"), over, "n")
    percents = parts.select(F.lit("number:percent"), F.concat(F.col("d").cast("string"), F.lit("%")), F.concat(say.cardinal(F.col("d")), F.when(a % 3 == 0, " per cent").otherwise(" percent")), "n")
    return keys.unionAll(years).unionAll(fractions).unionAll(percents)


_FORMS_SQL = f"""keys AS (SELECT o_orderkey AS n FROM orders WHERE regexp_matches(CAST(o_orderkey AS VARCHAR), '^[1-9][0-9]{{3}}$')), years AS (SELECT year(o_orderdate) AS n FROM orders),
parts AS (SELECT CAST(l_linenumber AS BIGINT) AS a, CAST(l_quantity AS BIGINT) AS b, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem),
{_cardinal_sql("SELECT n FROM keys UNION ALL SELECT n FROM years UNION ALL SELECT n // 100 FROM keys UNION ALL SELECT n % 100 FROM keys UNION ALL SELECT n // 100 FROM years UNION ALL SELECT n % 100 FROM years UNION ALL SELECT a FROM parts UNION ALL SELECT b FROM parts UNION ALL SELECT d FROM parts")},
four AS (SELECT DISTINCT kind, n AS y FROM (SELECT 'number:cardinal' AS kind, n FROM keys UNION ALL SELECT 'date:y', n FROM years)),
fourth AS (SELECT kind, y, yw.w AS c, {_YEAR} AS yr, {_DIGIT_WORDS.format("CAST(y AS VARCHAR)")} AS dg FROM four JOIN words AS yw ON yw.n = y JOIN words AS hw ON hw.n = y // 100 JOIN words AS lw ON lw.n = y % 100),
listed AS (SELECT kind AS type, CAST(y AS VARCHAR) AS surface, 'four-digit' AS scope, 'century:' || substr(CAST(y AS VARCHAR), 1, 2) AS sub, unnest(CASE kind WHEN 'date:y' THEN [0, 1, 2, 3] ELSE [2, 0, 1, 3] END) AS place, unnest(['year', 'cardinal', 'and', 'digits']) AS provenance, unnest([yr, c, replace(c, 'hundred ', 'hundred and '), dg]) AS spoken FROM fourth
  UNION ALL SELECT DISTINCT 'fraction:flexible', a || '/' || b, 'fraction:flexible', 'over:' || b, 0, 'fraction', CASE WHEN b = 1 THEN x.w || ' over one' WHEN b = 2 THEN x.w || CASE WHEN a = 1 THEN ' half' ELSE ' halves' END WHEN b = 4 THEN x.w || CASE WHEN a = 1 THEN ' quarter' ELSE ' quarters' END ELSE x.w || ' ' || {_ordinal_sql("z.w")} || CASE WHEN a = 1 THEN '' ELSE 's' END END FROM parts JOIN words AS x ON x.n = a JOIN words AS z ON z.n = b
  UNION ALL SELECT DISTINCT 'fraction:flexible', a || '/' || b, 'fraction:flexible', 'over:' || b, 1, 'over', x.w || ' over ' || z.w FROM parts JOIN words AS x ON x.n = a JOIN words AS z ON z.n = b
  UNION ALL SELECT DISTINCT 'number:percent', d || '%', 'number:percent', '*', 0, 'percent', w || ' percent' FROM parts JOIN words ON n = d UNION ALL SELECT DISTINCT 'number:percent', d || '%', 'number:percent', '*', 1, 'per-cent', w || ' per cent' FROM parts JOIN words ON n = d),
once AS (SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY type, surface, spoken ORDER BY place) = 1),
heard AS (SELECT 'four-digit' AS scope, 'century:' || substr(CAST(n AS VARCHAR), 1, 2) AS sub, 'cardinal' AS provenance FROM keys UNION ALL SELECT 'four-digit', 'century:' || substr(CAST(n AS VARCHAR), 1, 2), 'year' FROM years
  UNION ALL SELECT 'fraction:flexible', 'over:' || b, CASE WHEN b > 25 THEN 'over' ELSE 'fraction' END FROM parts UNION ALL SELECT 'number:percent', '*', CASE WHEN a % 3 = 0 THEN 'per-cent' ELSE 'percent' END FROM parts),
counted AS (SELECT scope, sub, provenance, count(*) AS n FROM (SELECT * FROM heard UNION ALL SELECT scope, '*', provenance FROM heard WHERE sub <> '*') GROUP BY ALL)"""


@query(f"WITH {_FORMS_SQL} SELECT scope, sub AS sub_key, provenance, n FROM counted")
def prior_spoken(spark, sf_dir):
    """How readings were heard, by type and by what they have in common beyond it."""
    return alternatives.spoken_priors(_heard_forms(spark, sf_dir), "n")


@query(f"""WITH {_FORMS_SQL}, totals AS (SELECT scope, sub, sum(n) AS n FROM counted GROUP BY 1, 2),
shared AS (SELECT o.*, coalesce(ca.n, 0) / ta.n AS parent, coalesce(co.n, 0) AS own, tt.n AS own_total FROM once AS o JOIN totals AS ta ON ta.scope = o.scope AND ta.sub = '*' LEFT JOIN counted AS ca ON ca.scope = o.scope AND ca.sub = '*' AND ca.provenance = o.provenance
  LEFT JOIN totals AS tt ON tt.scope = o.scope AND tt.sub = o.sub LEFT JOIN counted AS co ON co.scope = o.scope AND co.sub = o.sub AND co.provenance = o.provenance),
priced AS (SELECT *, CASE WHEN sub <> '*' AND own_total IS NOT NULL THEN (own + {STRENGTH} * parent) / (own_total + {STRENGTH}) ELSE parent END AS share FROM shared)
SELECT type, surface, row_number() OVER (PARTITION BY type, surface ORDER BY share DESC, place) AS rank, spoken, provenance, 1 AS tier, round(share, 9) AS share FROM priced""")
def ranked_alternatives(spark, sf_dir):
    """Every form of four-digit tokens, fractions and percentages, ranked by how such readings were heard."""
    heard = _heard_forms(spark, sf_dir)
    found = alternatives.ranked(heard.select("type", F.col("written").alias("surface")), alternatives.spoken_priors(heard, "n"))
    return found.withColumns({"share": F.round("share", 9), "tier": F.col("tier").cast("int")})


#: Rules for the invented words of the given tables, in the form of respelling.RULES; the stems are those of the documents.
_OWN_RULES = [("tion", "tion", "shun", " s"), ("eau", "eau", "o", " x"), ("ing", "ing", "in", "")]
_ENDINGS = ", ".join(f"('{r}', {i}, '{old + t}', '{new + t}')" for i, (r, old, new, ts) in enumerate(_OWN_RULES) for t in ts.split(" "))


@query(rf"""WITH d AS (SELECT conv_id || ':' || turn AS id, text FROM conversations WHERE text IS NOT NULL), ends AS (SELECT * FROM (VALUES {_ENDINGS}) AS r(rule, place, ending, target)),
seen AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '\p{{L}}+')) AS w FROM documents)),
hits AS (SELECT id, text, unnest(h) AS h, unnest(g[1:len(h)]) AS g, generate_subscripts(h, 1) AS i, g[len(h) + 1] AS tail FROM (SELECT id, text, regexp_extract_all(text, '\p{{L}}+') AS h, string_split_regex(text, '\p{{L}}+') AS g FROM d)),
words AS (SELECT DISTINCT lower(h) AS word FROM hits),
counted AS (SELECT lower(h) AS word, count(*) AS n FROM hits GROUP BY 1),
pairs AS (SELECT word, reverse(word) AS target FROM counted WHERE n % 7 = 0 AND length(word) = 3 AND n >= 3),
ruled AS (SELECT word, left(word, length(word) - length(ending)) || e.target AS target, e.rule AS by_, place, length(ending) AS size FROM words JOIN ends AS e ON ends_with(word, ending) AND length(word) > length(ending)
  JOIN (SELECT DISTINCT rule, left(w, length(w) - length(target)) AS stem FROM seen JOIN ends ON ends_with(w, target) AND length(w) > length(target)) AS s ON s.rule = e.rule AND s.stem = left(word, length(word) - length(ending))),
chosen AS (SELECT word, target FROM (SELECT word, target, -1 AS place, 0 AS size FROM pairs UNION ALL SELECT word, target, place, -size FROM ruled) QUALIFY row_number() OVER (PARTITION BY word ORDER BY place, size, target) = 1),
said AS (SELECT hits.*, CASE WHEN c.word IS NULL OR c.word = c.target OR h NOT IN (lower(h), upper(h), upper(h[1]) || lower(h[2:])) THEN NULL WHEN h = upper(h) AND h <> lower(h) AND length(h) > 1 THEN upper(c.target) WHEN h = lower(h) THEN c.target ELSE upper(c.target[1]) || c.target[2:] END AS t FROM hits LEFT JOIN chosen AS c ON c.word = lower(h)),
ends_ AS (SELECT *, sum(length(g) + length(coalesce(t, h))) OVER (PARTITION BY id ORDER BY i) AS o, sum(length(g) + length(h)) OVER (PARTITION BY id ORDER BY i) AS e FROM said)
SELECT id, sha256(string_agg(g || coalesce(t, h), '' ORDER BY i) || coalesce(any_value(tail), '')) AS respelled, count(t) AS n,
  coalesce(string_agg(CAST(e - length(h) AS BIGINT) || '-' || CAST(e AS BIGINT) || ':' || CAST(o - length(t) AS BIGINT) || '-' || CAST(o AS BIGINT) || t, ',' ORDER BY i) FILTER (t IS NOT NULL), '') AS changes FROM ends_ GROUP BY id""")
def respelled_turns(spark, sf_dir):
    """Turns with words respelled by pairs and by endings whose stems the documents attest, and the places of every change."""
    turns = read_table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    tokens = lambda df: df.select(F.explode(F.regexp_extract_all("text", F.lit(respelling.WORD), F.lit(0))).alias("w"))
    rules = respelling.rules(spark, _OWN_RULES)
    attested = respelling.stems(tokens(read_table(spark, sf_dir, "documents")), "w", rules)
    words = tokens(turns)
    counted = words.groupBy(tf.smalls(F.col("w")).alias("word")).agg(F.count("*").alias("converted"))
    pairs = counted.where("converted % 7 = 0 AND length(word) = 3").select("word", F.reverse("word").alias("target"), "converted", F.lit(0).alias("kept"))
    found = respelling.respellings(words, "w", pairs, rules, attested)
    out = respelling.respelled(turns, "id", "text", found).where(F.col("text").rlike(respelling.WORD))
    said = F.transform("changes", lambda c: F.concat(F.concat_ws("-", c["source_start"].cast("string"), c["source_end"].cast("string")), F.lit(":"), F.concat_ws("-", c["out_start"].cast("string"), c["out_end"].cast("string")), c["target"]))
    return out.select("id", F.sha2("respelled", 256).alias("respelled"), F.size("changes").cast("long").alias("n"), F.array_join(said, ",").alias("changes"))


@query(r"""WITH RECURSIVE t AS (SELECT conv_id || ':' || turn AS id, text, string_split_regex(text, '[ ]+') AS w FROM conversations WHERE text <> ''),
tokens AS (SELECT id, text, CASE WHEN i % 9 = 4 THEN 'not there' ELSE regexp_replace(w, '[.,]+$', '') END AS written, i FROM (SELECT id, text, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t) WHERE i % 5 <> 2 AND regexp_replace(w, '[.,]+$', '') <> ''),
numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM tokens),
walk AS (SELECT id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS past, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS i FROM t
  UNION ALL SELECT n.id, n.k, CASE WHEN p > 0 THEN past + p - 1 + length(written) ELSE past END, CASE WHEN p > 0 THEN past + p - 1 END, CASE WHEN p > 0 THEN past + p - 1 + length(written) END, n.i
    FROM (SELECT n.*, w.past, strpos(substr(n.text, w.past + 1), n.written) AS p FROM walk AS w JOIN numbered AS n ON n.id = w.id AND n.k = w.k + 1) AS n)
SELECT id, count(*) AS n, count(s) AS found, sha256(string_agg(coalesce(CAST(s AS VARCHAR), '-') || ':' || coalesce(CAST(e AS VARCHAR), '-'), ',' ORDER BY i)) AS spans FROM walk WHERE k > 0 GROUP BY 1""")
def running_triples(spark, sf_dir):
    """Tokens of the turns, some left out and some replaced, found again in the running text: how many, and where."""
    texts = read_table(spark, sf_dir, "conversations").where("text <> ''").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    words = texts.select("id", F.posexplode(F.split("text", "[ ]+")).alias("at", "w")).select("id", (F.col("at") + 1).alias("pos"), F.regexp_replace("w", "[.,]+$", "").alias("w")).where("pos % 5 <> 2 AND w <> ''")
    rows = words.select("id", "pos", F.when(F.col("pos") % 9 == 4, "not there").otherwise(F.col("w")).alias("written"), F.lower("w").alias("spoken"))
    found = running.triples(rows, texts, ["id"])
    one = F.concat_ws(":", F.coalesce(F.col("start").cast("string"), F.lit("-")), F.coalesce(F.col("end").cast("string"), F.lit("-")))
    each = found.groupBy("id").agg(F.count("*").alias("n"), F.count("start").alias("found"), F.array_sort(F.collect_list(F.struct("pos", one.alias("s")))).alias("_s"))
    return each.select("id", "n", "found", F.sha2(F.array_join(F.transform("_s", lambda x: x["s"]), ","), 256).alias("spans"))


_AHEAD = r"^[.!?][ ]+[A-Z]|^[.!?]\z"


@query(rf"""WITH t AS (SELECT conv_id || ':' || turn AS id, text FROM conversations WHERE text <> ''),
units AS (SELECT id, text, CAST(i AS BIGINT) AS unit FROM t, range(1, 100000) AS r(i) WHERE i <= length(text) AND substr(text, i, 1) IN ('.', '!', '?')),
runs AS (SELECT u.id, unit, CAST(p AS BIGINT) AS prefix, regexp_matches(substr(text, unit, p - unit + 1), '{_AHEAD}') AS reading FROM units AS u, range(0, 7) AS r(k), LATERAL (SELECT least(unit + k, length(text)) AS p)),
once AS (SELECT DISTINCT * FROM runs), final AS (SELECT id, unit, max_by(reading, prefix) AS f FROM once GROUP BY 1, 2),
bad AS (SELECT o.id, o.unit, f, coalesce(max(prefix) FILTER (reading <> f), -1) AS b FROM once AS o JOIN final USING (id, unit) GROUP BY 1, 2, 3),
stable AS (SELECT o.id, o.unit, min(prefix) AS s, any_value(f) AS f FROM once AS o JOIN bad USING (id, unit) WHERE prefix > b GROUP BY 1, 2)
SELECT f AS ends, count(*) AS n, quantile_disc(s - unit, 0.5) AS half, max(s - unit) AS most FROM stable GROUP BY 1""")
def sentence_lookahead(spark, sf_dir):
    """How many characters after a full stop it takes until it is sure whether a sentence ends there, over the turns' prefixes."""
    texts = read_table(spark, sf_dir, "conversations").where("text <> ''").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    places = F.filter(F.sequence(F.lit(1), F.length("text")), lambda i: F.col("text").substr(i, F.lit(1)).isin(".", "!", "?"))
    units = texts.select("id", "text", F.explode(places).alias("unit"))
    runs = units.select("id", "text", "unit", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.least(F.col("unit") + k, F.length("text"))))).alias("prefix"))
    read = runs.select("id", "unit", "prefix", F.col("text").substr(F.col("unit"), F.col("prefix") - F.col("unit") + 1).rlike(_AHEAD).alias("reading"))
    found = running.lookahead(read, ["id", "unit"]).withColumn("more", (F.col("stable") - F.col("unit")).cast("long"))
    return found.groupBy(F.col("final").alias("ends")).agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY more)").cast("long").alias("half"), F.max("more").alias("most"))


@query(r"""WITH h AS (SELECT page_id, url, regexp_extract(url, '//([^/?#]+)', 1) AS host FROM pages WHERE url IS NOT NULL), e AS (SELECT lower(regexp_extract(host, '([A-Za-z]+)$', 1)) AS ending FROM h WHERE host LIKE '%.%' GROUP BY 1 HAVING count(*) >= 20),
m AS (SELECT page_id, unnest(regexp_extract_all(url, '(?:^|[^A-Za-z0-9_.@-])((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?:$|[^A-Za-z0-9_-])', 1)) AS surface, url FROM h)
SELECT page_id, CAST(strpos(url, surface) - 1 AS INTEGER) AS start, CAST(strpos(url, surface) - 1 + length(surface) AS INTEGER) AS "end", surface, ending FROM m JOIN e ON ending = lower(regexp_extract(surface, '[A-Za-z]+$'))""")
def listed_domains(spark, sf_dir):
    """Domains in the pages' URLs whose ending is that of twenty hosts at least."""
    pages = read_table(spark, sf_dir, "pages").where("url IS NOT NULL")
    host = F.regexp_extract("url", "//([^/?#]+)", 1)
    endings = pages.where(host.contains(".")).groupBy(F.lower(F.regexp_extract(host, r"([A-Za-z]+)\z", 1)).alias("value")).count().where("count >= 20")
    return detect.listed_domains(pages.select("page_id", "url"), "url", endings)


_DAYS = ", ".join(f"'{d}'" for d in say.WEEKDAYS)
_SPANS_SQL = "(['second', 'minute', 'hour', 'day', 'week', 'month', 'year'])[m % 7 + 1]"


@query(f"""WITH d AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, isodow(o_orderdate) AS wd, count(*) AS c FROM orders GROUP BY ALL),
{_cardinal_sql('SELECT y AS n FROM d UNION ALL SELECT y // 100 FROM d UNION ALL SELECT y % 100 FROM d UNION ALL SELECT * FROM range(1, 32)')}, {_years_sql('SELECT DISTINCT y FROM d')},
x AS (SELECT d.*, yr.w AS yw, dw.w AS dw, {_ordinal_sql('dw.w')} AS ow, ([{_MONTHS}])[m] AS mo, upper(([{_MONTHS}])[m][1]) || ([{_MONTHS}])[m][2:] AS name, ([{_DAYS}])[wd] AS dayname, {_SPANS_SQL} || CASE WHEN d.d = 1 THEN '' ELSE 's' END AS span FROM d JOIN yr ON yr.y = d.y JOIN words AS dw ON dw.n = d.d),
z AS (SELECT x.*, {_ordinal_sql('nw.w')} AS ow2 FROM x JOIN words AS nw ON nw.n = CASE WHEN d = 31 THEN 31 ELSE d + 1 END)
""" + _recognized_sql("""SELECT dayname || ', ' || name || ' ' || d || ', ' || y AS written, 'date:weekday' AS type, lower(dayname) || ' ' || mo || ' ' || ow || ' ' || yw AS spoken, c FROM z
UNION ALL SELECT name || ' ' || d || '–' || CASE WHEN d = 31 THEN 31 ELSE d + 1 END || ', ' || y, 'date:interval', mo || ' ' || ow || ' to ' || ow2 || ' ' || yw, c FROM z
UNION ALL SELECT d || ' ' || span || ' ago', 'date:relative', dw || ' ' || span || ' ago', c FROM z UNION ALL SELECT 'in ' || d || ' ' || span, 'date:relative', 'in ' || dw || ' ' || span, c FROM z"""))
def normalize_date_forms(spark, sf_dir):
    """Dates with their weekday, intervals of days, and dates told from today."""
    at, name = F.col("o_orderdate"), F.date_format("o_orderdate", "MMMM")
    d, last = F.dayofmonth(at), F.least(F.dayofmonth(at) + 1, F.lit(31))
    span = F.concat(F.element_at(F.array(*[F.lit(x) for x in "second minute hour day week month year".split()]), F.month(at) % 7 + 1), F.when(d == 1, "").otherwise("s"))
    form = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return _recognized(read_table(spark, sf_dir, "orders"), form(F.date_format(at, "EEEE"), ", ", name, " ", d, ", ", F.year(at)), form(name, " ", d, "–", last, ", ", F.year(at)), form(d, " ", span, " ago"), form("in ", d, " ", span))


@query(f"""WITH t AS (SELECT (hour(ts) + 11) % 12 + 1 AS h, minute(ts) AS m, second(ts) AS s, hour(ts) < 12 AS am, count(*) AS c FROM events WHERE ts IS NOT NULL GROUP BY ALL), {_cardinal_sql('SELECT h AS n FROM t UNION ALL SELECT m FROM t UNION ALL SELECT s FROM t')}
""" + _recognized_sql("""SELECT h || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || ':' || lpad(CAST(s AS VARCHAR), 2, '0') || CASE WHEN am THEN ' AM' ELSE ' PM' END AS written, 'time:seconds' AS type,
  x.w || ' ' || CASE WHEN m = 0 THEN 'o''clock' WHEN m < 10 THEN 'o ' || y.w ELSE y.w END || ' and ' || z.w || CASE WHEN s = 1 THEN ' second' ELSE ' seconds' END || CASE WHEN am THEN ' a m' ELSE ' p m' END AS spoken, c FROM t JOIN words AS x ON x.n = h JOIN words AS y ON y.n = m JOIN words AS z ON z.n = s"""))
def normalize_clock_forms(spark, sf_dir):
    """Times of day with seconds and their half of the day."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    written = F.concat((F.pmod(F.hour("ts") + 11, F.lit(12)) + 1).cast("string"), F.lit(":"), two(F.minute("ts")), F.lit(":"), two(F.second("ts")), F.when(F.hour("ts") < 12, " AM").otherwise(" PM"))
    return _recognized(read_table(spark, sf_dir, "events").where("ts IS NOT NULL"), written)
