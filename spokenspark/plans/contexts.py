"""Registered queries of readings that counts of heard text decide: ranges, spelled tokens, Roman numerals, inches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spellout as say
from ..operators import letters, ranges
from ..sources.tables import read_table
from .forms import _DIGIT_WORDS
from .queries import _YEAR, _cardinal_sql, query

#: What tells sentences apart, and how many lines say them.
_LINE_KEYS = ["k", "q", "ln", "d", "y", "pk", "sk", "n"]


def _heard_lines(spark, sf_dir) -> DataFrame:
    """Labelled tokens of seven kinds of sentences, made of the different lines of orders: two ranges with a dash, ratios, dimensions,
    telephone numbers and times as single tokens, and three numbers in a row. Lines that say the same are one sentence, n times."""
    lines = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").cast("long").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_quantity").cast("long").alias("q"),
        F.round(F.col("l_discount") * 100).cast("long").alias("d"), F.year("l_shipdate").cast("long").alias("y"),
    ).distinct()
    kind = (F.col("ok") + F.col("ln")) % 7
    said_by = {"q": [0, 1, 3, 4, 5, 6], "ln": [0, 6], "d": [0, 5, 6], "y": [1], "pk": [2], "sk": [2]}  # the kinds that a column is said in
    own = {"pk": F.col("pk") % 1000, "sk": F.col("sk") % 10000}
    lines = lines.groupBy(kind.alias("k"), *[F.when(kind.isin(kinds), own.get(c, F.col(c))).alias(c) for c, kinds in said_by.items()]).agg(F.count("*").alias("n"))
    ln, q, d, y, k = (F.col(c) for c in ("ln", "q", "d", "y", "k"))
    token = lambda kind, written, how: F.struct(F.lit(kind).alias("class"), written.cast("string").alias("written"), how.alias("how"))
    number = lambda n: token("CARDINAL", n, F.lit("cardinal"))
    dated = lambda n: token("DATE", n, F.when(q % 5 == 0, "cardinal").otherwise("year"))
    sign = lambda s, said: token("PUNCT", F.lit(s), said)
    padded = lambda n, size: F.lpad(n.cast("string"), size, "0")
    silent, to, digits = F.lit("sil"), F.lit("to"), F.lit("digits")
    phone, clock = F.concat_ws("-", padded(F.col("pk"), 3), padded(F.col("sk"), 4)), F.concat_ws(":", (q % 24).cast("string"), padded(q, 2))
    kinds = [
        [number(q), sign("-", F.when(d % 2 == 0, to).otherwise(silent)), number(q + ln)], [dated(y), sign("–", to), dated(y + 1)], [token("TELEPHONE", phone, digits)],
        [number(q % 9 + 1), sign(":", to), number(q)], [token("TIME", clock, digits)], [number(q), sign("x", F.when(d % 3 > 0, "by").otherwise("x")), number(d)],
        [number(q), sign("-", silent), number(ln), sign("-", silent), number(d)],
    ]
    sentence = F.lit(None).cast("array<struct<class:string,written:string,how:string>>")
    for i, tokens in enumerate(kinds):
        sentence = F.when(k == i, F.array(*tokens)).otherwise(sentence)
    tokens = lines.select(*_LINE_KEYS, F.posexplode(sentence).alias("place", "t")).select(*_LINE_KEYS, "place", "t.*")
    n, how = F.col("written").try_cast("long"), F.col("how")  # said after the explode: one expression a form, not one a token
    spoken = F.when(how == "cardinal", say.cardinal(n)).when(how == "year", say.year(n)).when(how == "digits", say.digits(F.col("written"))).otherwise(how)
    return tokens.withColumn("spoken", spoken).drop("how")


def _document_spans(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]"))
    return docs.select("doc_id", F.explode(ranges.between_numbers(F.col("text"))).alias("s")).select("doc_id", F.col("s.left").alias("left"), F.col("s.sign").alias("sign"), F.col("s.right").alias("right"))


def _heard_spans(tokens: DataFrame) -> DataFrame:
    """left, sign and right of the ranges of tokens, and of single tokens that could be ranges."""
    piece = lambda i: F.regexp_extract("written", r"\A([0-9,]+)([-:])([0-9,]+)\z", i)
    single = tokens.where(F.col("class").isin("TELEPHONE", "TIME")).select(piece(1).alias("left"), piece(2).alias("sign"), piece(3).alias("right"))
    return ranges.triples(tokens, _LINE_KEYS).select("left", "sign", "right").unionAll(single)


def _bare(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '[0-9]{{1,3}}(,[0-9]{{3}})+') THEN replace({c}, ',', '') ELSE {c} END"


_KIND_SQL = "CASE WHEN sign IN ('-', '–') THEN 'dash' WHEN sign = ':' THEN 'ratio' ELSE 'dimension' END"
#: lines: the different lines; observed: what was heard, as a range or as one token; spans: where documents may hold a range.
_RANGES_SQL = rf"""lines AS (SELECT DISTINCT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d, year(l_shipdate) AS y, (l_orderkey + l_linenumber) % 7 AS k FROM lineitem),
heard AS (SELECT '' || q AS "left", '-' AS sign, '' || (q + ln) AS "right", 1 AS r, CASE WHEN d % 2 = 0 THEN 'cardinal+to+cardinal' ELSE 'cardinal+silent+cardinal' END AS source FROM lines WHERE k = 0
  UNION ALL SELECT '' || y, '–', '' || (y + 1), 1, CASE WHEN q % 5 > 0 OR (y // 100 % 10 = 0 AND y % 100 < 10) THEN 'year' ELSE 'cardinal' END || '+to+' || CASE WHEN q % 5 > 0 OR ((y + 1) // 100 % 10 = 0 AND (y + 1) % 100 < 10) THEN 'year' ELSE 'cardinal' END FROM lines WHERE k = 1
  UNION ALL SELECT lpad('' || (pk % 1000), 3, '0'), '-', lpad('' || (sk % 10000), 4, '0'), 0, NULL FROM lines WHERE k = 2 UNION ALL SELECT '' || (q % 9 + 1), ':', '' || q, 1, 'cardinal+to+cardinal' FROM lines WHERE k = 3
  UNION ALL SELECT '' || (q % 24), ':', lpad('' || q, 2, '0'), 0, NULL FROM lines WHERE k = 4 UNION ALL SELECT '' || q, 'x', '' || d, 1, CASE WHEN d % 3 > 0 THEN 'cardinal+by+cardinal' ELSE 'cardinal+x+cardinal' END FROM lines WHERE k = 5),
chains AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:,[0-9]+)*(?: ?[-–:x×] ?[0-9]+(?:,[0-9]+)*)+')) AS c FROM documents),
spans AS (SELECT doc_id, regexp_extract(c, '^([0-9,]+)', 1) AS "left", regexp_extract(c, '([-–:x×])', 1) AS sign, regexp_extract(c, '([0-9,]+)$', 1) AS "right" FROM chains WHERE regexp_full_match(c, '[0-9,]+ ?[-–:x×] ?[0-9,]+')),
keyed AS (SELECT *, {_KIND_SQL} AS kind, {_bare('"left"')} AS a, {_bare('"right"')} AS b FROM (SELECT DISTINCT "left", sign, "right" FROM heard UNION SELECT "left", sign, "right" FROM spans)),
keys AS (SELECT "left", sign, "right", kind, CASE WHEN kind = 'ratio' AND regexp_full_match("left" || ':' || "right", '([01]?[0-9]|2[0-3]):[0-5][0-9]') THEN 'ratio:clock' WHEN regexp_full_match(a, '[0-9]+') AND regexp_full_match(b, '[0-9]+') THEN kind || ':' || length(a) || '+' || length(b) || CASE WHEN length(b) > 1 AND b LIKE '0%' THEN ':0' ELSE '' END ELSE kind || ':other' END AS key FROM keyed),
observed AS (SELECT kind, key, regexp_replace(key, ':0$', '') AS narrow, r, source FROM heard JOIN keys USING ("left", sign, "right")),
emission AS (SELECT key, CAST(sum(r) AS BIGINT) AS as_range, CAST(sum(1 - r) AS BIGINT) AS single FROM (SELECT narrow AS key, r FROM observed UNION ALL SELECT kind, r FROM observed) GROUP BY key)"""


@query(f"WITH {_RANGES_SQL} SELECT * FROM emission")
def prior_range_emission(spark, sf_dir):
    """How often separators between numbers were heard as ranges and how often as single tokens, by narrow key and by class."""
    return ranges.emission_counts(_heard_lines(spark, sf_dir), _LINE_KEYS, "n")


@query(f"""WITH {_RANGES_SQL}, found AS (SELECT s.place, k.*, coalesce(o.as_range, w.as_range) AS as_range, coalesce(o.single, w.single) AS single
  FROM (SELECT '' || doc_id AS place, "left", sign, "right" FROM spans UNION ALL SELECT DISTINCT 'heard', "left", sign, "right" FROM heard) AS s JOIN keys AS k USING ("left", sign, "right") LEFT JOIN emission AS o ON o.key = regexp_replace(k.key, ':0$', '') AND o.as_range + o.single >= 50 LEFT JOIN emission AS w ON w.key = k.kind)
SELECT place, "left", sign, "right", key, as_range, single, coalesce(as_range > 0 AND as_range >= single, false) AS emits FROM found""")
def range_decisions(spark, sf_dir):
    """Every lone separator between two numbers of the documents (place is the doc_id), and the different heard ones: whether it is a
    range, by what was heard of its key."""
    tokens = _heard_lines(spark, sf_dir)
    own = _document_spans(spark, sf_dir).select(F.col("doc_id").cast("string").alias("place"), "left", "sign", "right")
    spans = own.unionByName(_heard_spans(tokens).distinct().withColumn("place", F.lit("heard")))
    return ranges.decided(spans, ranges.emission_counts(tokens, _LINE_KEYS, "n"))


@query(f"""WITH {_RANGES_SQL}, each AS (SELECT kind, split_part(source, '+', 2) AS connector FROM observed WHERE r = 1)
SELECT kind, connector, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY kind) AS share FROM each GROUP BY kind, connector""")
def connector_shares(spark, sf_dir):
    """What separators say between the ends of heard ranges, by class."""
    return ranges.connector_shares(ranges.joint_counts(_heard_lines(spark, sf_dir), _LINE_KEYS, "n"))


_ENDS_SQL = f"""ends AS (SELECT v, CASE WHEN regexp_full_match(v, '[1-9][0-9]{{3}}') THEN CAST(v AS BIGINT) END AS y, CASE WHEN regexp_full_match(replace(v, ',', ''), '0|[1-9][0-9]{{0,17}}') THEN CAST(replace(v, ',', '') AS BIGINT) END AS n FROM (SELECT "left" AS v FROM keys UNION SELECT "right" FROM keys)),
{_cardinal_sql("SELECT n FROM ends WHERE n IS NOT NULL UNION SELECT y // 100 FROM ends WHERE y IS NOT NULL UNION SELECT y % 100 FROM ends WHERE y IS NOT NULL")},
said AS (SELECT v, 0 AS i, 'year' AS e, {_YEAR} AS f FROM ends JOIN words AS yw ON yw.n = y JOIN words AS hw ON hw.n = y // 100 JOIN words AS lw ON lw.n = y % 100
  UNION ALL SELECT v, 1, 'cardinal', w FROM ends JOIN words USING (n) UNION ALL SELECT v, 2, 'digits', {_DIGIT_WORDS.format("v")} FROM ends WHERE v NOT LIKE '%,%'),
options AS (SELECT * FROM (VALUES ('dash', 0, 'to'), ('dash', 1, ''), ('ratio', 0, 'to'), ('ratio', 1, ''), ('dimension', 0, 'by'), ('dimension', 1, 'x')) AS o(kind, k, c))"""


@query(f"""WITH {_RANGES_SQL}, {_ENDS_SQL},
listed AS (SELECT "left", sign, "right", kind, key, a.e || '+' || CASE WHEN c = '' THEN 'silent' ELSE c END || '+' || b.e AS source, a.f || CASE WHEN c = '' THEN ' ' ELSE ' ' || c || ' ' END || b.f AS spoken, CASE WHEN a.i = b.i THEN 10 * a.i ELSE 100 + 20 * a.i + 5 * b.i END + k AS place
  FROM keys JOIN said AS a ON a.v = "left" JOIN said AS b ON b.v = "right" JOIN options USING (kind)),
wide AS (SELECT kind, source, count(*) / (SELECT count(*) FROM observed AS o WHERE o.r = 1 AND o.kind = x.kind) AS share FROM observed AS x WHERE r = 1 GROUP BY kind, source),
own AS (SELECT kind, key, source, count(*) AS n FROM observed WHERE r = 1 GROUP BY ALL), known AS (SELECT kind, key, sum(n) AS n FROM own GROUP BY ALL),
shared AS (SELECT l.*, CASE WHEN known.n IS NULL OR wide.share IS NULL THEN wide.share ELSE (coalesce(own.n, 0) + 5 * wide.share) / (known.n + 5) END AS share FROM listed AS l LEFT JOIN own USING (kind, key, source) LEFT JOIN known USING (kind, key) LEFT JOIN wide USING (kind, source)),
once AS (SELECT * FROM shared QUALIFY row_number() OVER (PARTITION BY "left", sign, "right", spoken ORDER BY coalesce(share, -1) DESC, place) = 1)
SELECT "left", sign, "right", source, spoken, CAST(share AS DOUBLE) AS share, row_number() OVER (PARTITION BY "left", sign, "right" ORDER BY coalesce(share, -1) DESC, place) AS rank FROM once""")
def range_readings(spark, sf_dir):
    """Ranked readings of every different pair of numbers with a separator, in the documents and in heard text."""
    tokens = _heard_lines(spark, sf_dir)
    spans = _heard_spans(tokens).unionByName(_document_spans(spark, sf_dir).drop("doc_id"))
    return ranges.readings(spans, ranges.joint_counts(tokens, _LINE_KEYS, "n"))


_SPLIT = r"string_split_regex(text, '[^\p{L}\p{M}\p{N}_]+')"


@query(rf"""SELECT CASE WHEN w IN ('I', 'a', 'A') THEN 'word:single-letter' ELSE 'letter:name' END AS type, w AS surface, count(*) AS n
FROM (SELECT unnest({_SPLIT}) AS w FROM documents) WHERE regexp_full_match(w, '\p{{L}}') GROUP BY w""")
def lone_letters(spark, sf_dir):
    """Letters that stand alone in the documents, by what they are."""
    found = read_table(spark, sf_dir, "documents").select(F.explode(letters.lone_letters(F.col("text"))).alias("c"))
    return found.groupBy(F.col("c.type").alias("type"), F.col("c.surface").alias("surface")).agg(F.count("*").alias("n"))


def _turn_words(spark, sf_dir) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return turns.select("turn", "role", F.explode(letters.words(F.col("text"))).alias("word"))


@query(rf"""WITH t AS (SELECT turn, role, unnest({_SPLIT}) AS w FROM conversations WHERE text IS NOT NULL), u AS (SELECT * FROM t WHERE w <> ''),
heard AS (SELECT w, count(*) FILTER (WHERE NOT s) AS said, count(*) FILTER (WHERE s) AS spelled, count(*) AS n FROM (SELECT w, NOT regexp_matches(lower(w), '[aeiou]') OR (length(w) = 2 AND turn % 3 > 0) OR (length(w) = 3 AND turn % 2 = 0) AS s FROM u WHERE role = 'user' AND regexp_full_match(w, '\p{{Latin}}{{2,6}}')) GROUP BY w),
known AS (SELECT w, lower(w) AS f, n, spelled / n AS share, CASE WHEN spelled > said THEN 'spell' ELSE 'say' END AS d, n >= 5 AND greatest(said, spelled) >= 0.99 * n AS sure, 2 * greatest(said, spelled) > n AS most, spelled FROM heard),
folds AS (SELECT f, min(d) AS d, sum(spelled) / sum(n) AS share FROM known WHERE sure GROUP BY f HAVING min(d) = max(d)),
asked AS (SELECT DISTINCT w AS word, CASE WHEN regexp_matches(lower(w), '[aeiou]') THEN 'say' ELSE 'spell' END AS r FROM u WHERE regexp_full_match(w, '\p{{Latin}}{{2,6}}') AND w <> upper(w)),
met AS (SELECT word, r, k.d AS kd, a.d AS ad, k.share AS ks, a.share AS sh, CASE WHEN k.sure THEN 'dictionary' WHEN a.f IS NOT NULL THEN 'case-variant' WHEN k.most AND k.n >= 3 AND k.d <> r THEN 'exception' ELSE 'rule' END AS source FROM asked LEFT JOIN known AS k ON k.w = word LEFT JOIN folds AS a ON a.f = lower(word))
SELECT word, source, CASE source WHEN 'rule' THEN r WHEN 'case-variant' THEN ad ELSE kd END AS decision, CASE source WHEN 'rule' THEN NULL WHEN 'case-variant' THEN sh ELSE ks END AS spell_share FROM met""")
def spelled_tokens(spark, sf_dir):
    """Every different word of two to six letters in the conversations: spelled or said, by the users' turns (heard spelled by their number)."""
    tokens = _turn_words(spark, sf_dir)
    word, turn = F.col("word"), F.col("turn")
    apart = (letters.rule(word) == "spell") | ((F.length(word) == 2) & (turn % 3 > 0)) | ((F.length(word) == 3) & (turn % 2 == 0))
    spoken = F.when(apart, F.array_join(F.split(F.lower(word), ""), " ")).otherwise(F.lower(word))
    heard = tokens.where("role = 'user'").select(F.lit("PLAIN").alias("class"), word.alias("written"), spoken.alias("spoken"))
    asked = tokens.where(letters.may_be_spelled(word)).select("word").distinct()
    return letters.spelled_or_said(asked, "word", letters.heard_words(heard))


_ROMAN_SQL = "['', 'X', 'XX', 'XXX', 'XL', 'L'][{0} // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][{0} % 10 + 1]"


@query(rf"""WITH heard AS (SELECT {_ROMAN_SQL.format("q")} AS w, l_partkey % (q % 4 + 1) = 0 AS numeral FROM (SELECT l_partkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem) WHERE q > 0), counted AS (SELECT w, count(*) FILTER (WHERE numeral) AS c, count(*) AS n FROM heard WHERE length(w) > 1 GROUP BY w),
pool AS (SELECT sum(c) / sum(n) AS p FROM counted), runs AS (SELECT DISTINCT w AS run FROM (SELECT unnest({_SPLIT}) AS w FROM documents) WHERE regexp_full_match(w, '\p{{Lu}}{{2,}}') UNION SELECT DISTINCT {_ROMAN_SQL.format("p_size")} FROM part),
shared AS (SELECT run, CASE WHEN length(run) > 1 AND regexp_full_match(run, 'M{{0,3}}(C[MD]|D?C{{0,3}})(X[CL]|L?X{{0,3}})(I[XV]|V?I{{0,3}})') THEN (coalesce(c, 0) + 5 * p) / (coalesce(n, 0) + 5) ELSE 0 END AS numeral_share FROM runs CROSS JOIN pool LEFT JOIN counted ON w = run)
SELECT run, numeral_share, CASE WHEN numeral_share > 0.5 THEN 'number:cardinal:roman' ELSE 'letters:run' END AS reading FROM shared""")
def roman_runs(spark, sf_dir):
    """Runs of capitals in the documents and the parts' sizes in Roman numerals: numbers or letters, by the lines' quantities."""
    q = F.col("l_quantity").cast("long")
    kind = F.when(F.col("l_partkey") % (q % 4 + 1) == 0, "CARDINAL").otherwise("LETTERS")
    heard = read_table(spark, sf_dir, "lineitem").select(kind.alias("class"), letters.roman(q).alias("written"))
    runs = read_table(spark, sf_dir, "documents").select(F.explode(letters.words(F.col("text"))).alias("run")).where(F.col("run").rlike(r"\A\p{Lu}{2,}\z"))
    sizes = read_table(spark, sf_dir, "part").select(letters.roman(F.col("p_size")).alias("run"))
    return letters.roman_veto(runs.unionAll(sizes).distinct(), "run", letters.roman_counts(heard))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, string_split(p_name, ' ') AS w FROM part),
heard AS (SELECT k, s, (k + s) % 3 = 0 OR (w[1] < 'h' AND k % 2 = 0) AS measure, CASE WHEN s % 5 > 0 THEN w[1] END AS a, CASE WHEN s % 5 > 1 THEN w[2] END AS b FROM p),
said AS (SELECT a AS w FROM heard UNION ALL SELECT b FROM heard UNION ALL SELECT 'in' FROM heard WHERE NOT measure), frequent AS (SELECT lower(w) AS word FROM said WHERE w IS NOT NULL GROUP BY lower(w) HAVING count(*) >= 10),
classed AS (SELECT measure, CASE WHEN a IS NULL THEN '</s>' WHEN word IS NULL THEN 'other' ELSE word END AS word_class FROM heard LEFT JOIN frequent ON word = lower(a)),
counts AS (SELECT word_class, count(*) FILTER (WHERE measure) AS m, count(*) FILTER (WHERE NOT measure) AS p FROM classed GROUP BY word_class),
asked AS (SELECT DISTINCT CASE WHEN s % 3 > 0 THEN w[1] END AS first_word, CASE WHEN s % 3 > 1 THEN w[2] END AS second_word FROM p),
found AS (SELECT first_word, second_word, CASE WHEN first_word IS NULL THEN '</s>' WHEN word IS NULL THEN 'other' ELSE word END AS word_class FROM asked LEFT JOIN frequent ON word = lower(first_word))
SELECT first_word, second_word, word_class, CASE word_class WHEN '</s>' THEN true WHEN 'other' THEN second_word IS NULL ELSE coalesce(m > 0 AND m > p, false) END AS is_measure FROM found LEFT JOIN counts USING (word_class)""")
def bare_inches(spark, sf_dir):
    """Whether a number and "in" before the words of a part's name are inches, by what was heard before each word."""
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("s"), F.split("p_name", " ").alias("w"))
    k, s, at = F.col("k"), F.col("s"), lambda i: F.get("w", F.lit(i))
    token = lambda kind, written: F.struct(F.lit(kind).alias("class"), written.cast("string").alias("written"))
    measure = ((k + s) % 3 == 0) | ((at(0) < "h") & (k % 2 == 0))
    head = F.when(measure, F.array(token("MEASURE", F.concat(s.cast("string"), F.lit(" in"))))).otherwise(F.array(token("CARDINAL", s), token("PLAIN", F.lit("in"))))
    tail = F.filter(F.array(token("PLAIN", F.when(s % 5 > 0, at(0))), token("PLAIN", F.when(s % 5 > 1, at(1)))), lambda t: t["written"].isNotNull())
    tokens = parts.select("k", F.posexplode(F.concat(head, tail)).alias("place", "t")).select("k", "place", "t.*")
    frequent = letters.frequent_words(tokens, 10)
    asked = parts.select(F.when(s % 3 > 0, at(0)).alias("first_word"), F.when(s % 3 > 1, at(1)).alias("second_word")).distinct()
    return letters.bare_inches(asked, "first_word", "second_word", letters.inch_counts(tokens, ["k"], frequent), frequent)
