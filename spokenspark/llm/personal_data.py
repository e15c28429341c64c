"""Personal data and what gives it away: a term that the corpus nearly always shows beside one protected value says that value.

Values (addresses, numbers of machines, cards and telephones) are found by form. How strongly a term reveals a value is
pointwise mutual information, PMI = ln(N n(t, v) / (n(t) n(v))), measured by what the value itself says, IC = ln(N / n(v)):
N is the number of terms in the corpus, n(t) those that are t, n(v) the mentions of v, and n(t, v) the mentions of v with t
among the tokens around. A term with PMI >= SHARE * IC for some value is generalised, and removed if all its places are there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import matches, stored, table

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The largest number of a part of an address of four.
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """name; plain, the contract's expression; pattern, one with the same matches that takes time in proportion to the text
    (no place is tried twice, and no repetition is undone); sign, what any match holds."""

    name: str
    plain: str
    pattern: str
    sign: str


#: A chain of digits is a whole match of the contract's expression, so shorter ones than 16 digits need not be looked at.
KINDS = [
    Kind("email", rf"{_LOCAL}+@{_LABEL}+(?:\.{_LABEL}+)+", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@"),
    Kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9]){15,}+", r"[0-9]{4}|[0-9][\x20-][0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
]
#: What the method adds, by rank after the kinds.
ADDED = ["generalised", "removed"]
#: Words and figures, of which contexts are made.
TERM = r"[\p{L}\p{N}]+"
#: A token is a value's form or a term.
_FORMS = (0, 3, 1, 2)
TOKEN = "|".join([KINDS[i].pattern for i in _FORMS] + [TERM])
TOKEN_PLAIN = "|".join(["(?:" + KINDS[i].plain.replace("[0-9])+", "[0-9]){15,}") + ")" if i == 2 else KINDS[i].plain for i in _FORMS] + [TERM])
#: What only a value's form holds, among tokens.
NO_TERM = r"[@+.\x20-]|^[0-9]{16}"
#: Tokens on each side of a value that are its context; the mentions in which they must be seen together; the share of IC.
AROUND, SUPPORT, SHARE = 8, 2, 0.95
#: 64 times so many places has the filter of disclosing terms: half a megabyte, whatever the corpus holds.
PLACES = 1 << 16
FOUND = "array<struct<rank:int,start:int,end:int>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a number's digits pass the check of cards: from the right every second one is doubled, its digits added."""
    doubled = F.array(*[F.lit(2 * d - (9 if d > 4 else 0)) for d in range(10)])

    def one(i: Column) -> Column:
        d = digits.substr(F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.get(doubled, d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + one(i)) % 10 == 0


def holds(rank: int, hit: Column) -> Column:
    """Whether a match of a kind is one: parts of at most 255, 16 to 19 digits that pass luhn(), 8 to 15 digits."""
    if rank == 1:
        return hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if rank == 2:
        return F.when(F.length(_digits(hit)).between(16, 19), luhn(_digits(hit))).otherwise(F.lit(False))
    return F.length(_digits(hit)).between(8, 15) if rank == 3 else F.lit(True)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_spans(text: Column) -> Column:
    """rank, start and end of the values in a text, by kind and then by start."""
    none = F.array().cast(FOUND)

    def of(rank: int, kind: Kind) -> Column:
        kept = F.filter(matches(text, kind.pattern), lambda m: holds(rank, m["hit"]))
        return F.when(text.rlike(kind.sign), F.transform(kept, lambda m: F.struct(F.lit(rank).alias("rank"), m["start"], m["end"]))).otherwise(none)

    return F.concat(*[of(i, k) for i, k in enumerate(KINDS)])


def value_of(token: Column) -> Column:
    """The value that a token (in lower case) is, the same for all ways to write its digits; null for terms and what does not hold."""
    of = F.when(token.contains("@"), token).when(token.startswith("+"), F.when(holds(3, token), F.concat(F.lit("+"), _digits(token))))
    return of.when(token.contains("."), F.when(holds(1, token), token)).when(token.rlike("^[0-9]"), F.when(holds(2, token), _digits(token)))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(TOKEN), F.lit(0))


def mentions(docs: DataFrame) -> DataFrame:
    """value and around: the mentions of values in docs (text) and the different terms about each."""
    some = docs.where(reduce(or_, [F.col("text").rlike(k.sign) for k in KINDS])).select(_tokens(F.col("text")).alias("tokens"))
    form = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("at"), F.when(t.rlike(NO_TERM), value_of(t)).alias("value"))), lambda x: x["value"].isNotNull())
    each = some.withColumn("m", F.explode(form))
    first = F.greatest(F.col("m.at") - AROUND, F.lit(0))
    near = F.concat(F.slice("tokens", first + 1, F.col("m.at") - first), F.slice("tokens", F.col("m.at") + 2, F.lit(AROUND)))
    return each.select("m.value", F.array_distinct(F.filter(near, lambda t: ~t.rlike(NO_TERM))).alias("around"))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """term and rank (generalised or removed) of the terms that reveal some value, from counts over all of docs (key, text).

    A term must be seen with SUPPORT mentions of a value, in whatever texts. Terms are counted in each task before they are
    shuffled, as are values and pairs.
    """
    counts = stored(docs.select(F.explode(_tokens(F.col("text"))).alias("term")).where(~F.col("term").rlike(NO_TERM)).groupBy("term").agg(F.count("*").alias("n_term")), "terms")
    total = counts.agg(F.sum("n_term")).first()[0] or 0
    seen = stored(mentions(docs), "mentions")
    values = seen.groupBy("value").agg(F.count("*").alias("n_value"))
    pairs = seen.select("value", F.explode("around").alias("term")).groupBy("value", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= SUPPORT)
    joined = pairs.join(values, "value").join(counts, "term")
    both, n = F.least("n_both", "n_term"), F.lit(float(total))
    known = F.log(n * both / (F.col("n_term") * F.col("n_value"))) >= SHARE * F.log(n / F.col("n_value"))
    rank = F.when(F.col("n_both") >= F.col("n_term"), len(KINDS) + 1).otherwise(len(KINDS))
    return joined.where(known).groupBy("term").agg(F.max(rank).alias("rank"))


def _filter_of(terms: DataFrame) -> Column:
    """An array of PLACES numbers with a bit for each term: one row of a fixed size, whatever the number of terms."""
    h = F.xxhash64("term")
    bits = terms.select(F.pmod(F.shiftright(h, 6), F.lit(PLACES)).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int")).alias("bit"))
    each = terms.sparkSession.range(PLACES).join(bits.groupBy("id").agg(F.bit_or("bit").alias("bits")), "id", "left")
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("bits")).scalar()


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """key and found (rank, start, end) of the places of terms (term, rank) in the texts of docs (key, text); texts without are left out.

    A filter of a fixed size keeps all but some terms' places from being shuffled. Equal texts are looked up once.
    """
    bits = _filter_of(terms)
    h = F.xxhash64("term")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    each = docs.select("key", F.explode(matches(lowered(F.col("text")), TOKEN)).alias("m")).select("key", "m.start", "m.end", F.col("m.hit").alias("term"))
    places = each.where(F.get(bits, F.pmod(F.shiftright(h, 6), F.lit(PLACES)).cast("int")).bitwiseAND(bit) != 0).distinct()
    met = places.join(terms, "term")
    return met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "end"))).alias("found"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs with found, an array of (rank, start, end) by rank and then by start; a column named found is replaced.

    Ranks are those of KINDS, then of ADDED. Values are found in each text for itself, disclosing terms by counts over all
    texts of docs. Null and empty texts have no spans; rows of equal texts have equal spans, and rows come out as often as
    they go in, whatever their doc_id. Without documents, or without values, no term is added.
    """
    docs = docs.drop("found")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    terms = stored(disclosing_terms(read), "disclosing")
    added = stored(term_spans(read, terms), "places")
    keyed = docs.withColumns({"_key": F.xxhash64(text), "_base": base_spans(text)})
    out = keyed.join(added.withColumnRenamed("key", "_key").withColumnRenamed("found", "_added"), "_key", "left")
    found = F.concat("_base", F.coalesce("_added", F.array().cast(FOUND)))
    return out.select(*docs.columns, found.alias("found"))


def _replaced(text: Column, pattern: str, mark) -> Column:
    """text with each match m of pattern as mark(m); linear in the text."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.when(F.size(hits) > 0, F.array_join(F.zip_with(gaps, hits, lambda g, h: F.when(h.isNull(), g).otherwise(F.concat(g, mark(h)))), "")).otherwise(text)


def sanitized(docs: DataFrame) -> DataFrame:
    """docs with each value in text as its kind in brackets, each generalised term as [TERM] and without the removed ones.

    n_chars, if there is one, follows. Null texts stay null. No row goes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    terms = stored(disclosing_terms(read), "disclosing")
    places = read.select("key", F.explode(F.array_distinct(_tokens(F.col("text")))).alias("term")).distinct().join(terms, "term")
    own = stored(places.groupBy(F.col("key").alias("_key")).agg(*[F.collect_list(F.when(F.col("rank") == len(KINDS) + i, F.col("term"))).alias(f"_{a}") for i, a in enumerate(ADDED)]), "own")
    out = docs.withColumn("_key", F.xxhash64(text)).join(own, "_key", "left")
    clean = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(
        _replaced(F.col("text"), TOKEN, lambda h: F.when(F.array_contains("_removed", lowered(h)), "").when(F.array_contains("_generalised", lowered(h)), "[TERM]").otherwise(h))
    )
    out = out.withColumn("text", clean)
    for i, k in enumerate(KINDS):
        marked = _replaced(F.col("text"), k.pattern, lambda h, i=i, k=k: F.when(holds(i, h), f"[{k.name.upper()}]").otherwise(h))
        out = out.withColumn("text", F.when(F.col("text").rlike(k.sign), marked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values in every document, and the terms of all documents that give one away."""
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    names = F.array(*[F.lit(x) for x in [k.name for k in KINDS] + ADDED])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_rank = lambda i: F.size(F.filter("found", lambda s: s["rank"] == i)).cast("long")
    return found.select("doc_id", *[of_rank(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS)], F.sha2(said(F.filter("found", lambda s: s["rank"] < len(KINDS))), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def _spans_sql(name: str, source: str, pattern: str) -> str:
    """A table name(doc_id, s, e, h) of a pattern's matches in the column t of source."""
    p = pattern.replace("'", "''")
    return f"""{name}_hits AS (SELECT doc_id, unnest(h) AS h, unnest(g[1:len(h)]) AS g, generate_subscripts(h, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS g FROM {source} WHERE regexp_matches(t, '{p}'))),
{name} AS (SELECT doc_id, i, e - length(h) AS s, e, h FROM (SELECT *, sum(length(g) + length(h)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM {name}_hits))"""


_LUHN_SQL = "list_sum(list_transform(range(length({0})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({0}, CAST(length({0}) - i AS INTEGER), 1) AS INTEGER) ELSE ([0, 2, 4, 6, 8, 1, 3, 5, 7, 9])[CAST(substr({0}, CAST(length({0}) - i AS INTEGER), 1) AS INTEGER) + 1] END)) % 10 = 0"
_D = "regexp_replace({0}, '[^0-9]', '', 'g')"
_HOLDS_SQL = {
    "email": "true",
    "ip": f"regexp_matches({{0}}, '^{_BYTE.replace('{1,2}', '{{1,2}}')}(\\.{_BYTE}){{{{3}}}}$')",
    "card": f"(length({_D}) BETWEEN 16 AND 19 AND {_LUHN_SQL.replace('{0}', _D)})",
    "phone": f"length({_D}) BETWEEN 8 AND 15",
}
_BASE_SQL = ",\n".join(_spans_sql(k.name, "d", k.plain) for k in KINDS)
_ALL_SQL = " UNION ALL ".join(f"SELECT doc_id, {i} AS rank, '{k.name}' AS kind, s, e FROM {k.name} WHERE {_HOLDS_SQL[k.name].format('h')}" for i, k in enumerate(KINDS))
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
low AS (SELECT doc_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM d),
{_BASE_SQL},
base AS ({_ALL_SQL}),
{_spans_sql("tokens", "low", TOKEN_PLAIN)},
shaped AS (SELECT doc_id, i, s, e, h, NOT regexp_matches(h, '{NO_TERM}') AS term, CASE WHEN NOT regexp_matches(h, '{NO_TERM}') THEN NULL WHEN contains(h, '@') THEN h
    WHEN starts_with(h, '+') THEN CASE WHEN {_HOLDS_SQL['phone'].format('h')} THEN '+' || {_D.format('h')} END WHEN contains(h, '.') THEN CASE WHEN {_HOLDS_SQL['ip'].format('h')} THEN h END
    WHEN {_HOLDS_SQL['card'].format('h')} THEN {_D.format('h')} END AS v FROM tokens),
n_term AS (SELECT h AS term, count(*) AS n FROM shaped WHERE term GROUP BY 1),
n_all AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM n_term),
n_value AS (SELECT v, count(*) AS n FROM shaped WHERE v IS NOT NULL GROUP BY 1),
pairs AS (SELECT v, h AS term, count(*) AS n FROM (SELECT DISTINCT m.doc_id, m.i, m.v, c.h FROM shaped AS m JOIN shaped AS c ON c.doc_id = m.doc_id AND c.i BETWEEN m.i - {AROUND} AND m.i + {AROUND}
    WHERE m.v IS NOT NULL AND c.term) GROUP BY 1, 2),
known AS (SELECT p.term, max(CASE WHEN p.n >= t.n THEN {len(KINDS) + 1} ELSE {len(KINDS)} END) AS rank FROM pairs AS p JOIN n_term AS t ON t.term = p.term JOIN n_value AS v ON v.v = p.v, n_all AS a
  WHERE p.n >= {SUPPORT} AND ln(a.n * least(p.n, t.n) / (t.n * v.n)) >= {SHARE} * ln(a.n / v.n) GROUP BY 1),
every AS (SELECT * FROM base UNION ALL SELECT doc_id, rank, CASE rank WHEN {len(KINDS)} THEN '{ADDED[0]}' ELSE '{ADDED[1]}' END, s, e FROM shaped JOIN known ON shaped.term AND known.term = shaped.h),
said AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS)}, string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY rank, s) FILTER (rank < {len(KINDS)}) AS base,
  string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY rank, s) AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{k.name}, 0) AS BIGINT) AS n_{k.name}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN said ON d.doc_id = said.doc_id
"""
