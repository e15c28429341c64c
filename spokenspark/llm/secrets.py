"""Secret scans: rules are sought through a trigram index and verified with their regular expressions."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, leftmost and without overlap, whose group has at least `least` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


#: The base rules as the contract states them, then the published formats of some providers.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]+", 24, 0, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
]


def _runs(parsed) -> list[list[str | None]]:
    """The alternatives of a parsed expression, each as its letters in order; None stands where anything may be."""
    found: list[list[str | None]] = [[]]
    for op, arg in parsed:
        if op is sre.LITERAL:
            more = [[chr(arg).lower()]]
        elif op is sre.SUBPATTERN:
            more = _runs(arg[3])
        elif op is sre.BRANCH:
            more = [r for x in arg[1] for r in _runs(x)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            more = [r * min(arg[0], 3) + ([None] if arg[0] != arg[1] or arg[0] > 3 else []) for r in _runs(arg[2])]
        else:
            more = [[None]]
        found = [a + b for a in found for b in more]
    return found


def trigram_query(pattern: str) -> list[set[str]]:
    """Any of the sets, all trigrams of a set: what the lower-cased text of every match holds. Empty if some match needs none."""
    sets = []
    for run in _runs(sre_parser.parse(pattern)):
        text = "".join("\0" if c is None else c for c in run)
        sets.append({text[i : i + 3] for i in range(len(text) - 2) if "\0" not in text[i : i + 3]})
    return sets if all(sets) else []


def _spans(rule: Rule, rank: int) -> Column:
    """rank, start and end (code points, end exclusive) of a rule's matches in the column text."""
    pattern = F.lit(rule.pattern)
    hits, parts = F.regexp_extract_all("text", pattern, F.lit(0)), F.split("text", rule.pattern, -1)
    kept = F.regexp_extract_all("text", pattern, F.lit(rule.group))
    rows = F.arrays_zip(F.transform(parts, F.length).alias("gap"), F.transform(hits, F.length).alias("long"), F.transform(kept, F.length).alias("size"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["long"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["size"] >= max(rule.least, 1), F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    long_enough = f"{rule.pattern[:-1]}{{{rule.least},}}" if rule.kind == "hex" else rule.pattern
    return F.when(F.col("text").rlike(long_enough), F.aggregate(rows, zero, step, lambda acc: acc["found"]))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, kinds): the rules whose trigram query a text meets; key is the text's hash, so copies are one text.

    The index has a posting (trigram, key) for each trigram that some query names; a set's postings are intersected by
    counting how many of its trigrams a text has.
    """
    sets = [(r.kind, f"{r.kind}{i}", g, len(s)) for r in rules for i, s in enumerate(trigram_query(r.pattern)) for g in sorted(s)]
    grams = sorted({s[2] for s in sets})
    low = F.lower("text")
    present = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))
    postings = docs.select(F.xxhash64("text").alias("key"), F.explode(present).alias("gram")).distinct()
    asked = docs.sparkSession.createDataFrame(sets, "kind string, set string, gram string, size int")
    met = postings.join(asked, "gram").groupBy("key", "kind", "set").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return met.where("n = size").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def scan_secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """docs with found, an array of (start, rank, end) by start and then by the rule's rank; text is kept as it is.

    Rules with mandatory trigrams are verified on the candidates only; the others read every text. Null and empty texts
    have no spans. Rows come out as often as they go in; a column named found is replaced.
    """
    rules = RULES if rules is None else rules
    docs = docs.drop("found")
    read = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    some = stored(candidates(read, rules), "candidates")
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    met = keyed.join(some.withColumnRenamed("kinds", "_kinds").withColumnRenamed("key", "_key"), "_key", "left")
    each = []
    for rank, rule in enumerate(rules):
        spans = _spans(rule, rank)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains("_kinds", rule.kind), spans)
        each.append(F.coalesce(spans, F.array().cast("array<struct<start:int,rank:int,end:int>>")))
    return met.withColumn("found", F.array_sort(F.concat(*each))).select(*docs.columns, "found")


def redact(docs: DataFrame, rules: list[Rule] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by mark (touching or overlapping ones by one mark); n_chars, if there is one, follows."""
    found = scan_secrets(docs, rules)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.col("text").substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = (s["start"] > acc["at"]) | ((acc["at"] == 0) & (acc["out"] == ""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, F.when(fresh, F.lit(mark)).otherwise(F.lit(""))).alias("out"))

    clean = F.aggregate("found", zero, step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    out = found.withColumn("text", F.when(F.size("found") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [i for i, r in enumerate(RULES) if r.base]
    names = F.array(*[F.lit(r.kind) for r in RULES])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_rank = lambda i: F.size(F.filter("found", lambda s: s["rank"] == i)).cast("long")
    counts = {f"n_{RULES[i].kind}": of_rank(i) for i in base}
    found = found.select("doc_id", "found").withColumns(counts)
    own = F.filter("found", lambda s: s["rank"].isin(base))
    return found.select("doc_id", *counts, F.sha2(said(own), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def _kind_sql(rank: int, r: Rule) -> str:
    p = r.pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, unnest(list_transform(generate_series(1, len(h)), lambda i:
  {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0), 'n': length(h[i]), 'k': length(k[i])}})) AS m
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS h, regexp_extract_all(t, '{p}', {r.group}) AS k, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')) AS q{rank}
"""


_EACH = " UNION ALL ".join(_kind_sql(i, r) for i, r in enumerate(RULES))
_LEAST = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS ({_EACH}),
f AS (SELECT doc_id, rank, kind, CAST(m.s AS BIGINT) AS s, concat(kind, ':', CAST(m.s AS BIGINT), ':', CAST(m.s + m.n AS BIGINT)) AS said FROM e WHERE m.k >= CASE kind {_LEAST} END),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(said, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(said, ',' ORDER BY s, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
