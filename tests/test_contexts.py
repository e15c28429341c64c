"""Ranges, spelled words, Roman numerals and inches by counts, against small hand-made and random cases."""

import random
from collections import Counter

from pyspark.sql import functions as F

from spokenspark.operators import letters, ranges

TOKENS = "s int, place int, class string, written string, spoken string"


def sentence(k, *tokens):
    return [(k, i, *t) for i, t in enumerate(tokens)]


def number(written, spoken):
    return ("CARDINAL", written, spoken)


def test_between_numbers(spark):
    texts = ["call 555-1234 or 1-2-3", "at 10:30, 2 x 4 and 3 – 5.", "7×8", "a-b 1- 2", "1,000-2,000", "😀 1-2", "", None, "5 -", "1-2 3-4"]
    got = {r.t: None if r.b is None else [(x.start, x.end, x.left, x.sign, x.right) for x in r.b] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", ranges.between_numbers(F.col("t")).alias("b")).collect()}
    assert got["call 555-1234 or 1-2-3"] == [(5, 13, "555", "-", "1234")] and got["at 10:30, 2 x 4 and 3 – 5."] == [(3, 8, "10", ":", "30"), (10, 15, "2", "x", "4"), (20, 25, "3", "–", "5")]
    assert got["7×8"] == [(0, 3, "7", "×", "8")] and got["a-b 1- 2"] == [(4, 8, "1", "-", "2")] and got["1,000-2,000"] == [(0, 11, "1,000", "-", "2,000")] and got["😀 1-2"] == [(2, 5, "1", "-", "2")]
    assert got[""] == got["5 -"] == [] and got[None] is None and got["1-2 3-4"] == [(0, 3, "1", "-", "2"), (4, 7, "3", "-", "4")]


def test_sub_keys(spark):
    cases = {("1", "-", "20"): "dash:1+2", ("1", "–", "05"): "dash:1+2:0", ("10", ":", "30"): "ratio:clock", ("16", ":", "79"): "ratio:2+2", ("1,000", "-", "2,000"): "dash:4+4", ("1,00", "×", "2"): "dimension:other", ("1", "/", "2"): None}
    rows = spark.createDataFrame(list(cases), "l string, s string, r string")
    assert {(r.l, r.s, r.r): r.k for r in rows.withColumn("k", ranges.sub_key(F.col("l"), F.col("s"), F.col("r"))).collect()} == cases


def test_range_counts_and_decisions(spark, monkeypatch):
    monkeypatch.setattr(ranges, "MIN_N", 3)
    rows, to, silent = [], ("PUNCT", "-", "to"), ("PUNCT", "-", "sil")
    for k in range(4):
        rows += sentence(k, number("5", "five"), to, number("9", "nine"))
    rows += sentence(4, ("DATE", "1994", "nineteen ninety-four"), ("PUNCT", "–", "to"), ("DATE", "1996", "nineteen ninety six"))
    rows += sentence(5, number("5", "five"), silent, number("1", "one"), silent, number("2", "two"))  # three in a row
    rows += sentence(6, number("5", "five"), ("PUNCT", "-", "minus"), number("1", "one")) + sentence(7, to, number("1", "one"))  # no range word; no left end
    for k in range(8, 14):
        rows += sentence(k, ("TELEPHONE", "555-1234", "five five five one two three four"))
    tokens = spark.createDataFrame(rows, TOKENS)
    counts = ranges.emission_counts(tokens, ["s"])
    assert {r.key: (r.as_range, r.single) for r in counts.collect()} == {"dash:1+1": (4, 0), "dash:4+4": (1, 0), "dash:3+4": (0, 6), "dash": (5, 6)}
    spans = spark.createDataFrame([("1", "-", "2"), ("555", "-", "0000"), ("1990", "-", "1991"), ("1", "x", "2"), ("1", "-", "2")], "left string, sign string, right string")
    got = Counter((r.left, r.key, r.as_range, r.emits) for r in ranges.decided(spans, counts).collect())
    assert got == Counter({("1", "dash:1+1", 4, True): 2, ("555", "dash:3+4:0", 0, False): 1, ("1990", "dash:4+4", 5, False): 1, ("1", "dimension:1+1", None, False): 1})
    joint = ranges.joint_counts(tokens, ["s"])
    assert {(r.key, r.source): r.n for r in joint.collect()} == {("dash:1+1", "cardinal+to+cardinal"): 4, ("dash:4+4", "year+to+year"): 1}
    assert {(r.kind, r.connector): (r.n, r.share) for r in ranges.connector_shares(joint).collect()} == {("dash", "to"): (5, 1.0)}
    assert ranges.emission_counts(tokens.limit(0), ["s"]).count() == 0 and ranges.decided(spans, counts.limit(0)).where("emits").count() == 0


def test_range_readings(spark):
    joint = spark.createDataFrame([("dash", "dash:4+4", "year+to+year", 3), ("dash", "dash:4+4", "cardinal+to+cardinal", 1), ("dash", "dash:1+1", "cardinal+silent+cardinal", 6)], "kind string, key string, source string, n long")
    spans = spark.createDataFrame([("1994", "-", "1996"), ("7", "-", "8"), ("3", "x", "007"), ("1994", "-", "1996")], "left string, sign string, right string")
    got = {}
    for r in ranges.readings(spans, joint).orderBy("rank").collect():
        got.setdefault(r.left, []).append((r.source, r.spoken, r.share))
    years = got["1994"]
    assert years[0] == ("year+to+year", "nineteen ninety-four to nineteen ninety-six", (3 + 5 * 0.3) / 9) and years[1][0] == "cardinal+silent+cardinal" and years[1][2] == 5 * 0.6 / 9
    assert years[2][0] == "cardinal+to+cardinal" and len(years) == 18 and all(share is None for *_, share in years[3:])
    assert [x[1] for x in got["7"]] == ["seven eight", "seven to eight"] and got["7"][0][2] == (6 + 5 * 0.6) / 11  # digits say the same as cardinals
    assert [x[:2] for x in got["3"]] == [("digits+by+digits", "three by o o seven"), ("digits+x+digits", "three x o o seven")] and all(x[2] is None for x in got["3"])


def test_lone_letters(spark):
    texts = ["I see a B.", "A-b c1 É", "😀 x", "", None, "I'm"]
    got = {r.t: None if r.c is None else [(x.start, x.type[:4], x.surface) for x in r.c] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", letters.lone_letters(F.col("t")).alias("c")).collect()}
    assert got == {"I see a B.": [(0, "word", "I"), (6, "word", "a"), (8, "lett", "B")], "A-b c1 É": [(0, "word", "A"), (2, "lett", "b"), (7, "lett", "É")], "😀 x": [(2, "lett", "x")], "": [], None: None, "I'm": [(0, "word", "I"), (2, "lett", "m")]}


def test_spelled_or_said(spark):
    heard = [("abc", "a b c")] * 6 + [("tvs", "tvs")] * 2 + [("tvs", "t v s")] + [("Xyz", "xyz")] * 5 + [("rst", "rst")] * 5 + [("RST", "r s t")] * 5 + [("mno", "m n o")] * 3 + [("uv", "u v")] * 2 + [("toolong", "toolong")]
    counts = letters.heard_words(spark.createDataFrame([("PLAIN", *r) for r in heard], "class string, written string, spoken string"))
    words = ["abc", "ABc", "tvs", "xyz", "Rst", "rst", "mno", "uv", "bcd", "abe", None, "abc"]
    tokens = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i int")
    got = {r.i: (r.decision, r.source, r.spell_share) for r in letters.spelled_or_said(tokens, "w", counts).collect()}
    assert got[0] == got[11] == ("spell", "dictionary", 1.0) and got[1] == ("spell", "case-variant", 1.0) and got[2] == ("say", "exception", 1 / 3) and got[3] == ("say", "case-variant", 0.0)
    assert got[4] == ("spell", "rule", None)  # rst and RST disagree
    assert got[5] == ("say", "dictionary", 0.0) and got[6] == ("spell", "exception", 1.0) and got[7] == ("say", "rule", None) and got[8] == ("spell", "rule", None) and got[9] == ("say", "rule", None) and len(got) == 12
    assert {r.i: r.source for r in letters.spelled_or_said(tokens, "w", counts, case_variants=False).collect()}[1] == "rule"
    able = {r.w for r in tokens.where(letters.may_be_spelled(F.col("w"))).collect()}
    assert able == {w for w in words if w}


def test_roman_numerals(spark):
    said = {r.n: r.w for r in spark.range(0, 4001).select(F.col("id").alias("n"), letters.roman(F.col("id")).alias("w")).collect()}
    values = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    worth = lambda w: sum(-values[c] if c != w[-1] and i + 1 < len(w) and values[w[i + 1]] > values[c] else values[c] for i, c in enumerate(w))
    assert said[0] is None and said[4000] is None and said[1994] == "MCMXCIV" and len(set(said.values())) == 4000
    assert all(worth(said[n]) == n for n in random.Random(1).sample(range(1, 4000), 300) if len(set(said[n])) > 1 and said[n][-1] not in said[n][:-1])
    rows = [("CARDINAL", "II", "two")] * 3 + [("LETTERS", "CD", "c d")] * 9 + [("ORDINAL", "IV", "fourth")] * 8 + [("LETTERS", "IIII", "i i i i"), ("CARDINAL", "V", "five")]
    counts = letters.roman_counts(spark.createDataFrame(rows, "class string, written string, spoken string"))
    assert {r.key: (r.numeral, r.other) for r in counts.collect()} == {"roman:*": (11, 9), "roman:II": (3, 0), "roman:CD": (0, 9), "roman:IV": (8, 0)}
    runs = spark.createDataFrame([("II",), ("CD",), ("XX",), ("ABC",), (None,), ("IIII",), ("V",)], "w string")
    got = {r.w: (r.numeral_share, r.reading) for r in letters.roman_veto(runs, "w", counts).collect()}
    assert got["II"] == ((3 + 5 * 0.55) / 8, "number:cardinal:roman") and got["CD"][1] == "letters:run" and got["XX"] == (0.55, "number:cardinal:roman") and got["ABC"] == got["IIII"] == got["V"] == (0.0, "letters:run")
    assert {r.numeral_share for r in letters.roman_veto(runs, "w", counts.limit(0)).collect()} == {0.0}


def test_bare_inches(spark):
    rows = []
    for k in range(4):
        rows += [(k, 0, "MEASURE", "5 in"), (k, 1, "PLAIN", "pipe")] + [(10 + k, 0, "CARDINAL", "5"), (10 + k, 1, "PLAIN", "in"), (10 + k, 2, "PLAIN", "total")]
    rows += [(20, 0, "CARDINAL", "5"), (20, 1, "PLAIN", "in"), (20, 2, "PLAIN", "Pipe"), (21, 0, "MEASURE", "5 kg"), (22, 0, "PLAIN", "no"), (22, 1, "PLAIN", "in")]
    tokens = spark.createDataFrame(rows, "s int, place int, class string, written string")
    frequent = letters.frequent_words(tokens, 4)
    assert {r.word for r in frequent.collect()} == {"pipe", "total", "in"}
    counts = letters.inch_counts(tokens, ["s"], frequent)
    assert {r.word_class: (r.measure, r.preposition) for r in counts.collect()} == {"pipe": (4, 1), "total": (0, 4), "</s>": (1, 0)}
    asked = spark.createDataFrame([("Pipe", "x"), ("total", None), (None, None), ("rare", None), ("rare", "x"), ("in", None)], "a string, b string")
    assert {(r.a, r.b): r.is_measure for r in letters.bare_inches(asked, "a", "b", counts, frequent).collect()} == {("Pipe", "x"): True, ("total", None): False, (None, None): True, ("rare", None): True, ("rare", "x"): False, ("in", None): False}


def test_sentences_count_as_often_as_they_were_said(spark):
    rows = [("a", 3, 0, "CARDINAL", "1", "one"), ("a", 3, 1, "PUNCT", "-", "to"), ("a", 3, 2, "CARDINAL", "5", "five"), ("b", 2, 0, "TELEPHONE", "1-5", "one five")]
    tokens = spark.createDataFrame(rows, "k string, n long, place int, class string, written string, spoken string")
    assert {(r.key, r.as_range, r.single) for r in ranges.emission_counts(tokens, ["k", "n"], "n").collect()} == {("dash:1+1", 3, 2), ("dash", 3, 2)}
    assert [(r.source, r.n) for r in ranges.joint_counts(tokens, ["k", "n"], "n").collect()] == [("cardinal+to+cardinal", 3)]
