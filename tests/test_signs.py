"""Coordinates, runs of signs and variants of abbreviations, by hand."""

from pyspark.sql import functions as F

from spokenspark.operators import signs


def test_coordinates(spark):
    texts = ["at 48°51'24\"N, 2.35° E!", "91°N 90°S 180°W 181°E", "5°60'N 5°3\"N 1°1'01\"E", "x5°N 5°Nx 5°", "😀 0°W", "", None, "-5°N"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: None if r.c is None else [(x.start, x.end, x.spoken) for x in r.c] for r in df.select("t", signs.coordinates(F.col("t")).alias("c")).collect()}
    assert got[texts[0]] == [(3, 13, "forty-eight degrees fifty-one minutes twenty-four seconds north"), (15, 22, "two point three five degrees east")]
    assert [x[2] for x in got[texts[1]]] == ["ninety degrees south", "one hundred eighty degrees west"] and [x[2] for x in got[texts[2]]] == ["one degree one minute one second east"]
    assert got[texts[3]] == [] and got[texts[4]] == [(2, 5, "zero degrees west")] and got[""] == [] and got[None] is None and got["-5°N"] == []


def test_sign_runs(spark):
    df = spark.createDataFrame([("a *** b----c ##",), ("=====",), ("**==!!!",), ("",), (None,)], "t string")
    got = {r.t: None if r.c is None else [(x.start, x.end, x.spoken) for x in r.c] for r in df.select("t", signs.sign_runs(F.col("t")).alias("c")).collect()}
    assert got == {"a *** b----c ##": [(2, 5, "line of asterisk"), (7, 11, "line of hyphen")], "=====": [(0, 5, "line of equals sign")], "**==!!!": [(4, 7, "line of exclamation mark")], "": [], None: None}
    assert [len(r.c) for r in df.select(signs.sign_runs(F.col("t"), 2).alias("c")).collect() if r.c is not None] == [3, 1, 3, 0]


def test_abbreviation_variants(spark):
    entries = spark.createDataFrame([("Dr.", "doctor"), ("e.g.", "for example"), ("St.", "saint"), ("ST.", "street"), ("Dr.", "doctor")], "written string, spoken string")
    rows = {(r.surface, r.written): r.kind for r in signs.variants(entries).collect()}
    assert rows == {
        ("Dr", "Dr."): "no-period", ("DR.", "Dr."): "upper", ("dr.", "Dr."): "lower", ("eg", "e.g."): "no-period", ("E.G.", "e.g."): "upper",
        ("St", "St."): "no-period", ("st.", "St."): "lower", ("ST", "ST."): "no-period", ("st.", "ST."): "lower",
    }
    docs = spark.createDataFrame([(1, "Dr Who, dr. No and Dr. X"), (2, "at st. 5, E.G. this, eg. that"), (3, ""), (4, None), (2, "ST end."), (5, "Drs DRx")], "id int, text string")
    got = sorted((r.id, r.start, r.end, r.surface, r.spoken) for r in signs.found_variants(docs, "text", entries).collect())
    assert got == [(1, 0, 2, "Dr", "doctor"), (1, 8, 11, "dr.", "doctor"), (2, 0, 2, "ST", "street"), (2, 3, 6, "st.", "saint"), (2, 3, 6, "st.", "street"), (2, 10, 14, "E.G.", "for example"), (2, 21, 23, "eg", "for example")]
    assert signs.found_variants(docs.limit(0), "text", entries).count() == 0
