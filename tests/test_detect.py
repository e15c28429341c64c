"""Each family alone gives what it gives among all, counts equal readings, and what may stand beside free values."""

from pyspark.sql import functions as F

from spokenspark.operators import detect

TEXTS = [
    "We saw cats, dogs, etc.", "It is approx.", "see vs.", "He met Dr.", "A site is example.org", "see www.example.net", "It has U.S.A.", "Run NASA", "the NASA-led", "Chapter IX", "100 % & more", "a #tag", "½", "mail a@b.com", "http://x.y",
    "in 12 F.2d 340 and 5 S. Ct. 17.", "at 7: 45, not 27: 10 or 7: 99", "code (4 5 6) or 4 5 6.5", "v1.2.3, v1.2 xv1.2.3 v10.0.0.1.", "ISBN 0-306-40615-2 and 0-306-40615-3", "on Jan. 5, 2021 at 5 p.m.", "plain words only. And more",
]


def test_families_alone_and_together(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    together, total = {}, {}
    for r in df.select("i", F.explode(detect.candidates(F.col("t"))).alias("c")).collect():
        together.setdefault(r.c.rank, []).append((r.i, r.c.start, r.c.end, r.c.surface))
        total[r.c.type] = total.get(r.c.type, 0) + 1
    alone = df.select("i", *[detect.spans(F.col("t"), f, k).alias(f"f{k}") for k, f in enumerate(detect.FAMILIES)]).collect()
    for k, f in enumerate(detect.FAMILIES):
        assert sorted(together.get(k, [])) == sorted((r.i, c.start, c.end, c.surface) for r in alone for c in r[f"f{k}"]), f
    assert {r.type: r.n for r in detect.counts(df, "t").collect()} == total
    assert total["abbreviation"] >= 4


def test_free_values(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    kinds = ["number:cardinal:citation", "time:spaced-colon", "number:digits:spaced", "version:dotted"]
    families = [f for f in detect.FAMILIES if f.type in kinds]
    got = {}
    for r in df.select(F.explode(detect.candidates(F.col("t"), families)).alias("c")).collect():
        got.setdefault(r.c.type, []).append(r.c.surface)
    assert got == {"number:cardinal:citation": ["12 F.2d", "5 S. Ct."], "time:spaced-colon": ["7: 45"], "number:digits:spaced": ["4 5 6", "4 5"], "version:dotted": ["v1.2.3", "v10.0.0.1"]}
