from pyspark.sql import functions as F

from spokenspark.operators import choices, detect, resolve


def test_curated_and_ranked(spark):
    rows = [(1, 0, "fraction:flexible", "1/2", 0, "one half", "first"), (1, 0, "fraction:flexible", "1/2", 1, "one over two", "over")]
    forms = spark.createDataFrame(rows, "doc_id long, start int, type string, surface string, place int, spoken string, provenance string").withColumn("end", F.lit(3))
    curated = spark.createDataFrame([("fraction:flexible", "1/2", "a half", "us"), ("fraction:flexible", "1/2", "one half", "us")], "type string, surface string, spoken string, source string")
    more = choices.with_curated(forms, curated)
    assert sorted(r.spoken for r in more.collect()) == ["a half", "one half", "one over two"]
    shares = spark.createDataFrame([("fraction:flexible", "over", 0.9)], "type string, provenance string, share double")
    assert [r.spoken for r in choices.ranked_forms(more, shares, ["doc_id"]).orderBy("rank").collect()] == ["one over two", "one half", "a half"]


def test_neighbours(spark):
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b c".split())], "s int, pos int, token string")
    got = {r.token: (r.before, r.after) for r in choices.neighbours(t, ["s"]).collect()}
    assert got["a"] == (["<s>"] * 3, ["b", "c"]) and got["c"] == (["<s>", "a", "b"], ["</s>", "</s>"])


def test_covers(spark):
    spans = [(0, 2), (1, 4), (4, 6), (2, 4), (5, 7)]
    df = spark.createDataFrame([(1, [(s, e, 0, "t", "x") for s, e in sorted(spans)])], f"k int, found {detect.READING}")
    r = df.select(resolve.cover_counts(F.col("found")).alias("n"), resolve.n_best_covers(F.col("found"), 100).alias("c"), resolve.best_cover(F.col("found")).alias("b")).first()
    import itertools

    every = [c for n in range(6) for c in itertools.combinations(sorted(spans), n) if all(a[1] <= b[0] for a, b in itertools.pairwise(c))]
    assert int(r.n) == len(every) == len(r.c)
    assert [(x.start, x.end) for x in r.c[0].chain] == [(x.start, x.end) for x in r.b]
    assert [(c.covered, c.fewer) for c in r.c] == sorted(((sum(e - s for s, e in c), -len(c)) for c in every), reverse=True)
