import pandas as pd
import pytest
from pyspark.sql import functions as F

from spokenspark.operators.sentences import sentences
from spokenspark.plans import evaluate, priors
from spokenspark.plans import queries as plans
from spokenspark.sources.tables import expected, read_labelled
from spokenspark.streaming.stream import settle, settled_sentences

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROWS = [("DATE", "1994", "nineteen ninety four"), ("CARDINAL", "1994", "one thousand"), ("DATE", "1995", "nineteen ninety five"), ("LETTERS", "USA", "u s a"), ("PLAIN", "NASA", "nasa"), ("ELECTRONIC", "ab.12", "ab dot one two"), ("TELEPHONE", "212-555", "two")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "class string, written string, spoken string")


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = plans.QUERIES[name](spark, SF).toPandas(), c.execute(plans.ORACLE_SQL[name]).df()
    k = sorted(b.columns)
    assert sorted(a.columns) == k
    order = lambda x: x[k].astype(str).sort_values(k).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(a), order(b))


def test_priors(spark, rows):
    types = {(r.shape, r["class"]): (r.n, r.total) for r in priors.type_priors(rows).collect()}
    assert types["N", "DATE"] == (2, 3) and types["N-N", "TELEPHONE"] == (1, 1)
    asked = spark.createDataFrame([("N", "DATE"), ("N", "MONEY"), ("A", "DATE")], "shape string, class string")
    tiers = {(r.shape, r["class"]): r.tier for r in priors.reading_prior(asked, priors.type_priors(rows)).collect()}
    assert tiers == {("N", "DATE"): "measured", ("N", "MONEY"): "attested-zero", ("A", "DATE"): "unsupported"}
    acronyms = {r.key: (r.spelled, r.said) for r in priors.acronym_priors(rows).collect()}
    assert acronyms["*"] == (1, 1) and acronyms["surface:USA"] == (1, 0)
    assert {(r.kind, r.key) for r in priors.electronic_priors(rows).collect()} == {("letters", "2:lower:vowel"), ("sign", "."), ("digits", "digits:2")}
    assert {r.century for r in priors.century_priors(rows).collect()} == {"19"}


def test_labelled_shards(spark, tmp_path):
    (tmp_path / "output-00000-of-00100").write_text("PLAIN\tHi\t<self>\nPUNCT\t.\tsil\n<eos>\t<eos>\nDATE\t1994\tnineteen\n<eos>\t<eos>\n")
    (tmp_path / "output-00099-of-00100").write_text("PLAIN\tNo\t<self>\n<eos>\t<eos>\n")
    got = read_labelled(spark, str(tmp_path), range(0, 90)).withColumn("target", expected(F.col("spoken"), F.col("written"), F.col("class"))).collect()
    assert {f.rsplit("/", 1)[1] for f in read_labelled(spark, str(tmp_path), range(0, 90)).inputFiles()} == {"output-00000-of-00100"}
    assert sorted((r.sent_id, r.pos, r.target) for r in got) == [(0, 1, "Hi"), (0, 2, ""), (1, 1, "nineteen")]


def test_evaluation(spark):
    df = spark.createDataFrame([(1, "one two", ["One, two"]), (1, "x", ["y", "x"]), (2, "a", ["a"])], "sent_id int, target string, said array<string>")
    r = evaluate.accuracy(evaluate.scored(df)).first()
    assert (r.tokens, round(r.first, 3), r["any"], r.sentences) == (3, 0.667, 1.0, 0.5)
    clusters = spark.range(200).select(F.col("id").alias("cluster"), (F.col("id") % 2).alias("v"), F.lit(1).alias("w"))
    low, high = evaluate.bootstrap(clusters, "v", "w").first()
    assert 0.38 < low < 0.5 < high < 0.62
    s = spark.range(1, 50).select(F.col("id").alias("n"), (F.col("id") ** 2).alias("c"))
    assert abs(evaluate.scaling(s, "n", "c").first().exponent - 2) < 1e-6


STREAM = "One is 1. Two are 22! And three.  Dr. Smith came at 5 p.m. today. J. Doe (not \"he\") left...\n\n  \nA new one?\n\n\nlower case. Rest"


def test_settle_equals_tables(spark):
    """Every chunking in two and each one of a fixed size gives the sentences that a table gives."""
    table = [(r.start, r.sent) for r in spark.createDataFrame([(STREAM,)], "t string").select(F.explode(sentences(F.col("t"))).alias("s")).select("s.start", "s.sent").collect()]
    assert len(table) == 8
    for cuts in [[k] for k in range(len(STREAM))] + [list(range(n, len(STREAM), n)) for n in (1, 2, 3, 7)]:
        found, pending, at, before = [], "", 0, 0
        for end in [*cuts, len(STREAM)]:
            done, pending, at = settle(pending + STREAM[before:end], at, end == len(STREAM))
            found, before = found + done, end
        assert found == table, cuts


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    text = STREAM
    for i, k in enumerate(range(0, len(text), 9)):
        spark.createDataFrame([(7, i, text[k : k + 9])], "stream_id long, seq long, text string").coalesce(1).write.mode("append").parquet(str(folder))
    spark.createDataFrame([(7, i + 1, None)], "stream_id long, seq long, text string").coalesce(1).write.mode("append").parquet(str(folder))
    chunks = spark.readStream.schema("stream_id long, seq long, text string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = settled_sentences(chunks).writeStream.outputMode("append").format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.start, r.sent) for r in spark.table("settled").collect())
    assert got == [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(F.explode(sentences(F.col("t"))).alias("s")).select("s.start", "s.sent").collect()]


def test_values_are_judged_once(spark, tmp_path):
    """Each different value is said once and by all tasks, its rows are all counted; a null price is wrong."""
    rows = spark.sql("SELECT * FROM VALUES (CAST(1500 AS BIGINT), DATE'1994-03-01', CAST(12.5 AS DOUBLE)), (7, DATE'1994-05-01', 12.5), (8, DATE'2001-01-01', NULL), (9, NULL, 12.5) AS t(o_orderkey, o_orderdate, o_totalprice)")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    found = plans.evaluate_normalization(spark, str(tmp_path))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "Repartition 4, true" in plan and "Deduplicate" in plan
    assert {r["class"]: (r.tokens, r.first, r.any, r.sentences) for r in found.collect()} == {"CARDINAL": (4, 0.75, 0.75, 0.75), "DATE": (4, 0.75, 0.75, 0.75), "MONEY": (4, 0.75, 0.75, 0.75)}


def test_order_forms_are_counted_first(spark):
    """Days and prices are counted before they are written, so that no row is written for itself."""
    plan = plans.normalize_order_forms(spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate [o_orderdate#" in plan and "Aggregate [o_totalprice#" in plan
