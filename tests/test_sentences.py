"""Sentences against a plain version, streams against tables, in whatever chunks, batches and order."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spokenspark.functions import arrays
from spokenspark.functions import text as tf
from spokenspark.operators import sentences as sent
from spokenspark.streaming.stream import settle, settled_sentences

TEXTS = [
    "Dr. Smith came on Jan. 5, 2021. He left. J. Doe stayed at 5 p.m. Then rest.", "One.\u2003Two came. Rest. 3 more! \"Yes.\" (No.) \u201cWell.\u201d End", "a\n\n\nb\n \nC. d", "", "  ", "word " * 900 + "end. Next one.", "x" * 2500 + ". Y",
    "\uff11\uff10\uff4b\uff4d. It is \uff15\uff0e\uff16\uff05 of \uff17\uff2d\uff42x. \u00c9t\u00e9 vs. Hiver, etc. A. B. C. Co. Ltd. \U0001f600 Ok?\u00a0Yes!", "We saw cats, dogs, etc. It is approx. 5. See Fig. 3.", "(a. B) stays. Gen. X. went. Ends with space.   ", "." * 40 + " A" * 700,
]


def table(spark, texts, **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", F.explode(sent.sentences(tf.folded(F.col("t")), **more)).alias("s")).collect()
    return {i: [(r.s.start, r.s.end, r.s.sent) for r in rows if r.i == i] for i in range(len(texts))}


def plain(text):
    """The rules one by one, at every place."""
    text, out, begin = tf.fold_text(text), [], 0
    ends = sent.cuts(text) + [(len(text), len(text))]
    for a, b in ends:
        while a - begin > 1024:
            k = next((i for i in range(begin + 1024, begin, -1) if text[i - 1] in "\t\n\x0b\f\r "), begin + 1024)
            out.append((begin, text[begin:k]))
            begin = k
        out.append((begin, text[begin:a]))
        begin = b
    return [(s, s + len(t.rstrip("\t\n\x0b\f\r ")), t.rstrip("\t\n\x0b\f\r ")) for s, t in out if t.strip("\t\n\x0b\f\r ")]


def test_tables_cut_as_the_plain_version(spark):
    got = table(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i] == plain(t), t
    assert [s for _, _, s in got[0]] == ["Dr. Smith came on Jan. 5, 2021.", "He left.", "J. Doe stayed at 5 p.m. Then rest."]
    assert all(e - s <= 1024 for x in got.values() for s, e, _ in x) and len(got[6]) == 4


def test_exceptions_and_spans_of_callers(spark):
    text = "Dr. A met Qu. B (It rained. Much. So) and left. End"
    assert len(table(spark, [text])[0]) == 5
    assert [s for _, _, s in table(spark, [text], exceptions=["Qu."])[0]] == ["Dr.", "A met Qu. B (It rained.", "Much.", "So) and left.", "End"]
    kept = arrays.matches(F.col("t"), r"\([^()]*\)")
    assert [s for _, _, s in table(spark, [text], spans=kept)[0]] == ["Dr. A met Qu.", "B (It rained. Much. So) and left.", "End"]


def test_running_maxima(spark):
    rng = random.Random(2)
    for n in (0, 1, 64, 65, 300):
        x = [rng.randrange(1000) for _ in range(n)]
        got = spark.createDataFrame([(x,)], "x array<int>").select(arrays.running_max(F.col("x")), arrays.running_sums(F.col("x"))).first()
        assert list(got) == [[max(x[: i + 1]) for i in range(n)], [sum(x[: i + 1]) for i in range(n)]]


def test_long_text_takes_time_in_proportion(spark):
    text = "Mr. A saw it. They came in Jan. 5 times. " * 20_000
    began = time.time()
    assert spark.createDataFrame([(text,)], "t string").select(F.size(sent.sentences(F.col("t")))).first()[0] == 40_000 and time.time() - began < 40


def test_fold_of_streams_equals_fold_of_tables(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("１２a5．，％＋－ｋｍｇＭＢ ‘”\u00a0x.") for _ in range(60)) for _ in range(60)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", tf.folded(F.col("t")).alias("f")).collect()
    assert all(r.f == tf.fold_text(texts[r.i]) for r in got)


@pytest.mark.parametrize("seed", range(6))
def test_any_chunks_settle_as_tables(spark, seed):
    rng = random.Random(seed)
    texts = TEXTS + [" ".join(rng.choice(TEXTS) for _ in range(3))]
    for i, rows in table(spark, texts).items():
        t, found, pending, at, cut = texts[i], [], "", 0, 0
        while cut < len(t):
            end = min(len(t), cut + rng.choice([1, 2, 3, 9, 200, 3000]))
            done, pending, at = settle(pending + t[cut:end], at)
            found, cut = found + done, end
            assert len(pending) <= 1024 + 8 + len(pending) - len(pending.rstrip()) + 1
        found += settle(pending, at, True)[0]
        assert found == [(s, x) for s, _, x in rows], t


def test_chunks_out_of_order_over_batches(spark, tmp_path):
    rng, folder = random.Random(8), tmp_path / "in"
    chunks = []
    for i, t in enumerate(TEXTS):
        parts = [t[k : k + 17] for k in range(0, len(t), 17)] + [None]
        chunks += [(i, n, p) for n, p in enumerate(parts)]
    rng.shuffle(chunks)
    chunks += rng.sample(chunks, 20)  # some come twice
    for b in range(0, len(chunks), len(chunks) // 4 + 1):
        spark.createDataFrame(chunks[b : b + len(chunks) // 4 + 1], "stream_id long, seq long, text string").coalesce(1).write.mode("append").parquet(str(folder))
    read = spark.readStream.schema("stream_id long, seq long, text string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = settled_sentences(read).writeStream.format("memory").queryName("shuffled").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got, want = spark.table("shuffled").collect(), table(spark, TEXTS)
    for i in range(len(TEXTS)):
        assert sorted((r.start, r.sent) for r in got if r.stream_id == i) == [(s, x) for s, _, x in want[i]]
    assert {r.missing for r in got} == {0}


def test_a_missing_chunk_is_given_up(spark, tmp_path):
    rows = [(1, 0, "One came. Tw", 0), (1, 2, " left. Three", 1), (2, 0, "Still here. And", 0)]
    batches = [rows, [(3, 0, "Later. Yes", 4000)], [(3, 1, " more. X", 8000)], [(3, 2, " y. Z", 8001)]]
    kind = "stream_id long, seq long, text string, s long"
    for b in batches:
        spark.createDataFrame(b, kind).selectExpr("stream_id", "seq", "text", "timestamp_seconds(1000000000 + s) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    read = spark.readStream.schema("stream_id long, seq long, text string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = settled_sentences(read, "10 minutes").writeStream.format("memory").queryName("waiting").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("waiting").orderBy("start").collect()
    assert [(r.sent, r.missing) for r in got if r.stream_id == 1] == [("One came.", 0), ("Tw left.", 1), ("Three", 1)]
    assert [r.sent for r in got if r.stream_id == 2] == ["Still here.", "And"]
