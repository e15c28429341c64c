"""Benchmark decontamination with a positional inverted index of the training documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Different benchmark words that every task holds; a benchmark with more is looked up in several passes over the documents.
BLOCK_TERMS = 1_000_000
_WORD = bytes(c for c in range(256) if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or 0x41 <= c <= 0x5A)
_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _WORD else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, a-z and whatever isn't ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes that name a row: the same in every pass, whatever the order of rows. Repeated rows share them."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.xxhash64(doc, F.lit(1), text).alias("key"), F.xxhash64(text).alias("text_hash"), doc.alias("doc_id"), text.alias("text"))


def benchmark_words(items: DataFrame) -> DataFrame:
    """(word) of all items (item_id, text), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array({w for t in batch.column(0) for w in words(t.as_py())}, pa.binary())], ["word"])

    return items.select("text").mapInArrow(run, "word binary").distinct()


def windows(items: DataFrame, terms: dict[bytes, int], counts: np.ndarray, size: int) -> DataFrame:
    """win (term numbers of each run of `size` item words, the whole item if it is shorter), items (those that have it), and the
    places in it of its rarest and its second rarest different words (the same if it has one word only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, None] = {}
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = [terms[x] for x in words(text.as_py())]
                for i in range(max(1, len(w) - size + 1) if w else 0):
                    win = tuple(w[i : i + size])
                    order = sorted(range(len(win)), key=lambda i: (counts[win[i]], win[i], i))
                    second = next((i for i in order if win[i] != win[order[0]]), order[0])
                    rows[(item, win, order[0], second)] = None
            columns = zip(*rows) if rows else [()] * 4
            kinds = (pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["item_id", "win", "first", "second"])

    made = items.mapInArrow(run, "item_id string, win array<int>, first int, second int")
    return made.groupBy("win", "first", "second").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def term_counts(docs: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """How often each term occurs in all documents: one row per term and task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(filter(terms.__contains__, words(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([terms[w] for w in seen], pa.int32()), pa.array(seen.values(), pa.int64())], ["term", "n"])

    counts = np.zeros(len(terms), np.int64)
    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for term, n in found.toLocalIterator():
        counts[term] = n
    return counts


def postings(docs: DataFrame, terms: dict[bytes, int], posted: set[bytes], reach: int) -> DataFrame:
    """The index: a row per occurrence of a posted term with the ids of the words within `reach` of it (-1: no benchmark word,
    -2: beyond the text); and one row per document, with term null and its number of words in pos."""
    text_at, names = 3, ["key", "text_hash", "doc_id", "term", "pos", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = np.zeros(len(terms) + 2, bool)
        rare[[terms[w] for w in posted]] = True
        span = np.arange(-reach, reach + 1)
        for batch in batches:
            of, at, near, n_words = [], [], [], []
            for i, text in enumerate(batch.column(text_at)):
                w = words(text.as_py())
                n_words.append(len(w))
                coded = np.full(len(w) + 2 * reach, -2, np.int32)
                coded[reach : reach + len(w)] = np.fromiter((terms.get(x, -1) for x in w), np.int32, len(w))
                here = np.flatnonzero(rare[coded])
                if len(here):
                    of += [i] * len(here)
                    at.append(here)
                    near.append(coded[here[:, None] + span])
            flat = np.concatenate(near) if near else np.zeros((0, 2 * reach + 1), np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, 2 * reach + 1, dtype=np.int32), pa.array(flat.ravel()))
            pos = np.concatenate(at) - reach if at else np.zeros(0, np.int64)
            mine = [c.take(pa.array(of, pa.int64())) for c in batch.columns[:text_at]]
            yield pa.RecordBatch.from_arrays([*mine, pa.array(flat[:, reach]), pa.array(pos, pa.int64()), lists], names)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], pa.nulls(n, pa.int32()), pa.array(n_words, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))], names)

    return _texts(docs).mapInArrow(run, "key long, text_hash long, doc_id long, term int, pos long, near array<int>")


def _block(docs: DataFrame, items: DataFrame, size: int, near: int) -> tuple[DataFrame, DataFrame]:
    """Documents (key, text_hash, doc_id, n_words) and matches (key, text_hash, start, length, items, exact, alike) for a block of items."""
    terms = {bytes(r["word"]): i for i, r in enumerate(benchmark_words(items).orderBy("word").toLocalIterator())}
    counts = term_counts(docs, terms) if terms else np.zeros(0, np.int64)
    sought = stored(windows(items, terms, counts, size), "windows")
    sought = sought.select("win", "items", F.explode(F.array_distinct(F.array("first", "second"))).alias("off"), F.col("first").alias("rarest"))
    sought = sought.select(F.get("win", F.col("off")).alias("term"), "off", "win", "items", (F.col("off") == F.col("rarest")).alias("rarest"))
    posted = {r["term"] for r in sought.select("term").distinct().toLocalIterator()}  # some of the terms of this block
    named = list(terms)
    index = stored(postings(docs, terms, {named[i] for i in posted}, size - 1), "postings")
    met = index.where("term IS NOT NULL").join(sought, "term").withColumn("length", F.size("win"))
    exact = F.col("rarest") & (F.slice("near", F.lit(size) - F.col("off"), F.col("length")) == F.col("win"))
    alike = F.size(F.array_intersect("near", "win")) >= F.least(F.lit(near), F.size(F.array_distinct("win")))
    met = met.select("key", "text_hash", (F.col("pos") - F.col("off")).alias("start"), "length", "items", exact.alias("exact"), alike.alias("alike"))
    matches = met.where("exact OR alike").select("key", "text_hash", "start", "length", "exact", F.explode("items").alias("item_id"))
    return index.where("term IS NULL").select("key", "text_hash", "doc_id", F.col("pos").alias("n_words")), matches


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, near: int = 9) -> DataFrame:
    """For every document: n_words, n_hit (words inside any occurrence of an item's window), items (those with an exact
    window), near_items (those with a window of which `near` different words or more, or all if it has fewer, stand within
    `size` - 1 words of an occurrence of its rarest or second rarest one), contaminated, and text_hash (xxhash64 of the text).

    docs: doc_id, text; benchmark: item_id, text. The corpus frequency of every benchmark word is counted over all
    documents; each window is sought by its two rarest words only, whose postings carry the words around them, so the other
    words' lists are intersected at their offsets without another shuffle. Windows are made, joined and grouped by Spark; a
    task holds at most about BLOCK_TERMS words of the benchmark, and a larger one takes several passes over the documents.
    Null and empty texts have no words. Items with a null id or no word are left out; items with equal ids are one. Repeated
    documents are each judged for themselves. No items: nothing is contaminated.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = 1 + benchmark_words(items).count() // BLOCK_TERMS
    counted: DataFrame | None = None
    matches: DataFrame | None = None
    for b in range(blocks):
        of, found = _block(docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), size, near)
        counted = of if counted is None else counted
        matches = found if matches is None else matches.unionAll(found)
    spans = F.array_sort(F.collect_set(F.when(F.col("exact"), F.struct("start", (F.col("start") + F.col("length")).alias("end")))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto")
        ),
        lambda acc: acc["n"],
    )
    per_doc = matches.groupBy("key", "text_hash").agg(
        spans.alias("spans"), F.collect_set(F.when(F.col("exact"), F.col("item_id"))).alias("items"), F.collect_set("item_id").alias("near_items")
    )
    per_doc = per_doc.select("key", "text_hash", covered.alias("n_hit"), F.array_sort("items").alias("items"), F.array_sort("near_items").alias("near_items"))
    none = F.array().cast("array<string>")
    return counted.join(per_doc, ["key", "text_hash"], "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - l + 1)) AS i FROM bl)),
dl AS (SELECT doc_id, w, l FROM d, (SELECT DISTINCT l FROM bl) WHERE len(w) >= l),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - l + 1)) AS i FROM dl)),
hit AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
