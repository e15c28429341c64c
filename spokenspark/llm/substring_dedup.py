"""Exact removal of repeated byte strings across and inside documents.

The README says why strings are named by content-defined anchors and digests here, and not by a difference-cover sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Different parts of one anchor that one task compares; an anchor with more has its strings spread.
CROWD = 2_000
#: Bytes hashed in one go; blocks overlap, so a long text needs little memory.
BLOCK = 1 << 20
_PRIMES = (0x100000001B3, 0x9E3779B97F4A7C15 | 1)
_INVERSES = tuple(pow(p, -1, 1 << 64) for p in _PRIMES)
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(p: int, n: int) -> np.ndarray:
    size = 1 << max(n - 1, 1).bit_length()
    if (p, size) not in _powers:
        steps = np.full(size, p, np.uint64)
        steps[0] = 1
        _powers[p, size] = np.cumprod(steps, dtype=np.uint64)
    return _powers[p, size][:n]


def string_hashes(data: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash, mixed, of every k-byte string of data (uint8)."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_PRIMES[which], n), out=sums[1:], dtype=np.uint64)
    h = (sums[k:] - sums[:-k]) * _power(_INVERSES[which], n - k + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _least_before(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    m, s = h, 1
    while 2 * s <= w:
        m, s = np.minimum(m[:-s], m[s:]), 2 * s
    return np.minimum(m[: len(h) - w + 1], m[w - s : w - s + len(h) - w + 1]) if s < w else m


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of start positions of `length`-byte strings that share their least inner half-length hash: hash, first and last start.

    The least inner hash is a function of the string alone, so equal strings have equal ones wherever they stand. A run
    comes twice if its least hash stands at several places in it, as in periodic texts.
    """
    k = length // 2
    w = length - k + 1
    found = []
    for at in range(0, max(len(text) - length + 1, 0), BLOCK):
        h = string_hashes(np.frombuffer(text, np.uint8)[at : at + BLOCK + length - 1], k)
        m = _least_before(h, w)
        first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        last = np.append(first[1:], len(m)) - 1
        found.append((m[first], first + at, last + at))
        padded = np.concatenate([np.zeros(w - 1, np.uint64), m, np.zeros(w - 1, np.uint64)])
        if np.count_nonzero(h == ~_least_before(~padded, w)) > len(first):
            more = [i for i, (s, e) in enumerate(zip(first, last)) if np.count_nonzero(h[s : e + w] == m[s]) > 1]
            found.append((m[first[more]], first[more] + at, last[more] + at))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _bytes(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document (doc_id, text).

    A byte goes if a string of `length` bytes that covers it starts at another place too, in the same text or another;
    strings are taken from the input. Null and empty texts have no bytes. Repeated rows are documents of their own, so
    they are copies of each other.

    1. Each text gives its anchors; an anchor that occurs once in the corpus marks strings that do, and they are left.
    2. Equal texts go on as one text. Its other anchors' strings are cut out with what they span, and equal cuts go on as
       one cut: what occurs twice as a whole is repeated as a whole.
    3. The different cuts of an anchor meet in a task, which names each string inside by 128 bits and looks for equal names.
    An anchor with more than CROWD different cuts has its strings counted by name over all tasks instead, and names that
    count twice are joined back; so a passage that a third of the texts share is spread.
    Every count is an aggregate with a sum on the way, and every join is of two stored tables.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), "text")})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, hashes, starts, ends = [], [], [], [], []
            for text in batch.column(3):
                b = _bytes(text)
                h, s, e = anchors(b, length)
                n.append(len(b))
                sha.append(hashlib.sha256(b).hexdigest())
                hashes.append(h.view(np.int64))
                starts.append(s)
                ends.append(e)
            of = lambda x, t: pa.array(x, pa.list_(t))
            yield _batch({"k1": batch.column(0), "k2": batch.column(1), "doc_id": batch.column(2), "n_bytes": pa.array(n, pa.int64()), "sha": pa.array(sha, pa.string()), "anchor": of(hashes, pa.int64()), "first": of(starts, pa.int64()), "last": of(ends, pa.int64())})

    marked = stored(docs.select("k1", "k2", "doc_id", "text").mapInArrow(mark, "k1 long, k2 long, doc_id long, n_bytes long, sha string, anchor array<long>, first array<long>, last array<long>"), "marked")
    often = stored(marked.select(F.explode("anchor").alias("anchor")).groupBy("anchor").count().where("count > 1").select("anchor"), "often")
    each = marked.select("k1", "k2", F.explode(F.arrays_zip("anchor", "first", "last")).alias("a")).select("k1", "k2", "a.*").join(often, "anchor")
    runs = stored(each.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("first", "last", "anchor"))).alias("runs")), "runs")
    texts = stored(docs.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies")).join(runs, ["k1", "k2"]), "texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, text, runs in zip(*(batch.column(i) for i in range(4))):
                b = _bytes(text)
                for r in runs.as_py():
                    part = b[r["first"] : r["last"] + length]
                    rows.append((r["anchor"], k1.as_py(), k2.as_py(), r["first"], r["last"], xxhash.xxh64_intdigest(part) - (1 << 63), xxhash.xxh64_intdigest(part, 1) - (1 << 63)))
            yield _batch({c: pa.array(v, pa.int64()) for c, v in zip(("anchor", "k1", "k2", "first", "last", "c1", "c2"), zip(*rows) if rows else [()] * 7)})

    cuts = stored(texts.select("k1", "k2", "text", "runs").mapInArrow(cut, "anchor long, k1 long, k2 long, first long, last long, c1 long, c2 long"), "cuts")
    kinds = stored(cuts.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "last")).alias("own")), "kinds")
    crowded = stored(kinds.groupBy("anchor").count().where(F.col("count") > CROWD).select("anchor", F.lit(True).alias("crowded")), "crowded")
    owned = kinds.join(crowded, "anchor", "left").groupBy(F.col("own.k1").alias("k1"), F.col("own.k2").alias("k2"))
    owned = texts.select("k1", "k2", "text").join(owned.agg(F.collect_list(F.struct("own.first", "own.last", "anchor", "c1", "c2", "crowded")).alias("own")), ["k1", "k2"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own in zip(batch.column(0), batch.column(1)):
                b = _bytes(text)
                rows += [(r["anchor"], r["c1"], r["c2"], bool(r["crowded"]), b[r["first"] : r["last"] + length]) for r in own.as_py()]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield _batch({c: pa.array(v, t) for c, v, t in zip(("anchor", "c1", "c2", "crowded", "part"), zip(*rows) if rows else [()] * 5, types)})

    parts = stored(owned.select("text", "own").mapInArrow(part, "anchor long, c1 long, c2 long, crowded boolean, part binary"), "parts")

    def names(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Of all strings of a batch's parts: the part's row, the place in it and the two names."""
        sizes = np.array([len(x) for x in batch.column("part").to_pylist()], np.int64)
        data = np.frombuffer(b"".join(batch.column("part").to_pylist()), np.uint8)
        begins, counts = np.cumsum(sizes) - sizes, sizes - length + 1
        row = np.repeat(np.arange(len(sizes)), counts)
        at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        h1, h2 = (string_hashes(data, length, w)[begins[row] + at] for w in (0, 1))
        return row, at.astype(np.int32), h1, h2

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of the anchor; equal strings have equal anchors, so each run of anchors is judged by itself."""
        held: list[pa.RecordBatch] = []

        def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, at, h1, h2 = names(batch)
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            again = np.zeros(len(row), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            row, at = row[again], at[again]
            rows, starts = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(at))
            return _batch({"c1": batch.column("c1").take(pa.array(rows)), "c2": batch.column("c2").take(pa.array(rows)), "ats": lists})

        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                held.append(batch.slice(k, 2048))
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                anchor = whole.column("anchor").to_numpy()
                upto = int(np.searchsorted(anchor, anchor[-1]))
                if upto:
                    yield judge(whole.slice(0, upto))
                held = [whole.slice(upto)]
        if held and held[0].num_rows:
            yield judge(held[0])

    # the usual case: the few parts of an anchor meet in one task
    few = parts.where("NOT crowded").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(meet, "c1 long, c2 long, ats array<int>")

    # an anchor that many different parts have: each string is spread by its own name
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                row, at, h1, h2 = names(batch)
                take = pa.array(row)
                yield _batch({"c1": batch.column("c1").take(take), "c2": batch.column("c2").take(take), "at": pa.array(at), "h1": pa.array(h1.view(np.int64)), "h2": pa.array(h2.view(np.int64))})

    strings = parts.where("crowded").select("c1", "c2", "part").mapInArrow(name, "c1 long, c2 long, at int, h1 long, h2 long")
    twice = stored(strings.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "twice")
    many = strings.join(twice, ["h1", "h2"]).groupBy("c1", "c2").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    hit = stored(few.unionByName(many), "hit")
    judged = stored(cuts.join(kinds.where("n > 1").select("c1", "c2", F.lit(True).alias("whole")), ["c1", "c2"], "left").join(hit, ["c1", "c2"], "left").where("whole OR ats IS NOT NULL").select("k1", "k2", "first", "last", "whole", "ats"), "judged")
    per_text = judged.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last", "whole", "ats")).alias("found"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, text, copies, found in zip(*(batch.column(i) for i in range(5))):
                b = _bytes(text)
                edge = np.zeros(len(b) + 1, np.int32)
                if copies.as_py() > 1 and len(b) >= length:
                    edge[0], edge[-1] = 1, -1
                for f in found.as_py() or ():
                    if f["whole"]:
                        edge[f["first"]] += 1
                        edge[f["last"] + length] -= 1
                    else:
                        s = np.asarray(f["ats"]) + f["first"]
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
                rows.append((k1.as_py(), k2.as_py(), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield _batch({c: pa.array(v, t) for c, v, t in zip(("k1", "k2", "n_removed", "n_spans", "kept"), zip(*rows) if rows else [()] * 5, kinds_)})

    cleaned = stored(texts.select("k1", "k2", "text", "copies").join(per_text, ["k1", "k2"], "left").mapInArrow(remove, "k1 long, k2 long, n_removed long, n_spans long, kept string"), "cleaned")
    out = marked.select("k1", "k2", "doc_id", "n_bytes", "sha").join(cleaned, ["k1", "k2"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
