"""Periodic runs of words, caught as squares by catchers over completed blocks of power-of-two lengths.

A run is a maximal stretch whose words repeat after q places, q the least such period, with two periods or more. Where the
words q apart agree for q places, those places hold a whole aligned block of 2^k words for the k with 2^(k+1) <= q < 2^(k+2).
So the catchers of level k are the blocks that are complete and two or three blocks behind the appended word's suffix of 2^k
words, and each appended word is compared with these two at each level, by hashes of words so far. What agrees is a square in
the making: it is grown both ways by the same hashes, compared word by word, and merged into the run that holds it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The fewest words of a run.
LEAST = 12
#: Periods below this one are compared at every place; from it on blocks of four words and more catch them.
SMALL = 8
#: Words of texts that are looked through together.
GROUP = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> np.ndarray:
    """_BASE to the power of 0 to n, modulo 2^64."""
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Words:
    """Words as numbers with hashes of all stretches. A stretch's hash is a polynomial modulo 2^64: equal stretches have equal
    ones; that unequal ones differ is only likely, so what they say is compared before it counts."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.powers = ids, _powers(len(ids))
        mixed = (ids.astype(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        # sum of mixed[j] * base^(n - j): a stretch's difference, brought to one power, is its hash
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.shift = np.full(len(ids) + 1, inverse, np.uint64)
        self.shift[0] = 1
        self.shift = np.cumprod(self.shift, dtype=np.uint64)
        np.cumsum(mixed * self.powers[: len(ids)], out=self.sums[1:], dtype=np.uint64)

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of `size` words at i and at j (later) have one hash."""
        return (self.sums[i + size] - self.sums[i]) * self.powers[j - i] == self.sums[j + size] - self.sums[j]

    def windows(self, size: int) -> np.ndarray:
        """The hash of the stretch of `size` words at each place."""
        n = len(self.ids) - size + 1
        return (self.sums[size:] - self.sums[:n]) * self.shift[:n]

    def grown(self, i: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """How many words before, and how many from there on, are alike at i and j: binary searches over hashes, never too few."""
        found = []
        for room, far in ((len(self.ids) - j, True), (i, False)):
            low, high = np.full(len(i), size if far else 0), room.copy()
            while (open_ := low < high).any():
                mid = (low + high + 1) // 2
                ok = self.same(i if far else i - mid, j if far else j - mid, mid)
                low, high = np.where(open_ & ok, mid, low), np.where(open_ & ~ok, mid - 1, high)
            found.append(low)
        return found[1], found[0]

    def periodic(self, start: int, end: int, q: int) -> bool:
        return bool(np.array_equal(self.ids[start : end - q], self.ids[start + q : end]))


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def runs(ids: np.ndarray) -> np.ndarray:
    """start, length and period of every run of at least LEAST words, by start and then by period.

    Equal words have equal numbers. Time and memory are those of some tens of looks at each word; what is periodic itself
    with a smaller period (as a word said a thousand times) is passed over, not compared for every multiple.
    """
    n, found = len(ids), {}

    def add(start: int, end: int, q: int) -> None:
        if end - start >= max(LEAST, 2 * q) and found.get((start, end), n) > q:
            found[start, end] = q

    for q in range(1, min(SMALL - 1, n // 2) + 1):
        starts, ends = _stretches(ids[q:] == ids[:-q])
        for i in np.flatnonzero(ends - starts >= max(LEAST - q, q)):
            add(int(starts[i]), int(ends[i]) + q, q)
    if n >= 2 * SMALL:
        _catch(_Words(ids), found, add)
    return np.array(sorted((s, e - s, q) for (s, e), q in found.items()), np.int64).reshape(-1, 3)


def _catch(words: _Words, found: dict[tuple[int, int], int], add) -> None:
    n, level, chance = len(words.ids), 2, False
    reach = np.zeros(n + 1, np.int64)  # by place: the furthest end of a run of a small period that starts there or before
    noted = 0
    while 4 * (size := 1 << level) <= n:
        if len(found) > noted:
            noted = len(found)
            reach[:] = 0
            for (s, e), q in found.items():
                if q <= size:
                    reach[s] = max(reach[s], e)
            np.maximum.accumulate(reach, out=reach)
        at, suffixes = np.arange(n - size + 1), words.windows(size)
        block = at & -size
        for behind in (2, 3):
            catcher = block - behind * size
            caught = np.flatnonzero((catcher >= 0) & (suffixes == suffixes[np.maximum(catcher, 0)]))
            i, j = catcher[caught], caught
            fresh = reach[i] < j + size  # else both lie in one run of a small period, which divides this one
            i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            before, after = words.grown(i, j, size)
            q = j - i
            long_ = before + after >= np.maximum(q, LEAST - q)
            for s, e, p in sorted(set(zip((i - before)[long_].tolist(), (j + after)[long_].tolist(), q[long_].tolist(), strict=True))):
                if (s, e) in found:
                    continue
                if words.periodic(s, e, p):
                    add(s, e, p)
                else:  # hashes met by chance: look at every place
                    chance = True
                    for x, y in zip(*_stretches(words.ids[p:] == words.ids[:-p]), strict=True):
                        if y - x >= max(LEAST - p, p):
                            add(int(x), int(y) + p, p)
        level += 1
    for (s, e), q in list(found.items()) if chance else []:  # a look at every place may add a multiple of the least period
        if any(q % p == 0 and words.periodic(s, e, p) for p in range(1, q // 2 + 1)):
            del found[s, e]


def numbered(texts: list[list[bytes]], sure: bool) -> list[np.ndarray]:
    """The words of texts as numbers, equal for equal words; if not sure, their hashes, so that unequal words may meet by chance."""
    if not sure:
        return [np.fromiter(map(hash, t), np.int64, len(t)) for t in texts]
    known: dict[bytes, int] = {}
    return [np.fromiter((known.setdefault(w, len(known)) for w in t), np.int64, len(t)) for t in texts]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """words, or for one doc_id in ten a text that is periodic from some word on, as a fixed rule says; a null doc_id leaves them."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run repeats, each run's first period staying, joined by spaces."""
    if len(found):
        gone = np.zeros(len(words), bool)
        for start, length, q in found.tolist():
            gone[start + q : start + length] = True
        words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
    return b" ".join(words)


def _groups(texts: list[list[bytes]]) -> Iterator[list[int]]:
    """Places of texts of like lengths, some GROUP words at once."""
    group, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if group and (size + len(texts[i]) > GROUP or len(texts[i]) >= 2 * len(texts[group[0]]) + 64):
            yield group
            group, size = [], 0
        group.append(i)
        size += len(texts[i]) + 1
    if group:
        yield group


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text. Texts of like lengths are looked through together; what is found is compared word by word."""
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    for group in _groups(texts):
        found = _runs_of([texts[i] for i in group], sure=False)
        if any(texts[i][s : s + m - q] != texts[i][s + q : s + m] for i, mine in zip(group, found, strict=True) for s, m, q in mine.tolist()):
            found = _runs_of([texts[i] for i in group], sure=True)
        for i, mine in zip(group, found, strict=True):
            out[i] = mine
    return out


def _runs_of(texts: list[list[bytes]], sure: bool) -> list[np.ndarray]:
    """The runs of each text, joined by marks that equal no word's number."""
    ids = numbered(texts, sure)
    starts = np.cumsum([0, *(len(x) + 1 for x in ids)])
    joined = np.full(starts[-1], -1, np.int64)
    for k, x in enumerate(ids):
        joined[starts[k] : starts[k] + len(x)] = x
        joined[starts[k] + len(x)] = -1 - k
    found = runs(joined)
    cuts = np.searchsorted(found[:, 0], starts)
    return [found[a:b] - [at, 0, 0] for a, b, at in zip(cuts, cuts[1:], starts, strict=False)]


KINDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, plant: bool = False, found: bool = False) -> DataFrame:
    """doc_id and, of every text, n_runs, the longest run's start, length, period and exponent_milli (nulls without a run), the
    SHA-256 of all runs and of the text without what they repeat; with found also runs, an array of (start, length, period).

    Words are stretches without ASCII white space, of whole texts, numbered from 0; ties go to the smallest start, then
    period. Null and empty texts have no words and no run. plant: texts are changed by planted() first. Rows come out as often
    as they go in, repeated ones and null doc_ids too; other columns are left out. Nothing is shuffled.
    """
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {KINDS}" + (", runs array<struct<start:bigint,length:bigint,period:bigint>>" if found else "")

    def row(words: list[bytes], mine: np.ndarray) -> dict:
        best = min(mine.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
        start, length, q = best or (None, None, None)
        said = "".join(f"{s},{m},{p}\n" for s, m, p in mine.tolist())
        out = {"n_runs": len(mine), "start": start, "length": length, "period": q, "exponent_milli": 1000 * length // q if q else None, "runs_sha256": sha256(said.encode()).hexdigest(), "collapsed_sha256": sha256(collapsed(words, mine)).hexdigest()}
        return out | ({"runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in mine.tolist()]} if found else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [(t.as_py() or "").encode().split() for t in part.column(1)]
                if plant:
                    texts = [planted(w, i.as_py()) for w, i in zip(texts, part.column(0), strict=True)]
                rows = [row(w, r) for w, r in zip(texts, runs_of(texts), strict=True)]
                columns = [pa.array([r[c] for r in rows], f.type) for c, f in zip(rows[0], fields, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [docs_id, *rows[0]])

    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    fields = [pa.field(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")] + [pa.field(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256")] + ([pa.field("runs", span)] if found else [])
    docs_id = "doc_id"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, of its planted form where the contract asks for one."""
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
