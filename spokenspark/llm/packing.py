"""Best-fit packing of tokenized documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Pieces that one task packs; a group of this size fills all but a few of its sequences.
GROUP = 50_000
#: Chunks of text whose ids a worker remembers.
REMEMBERED = 300_000
#: The vocabulary's special token and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50_256


class Subwords(dict):
    """Text to ids of a byte-level BPE, by chunks that start at a space and are remembered.

    The vocabulary's pattern never joins a character with white space after it, so a text without white space before
    a space can be cut before each space. Other texts are encoded in one go. As in the tokenizer file, the special token's
    string in a text is its id, and what stands before and after it is encoded apart.
    """

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._run = re.compile(r"\s ")

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self._bpe.encode_ordinary(" " + chunk), "<u4").tobytes()
        if len(self) < REMEMBERED and len(chunk) < 40:
            self[chunk] = ids
        return ids

    def whole(self, text: str) -> bytes:
        """What ids() gives, without remembering chunks: faster where most words are rare."""
        at = SPECIAL_ID.to_bytes(4, "little")
        return at.join(np.array(self._bpe.encode_ordinary(part), "<u4").tobytes() for part in text.split(SPECIAL))

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if SPECIAL in text:
            return SPECIAL_ID.to_bytes(4, "little").join(self.ids(part) if part else b"" for part in text.split(SPECIAL))
        if self._run.search(text) or text[:1].isspace():
            return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self._bpe.encode_ordinary(first), "<u4").tobytes() + b"".join(map(self.__getitem__, rest))


_loaded: dict[str, Subwords] = {}


def subwords(ranks_path: str) -> Subwords:
    if ranks_path not in _loaded:
        _loaded[ranks_path] = Subwords(ranks_path)
    return _loaded[ranks_path]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, limit: int, ranks_path: str, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids and the end id; only longer ones are cut, the first piece is the short one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = subwords(ranks_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.ids(text.as_py() or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = n % limit or limit if k == 0 else limit
                    rows.append((doc, k, at, size, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], list(names))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class OpenBins:
    """A segment tree over the room left: each leaf stands for a room and holds the open bins that have it."""

    def __init__(self, limit: int):
        self.width = 1 << limit.bit_length()
        self.open = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(limit + 1)]

    def _count(self, room: int, by: int) -> None:
        at = room + self.width
        while at:
            self.open[at] += by
            at >>= 1

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._count(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The tightest open bin with room for size, and its room; None if there is none."""
        at = size + self.width
        while not self.open[at]:
            while at & 1:  # a right child: its parent's next subtree is further up
                at >>= 1
                if not at:
                    return None
            at += 1
        while at < self.width:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        room = at - self.width
        self._count(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size."""
    bins, offsets, tree, made = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), OpenBins(limit), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            room, bin_, made = limit, made, made + 1
        else:
            room, bin_ = found
        bins[i], offsets[i] = bin_, limit - room
        if room > size:
            tree.put(room - size, bin_)
    return bins, offsets


def best_fit_packing(docs: DataFrame, limit: int = 2048, ranks_path: str | None = None, group: int = GROUP) -> DataFrame:
    """Packs every document's pieces into sequences of at most `limit` tokens.

    docs: doc_id, text; other columns are ignored. A null or empty text is its end id alone. Rows with equal or null
    doc_id are packed each for itself. An empty table gives no rows. Whole pieces of `limit` tokens are sequences of
    their own; the others are dealt at random into groups of about `group`, each packed best fit decreasing by one
    task, so no task grows with the input. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    cut = stored(pieces(docs, limit, ranks_path or default_ranks()), "pieces")
    n = cut.where(F.col("length") < limit).count()
    groups = max(1, -(-n // group))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins, rows["offset"] = best_fit_decreasing(rows["length"].to_numpy(), limit)
        rows["sequence_id"] = rows["salt"] * (1 << 32) + bins
        return rows.drop(columns="salt")

    small = (
        cut.where(F.col("length") < limit)
        .withColumn("salt", salt)
        .groupBy("salt")
        .applyInPandas(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, offset long, sequence_id long")
    )
    full = cut.where(F.col("length") >= limit).withColumns({"offset": F.lit(0).cast("long"), "sequence_id": -1 - F.monotonically_increasing_id()})
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return small.select(columns).unionAll(full.select(columns))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
