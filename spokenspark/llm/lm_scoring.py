"""Language-model scoring: a causal self-attention model on subword ids, beside a smoothed word model of the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored, table
from .packing import default_ranks, subwords

#: Windows of all training documents that a task has at least, if its input can be joined with others', and rounds; after each
#: round the tasks' parameters are averaged. Each window is learned from in one round; where there are few, in several, so that
#: a round has some LEAST_WINDOWS.
TASK_WINDOWS, LEAST_WINDOWS, ROUNDS, BATCH = 2048, 6_000, 4, 32
#: The most frequent words that every task holds; the others' counts are joined.
FREQUENT = 200_000
#: Ids of a window, and of those the ones that a window scores: the rest is context from the window before.
WINDOW, STRIDE = 128, 96
VOCABULARY = 50_257
START = 50_256  # stands before a text and after it
#: Places that look back together, at what stands up to the last of them: what none of them sees is not computed. SEEN: of
#: these places, itself and what stands before, which a place sees.
BLOCK = 32
SEEN = np.tril(np.ones((BLOCK, BLOCK), np.float32))
#: Places for pairs and triples of ids in the model (primes): of those that meet in a place the most frequent one stays, and
#: what the others would have counts for the shorter context. DISCOUNT is what a count gives to the shorter context.
PAIRS, TRIPLES, DISCOUNT = 1_048_573, 2_097_143, 0.6
#: What the attention mixes for each place: shares after no id, one id and two ids, and what followed the places attended to.
EXPERTS = 4


@dataclass
class Counts:
    """How often ids, pairs and triples occur in the training texts; pairs and triples by place, with their keys."""

    ids: np.ndarray
    pair_keys: np.ndarray
    pairs: np.ndarray
    triple_keys: np.ndarray
    triples: np.ndarray

    def __post_init__(self):
        smooth = self.ids + 0.5
        self.share = (smooth / smooth.sum()).astype(np.float32)
        self.contexts = self.ids.copy()  # how often something follows an id; two STARTs stand before a text
        self.contexts[START] *= 2
        has = np.maximum(self.contexts, 1)
        kept = np.maximum(self.pairs - DISCOUNT, 0)
        own = np.bincount(np.maximum(self.pair_keys, 0) // VOCABULARY, kept, VOCABULARY)
        self.left_one = np.where(self.contexts > 0, 1 - own / has, 1).astype(np.float32)  # what one id of context leaves to none
        context = np.maximum(self.triple_keys, 0) // VOCABULARY
        at = context % PAIRS
        kept = np.where((self.triple_keys >= 0) & (self.pair_keys[at] == context), np.maximum(self.triples - DISCOUNT, 0), 0)
        own = np.bincount(at, kept, PAIRS)
        self.left_two = np.where(self.pairs > 0, 1 - own / np.maximum(self.pairs, 1), 1).astype(np.float32)

    def shares(self, two: np.ndarray, one: np.ndarray, ids: np.ndarray, without: int = 0) -> list[np.ndarray]:
        """Shares of ids after no context, after `one` and after `two`, `one`; each sums to 1 over all ids. `without` leaves
        out so many occurrences of what is asked for: 1 for texts that have been counted."""
        one, ids = one.astype(np.int64), ids.astype(np.int64)
        none = self.share[ids]
        pair = one * VOCABULARY + ids
        at = pair % PAIRS
        n, c = self.contexts[one] - without, np.where(self.pair_keys[at] == pair, self.pairs[at], 0) - without
        after_one = np.where(n > 0, np.maximum(c - DISCOUNT, 0) / np.maximum(n, 1) + self.left_one[one] * none, none)
        context = two.astype(np.int64) * VOCABULARY + one
        known = context % PAIRS
        n = np.where(self.pair_keys[known] == context, self.pairs[known], 0) - without
        triple = context * VOCABULARY + ids
        at = triple % TRIPLES
        c = np.where(self.triple_keys[at] == triple, self.triples[at], 0) - without
        after_two = np.where(n > 0, np.maximum(c - DISCOUNT, 0) / np.maximum(n, 1) + self.left_two[known] * after_one, after_one)
        return [none, after_one.astype(np.float32), after_two.astype(np.float32)]


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place; the largest of a row is taken out first only where some value is large."""
    if z.max() > 60:
        z -= z.max(axis=-1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[-1], z.dtype))[..., None]
    return z


@dataclass
class Attention:
    """One layer of causal self-attention over `width` values a place. From a place's own vector and what it attends to come the
    shares with which four forecasts of the next id are mixed: its share in all texts, after one id, after two ids, and the
    ids that followed the places attended to (what a place pays to itself goes to the first). row: an id's embedding."""

    p: dict[str, np.ndarray]
    row: np.ndarray
    counts: Counts
    learned: int = 0  # windows that the weights come from

    @classmethod
    def untrained(cls, counts: Counts, width: int = 8, rows: int = 1500, shared: int = 48, seed: int = 1) -> Attention:
        """The most frequent ids have an embedding each; the others share them with ids of about the same frequency."""
        n = counts.ids
        order = np.argsort(-n, kind="stable")
        often = order[n[order] > 0]
        row = np.full(len(n), rows + shared - 1, np.int32)
        row[often] = rows + np.minimum(np.log2(n[often].max(initial=1) / np.maximum(n[often], 1)) * 2, shared - 1).astype(np.int32)
        row[order[: min(rows, len(often))]] = np.arange(min(rows, len(often)))
        rng = np.random.default_rng(seed)
        init = lambda *s, by=None: (rng.standard_normal(s) * (by or s[0] ** -0.5)).astype(np.float32)
        p = {"e": init(rows + shared, width, by=0.7), "at": init(WINDOW, width, by=0.3), "qkv": init(width, 3 * width), "g": init(width, EXPERTS, by=0.1), "o": init(width, EXPERTS, by=0.1), "b": np.array([0, 1, 2, 0], np.float32)}
        return cls(p, row, counts)

    def _attend(self, ids: np.ndarray) -> tuple:
        """Of windows (a row of WINDOW ids each): vectors, queries of the last STRIDE places, keys, values with a one beside
        them, and whether a query and a key may meet in a large value."""
        p, d, first = self.p, self.p["o"].shape[0], WINDOW - STRIDE
        here, table = self.row.take(ids), p["e"] @ p["qkv"]  # the vectors of ids and places are added, so each is multiplied once
        qkv = table.take(here, axis=0)
        qkv += p["at"] @ p["qkv"]
        q, k = qkv[:, first:, :d] * qkv.dtype.type(d**-0.5), np.ascontiguousarray(qkv[:, :, d : 2 * d])
        v = np.ones((*ids.shape, d + 1), qkv.dtype)
        v[:, :, :d] = qkv[:, :, 2 * d :]
        return here, q, k, v, d * max(q.max(), -q.min()) * max(k.max(), -k.min()) > 60

    def _mixed(self, ids: np.ndarray, follows: np.ndarray, without: int, keep: bool = False) -> tuple:
        """Probabilities of follows (windows x STRIDE), and what they come from. With `keep`, for each BLOCK of places also the
        weights that are not yet divided by their sums, and those of the places that were followed by what follows."""
        p, first, i = self.p, WINDOW - STRIDE, np.arange(BLOCK)
        here, q, k, v, large = self._attend(ids)
        after = np.full(ids.shape, VOCABULARY, np.uint16)  # what followed each place; no id behind the last
        after[:, :-1] = ids[:, 1:]
        wanted, turned = follows.astype(np.uint16), k.transpose(0, 2, 1)
        none, one, two = self.counts.shares(ids[:, first - 1 : -1], ids[:, first:], follows, without)
        copied, mixed, blocks = np.empty(follows.shape, q.dtype), np.empty((*follows.shape, v.shape[2]), q.dtype), []
        for low in range(0, STRIDE, BLOCK):
            high, end = low + BLOCK, first + low + BLOCK
            s = np.matmul(q[:, low:high], turned[:, :, :end])
            if large and s.max() > 60:  # the largest that a place sees is taken out first only where some value is large
                s[:, :, end - BLOCK :] += (SEEN - 1) * np.float32(1e9)
                s -= s.max(axis=-1, keepdims=True)
            np.exp(s, out=s)
            s[:, :, end - BLOCK :] *= SEEN
            same = wanted[:, low:high, None] == after[:, None, :end]
            same[:, i, end - BLOCK + i] = False  # a place doesn't know what follows itself
            own = s[:, i, end - BLOCK + i] * none[:, low:high]
            if keep:
                c = s * same
                c[:, i, end - BLOCK + i] = own
                np.matmul(c, np.ones(end, c.dtype), out=copied[:, low:high])
                blocks.append((low, end, s, c))
            else:
                np.einsum("bij,bij->bi", s, same, out=copied[:, low:high], optimize=False)
                copied[:, low:high] += own
            np.matmul(s, v[:, :end], out=mixed[:, low:high])
        by = 1 / mixed[:, :, -1]
        copied *= by
        mixed = mixed[:, :, :-1] * by[:, :, None]
        z = mixed @ p["o"]
        z += (p["e"] @ p["g"]).take(here[:, first:], axis=0)
        z += (p["at"] @ p["g"])[first:] + p["b"]
        gates = _softmax(z)
        forecasts = np.stack([none, one, two, copied], axis=2)
        return np.einsum("bik,bik->bi", gates, forecasts), gates, forecasts, (here, q, k, v, blocks, mixed, by)

    def log10(self, ids: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """log10 probability of each of follows (windows x STRIDE), the ids after the last STRIDE places of the windows."""
        return np.log10(self._mixed(ids, follows, 0)[0])

    def step(self, ids: np.ndarray, follows: np.ndarray, without: int = 1) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss in nats over the scored places, and its gradients."""
        p, d, first, g = self.p, self.p["o"].shape[0], WINDOW - STRIDE, {}
        chance, gates, forecasts, (here, q, k, v, blocks, mixed, by) = self._mixed(ids, follows, without, keep=True)
        n = chance.size
        dz = (gates - gates * forecasts / chance[:, :, None]) / n
        dcopied = -gates[:, :, 3] / chance / n
        g["b"], g["o"] = dz.sum(axis=(0, 1)), mixed.reshape(-1, d).T @ dz.reshape(-1, EXPERTS)
        dm = dz @ p["o"].T
        mean = (dm * mixed) @ np.ones(d, dm.dtype) + dcopied * forecasts[:, :, 3]  # of the weights' gradients, by the weights
        dm, dcopied = dm * by[:, :, None], dcopied * by
        both, turned = np.concatenate([dm, -(mean * by)[:, :, None]], axis=2), v.transpose(0, 2, 1)
        scaled = k * k.dtype.type(d**-0.5)
        down, back = np.ascontiguousarray(dm.transpose(0, 2, 1)), np.ascontiguousarray(q.transpose(0, 2, 1))
        dqkv, behind = np.zeros((*ids.shape, 3 * d), q.dtype), np.zeros((len(ids), 2 * d, ids.shape[1]), q.dtype)
        for low, end, s, c in blocks:
            high = low + BLOCK
            da = np.matmul(both[:, low:high], turned[:, :, :end])
            da *= s
            c *= dcopied[:, low:high, None]
            da += c
            dqkv[:, first + low : first + high, :d] = np.matmul(da, scaled[:, :end])
            behind[:, :d, :end] += np.matmul(back[:, :, low:high], da)
            behind[:, d:, :end] += np.matmul(down[:, :, low:high], s)
        dqkv[:, :, d:] = behind.transpose(0, 2, 1)
        x = p["e"].take(here, axis=0)
        x += p["at"]
        g["qkv"] = x.reshape(-1, d).T @ dqkv.reshape(-1, 3 * d)
        g["g"] = x[:, first:].reshape(-1, d).T @ dz.reshape(-1, EXPERTS)
        dx = dqkv @ p["qkv"].T
        dx[:, first:] += dz @ p["g"].T
        g["at"] = dx.sum(axis=0)
        g["e"] = np.stack([np.bincount(here.ravel(), dx[:, :, j].ravel(), len(p["e"])) for j in range(d)], axis=1).astype(s.dtype)
        return float(-np.log(chance).mean()), g

    def fit(self, full: np.ndarray, steps: int, rate: float = 0.01, last: float = 0.0, seed: int = 2) -> Attention:
        """Adam on batches of full (windows x WINDOW + 1 ids), dealt anew for each pass; the rate falls from `rate` to `last`."""
        rng, m, v = np.random.default_rng(seed), {n: np.zeros_like(x) for n, x in self.p.items()}, {n: np.zeros_like(x) for n, x in self.p.items()}
        deal = np.concatenate([rng.permutation(len(full)) for _ in range(-(-steps * BATCH // len(full)))])
        for t in range(1, steps + 1):
            x = full[deal[(t - 1) * BATCH : t * BATCH]].astype(np.int32)
            _, g = self.step(x[:, :-1], x[:, -STRIDE:])
            now = rate + (last - rate) * t / (steps + 1)
            for n, d in g.items():
                m[n] += 0.1 * (d - m[n])
                v[n] += 0.002 * (d * d - v[n])
                self.p[n] -= (now * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.998**t)) + 1e-8)).astype(np.float32)
        return self


def line(ids: np.ndarray) -> np.ndarray:
    """A text's ids with as many STARTs before them as its first window needs, and after them as its last one needs."""
    n = -(-(len(ids) + 1) // STRIDE)
    out = np.full(WINDOW - STRIDE + n * STRIDE + 1, START, np.int32)
    out[WINDOW - STRIDE + 1 : WINDOW - STRIDE + 1 + len(ids)] = ids  # the end is the START that follows
    return out


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows over a text's ids, and the ids that each scores: together every id and the end once.

    Rows past the end are filled up with START; only the first len(ids) + 1 scored places count."""
    x, at = line(ids), np.arange(-(-(len(ids) + 1) // STRIDE))[:, None] * STRIDE
    return x[at + np.arange(WINDOW)], x[at + np.arange(WINDOW - STRIDE + 1, WINDOW + 1)]


def text_scores(model: Attention, texts: list[np.ndarray], most: int = 32) -> np.ndarray:
    """log10 probability of each text (its ids and the end), windows of all texts in batches of at most `most`."""
    both = [windows(t) for t in texts]
    ids, follows = np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])
    said = np.concatenate([model.log10(ids[k : k + most], follows[k : k + most]) for k in range(0, len(ids), most)]).ravel()
    out, at = np.zeros(len(texts)), 0
    for i, (t, b) in enumerate(zip(texts, both)):
        out[i] = said[at : at + len(t) + 1].sum(dtype=np.float64)
        at += b[1].size
    return out


def words(text: str | None) -> list[bytes]:
    """Lower-cased in A-Z, cut at the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all texts; the empty word stands for the ends of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # Arrow's ASCII white space is the same six characters
            parts = [pa.table({"word": pa.array([b""]), "c": pa.array([batch.num_rows])})]
            for k in range(0, batch.num_rows, 1024):
                found = pc.list_flatten(pc.ascii_split_whitespace(pc.ascii_lower(batch.column(0).slice(k, 1024)))).value_counts()
                word = found.field("values").cast(pa.binary())
                some = pc.not_equal(pc.binary_length(word), 0)  # white space at an end of a text has an empty word beside it
                parts.append(pa.table({"word": word.filter(some), "c": found.field("counts").filter(some)}))
            summed = pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")])
            yield from summed.rename_columns({"word": "word", "c_sum": "c"}).select(["word", "c"]).to_batches()
            del parts, summed
            pa.default_memory_pool().release_unused()  # workers are used again, and what they hold counts for the executor

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@contextmanager
def short_batches(spark: SparkSession, rows: int = 2048) -> Iterator[None]:
    """Meanwhile whole texts go to Python so many at a time: an executor holds fewer of them at once, on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tokenized(docs: DataFrame, ranks_path: str) -> DataFrame:
    """docs (key, doc_id, held_out, text) with ids: the subword ids of the whole text in 16 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = subwords(ranks_path)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                ids = pa.array([np.frombuffer(bpe.whole(t.as_py() or ""), "<u4").astype("<u2").tobytes() for t in batch.column(3)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    return docs.select("key", "doc_id", "held_out", "text").mapInArrow(run, "key long, doc_id long, held_out boolean, text string, ids binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all texts of tokens (ids), START once a text: a row per id and task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                seen += np.bincount(np.frombuffer(ids.as_py(), "<u2"), minlength=VOCABULARY) if len(ids.as_py()) > 100_000 else 0
            short = b"".join(x for x in batch.column(0).to_pylist() if len(x) <= 100_000)
            seen += np.bincount(np.frombuffer(short, "<u2"), minlength=VOCABULARY)
            seen[START] += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["id", "n"])

    counts = np.zeros(VOCABULARY, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["id"]] = r["n"]
    return counts


def triple_counts(tokens: DataFrame, most: int = 1 << 22) -> DataFrame:
    """(key, n): how often each triple of ids occurs in all texts of tokens (ids), with two STARTs before a text and one after.

    Tasks add up what they read, at most about `most` ids at a time, and Spark adds up the tasks' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], ["key", "n"])

        size = 0
        for batch in batches:
            for ids in batch.column(0):
                x = np.frombuffer(ids.as_py(), "<u2")
                row = np.full(len(x) + 3, START, np.int64)
                row[2:-1] = x
                held.append((row[:-2] * VOCABULARY + row[1:-1]) * VOCABULARY + row[2:])
                size += len(row)
                if size > most:
                    yield rows()
                    size = 0
        yield rows()

    return tokens.select("ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def counted(tokens: DataFrame) -> Counts:
    """The counts of all texts of tokens (ids). What comes to the driver is one row for each place of the model at most."""
    triples = stored(triple_counts(tokens), "triples")
    pairs = triples.groupBy((F.col("key") % (VOCABULARY * VOCABULARY)).alias("key")).agg(F.sum("n").alias("n"))
    texts = tokens.select(F.lit(START * VOCABULARY + START).cast("long").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    tables = []
    for rows, places in ((pairs.unionAll(texts).groupBy("key").agg(F.sum("n").alias("n")), PAIRS), (triples, TRIPLES)):
        best = rows.groupBy(F.pmod("key", F.lit(places)).alias("place")).agg(F.max(F.struct("n", "key")).alias("m")).select("place", "m.key", "m.n").toArrow()
        keys, n = np.full(places, -1, np.int64), np.zeros(places, np.int64)
        at = best.column("place").to_numpy()
        keys[at], n[at] = best.column("key").to_numpy(), best.column("n").to_numpy()
        tables += [keys, n]
    dropped(triples)
    return Counts(id_counts(tokens), *tables)


def drawn_windows(tokens: DataFrame, share: float, start: float = 0.0) -> DataFrame:
    """(ids) of a share of the windows of all texts of tokens (key, ids), from any place, by a hash of key and place.

    Hashes go round a circle, and the share begins at `start`: shares that lie side by side have each window once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, WINDOW + 1), "<u2")]
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(ids.as_py(), "<u2")
                h = np.arange(1, 1 - (-(len(x) + 1) // STRIDE), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                h ^= np.uint64((key + 1) * 0xBF58476D1CE4E5B9 % (1 << 64))
                for shift in (31, 29):
                    h = (h ^ (h >> np.uint64(shift))) * np.uint64(0x94D049BB133111EB)
                h -= np.uint64(int(start * (1 << 64)))
                at = np.flatnonzero((h >> np.uint64(11)) < share * (1 << 53))
                if len(at):
                    found.append(line(x)[at[:, None] * STRIDE + np.arange(WINDOW + 1)].astype("<u2"))  # up to the text's end and beyond
            every = np.concatenate(found)
            for k in range(0, max(1, len(every)), 1 << 20):
                rows = every[k : k + (1 << 20)]
                ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.itemsize * (WINDOW + 1))
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])], ["ids"])

    return tokens.select("key", "ids").mapInArrow(run, "ids binary")


def fit(tokens: DataFrame) -> Attention:
    """The attention model of tokens (key, ids). Its forecasts come from the counts of all ids, pairs and triples.

    The weights learn from every window of every text. Each of ROUNDS rounds takes its share of all windows: each task passes
    over its own from the same weights, and the weights are averaged. Tasks are those that read the input, so the work grows
    with it and nothing is dealt anew. A task holds its share of what it has read.
    """
    model = Attention.untrained(counted(tokens))
    total = int(tokens.agg(F.coalesce(F.sum(F.ceil((F.octet_length("ids") / 2 + 1) / STRIDE)), F.lit(0))).first()[0])
    if not total:
        return model
    share = max(1, min(ROUNDS, -(-ROUNDS * LEAST_WINDOWS // total))) / ROUNDS
    n = max(1, round(total * share / TASK_WINDOWS))
    near = tokens.coalesce(n)
    names, shapes = list(model.p), [x.shape for x in model.p.values()]
    cuts = np.cumsum([x.size for x in model.p.values()])
    sc = tokens.sparkSession.sparkContext

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, flat = 0, np.zeros(cuts[-1])
        for batch in batches:
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1)):
                size, flat = size + k, flat + np.frombuffer(p.as_py(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["n", "p"])

    fixed = sc.broadcast(model.counts)
    for turn in range(ROUNDS):
        sent, drawn = sc.broadcast(Attention(model.p, model.row, None)), drawn_windows(near, share, turn / ROUNDS)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            rows = sorted(x for batch in batches for x in batch.column(0).to_pylist())
            if rows:
                full = np.frombuffer(b"".join(rows), "<u2").reshape(-1, WINDOW + 1)
                steps = -(-max(len(full), TASK_WINDOWS if n == 1 else 0) // BATCH)
                own = Attention({k: x.copy() for k, x in sent.value.p.items()}, sent.value.row, fixed.value)
                own.fit(full, steps, 0.01 * (1 - turn / ROUNDS), 0.01 * (1 - (turn + 1) / ROUNDS), seed=2 + turn)
                flat = np.concatenate([own.p[k].ravel() for k in names]).astype(np.float64) * len(full)
                yield pa.RecordBatch.from_arrays([pa.array([len(full)], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["n", "p"])

        made = drawn.mapInArrow(run, "n long, p binary").repartition(max(1, round(n**0.5))).mapInArrow(added, "n long, p binary").collect()
        size = sum(r["n"] for r in made)
        flat = sum(np.frombuffer(r["p"], np.float64) for r in made) / max(size, 1)
        model.learned += size
        if size:
            model.p = {k: x.reshape(s).astype(np.float32) for k, x, s in zip(names, np.split(flat, cuts[:-1]), shapes)}
        sent.unpersist()
    fixed.unpersist()
    return model


def score(docs: DataFrame, held_out, ranks_path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document (doc_id, text).

    Both models learn from the rows that are not held out (a null condition counts as not). Texts are cut into ids once.
    Counts of words and of ids cover all of them: the `frequent` most frequent words go to every task, the others' counts are joined to the words that texts ask for.
    The attention model scores each id once, in windows that overlap by WINDOW - STRIDE ids; what it mixes sums to 1 over all
    ids. Null and empty texts are an
    end alone. Without a training row every word is unknown. Repeated rows are scored each for themselves.
    """
    ranks_path = ranks_path or default_ranks()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    with short_batches(docs.sparkSession):
        docs = stored(tokenized(docs.withColumn("key", F.monotonically_increasing_id()), ranks_path), "tokens")
    train = docs.where(~F.col("held_out"))
    counts = stored(word_counts(train), "word_counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    below = total + 0.1 * (distinct + 1)
    least, held = None, 0  # the smallest count whose words, with all above, are at most `frequent`
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        held += r["n"]
        if held > frequent:
            break
        least = r["c"]
    top = {bytes(r["word"]): r["c"] for r in counts.where(F.col("c") >= (least or total + 1)).toLocalIterator()}
    sent = docs.sparkSession.sparkContext.broadcast((fit(train), {w: float(np.log10((c + 0.1) / below)) for w, c in top.items()}, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs, ends = sent.value
        end = float(np.log10((ends + 0.1) / below))
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                ids, sizes, known, base, rare = [], [], [], [], []
                for text, coded in zip(batch.column(2), batch.column(4)):
                    w = words(text.as_py())
                    own = list(map(logs.get, w))
                    other = [x for x, y in zip(w, own) if y is None] if None in own else []
                    ids.append(np.frombuffer(coded.as_py(), "<u2"))
                    sizes.append(len(w) + 1)
                    known.append(len(w) - len(other) + (ends > 0))
                    base.append(end + (sum(y for y in own if y is not None) if other else sum(own)))
                    rare.append(other)
                arrays = [*batch.columns[:2], batch.column(3), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(text_scores(model, ids)), pa.array(rare, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    keyed = docs.select("key", "doc_id", "text", "held_out", "ids")
    with short_batches(docs.sparkSession):
        scored = stored(keyed.mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>"), "scored")
    asked = scored.select("key", F.explode("rare").alias("word")).join(counts, "word", "left")
    more = asked.groupBy("key").agg(F.count("c").alias("more_known"), F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.1) / below)).alias("more"))
    out = scored.drop("rare").join(more, "key", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
