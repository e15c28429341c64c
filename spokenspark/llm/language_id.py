"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Labelled documents per language, expected, that a model is fitted on. Only the fit is bounded; every text is predicted whole.
SAMPLE = 2_000
#: Characters of a text that are turned into n-grams in one go.
BLOCK = 1 << 18
UNKNOWN = "und"


def letters(text: str) -> str:
    """Lower case, each run of other characters as one space, one at either end."""
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " " if text else " "


def _codes(text: str, lut: np.ndarray) -> np.ndarray:
    """Letter numbers of a text with each run of other characters as one 0, and a 0 at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.zeros(len(points) + 2, np.int64)
    x[1:-1] = lut[points]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    return x[keep]


@dataclass
class Profiles:
    """languages and their prototypes (a row each, of length 1); letter i is 1 + its place in alphabet, 1 + len(alphabet) any other letter."""

    alphabet: str
    languages: list[str]
    prototypes: np.ndarray
    size: int
    seed: int

    def __post_init__(self):
        self._lut: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_lut": None, "_shifted": None}

    def _ready(self) -> None:
        if self._lut is None:
            self._lut = np.zeros(0x110000, np.int32)
            self._lut[[i for i in range(0x110000) if chr(i).isalpha()]] = len(self.alphabet) + 1
            self._lut[[ord(c) for c in self.alphabet]] = np.arange(1, len(self.alphabet) + 1)
            base = np.random.default_rng(self.seed).choice(np.array([-1, 1], np.int8), (len(self.alphabet) + 2, self.size))
            self._shifted = [np.roll(base, k, axis=1) for k in (2, 1, 0)]  # one permutation step per place in the n-gram

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of 3-grams (numbers in base len(alphabet) + 2): the product of the letters' permuted vectors."""
        self._ready()
        n = len(self.alphabet) + 2
        a, b, c = self._shifted
        return a[grams // (n * n)] * b[grams // n % n] * c[grams % n]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The sum of the vectors of all 3-grams of the whole text; None if it has no letter."""
        self._ready()
        n, total = len(self.alphabet) + 2, None
        x = _codes(text or "", self._lut)
        if not x.any():
            return None
        for at in range(0, len(x) - 2, BLOCK):
            y = x[at : at + BLOCK + 2]
            grams, counts = np.unique((y[:-2] * n + y[1:-1]) * n + y[2:], return_counts=True)
            for k in range(0, len(grams), 4096):
                part = counts[k : k + 4096].astype(np.float32) @ self.bind(grams[k : k + 4096]).astype(np.float32)
                total = part.astype(np.float64) if total is None else total + part
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the nearest prototype and the cosine, negative ones as 0; und and 0 without a letter."""
        h = self.bundle(text)
        if h is None or not self.languages:
            return UNKNOWN, 0.0
        cosines = self.prototypes @ (h / max(np.linalg.norm(h), 1e-12))
        best = int(np.argmax(cosines))
        return self.languages[best], float(np.clip(cosines[best], 0, 1))


def fit(labelled: DataFrame, sample: int = SAMPLE, size: int = 512, seed: int = 7) -> Profiles:
    """Profiles of the languages of labelled (doc_id, text, lang).

    About `sample` documents per language are taken by a hash of doc_id and text; each task counts their 3-grams, so what
    is summed and brought to the driver is a count per language and 3-gram, bounded by the sample. A prototype is the
    bundle of its language's 3-gram vectors. Rows without lang or text are not used.
    """
    known = labelled.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().toLocalIterator()}
    picked = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003.0
    share = F.element_at(F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / v)))]), F.col("lang")) if sizes else F.lit(0.0)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = letters(text.as_py())
                seen.update((lang, t[i : i + 3]) for i in range(len(t) - 2))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(seen.values(), pa.int64())], ["lang", "gram", "n"])

    counted = known.where(picked < share).select("lang", "text").mapInArrow(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = sorted((r["lang"], r["gram"], r["n"]) for r in counted.toLocalIterator())
    model = Profiles("".join(sorted({c for _, g, _ in rows for c in g} - {" "})), sorted(sizes), np.zeros((len(sizes), size)), size, seed)
    at, n = {c: i + 1 for i, c in enumerate(model.alphabet)} | {" ": 0}, len(model.alphabet) + 2
    for i, lang in enumerate(model.languages):
        own = [(g, c) for k, g, c in rows if k == lang]
        for k in range(0, len(own), 4096):
            codes = np.array([(at[g[0]] * n + at[g[1]]) * n + at[g[2]] for g, _ in own[k : k + 4096]])
            model.prototypes[i] += np.array([c for _, c in own[k : k + 4096]], float) @ model.bind(codes)
    model.prototypes /= np.maximum(np.linalg.norm(model.prototypes, axis=1, keepdims=True), 1e-12)
    return model


def identify(docs: DataFrame, model: Profiles) -> DataFrame:
    """docs with lang_pred and score (the cosine, 0 to 1), which replace columns of these names.

    Each text is read whole. A null text, or one without a letter, is `und` with score 0, as is every text if the model
    has learned no language; a tie goes to the first language in order. Rows come out as often as they go in.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    place = kept.index(next(c for c in kept if c.lower() == "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(place)]
            columns = [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    out = docs.select(*[docs[c] for c in kept])
    schema = out.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    return out.mapInArrow(run, schema)


def in_language(docs: DataFrame, model: Profiles, share: float = 0.4, at_least: int = 256) -> DataFrame:
    """The rows of docs (doc_id, text, lang) that the model finds to be in one of its languages; columns stay.

    A text that is `und` goes. For each language, `share` of the cosine that 99 of 100 texts labelled with it and of
    `at_least` characters reach is the least one; a text of that length below its language's least goes. A shorter text
    has too few 3-grams to tell noise from a language and stays. A language without a labelled text of that length
    rejects nothing.
    """
    place = {c.lower(): "text" if c.lower() == "text" else f"_{i}" for i, c in enumerate(docs.columns)}
    scored = stored(identify(docs.select(*[docs[c].alias(place[c.lower()]) for c in docs.columns]), model), "scored")
    long_ = F.length("text") >= at_least
    known = scored.where(long_ & F.col(place["lang"]).isNotNull()).groupBy(F.col(place["lang"]).cast("string").alias("lang")).agg(F.percentile_approx("score", 0.01, 10_000).alias("q"))
    least = {r["lang"]: share * r["q"] for r in known.toLocalIterator() if r["lang"] in model.languages}
    floor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col("lang_pred")), F.lit(0.0)) if least else F.lit(0.0)
    kept = scored.where((F.col("lang_pred") != UNKNOWN) & (~long_ | (F.col("score") >= floor)))
    return kept.select(*[F.col(place[c.lower()]).alias(c) for c in docs.columns])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs.where(~held_out))
    asked = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return identify(asked, model).select("doc_id", "held_out", "lang_pred", "score")
