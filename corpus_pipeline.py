"""A training corpus from documents in five stages; each reads what the one before has written.

Language ID (documents without a learned language go), near-duplicates (the smallest doc_id of each group stays), benchmark
decontamination (contaminated documents go), secret scans (secrets are replaced in the text) and best-fit packing.
Rows of equal doc_id are judged each by their own text, as are rows whose doc_id is null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokenspark.llm.common import noting, removed, stored, table
from spokenspark.llm.decontamination import decontaminate
from spokenspark.llm.language_id import fit, in_language
from spokenspark.llm.packing import best_fit_packing
from spokenspark.llm.secrets import redact
from spokenspark.llm.simhash import similar_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_scratch: list[str] = []


def _stage(f: Stage) -> Stage:
    """Deletes the scratch tables of the stage before, whose result has been written by then, and notes this one's."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        removed(spark, _scratch)
        with noting(_scratch):
            return f(spark, docs, sf_dir)

    return run


def _without(docs: DataFrame, gone: DataFrame, tag: str) -> DataFrame:
    """docs without the rows whose doc_id and text are in gone (doc_id, text_hash); a merge at every size."""
    gone = stored(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), tag)
    same = docs.doc_id.cast("long").eqNullSafe(gone["_id"]) & (F.xxhash64(docs.text.cast("string")) == gone["_hash"])
    return docs.join(gone.hint("merge"), same, "left_anti").select(*docs.columns)


@_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text is in a language that the labels teach.

    A text without a letter (null and empty ones too) goes; so does one of 256 characters or more that is less like the
    language nearest to it than 0.4 times what 99 of 100 labelled texts of that language and length are. A shorter text
    says too little to be rejected. Where no language is labelled, every document goes.
    """
    return in_language(docs, fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)))


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies; rows whose doc_id is null stay as they are.

    Shingles of five words; near copies have fingerprints of at most two differing bits or a similarity of 0.8 or more.
    Null and empty texts are near copies of each other. Repeated rows (the same doc_id and text) stay or go together.
    """
    gone = similar_documents(docs.where("doc_id IS NOT NULL"), shingle=5, similarity=0.8).where("doc_id <> component_id")
    return _without(docs, gone, "copies")


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold ten consecutive words of a benchmark item, or a whole shorter item.

    Null and empty texts are clean. Rows with a null doc_id are judged like any other.
    """
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    return _without(docs, found, "contaminated")


@_stage
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in the texts, n_chars with them; no document goes, whatever its doc_id. Null texts stay null."""
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' token ids into sequences of 2048; a row per piece. A null or empty text is its end id alone,
    and rows of equal or null doc_id are packed each for itself."""
    removed(spark, _scratch)
    return best_fit_packing(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The first and last stages are a trained model and a tokenizer, which SQL can't express; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
