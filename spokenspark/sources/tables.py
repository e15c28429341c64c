"""Readers: Parquet tables, labelled corpus shards, plain lists and prior tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Shard numbers by use.
TRAIN, TUNE, TEST = range(0, 90), range(90, 95), range(95, 100)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_labelled(spark: SparkSession, path: str, shards: range | None = None) -> DataFrame:
    """class, written, spoken, file, sent_id, pos of a corpus of tab-separated shards in which `<eos>` rows end sentences.

    path: a folder of files named `...-00012-of-00100`. Only the files of the asked shards are listed and read. A sentence's number is the count of ends before it in its file, by a
    window per file, so files are the unit of parallelism, as they are written.
    """
    if shards is not None:
        path = f"{path.rstrip('/')}/*-{{{','.join(f'{n:05d}' for n in shards)}}}-of-*"
    rows = spark.read.option("sep", "\t").option("quote", "").option("escape", "").schema("class string, written string, spoken string").csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    order = W.partitionBy("file").orderBy("_block", "_line")
    ended = F.sum(F.when(F.col("class") == "<eos>", 1).otherwise(0)).over(order) - F.when(F.col("class") == "<eos>", 1).otherwise(0)
    rows = rows.withColumn("sent_id", ended.cast("long")).where("class <> '<eos>'")
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("file", "sent_id").orderBy("_block", "_line")).cast("int")).drop("_block", "_line")


def expected(spoken: Column, written: Column, label: Column) -> Column:
    """The target of a labelled row: `<self>` is the written form, `sil` is silence, letters lose their marks."""
    plain = F.regexp_replace(spoken, r"_letter\b", "")
    return F.when(spoken == "<self>", written).when(spoken == "sil", F.lit("")).when(label.isin("ELECTRONIC", "LETTERS"), plain).otherwise(spoken)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines that aren't comments, e.g. of a list of top-level domains."""
    return spark.read.text(path).where("value <> '' AND NOT startswith(value, '#')").select(F.lower(F.trim("value")).alias("value"))


def verified(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of each file, to compare with a receipt before a build."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
