"""What the operators share: table reading, shared scratch tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where that is unset and the master is local (tests) a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


#: Shuffle files go as soon as a table is stored: it is what later steps read.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read again: short lineage, safe when executors are lost, no shuffle files left."""
    spark, path = df.sparkSession, f"{scratch_dir(df.sparkSession)}/tables/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    if (noted := _noted.get()) is not None:
        noted.append(path)
    out = spark.read.parquet(path)
    out._scratch_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df._scratch_path)


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Adds the places of all tables stored meanwhile to paths, for removed()."""
    token = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(token)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes the tables at paths, and empties the list."""
    while paths:
        _remove(spark, paths.pop())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Alternates large stars and small stars: each round links every node's larger neighbours, then its smaller ones,
    to the smallest neighbour. Every round is one stored table (the one before is deleted), and the number of rounds grows
    with the logarithm of the largest component. A hub's neighbours are never gathered: minima are aggregates and the links
    are joins.
    """
    now = stored(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    before = None
    while True:
        both = now.unionAll(now.selectExpr("b AS a", "a AS b"))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")  # a plain scan: the join can split a hub
        large = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("b AS x", "m", "a")
        after = stored(
            small.where("x <> m").selectExpr("x AS a", "m AS b").unionAll(low.selectExpr("a", "m AS b")).distinct(), "edges"
        )
        dropped(now, least)
        now = after
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    return now.selectExpr("a AS node", "b AS root")  # stars now: every node but the root itself has one edge


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running_sums(numbers: Column, block: int = 64) -> Column:
    """The sums of an array of ints (of one at least) up to each place. Blocks are summed first and shifted after, so that no
    growing array is copied for every place."""
    last = lambda a: F.get(a, F.size(a) - 1)
    none = F.array().cast("array<int>")
    sums = lambda a: F.aggregate(a, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(last(acc), F.lit(0)) + x)))

    def of(parts: Column) -> Column:
        ends = sums(F.transform(parts, last))
        return bound(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(bound(F.get(e, i - 1), lambda at: F.transform(p, lambda x: x + at))))))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int")), lambda k: sums(F.slice(numbers, k * block + 1, F.lit(block))))
    return bound(cut, of)


def matches(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and hit of a pattern's matches in text, in order; linear in the matches but for
    one number for each 64 of them."""

    def of(x: Column) -> Column:
        sizes = F.zip_with(x["gaps"], x["hits"], lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
        ends = F.slice(running_sums(sizes), F.lit(1), F.size(x["hits"]))
        return F.zip_with(ends, x["hits"], lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))

    return bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), of)
