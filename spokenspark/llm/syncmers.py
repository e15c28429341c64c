"""Document fingerprints: closed syncmers over the bytes of a text, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bytes of an anchor and of its inner substrings.
K, S = 24, 8
#: Bytes of a text that are hashed in one go, so that a long text needs little memory.
BLOCK = 1 << 16
ANCHORS = "array<struct<pos:int,hash:int>>"


def anchors(data: str) -> Column:
    """(pos, hash) of the closed syncmers of a binary column, pos from 1; of a shorter text than K, but not empty, the whole.

    A k-mer is chosen if the least hash of its inner substrings is that of the first or the last one. That depends on its
    own bytes only, so blocks that overlap by K - 1 bytes give the same anchors as the whole. A look at four inner hashes
    spares most k-mers the minimum over all.
    """
    w = K - S + 1
    edge = f"least(h[i - 1], h[i + {w - 2}])"
    inner = ", ".join(f"h[i - 1 + {w * j // 6}]" for j in range(1, 5))
    return F.expr(f"""
      CASE WHEN octet_length({data}) = 0 THEN cast(array() AS {ANCHORS})
      WHEN octet_length({data}) < {K} THEN array(named_struct('pos', 1, 'hash', hash({data})))
      ELSE flatten(transform(sequence(0, cast((octet_length({data}) - {K}) div {BLOCK} AS int)), b ->
        flatten(transform(array(substring({data}, b * {BLOCK} + 1, {BLOCK} + {K - 1})), d ->
          flatten(transform(array(transform(sequence(1, octet_length(d) - {S - 1}), i -> xxhash64(substring(d, i, {S})))), h ->
            transform(filter(sequence(1, octet_length(d) - {K - 1}),
                i -> {edge} <= least({inner}) AND array_min(slice(h, i, {w})) = {edge}),
              i -> named_struct('pos', b * {BLOCK} + i, 'hash', hash(substring(d, i, {K}))))))))))
      END""")


def or_whole(hashes: Column, data: Column) -> Column:
    """The hashes, or that of the whole if a text that isn't empty has no anchor: one is sure only from 2K - S - 1 bytes on."""
    bound = F.transform(F.array(hashes), lambda h: F.when((F.size(h) > 0) | (F.octet_length(data) == 0), h).otherwise(F.array(F.hash(data))))
    return F.get(bound, F.lit(0))  # the hashes are computed once


def fingerprint(hashes: Column) -> Column:
    """Hex digits of the distinct anchor hashes in order; equal texts have equal ones, only an empty text has none."""
    return F.lower(F.array_join(F.transform(F.array_sort(hashes), lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """Shared anchors of all anchors of two fingerprints (their Jaccard index); 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """doc_id, text, and anchors of every row with those of the next row in doc_id order (after the last: the first).

    Quantiles of doc_id bound the buckets; each bucket's first row is also sent to the bucket before it, so one shuffle of
    the texts is enough and no task sees more than a bucket. Null doc_ids come first; equal ones are ordered by text.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"))
    n = max(1, partitions)
    cuts = docs.select("at").agg(F.percentile_approx("at", [i / n for i in range(n)], max(10_000, 20 * n)), F.min("at")).first()
    if cuts[1] is None:
        bounds = [0]
    else:
        bounds = sorted({cuts[1], *cuts[0]})
    step = max(1, round(len(bounds) ** 0.5))
    coarse, all_bounds = (F.expr(f"cast(split('{','.join(map(str, b))}', ',') AS array<bigint>)") for b in (bounds[::step], bounds))
    docs = docs.withColumn("_c", (F.size(F.filter(coarse, lambda x: x <= F.col("at"))) - 1) * step)
    docs = docs.withColumn("bucket", F.col("_c") + F.size(F.filter(F.slice(all_bounds, F.col("_c") + 1, F.lit(step)), lambda x: x <= F.col("at"))) - 1)
    first = F.get(all_bounds, F.col("bucket")) == F.col("at")
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(bounds))).alias("bucket"), F.lit(True).alias("guest"), (F.col("bucket") == 0).alias("wrapped"))
    own = F.struct("bucket", F.lit(False).alias("guest"), F.lit(False).alias("wrapped"))
    sent = docs.select("doc_id", "at", "text", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))).alias("to"))
    sent = sent.select("doc_id", "at", "text", "to.*").repartition(n, "bucket")
    made = sent.withColumn("data", F.col("text").cast("binary")).withColumn("anchors", anchors("data"))
    return made.selectExpr("*", *[f"lead({c}) OVER (PARTITION BY bucket ORDER BY wrapped, at, guest, text) AS next_{c}" for c in ("text", "anchors")]).where("NOT guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document (doc_id, text).

    The edited text's anchors are those of its two parts that lie wholly inside them and those across the seam. A text
    without an anchor (of 2K - S - 2 bytes at most) is one anchor as a whole, so that different texts are not alike. Null
    texts count as empty; a single document is its own next one. Repeated rows are documents of their own.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = with_next(docs, 4 * partitions)
    half = F.floor(F.length("text") / 2).cast("int")
    pairs = pairs.withColumns({"head": F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) AS int))"), "tail": F.col("next_text").substr(F.lit(1), half)})
    pairs = pairs.withColumns({"edited": F.concat("head", "tail"), "n_head": F.octet_length("head"), "n_tail": F.octet_length("tail")})
    from_ = F.greatest(F.lit(1), F.col("n_head") - (K - 2))
    whole = F.col("n_head") + F.col("n_tail") < K
    seam = F.when(whole, F.col("edited").cast("binary")).otherwise(
        F.substring(F.col("edited").cast("binary"), from_, F.least(F.col("n_head"), F.lit(K - 1)) + F.least(F.col("n_tail"), F.lit(K - 1)))
    )
    pairs = pairs.withColumn("seam", seam)
    hashes = lambda a: F.transform(a, lambda x: x["hash"])
    inside = lambda a, n: F.filter(F.col(a), lambda x: x["pos"] <= F.col(n) - (K - 1))
    across = F.when(whole | (F.octet_length("seam") >= K), hashes(anchors("seam"))).otherwise(F.array().cast("array<int>"))
    pairs = pairs.withColumns({
        "own": F.array_distinct(hashes(F.col("anchors"))),
        "others": F.array_distinct(hashes(F.col("next_anchors"))),
        "changed": F.array_distinct(F.concat(hashes(inside("anchors", "n_head")), hashes(inside("next_anchors", "n_tail")), across)),
    })
    pairs = pairs.withColumns({c: or_whole(F.col(c), F.col(text).cast("binary")) for c, text in (("own", "text"), ("others", "next_text"), ("changed", "edited"))})
    return pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"), likeness("own", "changed").alias("near_edited"), likeness("own", "others").alias("near_next"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
