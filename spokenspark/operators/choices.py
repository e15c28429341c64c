"""Ranking of spoken forms beside their readings: curated forms, measured shares and the words around a token."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import spellout as say


def with_curated(forms: DataFrame, curated: DataFrame) -> DataFrame:
    """forms with those of curated (type, surface, spoken, source) that they lack, after their own."""
    spans = forms.groupBy(*[c for c in forms.columns if c not in ("place", "spoken", "provenance")]).agg(F.max("place").alias("place"), F.collect_set("spoken").alias("_said"))
    more = spans.join(curated, ["type", "surface"]).where(~F.array_contains("_said", F.col("spoken"))).withColumns({"provenance": F.concat(F.lit("curated:"), F.col("source")), "place": F.col("place") + 1})
    return forms.unionByName(more.select(forms.columns))


def ranked_forms(forms: DataFrame, shares: DataFrame, keys: list[str]) -> DataFrame:
    """forms by measured share (type, provenance, share), unmeasured ones after, each in their own order; rank from 1."""
    order = W.partitionBy(*keys, "start", "end", "type").orderBy(F.desc_nulls_last("share"), "place", "spoken")
    return forms.join(shares, ["type", "provenance"], "left").withColumn("rank", F.row_number().over(order))


def neighbours(tokens: DataFrame, keys: list[str], left: int = 3, right: int = 2) -> DataFrame:
    """tokens (keys, pos, token) with the words before and after: `<s>` and `</s>` beyond the ends."""
    order = W.partitionBy(*keys).orderBy("pos")
    before = [F.coalesce(F.lag("token", k).over(order), F.lit("<s>")) for k in range(left, 0, -1)]
    after = [F.coalesce(F.lead("token", k).over(order), F.lit("</s>")) for k in range(1, right + 1)]
    return tokens.withColumns({"before": F.array(*before), "after": F.array(*after)})


def four_digit_forms(tokens: DataFrame, centuries: DataFrame) -> DataFrame:
    """tokens (written, four digits) as a year, a number and digit by digit (choice, spoken), ranked by how tokens that start
    with the same two digits are read (centuries: century, choice, n); without counts in that order."""
    value = F.col("written").cast("long")
    forms = [("date", say.year(value)), ("cardinal", say.cardinal(value)), ("digit", say.digits(F.col("written")))]
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("choice"), c.alias("spoken")) for i, (k, c) in enumerate(forms)])
    rows = tokens.select("written", F.substring("written", 1, 2).alias("century"), F.explode(each).alias("f")).select("written", "century", "f.*")
    order = W.partitionBy("written").orderBy(F.desc("n"), "place")
    return rows.join(centuries, ["century", "choice"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).select("written", "choice", "n", F.row_number().over(order).cast("long").alias("rank"), "spoken")
