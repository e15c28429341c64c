"""Prior tables counted from labelled rows (class, written, spoken): raw counts, one partial and one final aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tf

#: Fewest rows of a shape, and the strength with which a narrow count leans on its parent.
MIN_N, STRENGTH = 3, 5


def type_priors(rows: DataFrame) -> DataFrame:
    """shape, class, n and total of its shape, of written forms that hold a digit."""
    counts = rows.where(F.col("written").rlike(r"\p{Nd}")).groupBy(tf.shape(F.col("written")).alias("shape"), "class").agg(F.count("*").alias("n"))
    totals = counts.groupBy("shape").agg(F.sum("n").alias("total"))
    return counts.join(totals, "shape")


def reading_prior(readings: DataFrame, priors: DataFrame) -> DataFrame:
    """readings (shape, class) with n, total and tier: measured, attested-zero (the shape is known, not with this class) or
    unsupported. Counts stay apart, so that shares compare exactly; a missing count stays null."""
    shapes = priors.groupBy("shape").agg(F.max("total").alias("total")).where(F.col("total") >= MIN_N)
    counts = priors.select("shape", "class", "n")
    tier = F.when(F.col("total").isNull(), "unsupported").when(F.col("n").isNull(), "attested-zero").otherwise("measured")
    return readings.join(shapes, "shape", "left").join(counts, ["shape", "class"], "left").withColumn("tier", tier)


def century_priors(rows: DataFrame) -> DataFrame:
    """century (two digits), choice (date, cardinal or digit) and n of bare four-digit tokens."""
    choice = F.when(F.col("class") == "DATE", "date").when(F.col("class") == "CARDINAL", "cardinal").when(F.col("class").isin("DIGIT", "TELEPHONE"), "digit")
    return rows.where(F.col("written").rlike(r"\A[0-9]{4}\z")).select(F.substring("written", 1, 2).alias("century"), choice.alias("choice")).where("choice IS NOT NULL").groupBy("century", "choice").agg(F.count("*").alias("n"))


def zero_priors(rows: DataFrame) -> DataFrame:
    """class, word (o, oh or zero) and n of zeros in spoken forms."""
    return rows.select("class", F.explode(tf.spoken_tokens(F.col("spoken"))).alias("word")).where(F.col("word").isin("o", "oh", "zero")).groupBy("class", "word").agg(F.count("*").alias("n"))


def acronym_priors(rows: DataFrame) -> DataFrame:
    """key, spelled and said: counts of capital runs under the keys *, length and case, vowel pattern and surface."""
    runs = rows.where(F.col("written").rlike(r"\A\p{Lu}{2,}\z"))
    spelled = F.regexp_replace("spoken", " ", "") == F.lower("written")
    apart = spelled & F.col("spoken").contains(" ")
    keys = F.array(F.lit("*"), tf.letter_key(F.col("written")), F.concat(F.lit("cv:"), tf.consonant_vowel(F.col("written"))), F.concat(F.lit("surface:"), F.col("written")))
    return runs.select(F.explode(keys).alias("key"), apart.alias("apart")).groupBy("key").agg(F.count_if("apart").alias("spelled"), F.count_if(~F.col("apart")).alias("said"))


def acronym_shares(words: DataFrame, word: str, priors: DataFrame) -> DataFrame:
    """words with the share in which a run of capitals is spelled out, and the narrowest level that has counts of it.

    Each level's share leans on that of the level above: all runs, length and case, vowel pattern, surface. The priors are
    joined once for each level."""
    w = F.col(word)
    levels = [("all", F.lit("*")), ("shape", tf.letter_key(w)), ("pattern", F.concat(F.lit("cv:"), tf.consonant_vowel(w))), ("surface", F.concat(F.lit("surface:"), w))]
    out, share, level = words, None, None
    for i, (name, key) in enumerate(levels):
        own = priors.select(F.col("key").alias(f"_k{i}"), F.col("spelled").alias(f"_s{i}"), (F.col("spelled") + F.col("said")).alias(f"_n{i}"))
        out = out.withColumn(f"_k{i}", key).join(own, f"_k{i}", "left")
        n, s = F.coalesce(f"_n{i}", F.lit(0)), F.coalesce(f"_s{i}", F.lit(0))
        share = s / F.greatest(n, F.lit(1)) if share is None else blended(s, n, share)
        level = F.lit(name) if level is None else F.when(F.col(f"_n{i}").isNotNull(), name).otherwise(level)
    return out.select(*[F.col(c) for c in words.columns], share.alias("share"), level.alias("level"))


def abbreviation_priors(rows: DataFrame) -> DataFrame:
    """fold key, written case, whether it was expanded, n."""
    tokens = rows.where(F.col("written").rlike(r"\A\p{L}+\.?\z"))
    expanded = tf.normal_spoken(F.col("spoken")) != tf.normal_spoken(F.col("written"))
    return tokens.groupBy(tf.fold_key(F.col("written")).alias("key"), tf.written_case(F.col("written")).alias("case"), expanded.alias("expanded")).agg(F.count("*").alias("n"))


def electronic_priors(rows: DataFrame) -> DataFrame:
    """kind (letters, digits or sign), key and n of the runs of electronic forms."""
    run = F.explode(tf.runs(F.col("written"))).alias("run")
    kinds = rows.where("class = 'ELECTRONIC'").select(run)
    kind = F.when(F.col("run").rlike(r"\A\p{L}"), "letters").when(F.col("run").rlike(r"\A\p{Nd}"), "digits").otherwise("sign")
    key = F.when(kind == "letters", tf.letter_key(F.col("run"))).when(kind == "digits", tf.digit_key(F.col("run"))).otherwise(F.col("run"))
    return kinds.groupBy(kind.alias("kind"), key.alias("key")).agg(F.count("*").alias("n"))


def telephone_priors(rows: DataFrame) -> DataFrame:
    """shape (digit runs by length), class and n."""
    return rows.where(F.col("written").rlike(r"[0-9]+[ .()-]+[0-9]")).groupBy(tf.width_shape(F.col("written")).alias("shape"), "class").agg(F.count("*").alias("n"))


def spellout_dictionary(rows: DataFrame, support: int = 5, purity: float = 0.99) -> DataFrame:
    """surface, decision (say or spell) and n of tokens that are nearly always read one way."""
    spell = F.regexp_replace("spoken", " ", "") == F.lower("written")
    counts = rows.where(F.col("written").rlike(r"\A\p{L}{2,6}\z")).groupBy(F.col("written").alias("surface")).agg(F.count("*").alias("n"), F.count_if(spell & F.col("spoken").contains(" ")).alias("spelled"))
    share = F.greatest(F.col("spelled"), F.col("n") - F.col("spelled")) / F.col("n")
    return counts.where((F.col("n") >= support) & (share >= purity)).select("surface", F.when(F.col("spelled") * 2 > F.col("n"), "spell").otherwise("say").alias("decision"), "n")


def strict_majority(counts: DataFrame, keys: list[str], label: str, support: int = MIN_N) -> DataFrame:
    """keys and the label that more than half of at least `support` rows (n) have."""
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.max_by(label, "n").alias(label), F.max("n").alias("n"))
    return totals.where((F.col("n") >= support) & (2 * F.col("n") > F.col("total")))


def blended(n: Column, total: Column, parent: Column) -> Column:
    """A share that leans on its parent's with STRENGTH rows."""
    return (n + STRENGTH * parent) / (total + STRENGTH)


def seen_vocabulary(rows: DataFrame) -> DataFrame:
    return rows.select("written").distinct()


def unseen(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return rows.join(vocabulary, "written", "left_anti")
