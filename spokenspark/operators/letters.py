"""Letters by themselves, words that are spelled, Roman numerals and bare inches: what they are, by counts of heard text.

Heard rows have class, written and spoken. All decisions are joins with small aggregates of them; what was never heard goes by a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.priors import MIN_N, blended
from .detect import READING, Family, spans

#: Words of one letter, classes that say a number, and what follows a sentence's last word.
SINGLE_WORDS = ["I", "a", "A"]
NUMERALS = ["CARDINAL", "ORDINAL"]
COUNTED = ["CARDINAL", "DECIMAL", "ORDINAL"]
END, OTHER = "</s>", "other"
_WORD = r"\p{L}\p{M}\p{N}_"
_LONE = rf"(?<![{_WORD}])\p{{L}}(?![{_WORD}])"
#: Tens and ones of a Roman numeral, each from none to nine.
_ROMAN = r"\A(?=[IVXLCDM])M{0,3}(?:C[MD]|D?C{0,3})(?:X[CL]|L?X{0,3})(?:I[XV]|V?I{0,3})\z"


def lone_letters(text: Column) -> Column:
    """Readings of the letters that stand alone: letter:name, or word:single-letter for the words I and a."""
    found = spans(text, Family("letter:name", _LONE, False))
    return F.transform(found, lambda c: c.withField("type", F.when(c["surface"].isin(SINGLE_WORDS), "word:single-letter").otherwise(c["type"]))).cast(READING)


def words(text: Column) -> Column:
    """The words of a text: letters, marks, digits and low lines without anything between."""
    return F.filter(F.split(text, rf"[^{_WORD}]+"), lambda w: w != "")


def may_be_spelled(word: Column) -> Column:
    """Two to six Latin letters that are not all capitals."""
    return word.rlike(r"\A\p{IsLatin}{2,6}\z") & (word != F.upper(word))


def rule(word: Column) -> Column:
    """A word with one of aeiou is said, another one spelled."""
    return F.when(F.lower(word).rlike("[aeiou]"), "say").otherwise("spell")


def heard_words(rows: DataFrame) -> DataFrame:
    """surface, said and spelled of words of two to six letters: spelled if the spoken form is the letters one by one."""
    letter_by_letter = F.col("spoken") == F.array_join(F.split(F.lower("written"), ""), " ")
    tokens = rows.where(F.col("written").rlike(r"\A\p{IsLatin}{2,6}\z"))
    return tokens.groupBy(F.col("written").alias("surface")).agg(F.count_if(~letter_by_letter).alias("said"), F.count_if(letter_by_letter).alias("spelled"))


def spelled_or_said(tokens: DataFrame, word: str, counts: DataFrame, support: int = 5, purity: float = 0.99, case_variants: bool = True) -> DataFrame:
    """tokens with decision (say or spell), source and spell_share.

    The first that knows the word decides: dictionary (heard `support` times at least, and nearly always one way), case-variant (all
    words of the dictionary that differ in case only agree), exception (most heard ones are not as the rule has it), rule.
    """
    n, top = F.col("said") + F.col("spelled"), F.greatest("said", "spelled")
    decision = F.when(F.col("spelled") > F.col("said"), "spell").otherwise("say")
    known = counts.select("surface", "said", "spelled", n.alias("n"), decision.alias("decision"), ((n >= support) & (top >= purity * n)).alias("sure"))
    own = known.select(F.col("surface").alias("_word"), F.struct("decision", "sure", "n", (F.col("spelled") / F.col("n")).alias("share"), (2 * F.greatest("said", "spelled") > F.col("n")).alias("most")).alias("_own"))
    folds = known.where("sure").groupBy(F.lower("surface").alias("_fold")).agg(F.min("decision").alias("lo"), F.max("decision").alias("hi"), (F.sum("spelled") / F.sum("n")).alias("share"))
    folds = folds.where("lo = hi").select("_fold", F.struct(F.col("lo").alias("decision"), "share").alias("_alias"))
    met = tokens.withColumn("_word", F.col(word)).join(own, "_word", "left").withColumn("_fold", F.lower("_word")).join(folds, "_fold", "left")
    sure = F.coalesce(F.col("_own.sure"), F.lit(False))
    alias = F.col("_alias").isNotNull() & F.lit(case_variants)
    strange = F.coalesce(F.col("_own.most") & (F.col("_own.n") >= MIN_N) & (F.col("_own.decision") != rule(F.col("_word"))), F.lit(False))
    pick = lambda a, b, c, d: F.when(sure, a).when(alias, b).when(strange, c).otherwise(d)
    return met.select(
        *tokens.columns, pick(F.col("_own.decision"), F.col("_alias.decision"), F.col("_own.decision"), rule(F.col("_word"))).alias("decision"),
        pick(F.lit("dictionary"), F.lit("case-variant"), F.lit("exception"), F.lit("rule")).alias("source"), pick(F.col("_own.share"), F.col("_alias.share"), F.col("_own.share"), F.lit(None).cast("double")).alias("spell_share"),
    )


def is_roman(word: Column) -> Column:
    """Whether two or more capitals are a Roman numeral."""
    return (F.length(word) > 1) & word.rlike(_ROMAN)


def roman_counts(rows: DataFrame) -> DataFrame:
    """key (roman:* and roman:surface), numeral and other: how often runs that may be Roman numerals were heard as numbers."""
    key = F.explode(F.array(F.lit("roman:*"), F.concat(F.lit("roman:"), F.col("written")))).alias("key")
    each = rows.where(is_roman(F.col("written"))).select(key, F.col("class").isin(NUMERALS).alias("_n"))
    return each.groupBy("key").agg(F.count_if("_n").alias("numeral"), F.count_if(~F.col("_n")).alias("other"))


def roman_veto(runs: DataFrame, run: str, counts: DataFrame) -> DataFrame:
    """runs (capitals) with numeral_share and reading: number:cardinal:roman where a Roman numeral is more often a number than not,
    letters:run else. A surface's share leans on that of all numerals; without any count it is zero."""
    pooled = counts.where("key = 'roman:*'").select(F.col("key").alias("_all"), (F.col("numeral") / (F.col("numeral") + F.col("other"))).alias("_parent"))
    own = counts.select(F.col("key").alias("_key"), F.col("numeral").alias("_n"), (F.col("numeral") + F.col("other")).alias("_total"))
    met = runs.withColumn("_key", F.concat(F.lit("roman:"), F.col(run))).join(own, "_key", "left").withColumn("_all", F.lit("roman:*")).join(F.broadcast(pooled), "_all", "left")  # one row
    none = F.lit(0)
    share = F.when(is_roman(F.col(run)), blended(F.coalesce("_n", none), F.coalesce("_total", none), F.coalesce("_parent", F.lit(0.0)))).otherwise(0.0)
    return met.select(*runs.columns, share.alias("numeral_share"), F.when(share > 0.5, "number:cardinal:roman").otherwise("letters:run").alias("reading"))


def frequent_words(tokens: DataFrame, support: int) -> DataFrame:
    """word: lower-case words that were heard `support` times at least."""
    return tokens.where(F.col("written").rlike(r"\A\p{L}+\z")).groupBy(F.lower("written").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= support).select("word")


def _classed(rows: DataFrame, word: str, frequent: DataFrame) -> DataFrame:
    """rows with word_class: the word if it is frequent, other if not, END if there is none."""
    met = rows.withColumn("_w", F.lower(word)).join(frequent.select(F.col("word").alias("_w"), F.lit(True).alias("_known")), "_w", "left")
    return met.withColumn("word_class", F.when(F.col("_w").isNull(), END).when(F.col("_known"), F.col("_w")).otherwise(OTHER)).drop("_w", "_known")


def inch_counts(tokens: DataFrame, keys: list[str], frequent: DataFrame) -> DataFrame:
    """word_class, measure and preposition: what follows measures, and what follows a number and the word in."""
    order = Window.partitionBy(*keys).orderBy("place")
    after = lambda c, k: F.lead(c, k).over(order)
    rows = tokens.select("class", F.col("written"), after("written", 1).alias("_1"), after("written", 2).alias("_2"), after("class", 1).alias("_c"))
    preposition = F.col("class").isin(COUNTED) & (F.col("_c") == "PLAIN") & (F.col("_1") == "in")
    asked = rows.where((F.col("class") == "MEASURE") | preposition).select((F.col("class") == "MEASURE").alias("_m"), F.when(F.col("class") == "MEASURE", F.col("_1")).otherwise(F.col("_2")).alias("_next"))
    return _classed(asked, "_next", frequent).groupBy("word_class").agg(F.count_if("_m").alias("measure"), F.count_if(~F.col("_m")).alias("preposition"))


def bare_inches(rows: DataFrame, next_word: str, second_word: str, counts: DataFrame, frequent: DataFrame) -> DataFrame:
    """rows with word_class and is_measure: whether a number and "in" before two words (null: none) are inches.

    They are at the end of a sentence, before one infrequent last word, and before a word that more often follows measures than the
    preposition after a number.
    """
    met = _classed(rows, next_word, frequent).join(counts, "word_class", "left")
    more = (F.col("measure") > 0) & (F.col("measure") > F.col("preposition"))
    inches = F.when(F.col("word_class") == END, True).when(F.col("word_class") == OTHER, F.col(second_word).isNull()).otherwise(F.coalesce(more, F.lit(False)))
    return met.select(*rows.columns, "word_class", inches.alias("is_measure"))


def roman(n: Column) -> Column:
    """1 to 3999 in Roman capitals."""
    digit = lambda one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    place = lambda words, k: F.get(F.array(*[F.lit(w) for w in words]), (F.floor(n / k) % 10).cast("int"))
    return F.when((n > 0) & (n < 4000), F.concat(place(digit("M", "", "")[:4], 1000), place(digit("C", "D", "M"), 100), place(digit("X", "L", "C"), 10), place(digit("I", "V", "X"), 1)))
