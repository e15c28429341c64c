"""Separators between two numbers: whether they make a range, what was heard of it, and its readings in order of their shares.

Token rows have keys of their sentence, a place, class, written and spoken. Counts are kept for a narrow key (class of the
separator and the lengths of both numbers) and for its class, to which a rare or unheard key falls back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spellout as say
from ..functions.arrays import matches
from ..functions.text import normal_spoken

#: Separators and their classes, what each class says between its ends (nothing: silent), how many observations
#: decide by themselves, and with how many rows a narrow share leans on its class.
SEPARATORS = {"-": "dash", "–": "dash", ":": "ratio", "x": "dimension", "×": "dimension"}
CONNECTORS = {"dash": ["to", ""], "ratio": ["to", ""], "dimension": ["by", "x"]}
MIN_N, STRENGTH = 50, 5
ENDS = ["year", "cardinal", "digits"]
_NUMBER = "[0-9]+(?:,[0-9]+)*"
_SIGN = "[" + "".join(SEPARATORS) + "]"
_CHAIN = rf"{_NUMBER}(?: ?{_SIGN} ?{_NUMBER})+"


def separator_class(sign: Column) -> Column:
    """dash, ratio or dimension; null for what separates no numbers."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEPARATORS.items() for x in kv]), sign)


def sub_key(left: Column, sign: Column, right: Column) -> Column:
    """class:clock for a time of day, class:L+R by the numbers' lengths without grouping commas (:0 after it if the right one of
    two or more digits starts with a zero), else class:other."""
    bare = lambda c: F.when(c.rlike(r"\A[0-9]{1,3}(?:,[0-9]{3})+\z"), F.translate(c, ",", "")).otherwise(c)
    a, b, kind = bare(left), bare(right), separator_class(sign)
    clock = (kind == "ratio") & F.concat(left, F.lit(":"), right).rlike(r"\A(?:[01]?[0-9]|2[0-3]):[0-5][0-9]\z")
    sizes = F.concat(kind, F.lit(":"), F.length(a).cast("string"), F.lit("+"), F.length(b).cast("string"), F.when(b.rlike(r"\A0[0-9]"), ":0").otherwise(""))
    return F.when(clock, F.concat(kind, F.lit(":clock"))).when(a.rlike(r"\A[0-9]+\z") & b.rlike(r"\A[0-9]+\z"), sizes).otherwise(F.concat(kind, F.lit(":other")))


def emit_key(key: Column) -> Column:
    """The key under which ranges and single tokens are counted: without the mark of a leading zero."""
    return F.regexp_replace(key, r":0\z", "")


def between_numbers(text: Column) -> Column:
    """start, end, left, sign and right of the separators that stand alone between two numbers of a text. Three numbers in a row
    are an identifier and give none."""
    pieces = lambda h, i: F.regexp_extract(h["hit"], rf"\A({_NUMBER}) ?({_SIGN}) ?({_NUMBER})\z", i)
    alone = F.filter(matches(text, _CHAIN), lambda h: pieces(h, 2) != "")
    return F.transform(alone, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), pieces(h, 1).alias("left"), pieces(h, 2).alias("sign"), pieces(h, 3).alias("right")))


def triples(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, left, sign, right, key, kind, said (the separator's words) and both ends' words, of separators between two numbers. What
    continues to a third number with a separator of the same class is left out."""
    near = lambda c, k: F.lag(c, k).over(Window.partitionBy(*keys).orderBy("place"))
    kind = separator_class(F.col("written"))
    rows = tokens.select(
        *keys, "class", kind.alias("kind"), F.col("written").alias("sign"), near("written", 1).alias("left"), near("written", -1).alias("right"), near("spoken", 1).alias("_a"), near("spoken", -1).alias("_b"),
        F.when(F.col("spoken") == "sil", "").otherwise(normal_spoken(F.col("spoken"))).alias("said"), near(kind, 2).alias("_before"), near(kind, -2).alias("_after"),
    )
    number = lambda c: F.col(c).rlike(rf"\A{_NUMBER}\z")
    apart = ~F.coalesce(F.col("_before") == F.col("kind"), F.lit(False)) & ~F.coalesce(F.col("_after") == F.col("kind"), F.lit(False))
    found = rows.where(F.col("kind").isNotNull() & number("left") & number("right") & apart)
    return found.select(*keys, "left", "sign", "right", sub_key(F.col("left"), F.col("sign"), F.col("right")).alias("key"), "kind", "said", F.col("_a").alias("left_said"), F.col("_b").alias("right_said"))


def _said_by_class() -> Column:
    """Whether a separator says what its class may say."""
    options = F.create_map(*[x for k, v in CONNECTORS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    return F.array_contains(F.element_at(options, F.col("kind")), F.col("said"))


def emission_counts(tokens: DataFrame, keys: list[str], often: str | None = None) -> DataFrame:
    """key, as_range and single: how often numbers with a separator were heard as a range, and how often as one token of another kind;
    a row for each narrow key and for each class. A sentence counts once, or as often as its key `often` says."""
    times = (F.col(often) if often else F.lit(1)).alias("_times")
    ranges = triples(tokens, keys).where(_said_by_class()).select("key", "kind", F.lit(1).alias("r"), times)
    piece = lambda i: F.regexp_extract("written", rf"\A({_NUMBER})({_SIGN})({_NUMBER})\z", i)
    whole = tokens.where(F.col("written").rlike(rf"\A{_NUMBER}{_SIGN}{_NUMBER}\z"))
    singles = whole.select(sub_key(piece(1), piece(2), piece(3)).alias("key"), separator_class(piece(2)).alias("kind"), F.lit(0).alias("r"), times)
    each = ranges.unionAll(singles).select(F.explode(F.array(emit_key(F.col("key")), F.col("kind"))).alias("key"), "r", "_times")
    return each.groupBy("key").agg(F.sum(F.col("r") * F.col("_times")).alias("as_range"), F.sum((1 - F.col("r")) * F.col("_times")).alias("single"))


def decided(spans: DataFrame, counts: DataFrame) -> DataFrame:
    """spans (left, sign, right) with key, as_range, single and emits: whether a range is read here, which needs as many heard ranges as
    single tokens. A key with fewer than MIN_N observations goes by its class; one without counts is no range."""
    keyed = spans.withColumn("key", sub_key(F.col("left"), F.col("sign"), F.col("right"))).withColumn("_key", emit_key(F.col("key"))).withColumn("_kind", separator_class(F.col("sign")))
    named = lambda df, key, own: df.select(F.col("key").alias(key), F.struct("as_range", "single").alias(own))
    often = counts.where(F.col("as_range") + F.col("single") >= MIN_N)
    out = keyed.join(named(often, "_key", "_own"), "_key", "left").join(named(counts, "_kind", "_whole"), "_kind", "left").withColumn("_row", F.coalesce("_own", "_whole"))
    r, s = F.col("_row.as_range"), F.col("_row.single")
    return out.select(*spans.columns, "key", r.alias("as_range"), s.alias("single"), F.coalesce((r > 0) & (r >= s), F.lit(False)).alias("emits"))


def forms(number: Column) -> Column:
    """What a number may say, by ENDS: a year (four digits and no leading zero), a cardinal (no leading zero), its digits."""
    bare = F.translate(number, ",", "")
    n = bare.try_cast("long")
    plain = bare.rlike(r"\A(?:0|[1-9][0-9]{0,17})\z")
    year = F.when(number.rlike(r"\A[1-9][0-9]{3}\z"), say.year(n))
    return F.array(year, F.when(plain, say.cardinal(n)), F.when(~number.contains(","), say.digits(number)))


def joint_counts(tokens: DataFrame, keys: list[str], often: str | None = None) -> DataFrame:
    """kind, key, source (left+connector+right) and n of heard ranges whose ends both say one of their forms; the first such form counts.
    A sentence counts once, or as often as its key `often` says."""
    heard = triples(tokens, keys).where(_said_by_class())
    which = lambda number, said: F.get(F.array(*[F.lit(e) for e in ENDS]), (F.array_position(F.transform(forms(F.col(number)), lambda f: F.coalesce(normal_spoken(f), F.lit("\0"))), normal_spoken(F.col(said))) - 1).cast("int"))
    ends = heard.select("kind", "key", which("left", "left_said").alias("_a"), F.when(F.col("said") == "", "silent").otherwise(F.col("said")).alias("_c"), which("right", "right_said").alias("_b"), (F.col(often) if often else F.lit(1)).alias("_times"))
    return ends.where("_a IS NOT NULL AND _b IS NOT NULL").groupBy("kind", "key", F.concat_ws("+", "_a", "_c", "_b").alias("source")).agg(F.sum("_times").alias("n"))


def connector_shares(joint: DataFrame) -> DataFrame:
    """kind, connector, n and share of the class's heard ranges that it joins: the order of readings of a lone separator."""
    each = joint.groupBy("kind", F.split("source", r"\+")[1].alias("connector")).agg(F.sum("n").alias("n"))
    return each.join(joint.groupBy("kind").agg(F.sum("n").alias("_total")), "kind").select("kind", "connector", "n", (F.col("n") / F.col("_total")).alias("share"))


def readings(spans: DataFrame, joint: DataFrame) -> DataFrame:
    """left, sign, right, source, spoken, share and rank of every reading of the different spans.

    A reading is a form of each end and a connector of the class: 18 at most. Its share among the heard ranges of its narrow key
    leans on the share of its class; an unheard key goes by the class. Ties, and what was never heard (share null), keep the order
    of the forms. Readings that say the same stay once, the best of them.
    """
    asked = spans.select("left", "sign", "right").distinct()
    options = F.create_map(*[x for k, v in CONNECTORS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    kind = separator_class(F.col("sign"))
    rows = asked.withColumn("kind", kind).withColumn("key", sub_key(F.col("left"), F.col("sign"), F.col("right")))
    rows = rows.select("*", F.posexplode(forms(F.col("left"))).alias("_i", "_a")).select("*", F.posexplode(forms(F.col("right"))).alias("_j", "_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    rows = rows.select("*", F.posexplode(F.element_at(options, F.col("kind"))).alias("_k", "_c"))
    end = lambda i: F.get(F.array(*[F.lit(e) for e in ENDS]), F.col(i))
    middle = F.when(F.col("_c") == "", "silent").otherwise(F.col("_c"))
    spoken = F.concat_ws(" ", "_a", F.nullif("_c", F.lit("")), "_b")
    rows = rows.select("left", "sign", "right", "kind", "key", F.concat_ws("+", end("_i"), middle, end("_j")).alias("source"), spoken.alias("spoken"), (F.when(F.col("_i") == F.col("_j"), 10 * F.col("_i")).otherwise(100 + 20 * F.col("_i") + 5 * F.col("_j")) + F.col("_k")).alias("_place"))
    own = joint.select("kind", "key", "source", F.col("n").alias("_n"))
    known = joint.groupBy("kind", "key").agg(F.sum("n").alias("_own"))
    whole = joint.groupBy("kind", "source").agg(F.sum("n").alias("_wide"))
    total = joint.groupBy("kind").agg(F.sum("n").alias("_all"))
    met = rows.join(own, ["kind", "key", "source"], "left").join(known, ["kind", "key"], "left").join(whole, ["kind", "source"], "left").join(total, "kind", "left")
    wide = F.col("_wide") / F.col("_all")
    narrow = (F.coalesce("_n", F.lit(0)) + STRENGTH * F.coalesce(wide, F.lit(0.0))) / (F.col("_own") + STRENGTH)
    shared = met.withColumn("share", F.when(F.col("_own").isNull() | wide.isNull(), wide).otherwise(narrow))
    best = [F.coalesce("share", F.lit(-1.0)).desc(), F.col("_place")]
    once = shared.withColumn("_first", F.row_number().over(Window.partitionBy("left", "sign", "right", "spoken").orderBy(*best))).where("_first = 1")
    rank = F.row_number().over(Window.partitionBy("left", "sign", "right").orderBy(*best))
    return once.select("left", "sign", "right", "source", "spoken", "share", rank.cast("long").alias("rank"))
