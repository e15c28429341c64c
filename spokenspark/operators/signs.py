"""Readings beside the recognizers' own: coordinates, runs of one sign, and abbreviations in other spellings than the listed one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spellout as say
from ..functions.arrays import matches

#: The points of the compass, and signs that stand in runs with what one of them is called.
COMPASS = {"N": "north", "S": "south", "E": "east", "W": "west"}
RUN_NAMES = {"*": "asterisk", "=": "equals sign", "_": "underscore", "~": "tilde", "#": "number sign", "-": "hyphen", "+": "plus sign", "•": "bullet", "!": "exclamation mark", "?": "question mark"}
_PLACE = r"([0-9]{1,3}(?:\.[0-9]{1,9})?)° ?(?:([0-9]{1,2})['′] ?)?(?:([0-9]{1,2})[\"″] ?)?([NSEW])"
_COORDINATE = rf"(?<![\p{{L}}\p{{N}}.,-]){_PLACE}(?![\p{{L}}\p{{N}}])"
#: Signs that make a run at least.
LEAST = 3
_TOKEN = r"\p{L}+(?:\.\p{L}+)*\.?"


def coordinates(text: Column) -> Column:
    """start, end, surface and spoken of the coordinates of a text: degrees with minutes and seconds, if there are any, before a point of
    the compass. More than 90 degrees north or south, 180 east or west, or 59 minutes or seconds are none, nor are seconds without minutes."""
    part = lambda h, i: F.regexp_extract(h["hit"], _PLACE, i)
    many = lambda words, n, unit: F.concat(words, F.lit(f" {unit}"), F.when(n == "1", "").otherwise("s"))

    def real(h: Column) -> Column:
        most = F.when(part(h, 4).isin("N", "S"), 90.0).otherwise(180.0)
        below = lambda i: (part(h, i) == "") | (part(h, i).try_cast("int") < 60)
        return (part(h, 1).cast("double") <= most) & below(2) & below(3) & ((part(h, 3) == "") | (part(h, 2) != ""))

    def spoken(h: Column) -> Column:
        pieces = [many(say.decimal(part(h, 1)), part(h, 1), "degree")]
        pieces += [F.when(part(h, i) != "", many(say.cardinal(part(h, i).try_cast("long")), F.regexp_replace(part(h, i), r"\A0(?=[0-9])", ""), unit)) for i, unit in ((2, "minute"), (3, "second"))]
        return F.concat_ws(" ", *pieces, F.element_at(F.create_map(*[F.lit(x) for kv in COMPASS.items() for x in kv]), part(h, 4)))

    found = F.filter(matches(text, _COORDINATE), real)
    return F.transform(found, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["hit"].alias("surface"), spoken(h).alias("spoken")))


def sign_runs(text: Column, least: int = LEAST) -> Column:
    """start, end, surface and spoken (a line of the sign) of the runs of one sign, of `least` or more."""
    pattern = "|".join(f"[{s}]{{{least},}}" if s not in "-*" else f"[{chr(92)}{s}]{{{least},}}" for s in RUN_NAMES)
    name = lambda h: F.element_at(F.create_map(*[F.lit(x) for kv in RUN_NAMES.items() for x in kv]), F.substring(h["hit"], 1, 1))
    return F.transform(matches(text, pattern), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["hit"].alias("surface"), F.concat(F.lit("line of "), name(h)).alias("spoken")))


def variants(entries: DataFrame) -> DataFrame:
    """surface, written, spoken and kind of other spellings of listed abbreviations (written, spoken): without their periods, in capitals, in
    small letters. A spelling that is itself listed is none; one of several abbreviations has a row for each."""
    w = F.col("written")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("surface")) for k, c in (("no-period", F.replace(w, F.lit("."), F.lit(""))), ("upper", F.upper(w)), ("lower", F.lower(w)))])
    each = entries.select("written", "spoken", F.explode(kinds).alias("v")).select("v.surface", "written", "spoken", "v.kind").where((F.col("surface") != w) & (F.length("surface") > 1))
    once = each.groupBy("surface", "written", "spoken").agg(F.min("kind").alias("kind"))
    return once.join(entries.select(F.col("written").alias("surface")).distinct(), "surface", "left_anti")


def found_variants(docs: DataFrame, text: str, entries: DataFrame) -> DataFrame:
    """docs' other columns, start, end, surface, written, spoken and kind of the words of a column that are variants of listed abbreviations.

    A word with its period is looked up as a whole, and where that is neither listed nor a variant, without the period. The list is joined."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select(*others, F.explode(matches(F.col(text), _TOKEN)).alias("_h"))
    bare = F.regexp_replace("_h.hit", r"\.\z", "")
    listed = entries.select(F.col("written").alias("_listed")).distinct()
    free = rows.join(listed, F.col("_h.hit") == F.col("_listed"), "left_anti")
    known = variants(entries).groupBy("surface").agg(F.array_sort(F.collect_set(F.struct("written", "spoken", "kind"))).alias("_v"))  # a few spellings each
    whole = known.select(F.col("surface").alias("_s0"), F.col("_v").alias("_v0"))
    cut = known.select(F.col("surface").alias("_s1"), F.col("_v").alias("_v1"))
    met = free.join(whole, F.col("_h.hit") == F.col("_s0"), "left").withColumn("_bare", bare).join(cut, F.col("_bare") == F.col("_s1"), "left")
    met = met.where("_v0 IS NOT NULL OR _v1 IS NOT NULL")
    end = F.when(F.col("_v0").isNotNull(), F.col("_h.end")).otherwise(F.col("_h.start") + F.length("_bare"))
    out = met.select(*others, F.col("_h.start").alias("start"), end.alias("end"), F.when(F.col("_v0").isNotNull(), F.col("_h.hit")).otherwise(F.col("_bare")).alias("surface"), F.explode(F.coalesce("_v0", "_v1")).alias("_x"))
    return out.select(*others, "start", "end", "surface", "_x.written", "_x.spoken", "_x.kind")
