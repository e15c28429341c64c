"""Recognizers: candidate readings of the formatted values in a text, as an array column.

Each family is a regular expression; offsets are code points, summed from the pieces between its matches, since the
positions inside the expression engine count other units.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spellout
from ..functions.text import isbn_valid

_MONTH = "(?:" + "|".join(m + (f"|{m[:3]}\\.?" if len(m) > 4 else "") for m in spellout.MONTHS) + ")"
_WEEKDAY = "(?:" + "|".join(spellout.WEEKDAYS) + ")"
_SPAN = "(?:second|minute|hour|day|week|month|year)s?"
_UNIT = "(?:" + "|".join(sorted(spellout.UNITS, key=len, reverse=True)) + ")"
_AMOUNT = r"-?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
_SCALE = "(?:thousand|million|billion|trillion)"
_VULGAR = "[" + "".join(spellout.VULGAR) + "]"
_ISO = "(?:" + "|".join(k for k in spellout.CURRENCIES if len(k) == 3) + ")"
_NAME = "(?:" + "|".join(sorted(spellout.CURRENCY_NAMES, key=len, reverse=True)) + ")"
#: Time zones after a clock time.
_ZONE = "(?:UTC|GMT|EST|EDT|ET|CST|CDT|CT|MST|MDT|MT|PST|PDT|PT)"
#: What may stand beside a value that stands free: on its left a space, an opening sign or nothing, on its right a space, a closing
#: sign or nothing, but no point or comma that goes on with a digit.
_FREE = r"(?<![^\s(\[{\"'“‘,;–—])"
_END = r"(?![^\s)\]}\"'”’,;:!?.…–—]|[.,:][0-9])"
#: Reporters that court citations name between volume and page.
REPORTERS = ["U.S.", "U. S.", "S. Ct.", "F.2d", "F.3d", "F. Supp."]
_CLOCK = "(?:[01]?[0-9]|2[0-3]):[0-5][0-9]"
#: Abbreviations and what they say.
ABBREVIATIONS = {
    "Dr.": "doctor", "Mr.": "mister", "Mrs.": "missus", "Ms.": "miz", "Prof.": "professor", "St.": "saint", "Jr.": "junior", "Sr.": "senior", "vs.": "versus", "etc.": "et cetera",
    "e.g.": "for example", "i.e.": "that is", "No.": "number", "Inc.": "incorporated", "Ltd.": "limited", "Co.": "company", "approx.": "approximately", "dept.": "department", "Ave.": "avenue", "Blvd.": "boulevard",
}
#: Names of standalone symbols.
SYMBOLS = {"&": "and", "@": "at", "+": "plus", "=": "equals", "°": "degree", "§": "section", "©": "copyright", "®": "registered", "™": "trademark", "×": "times", "÷": "divided by", "±": "plus or minus", "→": "right arrow", "²": "squared", "³": "cubed"}


@dataclass(frozen=True)
class Family:
    """type, expression, whether it needs a digit, and a further test of the surface. The order of families is the rank of
    readings of the same span."""

    type: str
    pattern: str
    digit: bool = True
    test: str = ""


FAMILIES = [
    Family("electronic:url", r"(?i)\b(?:https?://|www\.)[^\s<>\"]*[^\s<>\".,;:!?)']", False),
    Family("electronic:email", r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", False),
    Family("electronic:domain", r"(?<![\w.@-])(?:[A-Za-z0-9-]+\.)+(?:com|org|net|edu|gov|info|co\.uk|io|uk|de|fr|es)(?![\w-])", False),
    Family("electronic:hashtag", r"(?<!\w)#\p{L}\w*", False),
    Family("telephone:number", r"(?<![\w+.-])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9](?!11)[0-9]{2}[ .-][0-9]{4}(?![\w-])"),
    Family("telephone:number", r"(?<![\w+])\+[0-9]{1,3}(?:[ -][0-9]{2,5}){2,5}(?![\w-])"),
    Family("identifier:grouped-digits", r"(?<![\w.-])(?:97[89][- ]?)?[0-9](?:[- ]?[0-9]){8}[- ]?[0-9Xx](?![\w-])", True, "isbn"),
    Family("version:dotted", rf"{_FREE}[vV](?:[0-9]+\.){{2,}}[0-9]+{_END}"),
    Family("number:dotted-run", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w.]*\w)"),
    Family("number:scientific", r"(?<![\w.])[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+|\s?[×x]\s?10\^[+-]?[0-9]+)(?!\w)"),
    Family("number:scientific", r"(?<![\w.])[0-9]+(?:\.[0-9]+)?\s?[×x]\s?10⁻?[⁰¹²³⁴⁵⁶⁷⁸⁹]+"),
    Family("number:currency:compact", rf"(?<!\w)[$€£¥]\s?{_AMOUNT}\s?(?:{_SCALE}\b|[KMBT](?!\w))"),
    Family("number:currency:name", rf"(?<![\w.,-])(?:{_AMOUNT} (?:{_ISO}|{_NAME})|{_ISO} {_AMOUNT})(?!\w)"),
    Family("number:compact", rf"(?<![\w.,$€£¥-]){_AMOUNT}(?:\s?{_SCALE}\b|[KMBT](?!\w))"),
    Family("number:currency", rf"(?<!\w)[$€£¥]\s?{_AMOUNT}(?!\w)"),
    Family("number:percent", rf"(?<![\w.]){_AMOUNT}\s?%"),
    Family("date:flexible", r"(?<![\w/-])[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![\w-])"),
    Family("date:numeric", r"(?<![\w/.-])(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])/(?:[0-9]{4}|[0-9]{2})(?![\w/]|\.[0-9])"),
    Family("date:quarter", r"(?<![\w-])Q[1-4](?: [12][0-9]{3})?(?![\w-])"),
    Family("date:text-flexible", rf"\b{_MONTH} [0-9]{{1,2}}(?:st|nd|rd|th)?(?:,? [0-9]{{4}})?\b"),
    Family("date:text-flexible", rf"\b[0-9]{{1,2}}(?:st|nd|rd|th)? {_MONTH}(?: [0-9]{{4}})?\b"),
    Family("date:weekday", rf"\b{_WEEKDAY},? {_MONTH} [0-9]{{1,2}}(?:st|nd|rd|th)?(?:,? [0-9]{{4}})?\b"),
    Family("date:interval", rf"\b{_MONTH} [0-9]{{1,2}} ?[–-] ?[0-9]{{1,2}}(?:, [0-9]{{4}})?(?![\w–-])"),
    Family("date:relative", rf"{_FREE}(?:[0-9]{{1,3}} {_SPAN} ago|in [0-9]{{1,3}} {_SPAN})(?!\w)"),
    Family("time:seconds", r"(?<![\w:.])(?:0?[1-9]|1[0-2]):[0-5][0-9]:[0-5][0-9] ?[aApP]\.?[mM]\b\.?"),
    Family("date:era", r"\b[0-9]{1,4} ?(?:BCE?|CE|AD|B\.C\.(?:E\.)?|C\.E\.|A\.D\.)(?![\p{L}\p{Nd}])"),
    Family("date:era", r"\b(?:AD|A\.D\.) ?[0-9]{1,4}\b(?![.,][0-9])"),
    Family("date:elided", r"(?<![\p{L}\p{Nd}'])'[0-9]{2}(?![\p{L}\p{Nd}])"),
    Family("time:flexible", rf"(?<![\w:.]){_CLOCK}(?:\s?[aApP]\.?[mM]\b\.?)?\s{_ZONE}(?!\w)"),
    Family("measure:duration:numeric", r"(?<![\w:.])(?:[0-9]{1,2}:[0-5][0-9]:[0-5][0-9]|[0-9]{1,3}:[0-5][0-9]\.[0-9]{1,3})(?![\w:])"),
    Family("range:time", rf"(?<![\w:.–-]){_CLOCK}\s?[–-]\s?{_CLOCK}(?![\w:])"),
    Family("range:year", r"(?<![\w.,/–-])(?:1[0-9]|20)[0-9]{2}[–-](?:1[0-9]|20)[0-9]{2}(?![\w/–-]|[.,][0-9])"),
    Family("range:percent", r"(?<![\w.–-])[0-9]+\s?[–-]\s?[0-9]+\s?%"),
    Family("range:measure", rf"(?<![\w.–-])[0-9]+\s?[–-]\s?[0-9]+\s?{_UNIT}(?!\w)"),
    Family("range:ratio", r"(?<![\w:.])[0-9]{1,4}:[0-9](?![\w:]|\.[0-9])"),
    Family("time:flexible", r"(?<![\w:.])(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?:\s?[aApP]\.?[mM]\b\.?)?(?![\w:])"),
    Family("time:spaced-colon", rf"{_FREE}[0-9]{{1,2}}: [0-9]{{2}}{_END}", True, "clock"),
    Family("range:dimension", r"(?<![\w.])[0-9]+\s?[x×]\s?[0-9]+(?![\w.]\w)"),
    Family("range:dash", r"(?<![\w.–-])[0-9]+\s?[–-]\s?[0-9]+(?![\w–-])"),
    Family("fraction:mixed", rf"(?<![\w/.,])[0-9]{{1,9}} [1-9][0-9]?/[1-9][0-9]{{0,2}}(?![\w/])"),
    Family("fraction:mixed", rf"(?<![\w/.,])(?:[0-9]{{1,9}} ?)?{_VULGAR}", False),
    Family("measure:foot-and-inch", r"(?<![\w.'])[0-9]{1,2}' ?(?:1[01]|[0-9])\"(?!\w)"),
    Family("measure:pound-and-ounce", r"(?<![\w.])[0-9]+ ?lbs? [0-9]{1,2} ?oz(?!\w)"),
    Family("fraction:flexible", r"(?<![\w/.])[1-9][0-9]{0,3}/[1-9][0-9]{0,3}(?![\w/])"),
    Family("ordinal:flexible", r"(?<![\w.])[0-9]+(?:st|nd|rd|th)\b"),
    Family("number:plural", r"(?<![\w.'])[0-9]+'?s\b"),
    Family("measure:unit", rf"(?<![\w.]){_AMOUNT}\s?{_UNIT}(?!\w)"),
    Family("date:y", r"(?<![\w.,/-])(?:1[0-9]|20)[0-9]{2}(?![\w/-]|[.,][0-9])"),
    Family("number:decimal", r"(?<![\w.,-])-?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,18})?\.[0-9]+(?![\w]|\.[0-9])"),
    Family("number:cardinal", r"(?<![\w.,-])-?(?:[0-9]{1,3}(?:,[0-9]{3}){1,5}|[0-9]{1,18})(?!\w|[.,][0-9])"),
    Family("number:cardinal:citation", rf"{_FREE}[0-9]{{1,4}} (?:{'|'.join(r.replace('.', chr(92) + '.') for r in REPORTERS)})(?=\s[0-9]{{1,4}}{_END})"),
    Family("number:digits:spaced", rf"{_FREE}(?:[0-9] )+[0-9]{_END}"),
    Family("number:digits", r"(?<![\w.,-])[0-9]{19,}(?![\w])"),
    Family("identifier:serial", r"(?<![\w-])[A-Z]{1,4}-[0-9]+(?:-[A-Z0-9]+)*(?![\w-])"),
    Family("alnum:runs", r"(?<!\w)(?:[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+)[A-Za-z0-9]*(?!\w)"),
    Family("number:cardinal:roman", r"(?<=(?i:chapter|volume|act|part|bowl|king|louis|henry|charles) )[IVXLCDM]+(?!\w)", False),
    Family("abbreviation", r"(?<!\w)(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + ")", False),
    Family("letters:initial", r"(?<!\w)(?:\p{Lu}\.){2,}", False),
    Family("letters:hyphen-word", r"(?<![\w-])\p{Lu}{2,}-\p{Ll}+(?!\w)", False),
    Family("letters:run", r"(?<![\w-])\p{Lu}{2,}(?:'?s)?(?![\w-])", False),
    Family("symbol:cldr", "[" + "".join(SYMBOLS) + "]", False),
]

#: What a match of a family without digits holds, by family: one of these signs at least.
_SIGNS = [
    "://|[wW]{3}\\.", "[@#" + "".join(SYMBOLS) + "".join(spellout.VULGAR) + "]", "\\.[A-Za-z]", r"\p{Lu}[\p{Lu}.]", "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS),
    "(?i:chapter|volume|act|part|bowl|king|louis|henry|charles) [IVXLCDM]",
]
_SIGN = "|".join(_SIGNS)
READING = "array<struct<start:int,end:int,rank:int,type:string,surface:string>>"


def _passes(family: Family, hit: Column) -> Column:
    """Whether a match is what its family means: a number with a right check digit, an hour and minute that exist."""
    if family.test == "isbn":
        return isbn_valid(hit)
    if family.test == "clock":
        part = lambda i: F.regexp_extract(hit, r"([0-9]+)[^0-9]+([0-9]+)", i).cast("int")
        return (part(1) < 24) & (part(2) < 60)
    return F.lit(True)


def counts(docs: DataFrame, text: str, families: list[Family] | None = None) -> DataFrame:
    """type and n of all readings in a column, as candidates() finds them: sums of counts over one scan, no reading is built or sorted."""
    families = FAMILIES if families is None else families
    c = F.col(text)
    n = lambda f: F.regexp_count(c, F.lit(f.pattern)) if not f.test else F.when(c.rlike(f.pattern), F.size(spans(c, f))).otherwise(0)
    types = list(dict.fromkeys(f.type for f in families))
    sums = docs.agg(*[F.sum(sum((n(f) for f in families if f.type == t), F.lit(0)).cast("long")).alias(f"_{i}") for i, t in enumerate(types)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.col(f"_{i}").alias("n")) for i, t in enumerate(types)])).alias("x")).select("x.*").where("n > 0")


def spans(text: Column, family: Family, rank: int = 0) -> Column:
    """start, end, rank, type and surface of a family's matches in text."""
    hits, gaps = F.regexp_extract_all(text, F.lit(family.pattern), F.lit(0)), F.split(text, family.pattern, -1)
    pairs = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), hits.alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(family.type).alias("type"), x["hit"].alias("surface"))
        keep = x["hit"].isNotNull() & _passes(family, x["hit"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(READING).alias("found"))
    return F.aggregate(pairs, zero, step, lambda acc: acc["found"])


#: A domain of any ending; which endings exist is a list's to say.
_DOMAIN = Family("electronic:domain", r"(?<![A-Za-z0-9_.@-])(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9_-])", False)


def listed_domains(docs: DataFrame, text: str, endings: DataFrame) -> DataFrame:
    """docs' other columns, start, end, surface and ending of the domains in a column whose ending (after the last dot, in lower case)
    is one of endings (value), as sources.read_list gives them. The list may be of any size: it is joined, not written into an expression."""
    others = [c for c in docs.columns if c != text]
    found = docs.where(F.col(text).contains(".")).select(*others, F.explode(spans(F.col(text), _DOMAIN)).alias("_c"))
    rows = found.select(*others, F.col("_c.start").alias("start"), F.col("_c.end").alias("end"), F.col("_c.surface").alias("surface"), F.lower(F.substring_index("_c.surface", ".", -1)).alias("ending"))
    return rows.join(endings.select(F.lower("value").alias("ending")).distinct(), "ending").select(*others, "start", "end", "surface", "ending")


def candidates(text: Column, families: list[Family] | None = None) -> Column:
    """All readings of all families, in order of start, end and rank.

    One look for a digit, and one for a sign that some other family needs, spare plain prose the families' own expressions.
    """
    families = FAMILIES if families is None else families
    none = F.array().cast(READING)
    of = lambda digit: [F.when(text.rlike(f.pattern), spans(text, f, i)).otherwise(none) for i, f in enumerate(families) if f.digit == digit]
    found = [F.when(text.rlike(sign), F.concat(*own)).otherwise(none) for sign, own in ((_SIGN, of(False)), ("[0-9]", of(True))) if own]
    return F.array_sort(F.concat(*found)) if found else none
