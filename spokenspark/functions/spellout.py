"""English words for values, as columns. Every function takes and gives columns and keeps null as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ["", " thousand", " million", " billion", " trillion", " quadrillion", " quintillion"]
ORDINAL_ENDS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
MONTHS = "January February March April May June July August September October November December".split()
WEEKDAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
BELOW_100 = ONES + [t + (f"-{ONES[i]}" if i else "") for t in TENS for i in range(10)]
#: Units by their written symbol: one and several.
UNITS = {
    "kg": ("kilogram", "kilograms"), "g": ("gram", "grams"), "mg": ("milligram", "milligrams"), "km": ("kilometer", "kilometers"), "m": ("meter", "meters"), "cm": ("centimeter", "centimeters"),
    "mm": ("millimeter", "millimeters"), "mi": ("mile", "miles"), "ft": ("foot", "feet"), "lb": ("pound", "pounds"), "oz": ("ounce", "ounces"), "l": ("liter", "liters"), "ml": ("milliliter", "milliliters"),
    "s": ("second", "seconds"), "min": ("minute", "minutes"), "h": ("hour", "hours"), "mph": ("mile per hour", "miles per hour"), "GB": ("gigabyte", "gigabytes"), "MB": ("megabyte", "megabytes"),
    "KB": ("kilobyte", "kilobytes"), "TB": ("terabyte", "terabytes"), "yd": ("yard", "yards"), "gal": ("gallon", "gallons"), "ha": ("hectare", "hectares"), "ms": ("millisecond", "milliseconds"),
    "Hz": ("hertz", "hertz"), "kHz": ("kilohertz", "kilohertz"), "MHz": ("megahertz", "megahertz"), "GHz": ("gigahertz", "gigahertz"), "kW": ("kilowatt", "kilowatts"), "MW": ("megawatt", "megawatts"),
    "kWh": ("kilowatt-hour", "kilowatt-hours"), "kPa": ("kilopascal", "kilopascals"), "psi": ("pound per square inch", "pounds per square inch"), "kcal": ("kilocalorie", "kilocalories"),
    "km/h": ("kilometer per hour", "kilometers per hour"), "m/s": ("meter per second", "meters per second"), "°C": ("degree Celsius", "degrees Celsius"), "°F": ("degree Fahrenheit", "degrees Fahrenheit"),
    "m²": ("square meter", "square meters"), "km²": ("square kilometer", "square kilometers"), "m³": ("cubic meter", "cubic meters"), "sq ft": ("square foot", "square feet"), "sq mi": ("square mile", "square miles"),
}
#: Currencies by their sign: major and minor unit, one and several.
CURRENCIES = {
    "$": ("dollar", "dollars", "cent", "cents"), "€": ("euro", "euros", "cent", "cents"), "£": ("pound", "pounds", "penny", "pence"), "¥": ("yen", "yen", "", ""),
    "USD": ("dollar", "dollars", "cent", "cents"), "EUR": ("euro", "euros", "cent", "cents"), "GBP": ("pound", "pounds", "penny", "pence"), "JPY": ("yen", "yen", "", ""), "CNY": ("yuan", "yuan", "fen", "fen"),
    "INR": ("rupee", "rupees", "paisa", "paise"), "CAD": ("Canadian dollar", "Canadian dollars", "cent", "cents"), "AUD": ("Australian dollar", "Australian dollars", "cent", "cents"), "KRW": ("won", "won", "", ""), "RUB": ("ruble", "rubles", "kopeck", "kopecks"),
}
#: Currency names in texts, one and several.
CURRENCY_NAMES = ["dollar", "dollars", "euro", "euros", "pound", "pounds", "yen", "yuan", "rupee", "rupees", "won", "ruble", "rubles"]
#: Letters of compact numbers, and the values of signs for fractions.
COMPACT = {"K": "thousand", "M": "million", "B": "billion", "T": "trillion"}
VULGAR = {"½": "1/2", "⅓": "1/3", "⅔": "2/3", "¼": "1/4", "¾": "3/4", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}


def _pick(words: list[str], i: Column) -> Column:
    return F.get(F.split(F.lit(",".join(words)), ","), i.cast("int"))


def below_1000(n: Column) -> Column:
    """Words of 0 to 999; nothing for 0."""
    n = n.cast("int")
    hundreds = F.when(n >= 100, F.concat(_pick(ONES, F.floor(n / 100)), F.lit(" hundred")))
    return F.concat_ws(" ", hundreds, F.when(n % 100 > 0, _pick(BELOW_100, n % 100)))


def cardinal(n: Column) -> Column:
    """1234 is one thousand two hundred thirty-four; a negative number starts with minus. Any 64-bit number but the least."""
    n = n.cast("long")
    written = F.lpad(F.abs(n).cast("string"), 21, "0")
    scales = F.split(F.lit(",".join(reversed(SCALES))), ",")
    groups = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: written.substr(3 * k + 1, F.lit(3)).cast("int"))
    words = F.array_join(F.transform(groups, lambda g, k: F.when(g > 0, F.concat(below_1000(g), F.get(scales, k)))), " ")
    return F.when(n < 0, F.concat(F.lit("minus "), words)).when(n == 0, F.lit("zero")).when(n > 0, words)


def _ordinal_ending(words: Column) -> Column:
    head, last = F.regexp_extract(words, r"\A(.*?)([a-z]+)\z", 1), F.regexp_extract(words, r"\A(.*?)([a-z]+)\z", 2)
    irregular = F.element_at(F.create_map(*[F.lit(x) for kv in ORDINAL_ENDS.items() for x in kv]), last)
    return F.concat(head, F.coalesce(irregular, F.when(last.endswith("y"), F.concat(F.regexp_replace(last, "y$", ""), F.lit("ieth"))).otherwise(F.concat(last, F.lit("th")))))


def ordinal(n: Column) -> Column:
    """21 is twenty-first."""
    return _ordinal_ending(cardinal(n))


def digits(text: Column, zero: str = "o") -> Column:
    """Each digit of a text by itself; other characters are left out."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[0-9]"), F.lit(0)), lambda d: F.when(d == "0", F.lit(zero)).otherwise(_pick(ONES, d))), " ")


def year(n: Column) -> Column:
    """1908 is nineteen o eight, 2000 two thousand, 2005 two thousand five, 1900 nineteen hundred."""
    n = n.cast("int")
    high, low = F.floor(n / 100), n % 100
    pair = F.concat_ws(" ", cardinal(high), F.when(low == 0, F.lit("hundred")).when(low < 10, F.concat(F.lit("o "), cardinal(low))).otherwise(cardinal(low)))
    return F.when((n < 1000) | (n > 9999) | ((high % 10 == 0) & (low < 10)), cardinal(n)).otherwise(pair)


def decimal(text: Column) -> Column:
    """-3.10 is minus three point one o; .5 is point five; grouping commas are left out."""
    bare = F.regexp_replace(text, "[,+]", "")
    sign = F.when(bare.startswith("-"), F.lit("minus"))
    whole, part = F.regexp_extract(bare, r"\A-?([0-9]*)", 1), F.regexp_extract(bare, r"\.([0-9]+)\z", 1)
    return F.concat_ws(" ", sign, F.when(whole != "", cardinal(whole.cast("long"))), F.when(part != "", F.concat(F.lit("point "), digits(part))))


def percent(text: Column) -> Column:
    return F.concat(decimal(F.regexp_replace(text, r"\s*%$", "")), F.lit(" percent"))


def fraction(numerator: Column, denominator: Column) -> Column:
    """1/2 is one half, 3/4 three quarters, 2/5 two fifths, 7/100 seven hundredths."""
    n, d = numerator.cast("long"), denominator.cast("long")
    name = F.when(d == 2, F.when(n == 1, "half").otherwise("halves")).when(d == 4, F.when(n == 1, "quarter").otherwise("quarters"))
    return F.when(d == 1, F.concat(cardinal(n), F.lit(" over one"))).otherwise(F.concat_ws(" ", cardinal(n), F.coalesce(name, F.concat(ordinal(d), F.when(n == 1, "").otherwise("s")))))


def money(amount: Column, sign: str | Column = "$") -> Column:
    """12.5 with $ is twelve dollars and fifty cents; a decimal or number, rounded to minor units."""
    sign = F.lit(sign) if isinstance(sign, str) else sign
    names = F.split(F.element_at(F.create_map(*[F.lit(x) for k, v in CURRENCIES.items() for x in (k, ",".join(v))]), sign), ",")
    minor = F.round(F.abs(amount).cast("decimal(24,4)") * 100, 0).cast("long")
    parts = F.array(F.call_function("div", minor, F.lit(100).cast("long")), minor % 100)
    shown = lambda x, i: F.when(i == 0, (x > 0) | (minor % 100 == 0)).otherwise(x > 0)
    said = F.transform(parts, lambda x, i: F.when(shown(x, i), F.concat(cardinal(x), F.lit(" "), F.get(names, 2 * i + F.when(x == 1, 0).otherwise(1)))))
    return F.concat_ws(" ", F.when(amount < 0, "minus"), F.array_join(said, " and "))


def measure(amount: Column, unit: Column) -> Column:
    """5 and kg is five kilograms; null for a unit that isn't known."""
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v[i])]), unit)
    return F.concat(decimal(amount), F.lit(" "), F.when(amount.isin("1", "-1"), of(0)).otherwise(of(1)))


def date(y: Column, m: Column, d: Column, day_first: bool = False) -> Column:
    """March third twenty twenty-one, or the third of March; a missing part is left out."""
    month = _pick([x.lower() for x in MONTHS], m - 1)
    parts = (F.when(d.isNotNull(), F.concat(F.lit("the "), ordinal(d), F.lit(" of"))), month) if day_first else (month, F.when(d.isNotNull(), ordinal(d)))
    return F.concat_ws(" ", *parts, F.when(y.isNotNull(), year(y)))


def time(h: Column, m: Column) -> Column:
    """5:30 is five thirty, 16:09 sixteen o nine, 5:00 five o'clock, 14:00 fourteen hundred."""
    tail = F.when((m == 0) & h.between(1, 12), "o'clock").when(m == 0, "hundred").when(m < 10, F.concat(F.lit("o "), cardinal(m))).otherwise(cardinal(m))
    return F.concat_ws(" ", cardinal(h), tail)


def roman(text: Column) -> Column:
    """The number that a Roman numeral writes; null for other texts."""
    value = F.create_map(*[F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv])
    values = F.transform(F.split(text, ""), lambda c: F.element_at(value, c))
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(text.rlike(r"\A(?=[IVXLCDM])M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})\z"), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def plural(words: Column) -> Column:
    """nineteen ninety is nineteen nineties, six sixes."""
    return F.when(words.endswith("y"), F.concat(F.regexp_replace(words, "y$", ""), F.lit("ies"))).when(words.rlike("(x|s)$"), F.concat(words, F.lit("es"))).otherwise(F.concat(words, F.lit("s")))


def grouped(text: Column) -> Column:
    """Telephone numbers and grouped identifiers: digit by digit, groups parted by `sil`; a plus is spoken, X is a letter."""
    groups = F.filter(F.split(F.regexp_replace(text, r"[^0-9Xx+]+", " "), " "), lambda g: g != "")
    zero = F.when(text.startswith("+"), "zero").otherwise("o")
    name = lambda c: F.when(c == "0", zero).when(c == "+", "plus").when(F.lower(c) == "x", "x").otherwise(_pick(ONES, c))
    return F.array_join(F.transform(groups, lambda g: F.array_join(F.transform(F.filter(F.split(g, ""), lambda c: c != ""), name), " ")), " sil ")


def letters(text: Column) -> Column:
    """Letters by name and digits one by one; other characters are left out."""
    kept = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}0-9]"), F.lit(0))
    return F.array_join(F.transform(kept, lambda c: F.when(c.rlike("[0-9]"), F.when(c == "0", "o").otherwise(_pick(ONES, c))).otherwise(c)), " ")


def version(text: Column) -> Column:
    """v2.3.1 is v two point three point one."""
    parts = F.split(F.regexp_replace(text, "^[vV]", ""), r"\.")
    return F.concat_ws(" ", F.when(text.rlike("^[vV]"), "v"), F.array_join(F.transform(parts, lambda p: cardinal(p.cast("long"))), " point "))


def ip_address(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\."), lambda p: digits(p)), " dot ")


def electronic(text: Column) -> Column:
    """URLs, addresses and domains: words as they are, capitals by letter, digits one by one, signs by name."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?<=\.)[a-z]{2}$|[A-Z]{2,}|[A-Za-z]+|[0-9]|[^A-Za-z0-9]"), F.lit(0))
    pieces = F.transform(pieces, lambda p, i: F.when((i == F.size(pieces) - 1) & p.rlike("^[a-z]{2}$"), F.upper(p)).otherwise(p))
    signs = F.create_map(*[F.lit(x) for kv in {".": "dot", "/": "slash", ":": "colon", "@": "at", "-": "dash", "_": "underscore", "?": "question mark", "=": "equals", "&": "and", "#": "hash", "%": "percent", "+": "plus", "~": "tilde"}.items() for x in kv])
    spoken = F.transform(pieces, lambda p: F.when(p.rlike("^[A-Z]{2,}$"), letters(p)).when(p.rlike("^[A-Za-z]+$"), F.lower(p)).when(p.rlike("^[0-9]$"), digits(p)).otherwise(F.coalesce(F.element_at(signs, p), p)))
    return F.array_join(spoken, " ")


def scientific(text: Column) -> Column:
    """6.02e23 is six point o two times ten to the twenty-third."""
    plain = F.translate(text, "⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
    found = lambda i: F.regexp_extract(plain, r"\A(-?[0-9]+(?:\.[0-9]+)?)\s*(?:[eE]|[×x]\s*10\^?)([+-]?[0-9]+)\z", i)
    power = found(2).cast("long")
    return F.concat(decimal(found(1)), F.lit(" times ten to the "), F.when(power < 0, "minus ").otherwise(""), ordinal(F.abs(power)))


def _lookup(words: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), key)


def compact(text: Column) -> Column:
    """3.5 million and 3.5M are three point five million."""
    word, letter = F.regexp_extract(text, r"([a-z]+)\z", 1), F.regexp_extract(text, r"([A-Z])\z", 1)
    return F.concat_ws(" ", decimal(F.regexp_replace(text, r"[^0-9.,-]", "")), F.when(word != "", word).otherwise(_lookup(COMPACT, letter)))


def compact_money(text: Column) -> Column:
    """$3.5 million is three point five million dollars."""
    names = _lookup({k: v[1] for k, v in CURRENCIES.items()}, F.substring(text, 1, 1))
    return F.concat_ws(" ", compact(F.regexp_replace(text, r"\A[$€£¥]\s?", "")), names)


def named_money(text: Column) -> Column:
    """USD 12.50 and 12.50 USD are twelve dollars and fifty cents; 5 euros is five euros."""
    code = F.regexp_extract(text, r"([A-Z]{3})", 1)
    amount = F.regexp_replace(text, r"[^0-9.-]", "")
    return F.when(code != "", money(amount.cast("decimal(24,4)"), code)).otherwise(F.concat_ws(" ", decimal(amount), F.regexp_extract(text, r"([a-z]+)\z", 1)))


def mixed_fraction(text: Column) -> Column:
    """1 1/2 and 1½ are one and a half, 2 3/4 two and three quarters, ½ one half."""
    signs = "".join(VULGAR)
    of = lambda written, i: F.translate(F.regexp_extract(text, written, 1), signs, "".join(v.split("/")[i] for v in VULGAR.values())).cast("long")
    whole = F.regexp_extract(text, rf"\A([0-9]+)(?: [0-9]| ?[{signs}])", 1)
    half = F.when((whole != "") & text.rlike(" 1/[24]$|[½¼]$"), F.when(text.rlike("[2½]$"), "a half").otherwise("a quarter"))
    return F.concat_ws(" and ", F.when(whole != "", cardinal(whole.cast("long"))), F.coalesce(half, fraction(of(rf"([0-9]+(?=/)|[{signs}])", 0), of(rf"((?<=/)[0-9]+|[{signs}])", 1))))


def duration(text: Column) -> Column:
    """31:18.85 is thirty-one minutes eighteen point eight five seconds, 1:02:03 one hour two minutes three seconds."""
    fields = F.split(text, ":")
    hours, minutes, seconds = F.when(F.size(fields) == 3, F.get(fields, F.lit(0)).cast("long")), F.get(fields, F.size(fields) - 2).cast("long"), F.get(fields, F.size(fields) - 1)
    count = lambda n, name: F.concat(cardinal(n), F.when(n == 1, F.lit(f" {name}")).otherwise(f" {name}s"))
    short = F.regexp_replace(seconds, r"\A0([0-9])", "$1")
    return F.concat_ws(" ", count(hours, "hour"), count(minutes, "minute"), F.concat(decimal(short), F.when(short == "1", " second").otherwise(" seconds")))


def mixed_measure(text: Column) -> Column:
    """5'10" is five feet ten inches, 3 lb 4 oz three pounds four ounces."""
    first, second = F.regexp_extract(text, r"\A([0-9]+)", 1).cast("long"), F.regexp_extract(text, r"[^0-9.]([0-9]+)[^0-9]*\z", 1).cast("long")
    pounds = text.contains("lb")
    big = F.when(pounds, F.when(first == 1, "pound").otherwise("pounds")).otherwise(F.when(first == 1, "foot").otherwise("feet"))
    small = F.when(pounds, F.when(second == 1, "ounce").otherwise("ounces")).otherwise(F.when(second == 1, "inch").otherwise("inches"))
    return F.concat_ws(" ", cardinal(first), big, cardinal(second), small)


def short_year(n: Column) -> Column:
    """Two digits of a year: 94 is ninety-four, 07 o seven, 00 o o."""
    n = n.cast("int")
    return F.when(n == 0, "o o").when(n < 10, F.concat(F.lit("o "), cardinal(n))).otherwise(cardinal(n))


def numeric_date(text: Column) -> Column:
    """Month, day and year: 3/4/2021 is march fourth twenty twenty-one, 3/4/07 march fourth o seven."""
    of = lambda i: F.get(F.split(text, "/"), F.lit(i)).cast("int")
    y = F.when(F.length(F.get(F.split(text, "/"), F.lit(2))) == 2, short_year(of(2))).otherwise(year(of(2)))
    return F.concat_ws(" ", date(F.lit(None).cast("int"), of(0), of(1)), y)


def quarter(text: Column) -> Column:
    """Q3 2021 is third quarter twenty twenty-one."""
    y = F.nullif(F.regexp_extract(text, r"([0-9]{4})\z", 1), F.lit("")).cast("int")
    return F.concat_ws(" ", ordinal(F.regexp_extract(text, r"\AQ([1-4])", 1).cast("int")), F.lit("quarter"), F.when(y.isNotNull(), year(y)))


def date_interval(text: Column) -> Column:
    """May 3–5, 2020 is may third to fifth twenty twenty; the month is named once."""
    name = F.lower(F.substring(F.regexp_extract(text, r"\A([A-Za-z]+)", 1), 1, 3))
    month = F.array_position(F.array(*[F.lit(x[:3].lower()) for x in MONTHS]), name).cast("int")
    of = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    y = of(r", ([0-9]{4})\z")
    return F.concat_ws(" ", date(F.lit(None).cast("int"), month, of(r"([0-9]{1,2}) ?[–-]")), F.lit("to"), ordinal(of(r"[–-] ?([0-9]{1,2})")), F.when(y.isNotNull(), year(y)))


def relative_date(text: Column) -> Column:
    """3 days ago is three days ago, in 2 weeks in two weeks."""
    return F.concat(F.regexp_extract(text, r"\A([^0-9]*)", 1), cardinal(F.regexp_extract(text, "([0-9]+)", 1).cast("long")), F.regexp_extract(text, r"[0-9]( [a-z ]+)\z", 1))


def clock_seconds(text: Column) -> Column:
    """5:30:01 PM is five thirty and one second p m."""
    of = lambda i: F.regexp_extract(text, r"\A([0-9]+):([0-9]+):([0-9]+)", i).cast("int")
    half = F.when(text.rlike("(?i)a"), "a m").otherwise("p m")
    return F.concat_ws(" ", time(of(1), of(2)), F.lit("and"), cardinal(of(3)), F.when(of(3) == 1, "second").otherwise("seconds"), half)
