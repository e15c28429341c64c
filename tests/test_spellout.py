import pytest
from pyspark.sql import functions as F

from spokenspark.functions import spellout as say
from spokenspark.functions import text as tf

CASES = [
    (lambda: say.cardinal(F.lit(0)), "zero"), (lambda: say.cardinal(F.lit(-19)), "minus nineteen"), (lambda: say.cardinal(F.lit(1_000_001)), "one million one"),
    (lambda: say.cardinal(F.lit(None).cast("long")), None), (lambda: say.cardinal(F.lit(58)), "fifty-eight"),
    (lambda: say.ordinal(F.lit(21)), "twenty-first"), (lambda: say.ordinal(F.lit(12)), "twelfth"), (lambda: say.ordinal(F.lit(40)), "fortieth"), (lambda: say.ordinal(F.lit(100)), "one hundredth"),
    (lambda: say.year(F.lit(1908)), "nineteen o eight"), (lambda: say.year(F.lit(2000)), "two thousand"), (lambda: say.year(F.lit(1900)), "nineteen hundred"), (lambda: say.year(F.lit(2011)), "twenty eleven"),
    (lambda: say.decimal(F.lit("3.00")), "three point o o"), (lambda: say.decimal(F.lit(".1")), "point one"), (lambda: say.decimal(F.lit("1,234.5")), "one thousand two hundred thirty-four point five"),
    (lambda: say.fraction(F.lit(1), F.lit(2)), "one half"), (lambda: say.fraction(F.lit(3), F.lit(4)), "three quarters"), (lambda: say.fraction(F.lit(2), F.lit(5)), "two fifths"),
    (lambda: say.money(F.lit(12.5)), "twelve dollars and fifty cents"), (lambda: say.money(F.lit(1.01)), "one dollar and one cent"), (lambda: say.money(F.lit(0.0)), "zero dollars"), (lambda: say.money(F.lit(-3), "€"), "minus three euros"),
    (lambda: say.measure(F.lit("5"), F.lit("kg")), "five kilograms"), (lambda: say.measure(F.lit("1"), F.lit("ft")), "one foot"),
    (lambda: say.time(F.lit(5), F.lit(30)), "five thirty"), (lambda: say.time(F.lit(16), F.lit(9)), "sixteen o nine"), (lambda: say.time(F.lit(5), F.lit(0)), "five o'clock"),
    (lambda: say.date(F.lit(2010), F.lit(10), F.lit(15)), "october fifteenth twenty ten"), (lambda: say.date(F.lit(2011), F.lit(7), F.lit(25), day_first=True), "the twenty-fifth of july twenty eleven"),
    (lambda: say.roman(F.lit("LVIII")).cast("string"), "58"), (lambda: say.roman(F.lit("IIII")).cast("string"), None),
    (lambda: say.grouped(F.lit("+44 20 7946 0958")), "plus four four sil two zero sil seven nine four six sil zero nine five eight"),
    (lambda: say.grouped(F.lit("(650) 696-1060")), "six five o sil six nine six sil one o six o"), (lambda: say.grouped(F.lit("0-8044-2957-X")), "o sil eight o four four sil two nine five seven sil x"),
    (lambda: say.version(F.lit("v2.3.1")), "v two point three point one"), (lambda: say.ip_address(F.lit("192.168.1.1")), "one nine two dot one six eight dot one dot one"),
    (lambda: say.electronic(F.lit("boston.com")), "boston dot com"), (lambda: say.electronic(F.lit("BBC.co.uk")), "b b c dot co dot u k"), (lambda: say.letters(F.lit("AB-123-CD")), "a b one two three c d"),
    (lambda: say.plural(say.year(F.lit(1990))), "nineteen nineties"), (lambda: say.scientific(F.lit("1.5×10^6")), "one point five times ten to the sixth"),
    (lambda: tf.shape(F.lit("3/24 €12 ab1 É")), "N/N ¤N AN A"), (lambda: tf.shape(F.lit("Q")), "<Lu>"), (lambda: tf.width_shape(F.lit("212-555")), "N3-N3"), (lambda: tf.consonant_vowel(F.lit("Hello")), "cvccv"),
    (lambda: tf.isbn_valid(F.lit("0306406152")).cast("string"), "true"), (lambda: tf.isbn_valid(F.lit("0306406153")).cast("string"), "false"), (lambda: tf.isbn_valid(F.lit("978-0-306-40615-7")).cast("string"), "true"),
    (lambda: tf.normal_spoken(F.lit("Hi, there!")), "hi there"), (lambda: tf.folded(F.lit("５％ “a”–b")), "5% \"a\"–b"), (lambda: tf.folded(F.lit("1，2，3 a，b 6′ 7″")), "1,2,3 a，b 6′ 7″"),
    (lambda: tf.folded(F.lit("４０ｋｍ ＋３ ｋｍ")), "40km +3 ｋｍ"), (lambda: tf.refusal(F.lit("a\0b")), "nul"), (lambda: tf.refusal(F.lit("plain")), None),
]


def test_values(spark):
    got = spark.range(1).select(*[f().alias(f"c{i}") for i, (f, _) in enumerate(CASES)]).first()
    wrong = {i: (got[i], want) for i, (_, want) in enumerate(CASES) if got[i] != want}
    assert not wrong
