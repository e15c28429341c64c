"""Arrays in columns: values that are computed once, running sums and maxima, matches with their places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def part(array: Column, first: Column, last: Column) -> Column:
    """The places first to last of an array (a column or a bound value), in time of their number (slice() goes through the whole)."""
    return F.transform(F.sequence(first, last), lambda i: F.get(array, i))


def running(numbers: Column, join: Callable[[Column, Column], Column], block: int = 64, kind: str = "int") -> Column:
    """An array of ints (or of another kind) with each place joined to all before it. Blocks go first and what came before them is joined after,
    so that no growing array is copied for every place."""
    last = lambda a: F.get(a, F.size(a) - 1)
    none = F.array().cast(f"array<{kind}>")
    within = lambda a: F.aggregate(a, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(join(last(acc), x)))))

    def shifted(parts: Column) -> Column:
        ends = within(F.transform(parts, last))
        return bound(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(bound(F.get(e, i - 1), lambda at: F.transform(p, lambda x: join(at, x)))))))


    def summed(whole: Column) -> Column:
        n = F.size(whole)
        blocks = F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / block).cast("int"))
        return F.when(n > 0, bound(F.transform(blocks, lambda k: within(part(whole, k * block, F.least((k + 1) * block, n) - 1))), shifted)).otherwise(none)

    return bound(numbers, summed)


def running_sums(numbers: Column) -> Column:
    return running(numbers, lambda a, b: a + b)


def running_max(numbers: Column) -> Column:
    return running(numbers, lambda a, b: F.greatest(a, b))


def matches(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and hit of a pattern's matches in text, in order."""

    def of(x: Column) -> Column:
        sizes = F.zip_with(x["gaps"], x["hits"], lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
        ends = F.slice(running_sums(sizes), F.lit(1), F.size(x["hits"]))
        return F.zip_with(ends, x["hits"], lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))

    return bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), of)
