"""Expressions on text: normal forms, checks and the positions of pattern matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths are summed in blocks, so that positions cost n * BLOCK and not n * n steps.
SHIFT = 7
BLOCK = 1 << SHIFT


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once; a plain column would be inlined wherever it is used, also in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(value: Column) -> Column:
    """Trimmed, white space collapsed to one space; case stays."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def luhn(value: Column) -> Column:
    """13 to 19 digits (others are ignored) that pass the check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def json_inner(value: Column) -> Column:
    """The value as it stands between the quotes of a JSON string."""
    quoted = F.to_json(F.struct(value.alias("v")))
    return F.substring(quoted, 7, F.greatest(F.length(quoted) - 8, F.lit(0)))


def quoted(term: Column) -> Column:
    """A pattern that matches the term literally."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def prefix_sums(sizes: Column) -> Column:
    """Exclusive prefix sums of an array of ints, by way of block sums."""
    zero, add = F.lit(0), lambda a, x: a + x

    def of(sizes: Column) -> Column:
        blocks = F.sequence(zero, F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)), zero, add))

        def before(starts: Column) -> Column:
            return F.transform(sizes, lambda _, i: F.get(starts, F.shiftright(i.cast("int"), SHIFT)) + F.aggregate(F.slice(sizes, i - i % BLOCK + 1, i % BLOCK), zero, add))

        return bound(sums, lambda sums: bound(F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), zero, add)), before))

    return F.when(F.size(sizes) > 0, bound(sizes, of))


def exploded(df: DataFrame, array: str, name: str, *keep: str) -> DataFrame:
    """``keep`` and a row for every element of ``array``, as ``name``.

    A plain explode would let the optimizer derive a filter on the array's size and push it below the projections that
    compute the array, which would then be computed twice and inlined into one another.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def settled(df: DataFrame) -> DataFrame:
    """The same rows, such that no filter above is pushed into the projections below (for results that are costly to compute)."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def occurrences(text: Column, needle: Column, flags: str = "") -> Column:
    """Starts of all non-overlapping occurrences of a literal needle (few are expected)."""
    pieces = F.split(text, F.concat(F.lit(flags), quoted(needle)), -1)

    def starts(pieces: Column) -> Column:
        return F.transform(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1),
            lambda _, i: F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda a, p: a + F.length(p)) + i * F.length(needle),
        )

    return bound(pieces, starts)
