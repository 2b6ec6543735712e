"""Column expressions shared by the operators. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def keys_in_text(text: Column, pattern: str) -> Column:
    """Sorted distinct matches of ``pattern`` in the whole text; NULL text holds none."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)))


def ends_with_any(name: Column, suffixes: Sequence[str]) -> Column:
    return reduce(lambda left, right: left | right, [name.endswith(s) for s in suffixes])


def split_trimmed(text: Column, sep: str = ",", drop_empty: bool = True) -> Column:
    """Delimited text as an array of trimmed items."""
    items = F.transform(F.split(text, f"\\Q{sep}\\E"), lambda item: F.trim(item))
    return F.filter(items, lambda item: item != "") if drop_empty else items


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(float(MICROS_PER_DAY))


def flag(condition: Column) -> Column:
    """A condition as a boolean that is never NULL."""
    return F.coalesce(condition, F.lit(False))


def ratio(num: Column, den: Column) -> Column:
    """Quotient, NULL where it is undefined."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """Quotient for a positive denominator, else 0."""
    return F.when(den > 0, ratio(num, den)).otherwise(F.lit(0.0))


def weight_of(value: Column, weights: Mapping[str, float], default: float = 1.0) -> Column:
    """Look a value up in a fixed weight table; unknown and NULL values weigh ``default``."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(value, F.lit(""))), F.lit(default))


def era_of(year: Column, bounds: Sequence[tuple[int, str]], last: str) -> Column:
    """First era whose upper year is not exceeded; later years and NULL fall into ``last``."""
    label = F.lit(last)
    for upper, name in reversed(list(bounds)):
        label = F.when(year <= upper, F.lit(name)).otherwise(label)
    return label


def stars(p_value: Column) -> Column:
    """Significance marks of a p-value."""
    return (
        F.when(p_value < 0.001, "***").when(p_value < 0.01, "**").when(p_value < 0.05, "*").otherwise(F.lit(""))
    )


def group_of(name: Column, groups: Mapping[str, Sequence[str]], default: str) -> Column:
    """First group that lists the name."""
    label = F.lit(default)
    for group, members in reversed(list(groups.items())):
        label = F.when(name.isin(list(members)), F.lit(group)).otherwise(label)
    return label


def mentions(name: Column, words: Sequence[str]) -> Column:
    """Does the lower-cased name contain one of the words?"""
    return reduce(lambda left, right: left | right, [F.lower(name).contains(w) for w in words])


#: Parts of one in which fractions are added up.
UNITS = 1 << 40


def sum_of_fractions(value: Column) -> Column:
    """Sum of doubles in whole units of 2^-40, so that rows may come in any order and equal groups have equal sums."""
    return F.sum((value * F.lit(float(UNITS))).cast("bigint").cast("decimal(20,0)")).cast("double") / F.lit(float(UNITS))
