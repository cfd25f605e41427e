"""Scalar expressions over genomic intervals: half-open [start, end), 0-based."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL, KEYS = "cell_type", ("cell_type", "chr")


def bare_chr(c: Column | str) -> Column:
    """The text after the last "chr"."""
    return F.element_at(F.split(c, "chr"), -1)


def with_chr(c: Column | str) -> Column:
    return F.concat(F.lit("chr"), c)


def middle_even(a: Column | str, b: Column | str) -> Column:
    """Midpoint, halves rounded to even."""
    return F.bround((F.col(a) + F.col(b)) / 2).cast("long")


def middle_floor(a: str, b: str) -> Column:
    return F.floor((F.col(a) + F.col(b)) / 2).cast("long")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """At least one base in common."""
    return (a_start < b_end) & (b_start < a_end)


def chromosome_rank(c: str = "chr") -> Column:
    """Sort key: numbers by value, X as 100, Y as 200, other names last."""
    return F.when(F.col(c) == "X", 100).when(F.col(c) == "Y", 200).otherwise(F.coalesce(F.expr(f"try_cast({c} as int)"), F.lit(1000)))


def windowed(radius: int) -> dict[str, Column]:
    """x_start, x_end, y_start and y_end around the centres x and y."""
    return {f"{s}_{e}": F.col(s) + d for s in "xy" for e, d in (("start", -radius), ("end", radius))}


def apart(radius: int) -> Column:
    """The windows around x and y do not touch."""
    return F.col("x") + radius < F.col("y") - radius


def anchor_name() -> Column:
    return F.concat_ws(":", "chr", "start", "end", CELL)


def strand_suffix(strand: str = "strand") -> Column:
    return F.when(F.col(strand) == "+", "_f").otherwise("_r")


def swap_strand(strand: str = "strand") -> Column:
    return F.translate(strand, "+-", "-+")


def zero_if_missing(c: str) -> Column:
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def row_sum(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in columns), F.lit(0))


def log10p1(c: str) -> Column:
    return F.log10(F.col(c) + 1)
