"""Numbers and rows as text, checks and small measures as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a missing number.
DASH = "–"


def fixed(x: Column, digits: int = 2, signed: bool = False) -> Column:
    """A number with so many digits, with its sign if asked; a dash for null and NaN."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), F.format_string(f"%{'+' if signed else ''}.{digits}f", x.cast("double"))).otherwise(DASH)


def interval(mean: Column, low: Column, high: Column, digits: int = 2) -> Column:
    """``mean [low, high]``."""
    return F.when(mean.isNotNull(), F.concat(fixed(mean, digits), F.lit(" ["), fixed(low, digits), F.lit(", "), fixed(high, digits), F.lit("]"))).otherwise(DASH)


def table_row(*cells: Column) -> Column:
    """A row of a Markdown table; bars inside cells are escaped."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(F.coalesce(c.cast("string"), F.lit(DASH)), F.lit("|"), F.lit("\\|")) for c in cells)), F.lit(" |"))


def solid_chars(text: Column) -> Column:
    """Characters besides spaces and newlines."""
    return F.length(F.translate(text, " \n", ""))


def class_of_number(number: Column, classes: Sequence[str], cycle: int) -> Column:
    """The class of a page by its number: each cycle runs through the classes in equal parts."""
    return F.element_at(F.array(*map(F.lit, classes)), (F.pmod(number, F.lit(cycle)) / (cycle // len(classes))).cast("int") + 1)


def clipped_box(xs: Column, ys: Column, margin: Column, width: Column, height: Column) -> Column:
    """The bounding box of corner points with a margin, inside a picture: whole numbers, outwards."""
    return F.struct(
        F.greatest(F.lit(0), F.floor(F.array_min(xs) - margin)).cast("bigint").alias("left"), F.greatest(F.lit(0), F.floor(F.array_min(ys) - margin)).cast("bigint").alias("top"),
        F.least(width, F.ceil(F.array_max(xs) + margin)).cast("bigint").alias("right"), F.least(height, F.ceil(F.array_max(ys) + margin)).cast("bigint").alias("bottom"),
    )


def shoelace(xs: Column, ys: Column) -> Column:
    """The area of a polygon."""
    n = F.size(xs)
    turns = F.transform(F.sequence(F.lit(0), n - 1), lambda i: xs[i] * ys[F.pmod(i + 1, n).cast("int")] - xs[F.pmod(i + 1, n).cast("int")] * ys[i])
    return F.abs(F.aggregate(turns, F.lit(0.0), lambda s, v: s + v)) / 2


def steps_within(budget: Column, step: int, least: int) -> Column:
    """A budget rounded down to whole steps, but so much at least."""
    return F.greatest(F.floor(budget / step) * step, F.lit(least)).cast("bigint")
