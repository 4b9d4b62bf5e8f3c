"""Arrays of numbers: PSNR, tile starts, ordered folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PSNR_CAP = 100.0


def mse(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def psnr(error: Column, peak: float = 255.0) -> Column:
    """From the mean squared error; identical inputs have the cap."""
    return F.when(error <= 0, PSNR_CAP).otherwise(F.least(F.lit(PSNR_CAP), 10 * F.log10(F.lit(peak * peak) / error)))


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Starts of tiles that cover ``[0, length)``, the last flush with the end."""
    if overlap >= tile:
        raise ValueError("overlap must be less than the tile")
    step = tile - overlap
    inner = F.transform(F.sequence(F.lit(0), F.ceil((length - tile) / step).cast("bigint") - 1), lambda i: i * step)
    return F.when(length <= tile, F.array(F.lit(0).cast("bigint"))).otherwise(F.concat(inner, F.array((length - tile).cast("bigint"))))


def reading_order(boxes: Column) -> Column:
    """Row number of each box of an array of structs with ``y0, y1, x0``, and a row's order: rows as arrays, left to right.

    Boxes come sorted by vertical centre; a box joins the current row if its centre lies within the first box of that row.
    """
    start = F.struct(F.filter(boxes, lambda b: F.lit(False)).alias("row"), F.array(F.filter(boxes, lambda b: F.lit(False))).alias("rows"))

    def step(state: Column, box: Column) -> Column:
        first = state["row"][0]
        centre = (box["y0"] + box["y1"]) / 2
        joins = (F.size(state["row"]) > 0) & (centre >= first["y0"]) & (centre <= first["y1"])
        return F.struct(
            F.when(joins, F.concat(state["row"], F.array(box))).otherwise(F.array(box)).alias("row"),
            F.when(joins | (F.size(state["row"]) == 0), state["rows"]).otherwise(F.concat(state["rows"], F.array(state["row"]))).alias("rows"),
        )

    done = F.aggregate(boxes, start, step, lambda s: F.concat(s["rows"], F.array(s["row"])))
    return F.filter(done, lambda r: F.size(r) > 0)


def wrapped_lines(words: Column, width: int) -> Column:
    """Number of lines of a greedy wrap; a word wider than the line takes as many lines as it needs."""

    def step(s: Column, w: Column) -> Column:
        n = F.length(w)
        fits = (s["used"] > 0) & (s["used"] + 1 + n <= width)
        rest = F.when(n > width, n - F.floor((n - 1) / width) * width).otherwise(n)
        return F.struct(
            F.when(fits, s["used"] + 1 + n).otherwise(rest).cast("bigint").alias("used"),
            F.when(fits, s["lines"]).otherwise(s["lines"] + F.ceil(n / width)).cast("bigint").alias("lines"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("lines"))
    return F.aggregate(F.filter(words, lambda w: w != ""), start, step, lambda s: s["lines"])


def warm_average(values: Column, decay: float) -> Column:
    """Exponential moving average along an array, with decay ``min(decay, (1 + n) / (10 + n))`` at step n."""

    def step(s: Column, v: Column) -> Column:
        n = s["n"] + 1
        d = F.least(F.lit(decay), (1 + n) / (10 + n))
        return F.struct(n.alias("n"), F.when(s["n"] == 0, v).otherwise(d * s["x"] + (1 - d) * v).alias("x"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("x")), step, lambda s: s["x"])


def schedule(step: Column, warmup: int, total: int, least: float) -> Column:
    """Linear warm-up to 1, then a cosine down to ``least``."""
    t = F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup)))
    return F.when(step < warmup, (step + 1) / float(max(1, warmup))).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(t * 3.141592653589793)))
