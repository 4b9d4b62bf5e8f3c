"""Columns on quadrilaterals: arrays of four ``struct<x, y>`` corners, in order around the shape."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quad(values: Column, first: int = 0) -> Column:
    """The quad whose corners are eight numbers of an array, ``x`` and ``y`` by turns."""
    number = lambda i: F.get(values, F.lit(first + i)).cast("double")
    return F.array(*(F.struct(number(2 * i).alias("x"), number(2 * i + 1).alias("y")) for i in range(4)))


def apart(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def _corner(corners: Column, i: Column) -> Column:
    return F.get(corners, F.pmod(i, F.lit(4)))


def sides(corners: Column) -> Column:
    """The length of each side, from each corner to the next."""
    return F.transform(corners, lambda p, i: apart(p, _corner(corners, i + 1)))


def bends(corners: Column) -> Column:
    """At each corner the cross product of the sides that meet there: its sign says to which side the outline turns."""

    def bend(p: Column, i: Column) -> Column:
        before, after = _corner(corners, i + 3), _corner(corners, i + 1)
        return (p["x"] - before["x"]) * (after["y"] - p["y"]) - (p["y"] - before["y"]) * (after["x"] - p["x"])

    return F.transform(corners, bend)


def convex(corners: Column) -> Column:
    """Whether the outline turns to the same side at all corners."""
    return F.forall(bends(corners), lambda b: b > 0) | F.forall(bends(corners), lambda b: b < 0)


def inside(corners: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether all corners lie in a box, its edges included."""
    return F.forall(corners, lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1))


def worst_corner(found: Column, true: Column) -> Column:
    """The largest distance between corners of the same place."""
    return F.array_max(F.zip_with(found, true, apart))


def detected(found: Column, true: Column, diagonal: Column, share: float) -> Column:
    """Whether there is a quad at all, whose worst corner is off by less than a share of the diagonal."""
    return F.coalesce(worst_corner(found, true) < diagonal * share, F.lit(False))


def snapped(ratio: Column, known: Sequence[float], tolerance: float) -> Column:
    """The known ratio nearest by logarithm, if it is within the tolerance, else the ratio itself; of two the smaller."""
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.ln(ratio) - math.log(k)).alias("off"), F.lit(float(k)).alias("to")) for k in sorted(known))))
    return F.when(nearest["off"] <= math.log(1 + tolerance), nearest["to"]).otherwise(ratio)


def distinct_within(points: Column, tolerance: float) -> Column:
    """An array of numbers' arrays without those of which every number is within the tolerance of one kept before."""
    near = lambda p, k: F.forall(F.zip_with(p, k, lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)
    keep = lambda kept, p: F.when(F.exists(kept, lambda k: near(p, k)), kept).otherwise(F.concat(kept, F.array(p)))
    return F.aggregate(points, F.slice(points, 1, 0), keep)


def ordered(corners: Column) -> Column:
    """Corners clockwise (where y points down) by their angle around their mean, the one with least x + y first; of equal ones the first by angle."""
    mean = lambda c: F.aggregate(corners, F.lit(0.0), lambda s, p: s + p[c]) / F.size(corners)
    told = F.transform(corners, lambda p: F.struct(F.atan2(p["y"] - mean("y"), p["x"] - mean("x")).alias("angle"), p["x"].alias("x"), p["y"].alias("y")))
    round_ = F.transform(F.array_sort(told), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    sums = F.transform(round_, lambda p: p["x"] + p["y"])
    first = F.array_position(sums, F.array_min(sums)).cast("int")
    return F.concat(F.slice(round_, first, F.size(corners)), F.slice(round_, F.lit(1), first - 1))


def corner_angles(corners: Column) -> Column:
    """The angle inside each corner, in degrees; null where a side has no length."""

    def angle(p: Column, i: Column) -> Column:
        a, b = _corner(corners, i + 3), _corner(corners, i + 1)
        cosine = ((a["x"] - p["x"]) * (b["x"] - p["x"]) + (a["y"] - p["y"]) * (b["y"] - p["y"])) / F.nullif(apart(p, a) * apart(p, b), F.lit(0.0))
        return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))

    return F.transform(corners, angle)


def crossing(p: Column, p2: Column, q: Column, q2: Column) -> Column:
    """Where the line through ``p`` and ``p2`` meets that through ``q`` and ``q2``; null if they are parallel."""
    dx, dy, ex, ey = p2["x"] - p["x"], p2["y"] - p["y"], q2["x"] - q["x"], q2["y"] - q["y"]
    across = dx * ey - dy * ex
    t = ((q["x"] - p["x"]) * ey - (q["y"] - p["y"]) * ex) / across
    return F.when(F.abs(across) >= 1e-9, F.struct((p["x"] + t * dx).alias("x"), (p["y"] + t * dy).alias("y")))


def clipped(shape: Column, by: Column) -> Column:
    """The part of a polygon inside a convex one whose corners come as :func:`ordered` gives them: one side after another cuts off what lies outside of it. Empty if nothing is left."""

    def cut(left: Column, i: Column) -> Column:
        a, b = F.get(by, i), F.get(by, F.pmod(i + 1, F.size(by)))
        side = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

        def corner(p: Column, k: Column) -> Column:
            q = F.get(left, F.pmod(k + 1, F.size(left)))
            s, t = side(p), side(q)
            at = s / F.nullif(s - t, F.lit(0.0))
            meets = F.struct((p["x"] + at * (q["x"] - p["x"])).alias("x"), (p["y"] + at * (q["y"] - p["y"])).alias("y"))
            stays, crosses = F.when(s >= 0, F.array(p)), F.when((s > 0) & (t < 0) | (s < 0) & (t > 0), F.array(meets))
            none = F.slice(F.array(p), 1, 0)
            return F.concat(F.coalesce(stays, none), F.coalesce(crosses, none))

        return F.when(F.size(left) == 0, left).otherwise(F.flatten(F.transform(left, corner)))

    return F.aggregate(F.sequence(F.lit(0), F.size(by) - 1), shape, cut)


def polygon_area(corners: Column) -> Column:
    """The area of a polygon given by its corners; 0 for less than three."""
    n = F.size(corners)
    turn = lambda p, i: p["x"] * F.get(corners, F.pmod(i + 1, n))["y"] - F.get(corners, F.pmod(i + 1, n))["x"] * p["y"]
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(F.transform(corners, turn), F.lit(0.0), lambda s, v: s + v)) / 2)


def flat(corners: Column) -> Column:
    """Whether three of four corners lie on a line, up to a billionth of the longest side squared."""
    longest = F.array_max(sides(corners))
    p = [F.get(corners, F.lit(i)) for i in range(4)]
    twice = [F.abs((p[j]["x"] - p[i]["x"]) * (p[k]["y"] - p[i]["y"]) - (p[j]["y"] - p[i]["y"]) * (p[k]["x"] - p[i]["x"])) for i, j, k in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))]
    return F.least(*twice) <= 1e-9 * longest * longest


def projected(numbers: Column, x: Column, y: Column) -> Column:
    """A point under a projective map, ``struct<x, y>``; null where it goes to infinity."""
    n = [F.get(numbers, F.lit(i)) for i in range(9)]
    w = F.nullif(n[6] * x + n[7] * y + n[8], F.lit(0.0))
    return F.struct(((n[0] * x + n[1] * y + n[2]) / w).alias("x"), ((n[3] * x + n[4] * y + n[5]) / w).alias("y"))


def onto_pages(quads: DataFrame, key: str, corners: str, width: int, height: int) -> DataFrame:
    """``key, map``: the projective map (nine numbers, the last 1, as an array of rows) that takes each quad's corners to those of a page, from -1/2 to width - 1/2 and height - 1/2.

    The eight equations of a quad are solved for a batch of quads at once. Null if three corners lie on a line, or a number is missing.
    """
    page = np.array([(-0.5, -0.5), (width - 0.5, -0.5), (width - 0.5, height - 0.5), (-0.5, height - 0.5)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = np.array([bool(x) for x in batch.column("fits").to_pylist()], bool)
            p = np.array([x for x, ok in zip(batch.column("flat").to_pylist(), fits, strict=True) if ok], float).reshape(-1, 4, 2)
            # Numbers of a like size: corners are moved to their middle and scaled before, and the map is put together with that after.
            middle = p.mean(1, keepdims=True)
            scale = np.abs(p - middle).max((1, 2))
            q = (p - middle) / scale[:, None, None]
            left, right = np.zeros((len(q), 8, 8)), np.broadcast_to(page.reshape(8), (len(q), 8))
            for i in range(4):
                for axis in range(2):
                    row = left[:, 2 * i + axis]
                    row[:, 3 * axis : 3 * axis + 2], row[:, 3 * axis + 2] = q[:, i], 1
                    row[:, 6:] = -q[:, i] * page[i, axis]
            h = np.concatenate((np.linalg.solve(left, right[..., None])[..., 0], np.ones((len(q), 1))), axis=1).reshape(-1, 3, 3)
            back = np.zeros((len(q), 3, 3))
            back[:, 0, 0] = back[:, 1, 1] = 1 / scale
            back[:, :2, 2], back[:, 2, 2] = -middle[:, 0] / scale[:, None], 1
            maps = (h @ back).reshape(-1, 9)
            maps /= maps[:, 8:]
            out: list = [None] * batch.num_rows
            for i, m in zip(np.flatnonzero(fits), maps.tolist(), strict=True):
                out[i] = m
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.float64()))], names=[key, "map"])

    numbers = F.flatten(F.transform(corners, lambda c: F.array(c["x"].cast("double"), c["y"].cast("double"))))
    whole = (F.size(numbers) == 8) & ~F.exists(numbers, lambda v: v.isNull() | F.isnan(v))
    kept = quads.select(F.col(key).alias("key"), numbers.alias("flat"), (whole & ~flat(F.col(corners))).alias("fits"))
    return kept.mapInArrow(run, T.StructType([T.StructField(key, quads.schema[key].dataType), T.StructField("map", T.ArrayType(T.DoubleType()))]))


def page_size(corners: Column, aspect: Column) -> Column:
    """``struct<width, height>``, whole numbers, of a page with an aspect (width by height) that shrinks no side of the quad."""
    side = sides(corners)
    w, h = F.greatest(side[0], side[2]), F.greatest(side[1], side[3])
    wide = w > h * aspect
    # Halves are rounded to even.
    return F.struct(F.greatest(F.lit(1), F.bround(F.when(wide, w).otherwise(h * aspect))).cast("bigint").alias("width"), F.greatest(F.lit(1), F.bround(F.when(wide, w / aspect).otherwise(h))).cast("bigint").alias("height"))
