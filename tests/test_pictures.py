"""Tiles, spectra, notch filters and quads against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import geometry
from pagemill.operators import pictures
from pagemill.plans.catalog import QUERIES


def frame(spark, arrays):
    rows = [(i, a.shape[0], a.shape[1], a.ravel().tolist()) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "k bigint, h int, w int, p array<double>")


@pytest.mark.parametrize("window", ["linear", "hann"])
def test_tiles_give_the_picture_back(spark, window):
    rng = np.random.default_rng(1)
    arrays = [rng.normal(size=s) for s in ((8, 8), (3, 20), (17, 5), (1, 1))]
    parts = pictures.tiles(frame(spark, arrays), "k", "h", "w", "p", 6, 2)
    got = {r["k"]: r["pixels"] for r in pictures.merged(parts, "k", "h", "w", 2, window).collect()}
    for i, a in enumerate(arrays):
        assert np.allclose(got[i], a.ravel())
    assert parts.filter("k = 0").count() == 4 and parts.filter("th > 6 OR tw > 6").count() == 0


def plain_transform(x):
    h, w = x.shape
    out = np.zeros((h, w), complex)
    for p in range(h):
        for q in range(w):
            out[p, q] = sum(x[y, z] * np.exp(-2j * np.pi * (p * y / h + q * z / w)) for y in range(h) for z in range(w))
    return out


def test_periodic_and_smooth_parts():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 5)) + np.arange(5) * 3.0
    periodic, smooth = pictures.periodic_smooth(x)
    assert np.allclose(periodic + smooth, x)
    # Inside, the smooth part's Laplacian is nothing; at the edges it is the jump.
    ring = lambda a: sum(np.roll(a, s, ax) for ax in (0, 1) for s in (1, -1)) - 4 * a
    assert np.allclose(ring(smooth)[1:-1, 1:-1], 0)
    assert np.allclose(plain_transform(periodic), plain_transform(x) - plain_transform(smooth))
    flat = np.outer(np.sin(2 * np.pi * np.arange(8) / 8), np.ones(8))
    assert np.abs(pictures.periodic_smooth(np.ones((4, 4)))[1]).max() < 1e-12 and pictures.periodic_smooth(flat)[1].shape == (8, 8)


def test_a_wave_is_found_and_taken_out():
    y, x = np.mgrid[:32, :32]
    smooth = 3 * np.exp(-((y - 16) ** 2 + (x - 16) ** 2) / 60)
    noise = np.random.default_rng(3).normal(0, 0.05, (32, 32))
    wave = 0.5 * np.cos(2 * np.pi * (5 * y + 9 * x) / 32)
    _, found = pictures.peaks(smooth + noise + wave, 9.0, 0.15)
    assert {(5, 9), (27, 23)} <= set(map(tuple, np.argwhere(found).tolist())) and found.sum() <= 6, np.argwhere(found)
    clean = pictures.notched(smooth + noise + wave, found, 0.7)
    assert np.abs(clean - smooth).mean() < 0.2 * np.abs(wave).mean()
    assert np.allclose(pictures.notched(wave, np.zeros((32, 32), bool), 0.7), wave)


def test_rings_of_power():
    x = np.random.default_rng(4).normal(size=(6, 8))
    power, n = pictures.radial_power(x, 4)
    window = np.outer(np.hanning(6), np.hanning(8))
    spectrum = np.abs(plain_transform((x - x.mean()) * window)) ** 2 / (window**2).sum()
    sums, counts = [0.0] * 4, [0] * 4
    for p in range(6):
        for q in range(8):
            ring = int(math.hypot(min(p, 6 - p) / 6, min(q, 8 - q) / 8) * 8 + 1e-9)
            if ring < 4:
                sums[ring] += spectrum[p, q]
                counts[ring] += 1
    assert np.allclose(power, sums) and n.tolist() == counts


def test_pictures_that_are_none(spark):
    rows = spark.createDataFrame([(1, 2, 2, None), (2, 2, 2, [1.0]), (3, 1, 1, [None]), (4, 1, 1, [2.0])], "k bigint, h int, w int, p array<double>")
    got = pictures.mapped(rows, "k", "h", "w", "p", lambda x: {"s": [float(x.sum())]}, "s array<double>").collect()
    assert [(r["k"], r["s"]) for r in got] == [(1, None), (2, None), (3, None), (4, [2.0])]


def quads_of(spark, quads):
    points = [(i, [(float(x), float(y)) for x, y in q]) for i, q in enumerate(quads)]
    return spark.createDataFrame(points, "k int, c array<struct<x: double, y: double>>")


def test_maps_onto_pages(spark):
    rng = random.Random(5)
    quads = [[(rng.uniform(-2, 2) + x * 1000, rng.uniform(-2, 2) + y * 700) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))] for _ in range(20)]
    quads += [[(0, 0), (1, 1), (2, 2), (0, 1)], [(0, 0), (0, 0), (1, 1), (0, 1)]]
    rows = quads_of(spark, quads)
    maps = geometry.onto_pages(rows, "k", "c", 300, 200).join(rows, "k")
    got = maps.select("k", "map", F.transform("c", lambda p: geometry.projected(F.col("map"), p["x"], p["y"])).alias("to")).orderBy("k").collect()
    for r in got[:20]:
        assert all(math.hypot(p["x"] - x, p["y"] - y) < 1e-6 for p, (x, y) in zip(r["to"], ((-0.5, -0.5), (299.5, -0.5), (299.5, 199.5), (-0.5, 199.5)), strict=True))
    assert [r["map"] for r in got[20:]] == [None, None]


def plain_clip(shape, by):
    for i in range(len(by)):
        (ax, ay), (bx, by_) = by[i], by[(i + 1) % len(by)]
        side = lambda p: (bx - ax) * (p[1] - ay) - (by_ - ay) * (p[0] - ax)  # noqa: B023, E731
        out = []
        for p, q in zip(shape, shape[1:] + shape[:1], strict=True):
            if side(p) >= 0:
                out.append(p)
            if side(p) * side(q) < 0:
                t = side(p) / (side(p) - side(q))
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        shape = out
    return shape


def area(p):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2 if len(p) > 2 else 0.0


def test_overlap_of_all_quads(spark):
    got = {r["vec_id"]: r for r in QUERIES["quad_overlap"](spark, "/root/testdata/sf0.001").collect()}
    square = [(0.5, 0.5), (3.5, 0.5), (3.5, 3.5), (0.5, 3.5)]
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        p = [(r["embedding"][2 * i] * 3 + (0, 4, 4, 0)[i], r["embedding"][2 * i + 1] * 3 + (0, 0, 4, 4)[i]) for i in range(4)]
        mx, my = sum(x for x, _ in p) / 4, sum(y for _, y in p) / 4
        p.sort(key=lambda c: math.atan2(c[1] - my, c[0] - mx))
        assert abs(got[r["vec_id"]]["area"] - area(p)) < 1e-5 and abs(got[r["vec_id"]]["common"] - area(plain_clip(p, square))) < 1e-5


def test_corners_and_lines(spark):
    rows = quads_of(spark, [[(10, 0), (0, 10), (10, 10), (0, 0)], [(1, 0), (2, 1), (1, 2), (0, 1)], [(0, 0), (0, 0), (4, 4), (0, 4)]])
    got = rows.select(geometry.ordered(F.col("c")).alias("o"), geometry.corner_angles(geometry.ordered(F.col("c"))).alias("a"), geometry.crossing(F.col("c")[0], F.col("c")[1], F.col("c")[2], F.col("c")[3]).alias("x"), geometry.page_size(geometry.ordered(F.col("c")), F.lit(2.0)).alias("s")).collect()
    assert [(p["x"], p["y"]) for p in got[0]["o"]] == [(0, 0), (10, 0), (10, 10), (0, 10)] and [round(a) for a in got[0]["a"]] == [90] * 4
    assert (got[0]["x"]["x"], got[0]["x"]["y"], tuple(got[0]["s"])) == (5.0, 5.0, (20, 10))
    assert got[1]["x"] is None and None in got[2]["a"]
