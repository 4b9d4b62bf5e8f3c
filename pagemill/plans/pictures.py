"""Registered queries on pictures (vectors of 64 numbers as 8 by 8) and on quads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagemill.functions import geometry
from pagemill.operators import pictures
from pagemill.plans.catalog import query, work_folder
from pagemill.sources.tables import table


def vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("pixels"))
    return rows.select("vec_id", "label", F.lit(8).alias("height"), F.lit(8).alias("width"), "pixels")


@query("""WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
s AS (SELECT unnest([0, 3]) AS s), t AS (SELECT y.s AS y0, x.s AS x0 FROM s y, s x),
cells AS (SELECT vec_id, pos, y0, x0, pos // 8 - y0 AS i, pos % 8 - x0 AS j, v + 0.001 * (y0 + x0) AS v FROM v JOIN t ON pos // 8 BETWEEN y0 AND y0 + 4 AND pos % 8 BETWEEN x0 AND x0 + 4),
w AS (SELECT *, (CASE WHEN y0 = 0 THEN CASE WHEN 4 - i < 2 THEN (4.5 - i) / 2 ELSE 1 END ELSE CASE WHEN i < 2 THEN (i + 0.5) / 2 ELSE 1 END END)::DOUBLE AS wy,
  (CASE WHEN x0 = 0 THEN CASE WHEN 4 - j < 2 THEN (4.5 - j) / 2 ELSE 1 END ELSE CASE WHEN j < 2 THEN (j + 0.5) / 2 ELSE 1 END END)::DOUBLE AS wx FROM cells)
SELECT vec_id, pos AS "at", round(sum(wy * wx * v) / sum(wy * wx), 6) AS v FROM w GROUP BY ALL""")
def tile_blend(spark, d):
    """Pictures cut into overlapping tiles, each tile changed by its place, and put together again."""
    parts = pictures.tiles(vectors(spark, d), "vec_id", "height", "width", "pixels", 5, 2)
    changed = parts.withColumn("part", F.transform("part", lambda v: v + 0.001 * (F.col("y0") + F.col("x0"))))
    whole = pictures.merged(changed, "vec_id", "height", "width", 2)
    return whole.select("vec_id", F.posexplode("pixels").alias("at", "v")).select("vec_id", F.col("at").cast("bigint").alias("at"), F.round("v", 6).alias("v"))


@query("""WITH v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v, list_avg(embedding::DOUBLE[]) AS m FROM embeddings),
hann AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 7) AS c FROM range(8) t(i)),
x AS (SELECT vec_id, label, pos // 8 AS y, pos % 8 AS x, (v - m) * hy.c * hx.c AS v FROM v JOIN hann hy ON hy.i = pos // 8 JOIN hann hx ON hx.i = pos % 8),
f AS (SELECT p.i AS p, q.i AS q, sqrt(power(least(p.i, 8 - p.i) / 8, 2) + power(least(q.i, 8 - q.i) / 8, 2)) AS r FROM range(8) p(i), range(8) q(i)),
a AS (SELECT vec_id, label, p, q, r, (power(sum(v * cos(2 * pi() * (p * y + q * x) / 8)), 2) + power(sum(v * sin(2 * pi() * (p * y + q * x) / 8)), 2)) / (SELECT power(sum(c * c), 2) FROM hann) AS power FROM x, f GROUP BY ALL)
SELECT label::BIGINT AS label, floor(r * 16 + 1e-9)::BIGINT AS ring, count(*) AS n, round(sum(power) / count(*), 6) AS power FROM a WHERE r * 16 + 1e-9 < 8 GROUP BY ALL""")
def radial_spectrum(spark, d):
    """Mean power by ring of frequencies and label, under a Hann window."""

    def made(x):
        power, n = pictures.radial_power(x, 8)
        return {"power": power.tolist(), "n": n.tolist()}

    rows = vectors(spark, d)
    rings = pictures.mapped(rows, "vec_id", "height", "width", "pixels", made, "power array<double>, n array<double>").join(rows.select("vec_id", "label"), "vec_id")
    each = rings.select("label", F.posexplode(F.arrays_zip("power", "n")).alias("ring", "s")).groupBy(F.col("label").cast("bigint").alias("label"), F.col("ring").cast("bigint").alias("ring"))
    return each.agg(F.sum("s.n").cast("bigint").alias("n"), F.round(F.sum("s.power") / F.sum("s.n"), 6).alias("power")).filter("n > 0")


@query()
def notch_filter(spark, d):
    """Waves found in each picture's spectrum, and the picture without them: how many frequencies go, and what share of the power. Tested against plain sums of waves."""

    def made(x):
        found = pictures.peaks(x, 3.0, 0.2)[1]
        clean = pictures.notched(x, found, 0.6)
        return {"found": [float(i * x.shape[1] + j) for i in range(x.shape[0]) for j in range(x.shape[1]) if found[i, j]], "clean": clean.ravel().tolist()}

    rows = vectors(spark, d)
    out = pictures.mapped(rows, "vec_id", "height", "width", "pixels", made, "found array<double>, clean array<double>").join(rows.select("vec_id", "pixels"), "vec_id")
    power = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v * v)
    share = 1 - power(F.col("clean")) / F.nullif(power(F.col("pixels")), F.lit(0.0))
    return out.select("vec_id", F.size("found").cast("bigint").alias("n_waves"), F.round(share, 6).alias("share"))


def quads(spark, d):
    """Each vector's first eight numbers, moved to the corners of a square of side 4, as corners in order; written down, as what is made of them is long."""
    moved = F.zip_with(F.slice(F.col("embedding").cast("array<double>"), 1, 8), F.array(*(F.lit(float(v)) for v in (0, 0, 4, 0, 4, 4, 0, 4))), lambda v, m: v * 3 + m)
    folder = f"{work_folder(spark)}/quads-{uuid.uuid4().hex}"
    table(spark, d, "embeddings").select("vec_id", geometry.ordered(geometry.quad(moved)).alias("corners")).write.parquet(folder)
    return spark.read.parquet(folder)


_QUADS = """WITH c AS (SELECT vec_id, i, embedding[2 * i + 1]::DOUBLE * 3 + [0, 4, 4, 0][i + 1] AS x, embedding[2 * i + 2]::DOUBLE * 3 + [0, 0, 4, 4][i + 1] AS y FROM embeddings, range(4) t(i)),
m AS (SELECT *, atan2(y - avg(y) OVER w, x - avg(x) OVER w) AS angle FROM c WINDOW w AS (PARTITION BY vec_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY angle, x, y) - 1 AS nth FROM m), f AS (SELECT vec_id, arg_min(nth, (x + y, nth)) AS first FROM r GROUP BY 1),
q AS (SELECT vec_id, (nth - first + 4) % 4 AS place, x, y FROM r JOIN f USING (vec_id))"""


@query(_QUADS + " SELECT vec_id, place, round(x, 6) AS x, round(y, 6) AS y FROM q")
def ordered_corners(spark, d):
    return quads(spark, d).select("vec_id", F.posexplode("corners").alias("place", "p")).select("vec_id", F.col("place").cast("bigint").alias("place"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(_QUADS + """, l AS (SELECT vec_id, list(x ORDER BY place) AS x, list(y ORDER BY place) AS y FROM q GROUP BY 1),
t AS (SELECT *, list_max([sqrt(power(x[i] - x[i % 4 + 1], 2) + power(y[i] - y[i % 4 + 1], 2)) for i in range(1, 5)]) AS side,
  list_min([abs((x[j[2]] - x[j[1]]) * (y[j[3]] - y[j[1]]) - (y[j[2]] - y[j[1]]) * (x[j[3]] - x[j[1]])) for j in [[1, 2, 3], [1, 2, 4], [1, 3, 4], [2, 3, 4]]]) AS least FROM l)
SELECT vec_id, i AS place, round(CASE WHEN i IN (0, 3) THEN -0.5 ELSE 639.5 END, 5) AS x, round(CASE WHEN i < 2 THEN -0.5 ELSE 479.5 END, 5) AS y FROM t, range(4) u(i) WHERE least > 1e-9 * side * side""")
def page_corners(spark, d):
    """Each quad's corners under its own map onto a page of 640 by 480: the page's corners."""
    rows = quads(spark, d)
    maps = geometry.onto_pages(rows, "vec_id", "corners", 640, 480).filter("map is not null")
    each = maps.join(rows, "vec_id").select("vec_id", "map", F.posexplode("corners").alias("place", "p"))
    return each.select("vec_id", F.col("place").cast("bigint").alias("place"), geometry.projected(F.col("map"), F.col("p.x"), F.col("p.y")).alias("q")).select("vec_id", "place", F.round("q.x", 5).alias("x"), F.round("q.y", 5).alias("y"))


@query()
def quad_overlap(spark, d):
    """How much of each quad lies in the square from 0.5 to 3.5, and what share that is of both together. Tested against a plain clipper."""
    square = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.5, 0.5), (3.5, 0.5), (3.5, 3.5), (0.5, 3.5))))
    both = quads(spark, d).select("vec_id", geometry.polygon_area(F.col("corners")).alias("area"), geometry.polygon_area(geometry.clipped(F.col("corners"), square)).alias("common"))
    return both.select("vec_id", F.round("area", 6).alias("area"), F.round("common", 6).alias("common"), F.round(F.col("common") / (F.col("area") + 9.0 - F.col("common")), 6).alias("iou"))
