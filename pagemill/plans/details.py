"""More registered queries: shapes, result layouts, settings, listings checked against manifests, a split built again."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import geometry
from pagemill.plans.catalog import query, r6
from pagemill.plans.reports import scratch
from pagemill.sinks import shards
from pagemill.sources.tables import table

_QUADS = """q AS (SELECT vec_id, [{'x': e[1], 'y': e[2]}, {'x': e[3], 'y': e[4]}, {'x': e[5], 'y': e[6]}, {'x': e[7], 'y': e[8]}] AS a,
  [{'x': e[9], 'y': e[10]}, {'x': e[11], 'y': e[12]}, {'x': e[13], 'y': e[14]}, {'x': e[15], 'y': e[16]}] AS b
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))"""


@query(f"""WITH {_QUADS}, s AS (SELECT vec_id, list_transform([1, 2, 3, 4], lambda i: sqrt((a[i].x - a[i % 4 + 1].x) * (a[i].x - a[i % 4 + 1].x) + (a[i].y - a[i % 4 + 1].y) * (a[i].y - a[i % 4 + 1].y))) AS sides,
  list_transform([1, 2, 3, 4], lambda i: (a[i].x - a[(i + 2) % 4 + 1].x) * (a[i % 4 + 1].y - a[i].y) - (a[i].y - a[(i + 2) % 4 + 1].y) * (a[i % 4 + 1].x - a[i].x)) AS bends FROM q)
SELECT vec_id, round(list_max(sides), 6) AS longest, round(list_min(sides), 6) AS shortest, (list_min(bends) > 0 OR list_max(bends) < 0) AS convex FROM s""")
def quad_shapes(spark, d):
    """Longest and shortest side of a quad, and whether it is convex."""
    a = geometry.quad(F.col("embedding"))
    rows = table(spark, d, "embeddings").select("vec_id", a.alias("a"))
    sides = geometry.sides(F.col("a"))
    return rows.select("vec_id", r6(F.array_max(sides)).alias("longest"), r6(F.array_min(sides)).alias("shortest"), geometry.convex(F.col("a")).alias("convex"))


@query(f"""WITH {_QUADS}, w AS (SELECT vec_id, a, list_max(list_transform([1, 2, 3, 4], lambda i: sqrt((a[i].x - b[i].x) * (a[i].x - b[i].x) + (a[i].y - b[i].y) * (a[i].y - b[i].y)))) AS worst FROM q)
SELECT vec_id, round(worst, 6) AS worst, worst < 0.5 * 4.0 AS detected, list_min(list_transform(a, lambda p: (p.x BETWEEN -1 AND 1 AND p.y BETWEEN -1 AND 1)::INT)) = 1 AS contained FROM w""")
def quad_detection(spark, d):
    """How far a quad is from the true one, whether that counts as found, and whether it lies in a box."""
    e = F.col("embedding")
    rows = table(spark, d, "embeddings").select("vec_id", geometry.quad(e).alias("a"), geometry.quad(e, 8).alias("b"))
    a, b, low, high = F.col("a"), F.col("b"), F.lit(-1.0), F.lit(1.0)
    return rows.select("vec_id", r6(geometry.worst_corner(a, b)).alias("worst"), geometry.detected(a, b, F.lit(4.0), 0.5).alias("detected"), geometry.inside(a, low, low, high, high).alias("contained"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE / (l_linenumber + 10) AS ratio FROM lineitem),
s AS (SELECT *, list_min(list_transform([1.0, 1.25, 1.5, 2.0, 3.0], lambda k: {'off': abs(ln(ratio) - ln(k)), 'to': k::DOUBLE})) AS best FROM r)
SELECT l_orderkey, l_linenumber, round(CASE WHEN best.off <= ln(1.04) THEN best.to ELSE ratio END, 6) AS snapped FROM s""")
def snapped_ratio(spark, d):
    ratio = F.col("l_quantity").cast("double") / (F.col("l_linenumber") + 10)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(geometry.snapped(ratio, (1.0, 1.25, 1.5, 2.0, 3.0), 0.04)).alias("snapped"))


@query("""WITH RECURSIVE o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i, [l_quantity::DOUBLE, l_linenumber::DOUBLE] AS p FROM lineitem),
f AS (SELECT l_orderkey, i, [p] AS kept FROM o WHERE i = 1
  UNION ALL SELECT f.l_orderkey, o.i, CASE WHEN list_bool_or(list_transform(f.kept, lambda k: abs(k[1] - o.p[1]) <= 5 AND abs(k[2] - o.p[2]) <= 5)) THEN f.kept ELSE list_append(f.kept, o.p) END
  FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.i = f.i + 1)
SELECT l_orderkey, len(arg_max(kept, i)) AS n_kept, list_sum(list_transform(arg_max(kept, i), lambda k: k[1]))::DOUBLE AS total FROM f GROUP BY l_orderkey""")
def tolerant_distinct(spark, d):
    """An order's lines without those close to one kept before, in order of their numbers, then quantities."""
    point = F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double"))
    listed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", point.alias("p")))).alias("lines"))
    kept = listed.select("l_orderkey", geometry.distinct_within(F.col("lines")["p"], 5.0).alias("kept"))
    return kept.select("l_orderkey", F.size("kept").cast("bigint").alias("n_kept"), F.aggregate("kept", F.lit(0.0), lambda t, k: t + k[0]).alias("total"))


@query("""SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'attributes' WHEN 1 THEN 'keys' ELSE 'tuple' END AS layout, 'w' || vec_id AS text,
  round(list_min([e[1], e[3], e[5], e[7]]), 6) AS x0, round(list_min([e[2], e[4], e[6], e[8]]), 6) AS y0, round(list_max([e[1], e[3], e[5], e[7]]), 6) AS x1, round(list_max([e[2], e[4], e[6], e[8]]), 6) AS y1
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) WHERE vec_id % 10 <> 0""")
def result_layouts(spark, d):
    """Three layouts of recognised words (attributes with an outline, keys with one, tuples with a box) in one; blank texts go."""
    corners = geometry.quad(F.col("embedding"))
    text = F.when(F.col("vec_id") % 10 == 0, "  ").otherwise(F.concat(F.lit("w"), F.col("vec_id").cast("string")))
    edge = lambda c, f: f(F.transform(corners, lambda p: p[c]))
    box = F.array(edge("x", F.array_min), edge("y", F.array_min), edge("x", F.array_max), edge("y", F.array_max))
    kind = F.col("vec_id") % 3
    raw = table(spark, d, "embeddings").select("vec_id",
        F.when(kind == 0, F.struct(text.alias("text"), corners.alias("poly"))).alias("attributes"),
        F.when(kind == 1, F.struct(text.alias("rec_text"), corners.alias("rec_poly"))).alias("keys"),
        F.when(kind == 2, F.struct(box.alias("_1"), text.alias("_2"))).alias("tuple"))
    poly = F.coalesce(F.col("attributes.poly"), F.col("keys.rec_poly"))
    side = lambda c, f, i: r6(F.coalesce(f(F.transform(poly, lambda p: p[c])), F.col("tuple._1")[i]))
    layout = F.when(F.col("attributes").isNotNull(), "attributes").when(F.col("keys").isNotNull(), "keys").otherwise("tuple")
    return raw.select("vec_id", layout.alias("layout"), F.coalesce("attributes.text", "keys.rec_text", "tuple._2").alias("text"),
        side("x", F.array_min, 0).alias("x0"), side("y", F.array_min, 1).alias("y0"), side("x", F.array_max, 2).alias("x1"), side("y", F.array_max, 3).alias("y1")).filter("trim(text) != ''")


@query("""WITH t AS (SELECT c_nationkey AS id, count(*) AS tuned FROM customer GROUP BY 1)
SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'nation ' || n_nationkey END AS label, coalesce(tuned, n_regionkey)::VARCHAR AS strength, n_nationkey::VARCHAR AS seed
FROM nation LEFT JOIN t ON id = n_nationkey""")
def resolved_methods(spark, d):
    """Methods with their own parameters, tuned ones going before these, and a label that is their name unless given."""
    tuned = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.create_map(F.lit("strength"), F.count("*").cast("string")).alias("tuned"))
    own = F.create_map(F.lit("strength"), F.col("n_regionkey").cast("string"), F.lit("seed"), F.col("n_nationkey").cast("string"))
    given = F.when(F.col("n_nationkey") % 2 == 1, F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")))
    methods = table(spark, d, "nation").join(tuned, F.col("id") == F.col("n_nationkey"), "left")
    params = F.when(F.col("tuned").isNull(), own).otherwise(F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key("tuned", k)), "tuned"))
    return methods.select(F.col("n_name").alias("name"), F.coalesce(given, "n_name").alias("label"), params.alias("p")).select("name", "label", F.col("p")["strength"].alias("strength"), F.col("p")["seed"].alias("seed"))


@query("""WITH m AS (SELECT doc_id, length(text) + (doc_id % 7 = 3)::INT AS size, sha256(CASE WHEN doc_id % 11 = 5 THEN text || '.' ELSE text END) AS digest FROM documents),
l AS (SELECT doc_id, length(text) AS size, sha256(text) AS digest FROM documents WHERE doc_id % 13 <> 0)
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.size <> m.size THEN 'size' WHEN l.digest <> m.digest THEN 'digest' ELSE 'intact' END AS state FROM m LEFT JOIN l USING (doc_id)""")
def staging_check(spark, d):
    """What a manifest lists against what is there: missing, of another size, of other content, or intact."""
    docs, text = table(spark, d, "documents"), F.col("text")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    told = F.when(F.col("doc_id") % 11 == 5, F.concat(text, F.lit("."))).otherwise(text)
    manifest = docs.select("doc_id", (F.length(text) + (F.col("doc_id") % 7 == 3).cast("int")).alias("size"), digest(told).alias("digest"))
    listing = docs.filter("doc_id % 13 != 0").select(F.col("doc_id").alias("there"), F.length(text).alias("size_there"), digest(text).alias("digest_there"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("size") != F.col("size_there"), "size").when(F.col("digest") != F.col("digest_there"), "digest").otherwise("intact")
    return manifest.join(listing, F.col("doc_id") == F.col("there"), "left").select("doc_id", state.alias("state"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def worst_list(spark, d):
    """The 25 worst, as a report names them."""
    worst = table(spark, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)
    return worst.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""WITH split AS (SELECT n_nationkey, n_name, CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS shard FROM nation WHERE n_regionkey <> 4)
SELECT n_nationkey, n_name, shard, CASE WHEN shard IN (1, 3) THEN 'written' ELSE 'kept' END AS state FROM split""")
def split_build(spark, d):
    """A split (one of whose shards is null) built, then again with other rows in one shard, one shard lost and one no longer planned; what the second build did with each row's."""
    folder, shard = f"{scratch(spark)}/split", F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")).alias("shard")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", shard, "n_regionkey")
    first = nation.withColumn("n_name", F.when(F.col("n_nationkey") == nation.filter("n_regionkey = 1").agg(F.min("n_nationkey")).first()[0], "?").otherwise(F.col("n_name")))
    shards.build_split(first.filter("n_regionkey != 3").drop("n_regionkey"), folder, "shard", "v1")
    now = nation.filter("n_regionkey != 4").drop("n_regionkey")
    plan = shards.build_split(now, folder, "shard", "v1").withColumnRenamed("shard", "folder")
    rows = shards.read_split(spark, folder, now.schema)
    state = F.when(F.col("kept"), "kept").otherwise("written").alias("state")
    return rows.join(plan, shards.tagged("shard") == F.col("folder")).select("n_nationkey", "n_name", "shard", state)
