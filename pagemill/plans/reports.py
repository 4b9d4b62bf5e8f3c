"""More registered queries: round trips through readers and sinks, summaries per engine and method, report tables, small measures."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.functions import report
from pagemill.operators import intervals
from pagemill.plans.catalog import query, r6, work_folder
from pagemill.sinks import logs
from pagemill.sources import files
from pagemill.sources.tables import table


def scratch(spark) -> str:
    return f"{work_folder(spark)}/reports-{uuid.uuid4().hex}"


# Readers and sinks


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(NULL AS VARCHAR) AS note FROM customer")
def csv_round_trip(spark, d):
    """A CSV log read as strings, with a column that it lacks; a file that isn't there adds nothing."""
    folder, columns = scratch(spark), ["c_custkey", "c_name", "c_nationkey", "note"]
    table(spark, d, "customer").drop("c_acctbal").write.csv(f"{folder}/log", header=True)
    return files.csv_rows(spark, f"{folder}/log", columns).unionByName(files.csv_rows(spark, f"{folder}/none", columns))


@query("SELECT 'r_name=' || r_name AS folder, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_by_folder(spark, d):
    folder = scratch(spark)
    named = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # a table of five rows
    named.select("n_nationkey", "n_name", "r_name").write.partitionBy("r_name").json(f"{folder}/jobs")
    return files.json_documents(spark, f"{folder}/jobs/*/*.json", "n_nationkey int, n_name string")


@query("SELECT line, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark) WHERE line <> '' GROUP BY 1")
def text_line_scan(spark, d):
    folder = scratch(spark)
    table(spark, d, "benchmark").select("text").write.text(f"{folder}/lines")
    return files.text_lines(spark, f"{folder}/lines").groupBy("line").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN s_nationkey % 3 = 0 THEN '?' ELSE 'screen' || s_nationkey % 3 END AS screen, CASE WHEN s_nationkey % 3 = 0 THEN '?' ELSE 'phone' || s_nationkey % 2 END AS phone,
  s_suppkey % 5 <> 0 AS ok, count(*) AS n FROM supplier GROUP BY ALL""")
def capture_folders(spark, d):
    """Folders named by screen and phone; every fifth capture lacks its measure."""
    folder = scratch(spark)
    third = F.col("s_nationkey") % 3
    at = F.when(third == 0, "misc").otherwise(F.format_string("screen-screen%d__phone-phone%d", third, F.col("s_nationkey") % 2))
    err = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal"))
    table(spark, d, "supplier").select("s_suppkey", err.alias("err"), at.alias("at")).write.partitionBy("at").json(f"{folder}/photos")
    # Paths have the folder's name behind ``at=``.
    return files.capture_rows(spark, f"{folder}/photos/*/*.json", "s_suppkey bigint, err double", "err").groupBy("screen", "phone", "ok").agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders")
def append_log(spark, d):
    """Two overlapping appends of a log; each order is in it once, and columns that it doesn't have are left out."""
    path, orders = f"{scratch(spark)}/log", table(spark, d, "orders")
    for part in (orders.filter(F.col("o_orderkey") % 3 != 0), orders):
        logs.append_rows(part, path, ["o_orderkey", "o_orderpriority"], ["o_orderkey"])
    return files.csv_rows(spark, path, ["o_orderkey", "o_orderpriority"])


@query("SELECT event_id, value FROM events WHERE event_id <= 500 UNION ALL SELECT event_id, -value FROM events WHERE event_id > 500 AND event_id <= 600")
def resumed_log(spark, d):
    """A log cut back to step 500, then continued by a second run up to step 600."""
    events = table(spark, d, "events").select("event_id", "value")
    kept = logs.cut_log(events.filter("event_id <= 550"), "event_id", 500, scratch(spark))
    return kept.unionByName(events.filter("event_id > 500 and event_id <= 600").withColumn("value", -F.col("value")))


# Summaries and reports


@query("""WITH m AS (SELECT l_linestatus AS engine, l_returnflag AS method, l_suppkey AS key, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
p AS (SELECT m.*, m.v - b.v AS diff FROM m LEFT JOIN m b ON b.method = 'N' AND b.engine = m.engine AND b.key = m.key AND m.method <> 'N')
SELECT engine, method, count(*) AS n, round(avg(v), 6) AS mean_v, count(diff) AS n_paired, round(avg(diff), 6) AS mean_diff, round(stddev_samp(diff) / sqrt(count(diff)), 6) AS se_diff,
  coalesce(avg(diff) > 0, false) AS reads_worse FROM p GROUP BY ALL""")
def engine_method_summary(spark, d):
    """For each engine and method the mean over keys, and the paired difference against the method N on the keys both have."""
    means = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("engine"), F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("key")).agg(F.avg("l_extendedprice").alias("v"))
    # The baseline rides along by a second grouping instead of a self join.
    per_key = means.groupBy("engine", "key").agg(F.max(F.when(F.col("method") == "N", F.col("v"))).alias("base"), F.collect_list(F.struct("method", "v")).alias("ms"))  # a few methods a key
    rows = per_key.select("engine", "base", F.explode("ms").alias("m")).select("engine", "m.method", "m.v", F.when(F.col("m.method") != "N", F.col("m.v") - F.col("base")).alias("diff"))
    return rows.groupBy("engine", "method").agg(
        F.count("*").alias("n"), r6(F.avg("v")).alias("mean_v"), F.count("diff").alias("n_paired"), r6(F.avg("diff")).alias("mean_diff"),
        F.round(F.stddev_samp("diff") / F.sqrt(F.count("diff")), 6).alias("se_diff"), F.coalesce(F.avg("diff") > 0, F.lit(False)).alias("reads_worse"),
    )


_PAIRS = (("A", "R"), ("R", "N"))


@query(f"""WITH s AS (SELECT l_linestatus AS engine, l_returnflag AS method, l_suppkey AS key, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
u AS (SELECT engine, 'mean' AS what, method AS a, NULL AS b, key, v FROM s
  UNION ALL SELECT x.engine, 'against input', x.method, 'N', key, x.v - y.v FROM s x JOIN s y USING (engine, key) WHERE y.method = 'N' AND x.method <> 'N'
  UNION ALL SELECT x.engine, 'pair', x.method, y.method, key, x.v - y.v FROM s x JOIN s y USING (engine, key) WHERE (x.method, y.method) IN (('A', 'R'), ('R', 'N'))),
picked AS (SELECT engine, what, a, b, r, v, {intervals.DRAWS_SQL} AS w FROM (SELECT *, key AS k FROM u), range(1, {intervals.RESAMPLES + 1}) t(r)),
means AS (SELECT engine, what, a, b, sum(w * v) / nullif(sum(w), 0) AS m FROM picked GROUP BY engine, what, a, b, r),
ci AS (SELECT engine, what, a, b, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM means GROUP BY ALL)
SELECT ci.engine, ci.what, ci.a, ci.b, n, mean, lo, hi, lo > 0 AS worse, lo > 0 OR hi < 0 AS excludes_zero
FROM ci JOIN (SELECT engine, what, a, b, count(*) AS n, round(avg(v), 4) AS mean FROM u GROUP BY ALL) g
  ON g.engine = ci.engine AND g.what = ci.what AND g.a = ci.a AND g.b IS NOT DISTINCT FROM ci.b""")
def engine_method_intervals(spark, d):
    """The result table in full, 10,000 resamples: for each engine the mean of each method, each method against the input's, and chosen pairs, on the keys both have."""
    line = table(spark, d, "lineitem")
    scores = line.groupBy(F.col("l_linestatus").alias("engine"), F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("key")).agg(F.avg("l_extendedprice").alias("v"))
    means = scores.select("engine", F.lit("mean").alias("what"), F.col("method").alias("a"), F.lit(None).cast("string").alias("b"), "key", "v")
    told = lambda what, pairs: intervals.compared(scores, "engine", "method", "key", "v", pairs).select("engine", F.lit(what).alias("what"), "a", "b", "key", F.col("difference").alias("v"))
    every = means.unionByName(told("against input", [(m, "N") for m in ("A", "R")])).unionByName(told("pair", _PAIRS))
    out = intervals.bootstrap(every, ["engine", "what", "a", "b"], F.col("key"), "v")
    rounded = out.select("engine", "what", "a", "b", "n", *(F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")))
    return rounded.withColumn("worse", F.col("lo") > 0).withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


@query("""WITH m AS (SELECT o_orderpriority AS name, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1), i AS (SELECT v FROM m WHERE name = '1-URGENT')
SELECT row_number() OVER (ORDER BY name <> '1-URGENT', name = '5-LOW', v DESC) AS place,
  '| ' || name || ' | ' || printf('%.2f', v) || ' | ' || CASE WHEN name = '1-URGENT' THEN '–' ELSE printf('%+.2f', v - (SELECT v FROM i)) END || ' | ' || n || ' |' AS line FROM m""")
def markdown_table(spark, d):
    """A result table in three-key order: the identity first, the reference last, the others by their mean."""
    means = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg("o_totalprice").alias("v"), F.count("*").alias("n"))
    base = F.max(F.when(F.col("name") == "1-URGENT", F.col("v"))).over(Window.partitionBy())  # five rows
    gain = F.when(F.col("name") != "1-URGENT", F.col("v") - base)
    place = F.row_number().over(Window.orderBy(F.col("name") != "1-URGENT", F.col("name") == "5-LOW", F.desc("v")))
    return means.select(place.alias("place"), report.table_row(F.col("name"), report.fixed(F.col("v")), report.fixed(gain, signed=True), F.col("n")).alias("line"))


@query("""SELECT n_name, CASE WHEN count(c_custkey) = 0 THEN '–' ELSE printf('%.2f [%.2f, %.2f]', avg(c_acctbal), min(c_acctbal), max(c_acctbal)) END AS shown
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1""")
def interval_text(spark, d):
    rich = table(spark, d, "customer").filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.min("c_acctbal").alias("l"), F.max("c_acctbal").alias("h"))
    joined = table(spark, d, "nation").join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select("n_name", report.interval(F.col("m"), F.col("l"), F.col("h")).alias("shown"))


@query("""WITH s AS (SELECT ['straight', 'angle', 'far', 'zoom'][((o_orderkey % 20) // 5)::INT + 1] AS shot, o_orderpriority = '1-URGENT' AS hit FROM orders)
SELECT coalesce(shot, 'overall') AS shot, round(avg(hit::INT), 6) AS rate, count(*) AS n FROM s GROUP BY GROUPING SETS ((shot), ())""")
def rates_by_shot(spark, d):
    """Shares by class of page number, and overall."""
    shot = report.class_of_number(F.col("o_orderkey"), ("straight", "angle", "far", "zoom"), 20)
    rows = table(spark, d, "orders").select(shot.alias("shot"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("hit"))
    return rows.rollup("shot").agg(F.round(F.avg("hit"), 6).alias("rate"), F.count("*").alias("n")).withColumn("shot", F.coalesce("shot", F.lit("overall")))


# Words, boxes and other small measures


@query("""WITH w AS (SELECT l_orderkey AS page, l_suppkey % 3 AS block, l_linenumber AS line, l_partkey AS pos, l_quantity AS x, l_extendedprice AS y, l_discount * 100 - 1 AS conf, 'w' || l_partkey AS word FROM lineitem),
l AS (SELECT page, block, line, min(pos) AS first, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, round(avg(greatest(conf, 0) / 100), 6) AS score, string_agg(word, ' ' ORDER BY pos, word) AS text FROM w GROUP BY ALL),
b AS (SELECT page, block, min(first) AS seen FROM l GROUP BY ALL)
SELECT l.page, dense_rank() OVER (PARTITION BY l.page ORDER BY b.seen, l.block) AS paragraph, line, x0, x1, y0, y1, score, text FROM l JOIN b ON l.page = b.page AND l.block = b.block""")
def words_to_lines(spark, d):
    """Words of a page joined to lines in their order, with box and mean confidence; blocks are numbered as they are first seen."""
    words = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 3).alias("block"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("pos"), F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"), F.greatest(F.col("l_discount") * 100 - 1, F.lit(0.0)).alias("conf"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("word"),
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ")  # the words of one line
    lines = words.groupBy("page", "block", "line").agg(F.min("pos").alias("first"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), r6(F.avg(F.col("conf") / 100)).alias("score"), joined.alias("text"))
    seen = F.min("first").over(Window.partitionBy("page", "block"))
    number = F.dense_rank().over(Window.partitionBy("page").orderBy("seen", "block"))
    return lines.withColumn("seen", seen).withColumn("paragraph", number).select("page", "paragraph", "line", "x0", "x1", "y0", "y1", "score", "text")


@query("SELECT doc_id, length(replace(replace(text, ' ', ''), chr(10), '')) AS solid, length(replace(replace(text, ' ', ''), chr(10), '')) >= 200 AS enough, sha1(text) AS digest FROM documents")
def least_content(spark, d):
    solid = report.solid_chars(F.col("text"))
    return table(spark, d, "documents").select("doc_id", solid.cast("bigint").alias("solid"), (solid >= 200).alias("enough"), F.sha1(F.col("text").cast("binary")).alias("digest"))


@query("""WITH b AS (SELECT l_orderkey, list(l_quantity ORDER BY l_partkey, l_quantity, l_extendedprice) AS xs, list(l_extendedprice / 1000 ORDER BY l_partkey, l_quantity, l_extendedprice) AS ys FROM lineitem GROUP BY 1)
SELECT l_orderkey, greatest(0, floor(list_min(xs) - 5))::BIGINT AS "left", greatest(0, floor(list_min(ys) - 5))::BIGINT AS top, least(45, ceil(list_max(xs) + 5))::BIGINT AS "right", least(60, ceil(list_max(ys) + 5))::BIGINT AS bottom,
  round(abs(list_sum([xs[i] * ys[i % len(xs) + 1] - xs[i % len(xs) + 1] * ys[i] for i in range(1, len(xs) + 1)]))/ 2, 6) AS area FROM b""")
def boxes_and_areas(spark, d):
    """The clipped bounding box of a polygon of a few corners, and its area."""
    corners = F.sort_array(F.collect_list(F.struct("l_partkey", "l_quantity", "l_extendedprice")))
    shapes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(corners.alias("c"))
    shapes = shapes.select("l_orderkey", F.transform("c", lambda s: s["l_quantity"]).alias("xs"), F.transform("c", lambda s: s["l_extendedprice"] / 1000).alias("ys"))
    box = report.clipped_box(F.col("xs"), F.col("ys"), F.lit(5), F.lit(45), F.lit(60))
    return shapes.select("l_orderkey", box.alias("box"), F.round(report.shoelace(F.col("xs"), F.col("ys")), 6).alias("area")).select("l_orderkey", "box.*", "area")


@query("""WITH s AS (SELECT o_orderpriority AS set, year(o_orderdate) AS year, avg(o_totalprice) AS x FROM orders WHERE o_orderpriority <> '5-LOW' OR year(o_orderdate) % 2 = 0 GROUP BY ALL), w AS (SELECT *, substr(set, 1, 1)::DOUBLE AS weight FROM s)
SELECT year, count(*) AS n_sets, round(sum(weight * x) / sum(weight), 6) AS score FROM w GROUP BY 1""")
def weighted_sets(spark, d):
    """A mean over sets by weight, renewed over those that a year has."""
    year = F.year("o_orderdate")
    sets = table(spark, d, "orders").filter((F.col("o_orderpriority") != "5-LOW") | (year % 2 == 0)).groupBy(F.col("o_orderpriority").alias("set"), year.alias("year")).agg(F.avg("o_totalprice").alias("x"))
    weight = F.substring("set", 1, 1).cast("double")
    return sets.groupBy("year").agg(F.count("*").alias("n_sets"), r6(F.sum(weight * F.col("x")) / F.sum(weight)).alias("score"))


@query("""SELECT user_id, round(sum(CASE WHEN event_id % 8 < 2 THEN value ELSE 0 END), 4) AS low, round(sum(CASE WHEN event_id % 8 >= 2 THEN value ELSE 0 END), 4) AS high,
  round(sum(CASE WHEN event_id % 8 < 2 THEN value ELSE 0 END) / greatest(sum(CASE WHEN event_id % 8 >= 2 THEN value ELSE 0 END), 1e-12), 6) AS ratio FROM events GROUP BY 1""")
def band_energy(spark, d):
    low = F.sum(F.when(F.col("event_id") % 8 < 2, F.col("value")).otherwise(0.0))
    high = F.sum(F.when(F.col("event_id") % 8 >= 2, F.col("value")).otherwise(0.0))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(low, 4).alias("low"), F.round(high, 4).alias("high"), r6(low / F.greatest(high, F.lit(1e-12))).alias("ratio"))


@query("SELECT role, min(conv_id * 1000 + turn) AS first FROM conversations GROUP BY 1 UNION ALL SELECT lang, min(doc_id) FROM documents GROUP BY 1")
def ordered_distinct(spark, d):
    """Distinct values of two tables with the place where each is first seen."""
    roles = table(spark, d, "conversations").groupBy("role").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first"))
    return roles.unionByName(table(spark, d, "documents").groupBy(F.col("lang").alias("role")).agg(F.min("doc_id").alias("first")))


@query("""SELECT e.event_id, list_filter(json_keys(props), lambda k: NOT list_contains(['k'], k)) AS unknown, list_filter(['k', 'seed'], lambda k: NOT list_contains(json_keys(props), k)) AS missing FROM events e""")
def field_checks(spark, d):
    """Fields of a JSON record that a schema doesn't know, and those that it lacks."""
    have = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    lit = lambda *xs: F.array(*map(F.lit, xs))
    return table(spark, d, "events").select("event_id", F.array_except(have, lit("k")).alias("unknown"), F.array_except(lit("k", "seed"), have).alias("missing"))


@query("SELECT o_orderkey, greatest(floor(o_totalprice / 1000) * 1000, 5000)::BIGINT AS steps FROM orders")
def schedule_steps(spark, d):
    return table(spark, d, "orders").select("o_orderkey", report.steps_within(F.col("o_totalprice"), 1000, 5000).alias("steps"))


@query("""WITH y AS (SELECT l.vec_id, l.label, unnest(l.embedding)::DOUBLE AS y, unnest(b.embedding)::DOUBLE AS x FROM embeddings l JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) b USING (label)),
f AS (SELECT vec_id, CASE WHEN var_pop(x) <= 1e-6 THEN 1 ELSE covar_pop(y, x) / var_pop(x) END AS a, avg(y) AS my, avg(x) AS mx FROM y GROUP BY 1)
SELECT vec_id, round(sqrt(avg(power(y - (my - a * mx) - a * x, 2))), 5) AS residual FROM y JOIN f USING (vec_id) GROUP BY 1""")
def fit_residual(spark, d):
    """The root mean square left by the least-squares line through a vector and the first vector of its label, from sums alone."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("y"))
    base = rows.groupBy("label").agg(F.min_by("y", "vec_id").alias("x"))
    long = rows.join(base, "label").select("vec_id", F.explode(F.arrays_zip("y", "x")).alias("p")).select("vec_id", "p.y", "p.x")
    a = F.when(F.var_pop("x") <= 1e-6, 1.0).otherwise(F.covar_pop("y", "x") / F.var_pop("x"))
    left = F.greatest(F.var_pop("y") - 2 * a * F.covar_pop("y", "x") + a * a * F.var_pop("x"), F.lit(0.0))
    return long.groupBy("vec_id").agg(F.round(F.sqrt(left), 5).alias("residual"))
