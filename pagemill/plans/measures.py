"""More registered queries: archives, job reasons, gated ingest, spectra, structural similarity, votes, ablations, seeded picks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators import jobs
from pagemill.plans.catalog import query, queue, r6
from pagemill.plans.reports import scratch
from pagemill.sources import archives, files
from pagemill.sources.tables import table

# Archives and lists of keys


@query("SELECT doc_id // 100 AS shard, doc_id || '.txt' AS name, sha1(coalesce(text, '')) AS digest FROM documents")
def tar_round_trip(spark, d):
    """Documents in tar shards of a hundred, kept in a table, and read again."""
    path, data = f"{scratch(spark)}/shards", F.col("text").cast("binary")
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 100).alias("shard"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), data.alias("data"))
    archives.tar_shards(rows).write.parquet(path)
    return archives.tar_members(spark.read.parquet(path)).select("shard", "name", F.sha1("data").alias("digest"))


@query("SELECT 'p' || page_id AS line FROM pages")
def key_list(spark, d):
    """Keys as a sorted text, in files whose order is that of the keys."""
    path, key = f"{scratch(spark)}/keys", F.concat(F.lit("p"), F.col("page_id").cast("string"))
    table(spark, d, "pages").select(key.alias("value")).orderBy("value").write.text(path)
    return files.text_lines(spark, path)


# Jobs and ingest

_JOBS = """WITH j AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'cpu' ELSE 'gpu' END AS runtime, conv_id % 5 AS file FROM conversations),
st AS (SELECT id, CASE WHEN turn % 2 = 0 AND conv_id % 2 = 0 THEN 'done' WHEN id % 7 = 0 THEN 'failed' END AS status, CASE WHEN id % 14 = 0 THEN 1 ELSE 0 END AS at_attempt FROM j),
e AS (SELECT id, id - 1 AS needs FROM j WHERE turn > 0 UNION ALL SELECT id, -id FROM j WHERE id % 11 = 0),
u AS (SELECT e.id, count(*) FILTER (WHERE k.id IS NULL) AS n_unknown, count(*) FILTER (WHERE k.id IS NOT NULL AND s.id IS NULL) AS n_waiting
  FROM e LEFT JOIN j k ON k.id = e.needs LEFT JOIN st s ON s.id = e.needs AND s.status = 'done' GROUP BY e.id),
r AS (SELECT id, runtime, status = 'done' AS is_done, status = 'failed' AND at_attempt = 1 AS failed, n_unknown > 0 AS unknown, n_waiting > 0 AS waits, file = 4 AS missing FROM j LEFT JOIN st USING (id) LEFT JOIN u USING (id))
"""


def reasons(spark, d: str, session: str) -> DataFrame:
    rows, edges, status = queue(spark, d)
    rows = rows.withColumn("runtime", F.when(F.col("conv_id") % 3 == 0, "cpu").otherwise("gpu")).withColumn("file", F.col("conv_id") % 5)
    edges = edges.unionByName(rows.filter("id % 11 = 0").select("id", (-F.col("id")).alias("needs")))
    return jobs.job_reasons(rows, edges, status, spark.range(4).withColumnRenamed("id", "file"), session)


@query(_JOBS + """SELECT id, array_to_string(list_filter([CASE WHEN is_done THEN 'done' END, CASE WHEN failed THEN 'failed at this attempt' END, CASE WHEN unknown THEN 'needs unknown jobs' END,
  CASE WHEN waits THEN 'waits for jobs' END, CASE WHEN missing THEN 'file is missing' END, CASE WHEN runtime <> 'gpu' THEN 'needs another runtime' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM r""")
def job_reasons(spark, d):
    """Why each job can't start in a session with a GPU."""
    return reasons(spark, d, "gpu").select("id", F.array_join("reasons", "; ").alias("reasons"))


@query(_JOBS + "SELECT id, runtime FROM r WHERE NOT (coalesce(is_done, false) OR coalesce(failed, false) OR coalesce(unknown, false) OR coalesce(waits, false) OR missing) ORDER BY runtime <> 'cpu', id LIMIT 1")
def job_next(spark, d):
    """The first job that can start in a session without a GPU, those for its runtime first."""
    return reasons(spark, d, "cpu").filter(F.size("reasons") == 0).orderBy(F.col("runtime") != "cpu", "id").limit(1).select("id", "runtime")


@query("""WITH f AS (SELECT doc_id, doc_id // 4 AS bundle, length(text) > 6000 OR regexp_matches(text, '[A-Za-z0-9._]+@[a-z]+') AS bad FROM documents)
SELECT doc_id, bundle, count(*) FILTER (WHERE bad) OVER (PARTITION BY bundle) AS n_bad, count(*) FILTER (WHERE bad) OVER (PARTITION BY bundle) = 0 AS accepted FROM f""")
def gated_ingest(spark, d):
    """Bundles of files go in whole or not at all: one file too long, or with a forbidden pattern, keeps out its bundle."""
    bad = (F.length("text") > 6000) | F.col("text").rlike("[A-Za-z0-9._]+@[a-z]+")
    rows = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("bundle"), bad.alias("bad"))
    return rows.join(rows.groupBy("bundle").agg(F.count_if("bad").alias("n_bad")), "bundle").select("doc_id", "bundle", "n_bad", (F.col("n_bad") == 0).alias("accepted"))


@query("""SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_id % 3 <> 0) AS state, max(event_id) FILTER (WHERE event_id % 3 <> 0) AS state_at,
  round(arg_max(value, event_id) FILTER (WHERE event_id % 2 = 0), 6) AS progress FROM events GROUP BY 1""")
def status_merge(spark, d):
    """A status put together from partial updates: of each field the newest value that some update had."""
    named, counted = F.col("event_id") % 3 != 0, F.col("event_id") % 2 == 0
    newest = lambda c, has: F.max_by(c, F.when(has, F.col("event_id")))
    return table(spark, d, "events").groupBy("user_id").agg(
        newest("event_type", named).alias("state"), F.max(F.when(named, F.col("event_id"))).alias("state_at"), F.round(newest("value", counted), 6).alias("progress"),
    )


# Measures of vectors


def spectrum(vectors: DataFrame, bins: int) -> DataFrame:
    """``label, bin, power, n``: of each vector of ``label, x`` the sum of power over each band of frequencies, and how many these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, power, counts, places = [], [], [], []
            for label, x in zip(batch.column("label").to_pylist(), batch.column("x").to_pylist(), strict=True):
                p = np.abs(np.fft.rfft(np.array(x))) ** 2
                place = np.arange(len(p)) * bins // len(p)
                n = np.bincount(place, minlength=bins)
                labels += [label] * bins
                places.append(np.arange(bins))
                power.append(np.bincount(place, p, bins))
                counts.append(n)
            flat = lambda xs, t: pa.array(np.concatenate(xs), t) if xs else pa.array([], t)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), flat(places, pa.int64()), flat(power, pa.float64()), flat(counts, pa.int64())], names=["label", "bin", "power", "n"])

    return vectors.filter(F.size("x") > 0).mapInArrow(run, "label bigint, bin bigint, power double, n bigint")


@query("""WITH v AS (SELECT vec_id, label, len(embedding) AS n, unnest(range(0, len(embedding))) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings),
f AS (SELECT DISTINCT n, unnest(range(0, n // 2 + 1)) AS k FROM v),
p AS (SELECT vec_id, label, n, k, power(sum(x * cos(2 * pi() * k * j / n)), 2) + power(sum(x * sin(2 * pi() * k * j / n)), 2) AS p FROM v JOIN f USING (n) GROUP BY ALL)
SELECT label::BIGINT AS label, (k * 8) // (n // 2 + 1) AS bin, round(avg(p), 4) AS power FROM p GROUP BY ALL""")
def power_spectrum(spark, d):
    """Mean power by band of frequencies and label."""
    vectors = table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    return spectrum(vectors, 8).groupBy("label", "bin").agg(F.round(F.sum("power") / F.sum("n"), 4).alias("power"))


#: Reach and spread of the window, and what keeps quotients of small numbers stable.
REACH, SPREAD, C1, C2 = 5, 1.5, 0.0001, 0.0009


def ssim(pairs: DataFrame, key: str) -> DataFrame:
    """``key, ssim`` of vectors ``x, y``: structural similarity under a Gaussian window, its mean where the window lies inside; null if it never does."""
    w = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SPREAD) ** 2)
    w /= w.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.array(x, float), np.array(y, float)
                if min(len(x), len(y)) < len(w) or len(x) != len(y):
                    out.append(None)
                    continue
                mx, my, xx, yy, xy = (np.convolve(z, w, "valid") for z in (x, y, x * x, y * y, x * y))
                out.append(float(np.mean((2 * mx * my + C1) * (2 * (xy - mx * my) + C2) / ((mx * mx + my * my + C1) * (xx - mx * mx + yy - my * my + C2)))))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.float64())], names=[key, "ssim"])

    return pairs.select(key, "x", "y").mapInArrow(run, f"{key} {pairs.schema[key].dataType.simpleString()}, ssim double")


@query("""WITH b AS (SELECT label, arg_min(embedding, vec_id) AS x FROM embeddings GROUP BY 1), p AS (SELECT vec_id, x::DOUBLE[] AS x, embedding::DOUBLE[] AS y FROM embeddings JOIN b USING (label)),
g AS (SELECT k, exp(-k * k / 4.5) / sum(exp(-k * k / 4.5)) OVER () AS w FROM (SELECT unnest(range(-5, 6)) AS k)), q AS (SELECT vec_id, x, y, unnest(range(6, len(y) - 4)) AS i FROM p),
s AS (SELECT vec_id, i, sum(w * x[i + k]) AS mx, sum(w * y[i + k]) AS my, sum(w * x[i + k] * x[i + k]) AS xx, sum(w * y[i + k] * y[i + k]) AS yy, sum(w * x[i + k] * y[i + k]) AS xy FROM q, g GROUP BY vec_id, i)
SELECT vec_id, round(avg((2 * mx * my + 0.0001) * (2 * (xy - mx * my) + 0.0009) / ((mx * mx + my * my + 0.0001) * (xx - mx * mx + yy - my * my + 0.0009))), 6) AS ssim FROM s GROUP BY 1""")
def vector_ssim(spark, d):
    """Structural similarity of each vector with the first one of its label."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("y"))
    return ssim(rows.join(rows.groupBy("label").agg(F.min_by("y", "vec_id").alias("x")), "label"), "vec_id").select("vec_id", r6(F.col("ssim")).alias("ssim"))


@query("SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor(x::DOUBLE * 255 + 0.5), 0), 255)::INT) AS levels FROM embeddings")
def byte_levels(spark, d):
    """Numbers as levels from 0 to 255, rounded half up."""
    level = lambda x: F.least(F.greatest(F.floor(x.cast("double") * 255 + 0.5), F.lit(0)), F.lit(255)).cast("int")
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", level).alias("levels"))


# Votes, ablations, picks


@query("""WITH v AS (SELECT l_suppkey AS sheet, l_partkey % 50 AS page, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY ALL)
SELECT sheet, page, n FROM v QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY n DESC, page) = 1""")
def page_vote(spark, d):
    """The page that most distinct corners name; of several the smallest."""
    votes = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sheet"), (F.col("l_partkey") % 50).alias("page")).agg(F.count_distinct("l_linenumber").alias("n"))
    return votes.groupBy("sheet").agg(F.min(F.struct((-F.col("n")).alias("less"), "page")).alias("best")).select("sheet", "best.page", (-F.col("best.less")).alias("n"))


@query("""WITH a AS (SELECT p_brand AS label, avg(p_retailprice) AS dev FROM part GROUP BY 1), b AS (SELECT p_brand AS label, avg(p_size) AS synthetic FROM part WHERE p_size > 25 GROUP BY 1)
SELECT label, round(dev, 6) AS dev, round(dev - (SELECT dev FROM a WHERE label = (SELECT min(label) FROM a)), 6) AS delta, round(synthetic, 6) AS synthetic FROM a LEFT JOIN b USING (label)""")
def ablation_table(spark, d):
    """Scores by label with their difference against one label, beside those of a second set where it has them."""
    part, label = table(spark, d, "part"), F.col("p_brand").alias("label")
    dev, synthetic = part.groupBy(label).agg(F.avg("p_retailprice").alias("dev")), part.filter("p_size > 25").groupBy(label).agg(F.avg("p_size").alias("synthetic"))
    base = dev.agg(F.min_by("dev", "label").alias("base"))  # one row
    return dev.join(synthetic, "label", "left").join(F.broadcast(base)).select("label", r6("dev").alias("dev"), r6(F.col("dev") - F.col("base")).alias("delta"), r6("synthetic").alias("synthetic"))


def pick(key: Column, seed: int, weights: Sequence[tuple[str, float]]) -> Column:
    """One of the names, each as likely as its weight says; seed and key alone decide."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    total, below, chosen = sum(w for _, w in weights), 0.0, F
    for name, weight in weights:
        below += weight
        chosen = chosen.when(u * total < below, name)
    return chosen.otherwise(weights[-1][0])


@query("""WITH u AS (SELECT event_id, ('0x' || substr(md5('7:' || event_id), 1, 8))::BIGINT / 4294967296.0 * 8 AS u FROM events)
SELECT event_id, CASE WHEN u < 5 THEN 'web' WHEN u < 7 THEN 'book' ELSE 'code' END AS source FROM u""")
def seeded_pick(spark, d):
    return table(spark, d, "events").select("event_id", pick(F.col("event_id"), 7, (("web", 5.0), ("book", 2.0), ("code", 1.0))).alias("source"))


@query("""WITH r AS (SELECT event_type AS theme, user_id % 4 AS template, event_id % 5 = 0 AS lost, event_id % 7 = 0 AS wrong, value FROM events)
SELECT coalesce(theme, 'all') AS theme, coalesce(template, -1) AS template, count(*) AS n, count(*) FILTER (WHERE lost) AS not_found, count(*) FILTER (WHERE NOT lost AND wrong) AS found_wrong,
  round(avg((NOT lost AND NOT wrong)::INT), 6) AS rate, round(max(value) FILTER (WHERE NOT lost), 6) AS worst FROM r GROUP BY GROUPING SETS ((theme), (template), ())""")
def detection_report(spark, d):
    """What wasn't found and what was found wrongly, by theme, by template and over all."""
    lost, wrong = F.col("event_id") % 5 == 0, F.col("event_id") % 7 == 0
    rows = table(spark, d, "events").select(F.col("event_type").alias("theme"), (F.col("user_id") % 4).alias("template"), lost.alias("lost"), wrong.alias("wrong"), "value")
    found = ~F.col("lost")
    return rows.groupingSets([["theme"], ["template"], []], "theme", "template").agg(
        F.count("*").alias("n"), F.count_if("lost").alias("not_found"), F.count_if(found & F.col("wrong")).alias("found_wrong"),
        F.round(F.avg((found & ~F.col("wrong")).cast("int")), 6).alias("rate"), F.round(F.max(F.when(found, F.col("value"))), 6).alias("worst"),
    ).withColumn("theme", F.coalesce("theme", F.lit("all"))).withColumn("template", F.coalesce("template", F.lit(-1)))
