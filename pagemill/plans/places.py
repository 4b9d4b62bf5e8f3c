"""Registered queries on archives, documents of several lines, listings and word boxes, each written first and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagemill.plans.catalog import query, work_folder
from pagemill.sources import archives, files
from pagemill.sources.tables import table


def scratch(spark) -> str:
    return f"{work_folder(spark)}/places-{uuid.uuid4().hex}"


@query("""SELECT printf('%s/%d.txt', lang, doc_id) AS name, strlen(text) AS size, md5(text) AS md5, true AS ok FROM documents WHERE lang = 'de' AND strlen(text) >= 200""")
def zip_scan(spark, d):
    """Archives of whole documents, of which the members of one folder and of some size are read: conditions choose them in the archives' directories."""
    docs = table(spark, d, "documents").filter("lang is not null")
    rows = docs.select(F.floor(F.col("doc_id") / 2000).cast("bigint").alias("shard"), F.format_string("%s/%d.txt", "lang", "doc_id").alias("name"), F.encode("text", "UTF-8").alias("data"))
    paths = [r["path"] for r in archives.zip_shards(rows, scratch(spark)).select("path").collect()]  # an archive a row
    members = archives.zip_members(spark, paths).filter(F.col("name").startswith("de/") & (F.col("size") >= 200))
    return members.select("name", "size", F.md5("data").alias("md5"), "ok")


@query("SELECT 'r_name=' || r_name AS folder, r_regionkey, count(*) AS n, max(n_name) AS last FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def json_whole_documents(spark, d):
    """A document a file over several lines, by folder: indented, with a list inside."""
    folder = scratch(spark)
    nations = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations")  # a region's
    by_region = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(nations)
    told = F.to_json(F.struct("r_regionkey", "nations"), {"pretty": "true"})
    by_region.select("r_name", told.alias("value")).repartition("r_name").write.partitionBy("r_name").text(f"{folder}/docs")
    found = files.json_documents(spark, f"{folder}/docs/*/*.txt", "r_regionkey int, nations array<struct<n_nationkey: int, n_name: string>>", multi_line=True)
    return found.select("folder", "r_regionkey", F.size("nations").cast("bigint").alias("n"), F.array_max("nations.n_name").alias("last"))


@query("""SELECT place, name FROM (SELECT row_number() OVER (ORDER BY n_regionkey <> 3, n_nationkey) AS place, printf('n%03d.JPG', n_nationkey) AS name, n_regionkey FROM nation WHERE n_regionkey IN (1, 3))
UNION ALL SELECT count(*) + 1, 'missing.txt' FROM nation WHERE n_regionkey IN (1, 3)""")
def file_expansion(spark, d):
    """A pattern, a folder that holds what the pattern has named already, and a file that isn't there: each file once, at its first place."""
    folder = scratch(spark)
    nation = table(spark, d, "nation").filter("n_regionkey in (1, 3)").select("n_nationkey", "n_regionkey", F.format_string("n%03d.JPG", "n_nationkey").alias("name"))
    jvm = spark.sparkContext._jvm
    store = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in nation.collect():  # 25 nations at most
        store.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/all/{r['name']}")).close()
    store.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/all/notes.txt")).close()
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    threes = [f"{folder}/all/n{r['n_nationkey']:03d}.JPG" for r in nation.filter("n_regionkey = 3").orderBy("n_nationkey").collect()]
    listed = files.file_listing(spark, [*threes, f"{folder}/all/*", f"{folder}/all", f"{folder}/missing.txt"], [".jpg", ".png"])
    return listed.select("place", name)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey % 7 AS kind, l_quantity FROM lineitem)
SELECT l_orderkey, count(*) FILTER (WHERE kind > 2) AS n_words, count(*) FILTER (WHERE kind = 0) AS n_short, count(*) FILTER (WHERE kind = 1) AS n_levels, count(*) FILTER (WHERE kind = 2) AS n_blank,
  coalesce(string_agg(CASE WHEN kind > 2 THEN 'w' || l_linenumber END, ' ' ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)), '') AS words FROM l GROUP BY 1""")
def word_box_lines(spark, d):
    """Line items written as lines of word boxes, some too short, of another level, or blank; what is read back of each order."""
    kind = F.col("l_partkey") % 7
    q = F.col("l_quantity").cast("bigint")
    level, text = F.when(kind == 1, "4").otherwise("5"), F.when(kind == 2, " ").otherwise(F.concat(F.lit("w"), F.col("l_linenumber")))
    whole = F.concat_ws("\t", level, F.lit("1"), F.lit("1"), F.lit("1"), F.col("l_linenumber").cast("string"), F.lit("1"), q.cast("string"), F.lit("0"), F.lit("10"), F.lit("5"), F.lit("96.5"), text)
    folder = scratch(spark)
    lines = table(spark, d, "lineitem").select(F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.when(kind == 0, "5\t1").otherwise(whole)).alias("value"))
    lines.write.text(f"{folder}/tsv")
    read = spark.read.text(f"{folder}/tsv").select(F.split("value", "\t", 2).alias("v")).select(F.col("v")[0].cast("bigint").alias("l_orderkey"), F.col("v")[1].alias("line"))
    boxes = files.word_boxes(read)
    word = F.when(F.col("problem").isNull(), F.struct("line", "x", "text"))
    of = lambda p: F.count_if(F.col("problem") == p)
    words = F.array_join(F.transform(F.sort_array(F.collect_list(word)), lambda w: w["text"]), " ")  # an order's
    return boxes.groupBy("l_orderkey").agg(F.count_if(F.col("problem").isNull()).alias("n_words"), of("fields").alias("n_short"), of("level").alias("n_levels"), of("blank").alias("n_blank"), words.alias("words"))
