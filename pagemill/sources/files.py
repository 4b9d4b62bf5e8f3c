"""Readers of text formats: CSV as strings, JSON documents by folder, lines, and folders whose names hold dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file or folder fits the path (which may hold wildcards), in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def plain_path(path: Column) -> Column:
    """A file's path as Spark gives it, without the escapes of a URL."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def csv_rows(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = False) -> DataFrame:
    """The columns of CSV files with a header, all strings, empty ones null. A missing file is an empty table, a missing column null.

    Only with ``multi_line`` may a quoted value hold newlines; a file is then one task's, else it is read in pieces.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    rows = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    return rows.select(*(F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))


def json_documents(spark: SparkSession, pattern: str, schema: str, multi_line: bool = False) -> DataFrame:
    """One row a JSON document, with ``folder``, the name of the folder it is in. Missing files are an empty table; broken ones give nulls.

    A document is a line; with ``multi_line`` a file, which may be indented, or hold a list, of which each item is a row.
    """
    if not exists(spark, pattern):
        return spark.createDataFrame([], f"{schema}, folder string")
    return spark.read.schema(schema).json(pattern, multiLine=multi_line).withColumn("folder", F.element_at(F.split(plain_path(F.col("_metadata.file_path")), "/"), -2))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``: the lines that aren't blank, without spaces at their ends."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line != ''")


def folder_dimensions(path: Column) -> list[Column]:
    """``screen`` and ``phone`` of a path with a folder ``screen-<a>__phone-<b>``; ``?`` where there is none."""
    part = lambda i: F.regexp_extract(path, r"screen-([^/]*?)__phone-([^/]*)/", i)
    return [F.when(part(i) == "", "?").otherwise(part(i)).alias(name) for i, name in ((1, "screen"), (2, "phone"))]


def capture_rows(spark: SparkSession, pattern: str, schema: str, needed: str, multi_line: bool = False) -> DataFrame:
    """JSON captures with the dimensions of their folders; a file that can't be read, or lacks ``needed``, is a row with ``ok`` false."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(pattern, multiLine=multi_line).select("*", plain_path(F.col("_metadata.file_path")).alias("file"))
    return rows.select("*", *folder_dimensions(F.col("file")), F.col(needed).isNotNull().alias("ok"))


def file_listing(spark: SparkSession, items: Sequence[str], endings: Sequence[str] = ()) -> DataFrame:
    """``place, path, size``: the files that items name, each once, at the first item that names it. An item is a file, a folder (the files in it) or a pattern.

    Files of folders and patterns come by path, and only those with one of the endings (whatever their case), if any are given; a file named as such comes whatever its
    ending, and though it may not exist (then ``size`` is null). Contents aren't read. Paths are without a scheme. The driver lists, as Spark does before it reads files.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    rows, seen = [], set()
    for item in items:
        where = hadoop.Path(item)
        store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        many = any(c in item for c in "*?[{")
        if not many and (not store.exists(where) or not store.getFileStatus(where).isDirectory()):
            found = [(where.toUri().getPath(), store.getFileStatus(where).getLen() if store.exists(where) else None)]
        else:
            listed = store.globStatus(where if many else hadoop.Path(where, "*")) or []
            found = sorted((x.getPath().toUri().getPath(), x.getLen()) for x in listed if not x.isDirectory())
            found = [x for x in found if not endings or x[0].lower().endswith(tuple(e.lower() for e in endings))]
        for path, size in found:
            if path not in seen:
                seen.add(path)
                rows.append((len(rows) + 1, path, size))
    return spark.createDataFrame(rows, "place bigint, path string, size bigint")


#: Fields of a line of word boxes, by place.
_BOX_FIELDS = ("level", "page", "block", "paragraph", "line", "word", "x", "y", "width", "height", "confidence", "text")


def word_boxes(lines: DataFrame) -> DataFrame:
    """Word boxes as text engines write them, a line each of twelve fields parted by tabs: of rows ``line`` (and more columns, which stay), the fields and ``problem``.

    ``problem`` is null for a word; else why a line is none: ``fields`` (fewer than twelve), ``level`` (a header, or a box of more than one word), ``blank``
    (no text) or ``number`` (a field that should be one isn't). Further tabs belong to nothing: the text is the twelfth field.
    """
    field = F.split("line", "\t")
    number = lambda i: F.get(field, F.lit(i)).try_cast("double")
    named = [F.get(field, F.lit(i)).alias(c) if c == "text" else (number(i) if c == "confidence" else number(i).try_cast("bigint")).alias(c) for i, c in enumerate(_BOX_FIELDS)]
    numbers = F.exists(F.array(*(number(i) for i in range(11))), lambda x: x.isNull())
    problem = F.when(F.size(field) < 12, "fields").when(F.get(field, F.lit(0)) != "5", "level").when(F.trim(F.get(field, F.lit(11))) == "", "blank").when(numbers, "number")
    return lines.select(*(c for c in lines.columns if c != "line" and c not in _BOX_FIELDS), F.col("line").alias("raw"), *named, problem.alias("problem"))
