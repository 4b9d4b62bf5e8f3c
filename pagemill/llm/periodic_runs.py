"""Periodic run detection: the array of word ids compared with each of its shifts, stretches of equal places read off.

A run is a stretch of consecutive words in which words ``period`` apart are equal, where ``period`` is the smallest such number, no
neighbouring word extends it, and which has ``least_length`` words and ``least_exponent`` periods at least. A word is dropped if a run holds it
after the run's first period: of every repetition the first round stays.

All lags up to n / ``least_exponent`` are looked at: a block of shifts is compared with the array at once, and true stretches
of 3 q places (for 4 periods) at lag q are candidates. A stretch found at several lags has its smallest lag as its period: with four
rounds and more, any smaller period divides a larger one, and then both have the same extent.

How it scales: a document of n words takes n^2 / 4 comparisons. Documents of up to ``LONG_BYTES`` bytes are done where they are read, with no
shuffle. Longer ones are cut into ranges of lags of about ``WORK`` comparisons each; the ranges, with the word ids, are dealt out to all machines, and
only the runs found come back together, by document: there are fewer of them than the document has words.

Defined results: null and empty texts, and texts of whitespace, have no runs and an empty collapsed text; rows that repeat a doc_id,
and rows without one, are each judged by their own text; very long texts count whole; of equally long runs the first counts as longest,
then that of the smallest period; other columns are kept, whatever their names, but ``n_words``, ``runs`` and ``collapsed`` are new columns and
take the place of columns of that name; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.shared import slices, solid_runs, staged, unused

LEAST_EXPONENT, LEAST_LENGTH = 4, 6
#: Texts of more bytes have their lags dealt out, in ranges of so many comparisons.
LONG_BYTES, WORK = 1 << 16, 1 << 28
#: So many comparisons are made by one array operation.
_AT_ONCE = 1 << 20

_SOLID = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)
_ARROW_RUNS = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]))


def stretches(ids: np.ndarray, low: int, high: int, least_exponent: int, least_length: int) -> np.ndarray:
    """Rows ``start, length, period`` of all stretches of equal places at the lags from ``low`` up to ``high`` that are long enough."""
    n = len(ids)
    high = min(high, n // least_exponent)
    if low > high:
        return np.zeros((0, 3), np.int64)
    # A last column in which nothing is equal ends each row's last stretch.
    top = np.iinfo(ids.dtype).max
    base = np.append(ids, ids.dtype.type(top - 1))
    shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate((ids, np.full(high + 1, top, ids.dtype))), n + 1)
    step, found = max(1, _AT_ONCE // (n + 1)), []
    for lag in range(low, high + 1, step):
        equal = np.flatnonzero(shifted[lag : min(lag + step, high + 1)] == base)
        if not len(equal):
            continue
        heads = np.flatnonzero(np.diff(equal, prepend=-2) != 1)
        period = equal[heads] // (n + 1) + lag
        length = np.diff(heads, append=len(equal)) + period
        keep = length >= np.maximum(least_exponent * period, least_length)
        found.append(np.stack((equal[heads][keep] % (n + 1), length[keep], period[keep]), axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def smallest(found: np.ndarray) -> np.ndarray:
    """Of each stretch its smallest period; by start, then period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.append(True, (found[1:, :2] != found[:-1, :2]).any(1))[: len(found)]
    found = found[fresh]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run drops, joined by spaces."""
    if len(runs):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
    return b" ".join(words).decode()


def _codes(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batch, with the word ids of each text, in two bytes if there are few."""
    for part in slices(batch, "text", 1 << 19):
        row, code, terms = solid_runs(part.column("text"), _SOLID)
        edges = np.searchsorted(row, np.arange(part.num_rows + 1))
        code = code.astype(np.uint16 if len(terms) < 65_000 else np.int32)
        yield part, [code[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _lists(each: list[np.ndarray]) -> pa.Array:
    rows = np.concatenate(each) if each else np.zeros((0, 3), np.int64)
    ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
    kind = _ARROW_RUNS.value_type
    values = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(ends), values, type=_ARROW_RUNS)


def periodic_runs(docs: DataFrame, least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH, long_bytes: int = LONG_BYTES, work: int = WORK) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of ``start, length, period``, by start, then period) and ``collapsed``, the text without repeated rounds."""
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    docs = docs.drop("n_words", "runs", "collapsed").withColumn("text", F.col("text").cast("string"))
    (uid,), n_own = unused(docs.columns, "uid"), len(docs.columns)
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def finished(part: pa.RecordBatch, runs: list[np.ndarray]) -> pa.RecordBatch:
        words = [(x or "").encode().split() for x in part.column("text").to_pylist()]
        kept = [collapsed(w, r) for w, r in zip(words, runs, strict=True)]
        return pa.RecordBatch.from_arrays([*part.columns[:n_own], pa.array(list(map(len, words)), pa.int64()), _lists(runs), pa.array(kept, pa.string())], names=out.names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, codes in _codes(batch):
                yield finished(part, [smallest(stretches(c, 1, len(c), least_exponent, least_length)) for c in codes])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, codes in _codes(batch):
                for name, c in zip(part.column(0).to_pylist(), codes, strict=True):
                    lags = max(1, work // (len(c) + 1))
                    for low in range(1, len(c) // least_exponent + 1, lags):
                        columns = [[name], [low], [low + lags - 1]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.array([c.astype(np.int32).tobytes()], pa.binary())], names=["uid", "low", "high", "ids"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                found = stretches(np.frombuffer(x["ids"], np.int32), x["low"], x["high"], least_exponent, least_length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x["uid"])), *(pa.array(found[:, i]) for i in range(3))], names=["uid", "start", "length", "period"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lists = [[(r["start"], r["length"], r["period"]) for r in x or []] for x in part.column(n_own).to_pylist()]
                yield finished(part, [smallest(np.array(x, np.int64).reshape(-1, 3)) for x in lists])

    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    short = docs.filter(~is_long).mapInArrow(whole, out)
    # The number of a row must not change when a lost task runs again.
    long = staged(docs.filter(is_long).withColumn(uid, F.monotonically_increasing_id()), "long")
    spread = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    items = long.select(uid, "text").mapInArrow(ranges, "uid bigint, low bigint, high bigint, ids binary").repartition(spread, "uid", "low")
    found = items.mapInArrow(scanned, "uid bigint, start bigint, length bigint, period bigint").groupBy("uid", "start", "length").agg(F.min("period").alias("period"))
    each = found.groupBy(F.col("uid").alias("of")).agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    joined = long.join(each, long[uid] == each["of"], "left").select(*(long[c] for c in docs.columns), each["found"])
    return short.unionByName(joined.mapInArrow(merged, out))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs``, of which a tenth by the checksum of doc_id have texts that repeat themselves from some word on: h = crc32(doc_id), g = h // 10,
    and if h % 10 = 0 each word i from a = g % n on is word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"))
    g = F.floor(h / 10).cast("bigint")
    chosen, n, a, p, w = unused(docs.columns, "chosen", "n", "a", "p", "w")
    planned = docs.withColumn(w, F.when(h % 10 == 0, words)).withColumn(n, F.size(w).cast("bigint")).withColumn(chosen, F.coalesce(F.col(n) > 0, F.lit(False)))
    planned = planned.withColumn(a, F.when(F.col(chosen), g % F.col(n)))
    planned = planned.withColumn(p, (1 + F.floor((F.col(n) - F.col(a)) / (3 + g % 8))).cast("bigint"))
    # The round, as often as it takes and more, cut to length.
    times = F.ceil((F.col(n) - F.col(a)) / F.col(p)).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, F.col(a) + 1, F.col(p)), times)), F.lit(1), F.col(n) - F.col(a))
    told = F.array_join(F.concat(F.slice(w, F.lit(1), F.col(a)), tail), " ")
    return planned.withColumn("text", F.when(F.col(chosen), told).otherwise(F.col("text"))).select(*docs.columns)
