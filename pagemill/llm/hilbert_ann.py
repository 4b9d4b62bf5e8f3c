"""Approximate nearest neighbours by shifted space-filling curves.

Several Hilbert curves, each over its own random projection and random shift, order all vectors. Near
vectors are near on some of the curves. Spark range-sorts every curve, cuts it into blocks, and sends
each query to the blocks that its window of neighbouring positions overlaps; there the exact distances
are taken. Each block returns the nearest few, and the merge over blocks and curves ranks them again.

``window`` is a share of the rows. Vectors without low-dimensional structure need a wide one: the
production value is set for isotropic noise in 64 dimensions, the worst case, and the README gives
the recall measured against brute force.

Defined results: vectors that are null, empty, zero, of another length than most (of two, the shorter) or with
null or non-finite components take no part; ties go to the smaller vec_id; of repeated vec_ids each
row is a candidate, and a query's own id is none; repeated rows are candidates each; other
columns, whatever their names, don't matter; empty tables give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.shared import staged

CURVES, DIMENSIONS, BITS = 16, 8, 4
WINDOW = 0.09
BLOCK_ROWS = 1024
#: Queries that one block meets in one task at most.
QUERY_ROWS = 8192
#: Of these, so many at a time.
MET_AT_ONCE = 128


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer ``cells`` (n, d), for d * bits <= 62.

    From the top bit down, the axes are inverted or exchanged as the sub-cube's orientation asks
    (Skilling's transposed form), then Gray-decoded and interleaved.
    """
    axes = cells.astype(np.int64).T.copy()
    d = len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            set_ = (axes[i] & q) != 0
            swap = np.where(set_, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(set_, axes[0] ^ low, axes[0]) ^ swap
            axes[i] ^= swap
        q >>= 1
    for i in range(1, d):
        axes[i] ^= axes[i - 1]
    flip = np.zeros_like(axes[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(axes[-1] & q, q - 1, 0)
        q >>= 1
    axes ^= flip
    key = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | axes[i] >> b & 1
    return key


def usable(embedding: Column) -> Column:
    """Not null, every component a finite number, and not all zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def curve_keys(rows: DataFrame, length: int, spread: tuple[np.ndarray, np.ndarray], curves: int, dims: int, bits: int, seed: int) -> DataFrame:
    """``vec_id, embedding, key`` with one row a curve; ``spread`` is the mean and deviation of each component."""
    rng = np.random.default_rng(seed)
    frames = [(np.linalg.qr(rng.normal(size=(length, min(dims, length))))[0], rng.uniform(0, 1, min(dims, length))) for _ in range(curves)]
    turns = np.random.default_rng(seed + 1).normal(size=(length, curves))  # order within a cell, another on each curve
    mean, scale = spread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)
            x = (flat - mean) / scale
            keys, fine = [], x @ turns
            for turn, shift in frames:
                y = np.clip((x @ turn + 4) / 8, 0, 1)  # four deviations to either side
                cells = np.minimum(((y + shift) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1)
                keys.append(hilbert_key(cells, bits))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(np.stack(keys, 1).tolist(), pa.list_(pa.int64())), pa.array(fine.tolist(), pa.list_(pa.float64()))], names=["vec_id", "embedding", "keys", "fine"])

    return rows.mapInArrow(run, "vec_id bigint, embedding array<double>, keys array<bigint>, fine array<double>")


def on_curves(keyed: DataFrame) -> DataFrame:
    """``curve, position, vec_id``: every row's place along every curve, from one range sort.

    The sorted rows are staged with a number that follows the order; sizes of the sorted pieces give
    each piece's first place, and a window inside a piece the rest.
    """
    long = keyed.select("vec_id", F.posexplode(F.arrays_zip("keys", "fine")).alias("curve", "at")).select("vec_id", "curve", F.col("at.keys").alias("key"), F.col("at.fine").alias("fine"))
    pieces = max(long.sparkSession.sparkContext.defaultParallelism, int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = long.repartitionByRange(pieces, "curve", "key", "fine", "vec_id").sortWithinPartitions("curve", "key", "fine", "vec_id")
    marked = staged(ordered.select("curve", "vec_id", F.monotonically_increasing_id().alias("mark")), "curves").withColumn("piece", F.shiftright("mark", 33))
    sizes = marked.groupBy("curve", "piece").agg(F.count("*").alias("n"), F.min("mark").alias("first"))
    before = Window.partitionBy("curve").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("curve", "piece", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return marked.join(F.broadcast(starts), ["curve", "piece"]).select("curve", "vec_id", (F.col("mark") - F.col("first") + F.col("base")).alias("position"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, curves: int = CURVES, dims: int = DIMENSIONS, bits: int = BITS,
            window: float = WINDOW, block_rows: int = BLOCK_ROWS, seed: int = 17) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of each query, by exact Euclidean distance."""
    good = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks")).filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    lengths = good.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not lengths:
        return vectors.sparkSession.createDataFrame([], empty)
    length = lengths[0]["length"]
    rows = staged(good.filter(F.size("embedding") == length), "rows")
    by_component = rows.select(F.posexplode("embedding")).groupBy("pos").agg(F.avg("col"), F.stddev_pop("col")).orderBy("pos").collect()
    mean = np.array([r[1] for r in by_component])
    scale = np.array([r[2] if r[2] > 1e-12 else 1.0 for r in by_component]) * 1.0
    # Equal vectors are one node; ``low`` is its smallest vec_id. The nodes are searched, and those found stand for their first k + 1 rows.
    nodes = staged(rows.groupBy("embedding").agg(F.min("vec_id").alias("low")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    own = staged(rows.join(nodes, "embedding").select("node", "vec_id", "asks"), "own")
    nth = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    firsts = own.select("node", "vec_id").withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("node", "vec_id")
    keyed = staged(curve_keys(nodes.select(F.col("node").alias("vec_id"), "embedding"), length, (mean, scale), curves, dims, bits, seed), "vectors")
    n = keyed.count()
    reach = max(k, math.ceil(n * window / 2))
    places = staged(on_curves(keyed), "places")
    seeking = own.filter("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("node").alias("of"))
    asked = seeking.select(F.col("of").alias("vec_id")).distinct()
    chunks = max(1, math.ceil(asked.count() * (2 * reach + block_rows) / max(n, 1) / QUERY_ROWS))
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")  # of the same type as on the other side, for equal hashes
    cells = places.withColumn("block", F.floor(F.col("position") / block_rows))
    body = nodes.select(F.col("node").alias("vec_id"), "embedding", "low")
    members = cells.join(body, "vec_id").withColumn("chunk", F.explode(F.array(*map(F.lit, range(chunks)))))
    first, last = (F.floor(F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col("position") + s)) / block_rows) for s in (-reach, reach))
    seekers = (
        places.join(asked, "vec_id").join(body, "vec_id").dropDuplicates(["vec_id", "curve"])
        .withColumn("chunk", chunk).withColumn("block", F.explode(F.sequence(first, last)))
    )

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids, at, low = (left[c].to_numpy() for c in ("vec_id", "position", "low"))
            x = left["embedding"].combine_chunks().flatten().to_numpy().reshape(len(ids), length)
            qids, qat = right["vec_id"].to_numpy(), right["position"].to_numpy()
            q = right["embedding"].combine_chunks().flatten().to_numpy().reshape(len(qids), length)
            squares, q_squares = (x * x).sum(1), (q * q).sum(1)
            for at_once in np.split(np.arange(len(qids)), range(MET_AT_ONCE, len(qids), MET_AT_ONCE)):
                near = np.abs(at - qat[at_once, None]) <= reach
                # Squared distances as a product of matrices are rounded otherwise than the score, by far less than ``slack``:
                # who is within it of the last rank has its score taken exactly.
                rough = np.where(near, squares + q_squares[at_once, None] - 2 * (q[at_once] @ x.T), np.inf)
                last = np.partition(rough, min(k, len(ids) - 1), axis=1)[:, min(k, len(ids) - 1)]
                slack = 1e-9 * (squares.max() + q_squares[at_once])
                if np.isfinite(slack).all():
                    near &= rough <= (last + slack)[:, None]
                which, who = np.nonzero(near)
                score = np.sqrt(((x[who] - q[at_once[which]]) ** 2).sum(1))
                order = np.lexsort((low[who], score, which))
                which, who, score = which[order], who[order], score[order]
                best = np.arange(len(which)) - np.searchsorted(which, which) <= k
                out["query_id"] += qids[at_once[which[best]]].tolist()
                out["vec_id"] += ids[who[best]].tolist()
                out["score"] += score[best].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    # New names for one side: both come from the same staged rows.
    seekers = seekers.select(*(F.col(c).alias(c) for c in ("vec_id", "embedding", "position", "curve", "block", "chunk")))
    members = members.select("vec_id", "embedding", "position", "curve", "block", "chunk", "low")
    sides = ("curve", "block", "chunk")
    met = members.groupBy(*sides).cogroup(seekers.groupBy(*sides)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = Window.partitionBy("of").orderBy("score", "low")
    found = met.distinct().select(F.col("query_id").alias("of"), F.col("vec_id").alias("node"), "score").join(nodes.select("node", "low"), "node")
    found = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    near = found.select("of", "node", "score").join(firsts, "node").join(seeking, "of").filter("vec_id != query_id")
    return near.select("query_id", "vec_id", "score").withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
