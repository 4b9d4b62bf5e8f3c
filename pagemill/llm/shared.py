"""What several operators of this package share: cut lineage, link buckets, find components, sum along an order."""

from __future__ import annotations

import functools
import math
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The whitespace that separates words in every contract of this package: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in local mode, if unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/pagemill-{spark.sparkContext.applicationId}"


#: With it, shuffle files go when the query that made them ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the tables staged on the way to a result of :func:`distilled`.
_on_the_way: ContextVar[list[str] | None] = ContextVar("_on_the_way", default=None)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, its shuffle files go, and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pagemill/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if (paths := _on_the_way.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def distilled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, staged; all tables that were staged on the way to it are deleted then, so nothing else may read them."""
    paths: list[str] = []
    token = _on_the_way.set(paths)
    try:
        out = staged(make(), name)
    finally:
        _on_the_way.reset(token)
    _deleted(out.sparkSession, paths[:-1])
    if (outer := _on_the_way.get()) is not None:
        outer.append(paths[-1])
    return out


def sent(context: SparkContext, value: object) -> Broadcast:
    """``value`` broadcast as bytes that hold its classes too, so that executors needn't have this package; read by :func:`received`."""
    return context.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast) -> object:
    return pickle.loads(shared.value)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`staged` which nothing reads any more."""
    _deleted(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def _deleted(spark: SparkSession, folders: Iterable[str]) -> None:
    for folder in folders:
        if "/pagemill/" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crowded(keyed: DataFrame, rate: float, passes: int = 1) -> DataFrame:
    """The rows (``key, size, id``) that have a neighbour of the same key whose size is less by a share of ``rate`` at most, each once, and a few more; staged.

    Rows are range-sorted by all three columns, so that a key that a third of all rows have is many tasks' work. A row stays if the one before
    or after it in its piece is such a neighbour; of what lies beyond its ends a piece knows nothing, and its first and last rows stay.
    Each of the ``passes`` takes its share of the keys, so that only this share's shuffle files are on disk at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "size", "id"]
        key, size, name = (np.array([], np.int64),) * 3  # the last row so far, of which it is open whether it stays
        stays = True
        for batch in batches:
            key, size, name = (np.concatenate((x, batch.column(c).to_numpy())) for x, c in zip((key, size, name), names, strict=True))
            if not len(key):
                continue
            fresh = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))
            key, size, name = key[fresh], size[fresh], name[fresh]
            pairs = (key[1:] == key[:-1]) & (size[1:] - size[:-1] <= rate * size[1:])
            keep = np.append(False, pairs) | np.append(pairs, False)
            keep[0] |= stays
            out = np.flatnonzero(keep[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, size, name)], names=names)
            key, size, name, stays = key[-1:], size[-1:], name[-1:], bool(keep[-1])
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, size, name)], names=names)

    spark = keyed.sparkSession
    pieces = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = []
    for i in range(passes):
        mine = keyed.select("key", "size", "id").filter(F.pmod("key", F.lit(passes)) == i) if passes > 1 else keyed.select("key", "size", "id")
        ordered = mine.repartitionByRange(pieces, "key", "size", "id").sortWithinPartitions("key", "size", "id")
        parts.append(staged(ordered.mapInArrow(run, "key bigint, size bigint, id bigint"), "buckets"))
    return functools.reduce(DataFrame.unionByName, parts)


#: Star passes go on while they link at least this share of the pairs they try, and so many at most.
STAR_ROUNDS, FRUITFUL = 4, 0.2


def linked(
    buckets: DataFrame,
    facts: DataFrame,
    alike: Callable[[str, str], Column],
    confirm: Callable[[DataFrame, bool], DataFrame],
    finer: Callable[[DataFrame], DataFrame] | None = None,
    meet: Callable[[str, str], Column] = lambda x, y: F.lit(True),
    bounds: tuple[Callable[[DataFrame], DataFrame], Callable[[str, str], Column]] | None = None,
    links: DataFrame | None = None,
    tried: DataFrame | None = None,
    sizes: tuple[str, float] | None = None,
) -> DataFrame:
    """Confirmed links ``(a, b)`` that connect all that can be connected by pairs of one bucket which ``alike`` and ``confirm`` accept.

    ``buckets`` has columns ``key`` and ``id`` (if staged, its files are deleted as soon as they are used up); ``facts`` has by ``id`` the columns that ``alike("x.", "y.")`` reads,
    and ``n``, how many equal ones it stands for. First each bucket's members meet its hub: the one with most equals (an original is often
    copied whole too), then by turns one at random. Links contract members to
    components, and pairs within a component change nothing, so a bucket of m near copies costs about m pairs. A bucket of two that aren't alike is done with. When a round
    brings few links, what is left are members of one bucket that aren't connected; their pairs meet in a join whose condition rejects before a row is made.
    ``confirm`` gets pairs and whether these are the first round's, for which it may give, with ``near``, whether a pair is linked, also a few features of either that the other lacks
    (``own_a, own_b``): then members that the same hub has met meet only if they share a feature that the hub lacks, as far copies of one original don't, unless they share edits.
    With ``finer`` they are dealt out anew before: it gives for a table of ids (``id``) keys (``id, key`` and what ``meet("x.", "y.")`` reads) of what is rare in each among all
    that are left, so that copies just too far from each other, whose pairs would be many, mostly don't meet.
    ``bounds`` give further facts to rows with an ``id``, and a condition on them that no pair fails which can be linked: of the pairs that hubs leave only those are made that meet it, each once,
    in the first of the buckets that both are in. ``links`` are those known before, which the result contains, and ``tried`` the pairs ``(a, b)`` that were looked at for them.
    ``sizes`` names a column of ``facts``, and the share of the larger by which it may differ in pairs that are alike: of the pairs that hubs leave only those are tested that are in the same class of size or in the next.
    """
    rows = staged(buckets.join(facts, "id"), "rows")
    dropped(buckets)
    groups, views = None if links is None else connected_components(links), None
    names = [c for c in rows.columns if c != "key"]
    for turn in range(STAR_ROUNDS):
        live = _open(rows, groups)
        order = F.struct(-F.col("n"), "id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        hubs = staged(live.groupBy("key").agg(F.min_by(F.struct(*names, "component"), order).alias("hub"), F.count("*").alias("members")).select("key", "members", "hub.*"), "hubs")
        x, y = hubs.alias("x"), live.alias("y")
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & alike("x.", "y."))
        met = staged(met.select("x.key", F.col("y.id").alias("id"), F.col("x.id").alias("hub"), F.col("x.n").alias("hub_n")), "met")
        if turn == 0:
            some = hubs.filter("members > 2").select("key").union(met.select("key")).distinct()
            fewer = staged(rows.join(some, "key", "left_semi"), "rows")
            dropped(rows)
            rows = fewer
        else:
            dropped(live)
        # Of the hubs of its buckets, each member meets one a round.
        one = met.groupBy("id").agg(F.min_by("hub", F.struct(-F.col("hub_n"), "hub")).alias("hub"))
        # The first round looks again at pairs that were tried before, for what their members have of their own.
        fresh, found, n = _settled(one.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")), tried if turn else None, lambda pairs, first=not turn: confirm(pairs, first))
        dropped(hubs)
        if not n:
            break
        tried = fresh if tried is None else tried.unionByName(fresh)
        if "near" in found.columns:
            if "own_a" in found.columns:
                of = lambda i, j: found.select(F.col(i).alias("id"), F.col(j).alias("hub"), F.col(f"own_{i}").alias("own"))
                views = staged(one.join(of("a", "b").unionByName(of("b", "a")), ["id", "hub"]), "views")
            found = found.filter("near").select("a", "b")
        dropped(met)
        n_found = found.count()
        if n_found:
            links = found if links is None else links.unionByName(found)
            groups = connected_components(links)
        if n_found < FRUITFUL * n:
            break
    left = _open(rows, groups)
    if groups is not None:
        dropped(rows)
    if finer:
        ids = staged(left.drop("key").dropDuplicates(["id"]), "left")
        dropped(left)
        left = staged(finer(ids.select("id")).join(ids, "id"), "finer")
    once = F.lit(True)
    if views is not None or bounds:
        seen = left if views is None else left.join(views, "id", "left")
        if bounds:
            keys = left.groupBy("id").agg(F.collect_set("key").alias("keys"))
            seen = seen.join(bounds[0](keys), "id")
            once = F.forall(F.array_intersect("x.keys", "y.keys"), lambda key: key >= F.col("x.key")) & bounds[1]("x.", "y.")
        seen = staged(seen, "left")
        dropped(left)
        left = seen
    if views is not None:
        met_already = (F.col("x.hub") == F.col("y.id")) | (F.col("y.hub") == F.col("x.id"))
        strangers = (F.col("x.hub") == F.col("y.hub")) & ~F.arrays_overlap("x.own", "y.own")
        meet = lambda x, y: ~F.coalesce(met_already | strangers, F.lit(False))
    x, y = left.alias("x"), left.alias("y")
    first = F.col("x.id") < F.col("y.id")
    if sizes:
        kind = F.floor(F.log(F.col(sizes[0])) / (-math.log(1 - sizes[1]) * 1.0001))
        x, y = left.withColumn("kind", F.explode(F.array(kind, kind + 1))).alias("x"), left.withColumn("kind", kind).alias("y")
        m, n = F.col(f"x.{sizes[0]}"), F.col(f"y.{sizes[0]}")
        first = (F.col("x.kind") == F.col("y.kind")) & ((m < n) | ((m == n) & first))
    across = (F.col("x.key") == F.col("y.key")) & first & (F.col("x.component") != F.col("y.component"))
    met = x.join(y, across & alike("x.", "y.") & meet("x.", "y.") & once).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    _, found, n = _settled(met, tried, lambda pairs: confirm(pairs, False))
    if n:
        found = found.filter("near").select("a", "b") if "near" in found.columns else found
        links = found if links is None else links.unionByName(found)
    return links if links is not None else rows.sparkSession.createDataFrame([], T.StructType([T.StructField("a", rows.schema["id"].dataType), T.StructField("b", rows.schema["id"].dataType)]))


def rarest(features: DataFrame) -> DataFrame:
    """``id, key, place`` of each feature (``id, key``, each once) that another id has too: its place, from 0, among the id's features by how few ids have them."""
    common = features.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    alone = features.groupBy("id").agg(F.count("*").alias("size"))
    shared = features.join(common, "key")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("n", "key")) - 1
    n_shared = F.count("*").over(Window.partitionBy("id"))
    return shared.withColumn("nth", nth).withColumn("shared", n_shared).join(alone, "id").select("id", "key", (F.col("size") - F.col("shared") + F.col("nth")).alias("place"), "nth")


def _settled(pairs: DataFrame, tried: DataFrame | None, confirm: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None, int]:
    """The pairs that are new, of these the confirmed ones (nothing if none is new), and how many are new."""
    pairs = pairs.distinct()
    fresh = staged(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    n = fresh.count()
    return fresh, distilled(lambda: confirm(fresh), "links") if n else None, n


def _open(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The rows of buckets that span several components, with ``component``."""
    if groups is None:
        return rows.withColumn("component", F.col("id"))
    labelled = staged(rows.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
    spans = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    out = staged(labelled.join(spans, "key"), "open")
    dropped(labelled)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``edges`` (columns ``a``, ``b``); component is the smallest id reachable.

    Each round hooks every node to its smallest neighbour, follows the pointers to their roots by
    doubling, and contracts the edges to roots. Edges shrink each round; nothing is collected.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    live = staged(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct(), "edges")
    labels = None
    while not live.isEmpty():
        parent = staged(live.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("parent")), "parent")
        while True:
            up = parent.select(F.col("id").alias("up"), F.col("parent").alias("grand"))
            jumped = staged(
                parent.join(up, parent.parent == up.up, "left").select("id", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")),
                "jumped",
            )
            dropped(parent)
            parent = jumped
            if parent.filter("moved").isEmpty():
                break
        parent = parent.select("id", "parent")
        if labels is None:
            fresh = parent.select("id", F.col("parent").alias("component"))
        else:
            step = parent.select(F.col("id").alias("was"), "parent")
            moved = labels.join(step, labels.component == step.was, "left").select("id", F.coalesce("parent", "component").alias("component"))
            fresh = moved.unionByName(parent.join(labels, "id", "left_anti").select("id", F.col("parent").alias("component")))
        new_labels = staged(fresh, "labels")
        low = parent.select(F.col("id").alias("x"), F.col("parent").alias("px"))
        high = parent.select(F.col("id").alias("y"), F.col("parent").alias("py"))
        contracted = (
            live.join(low, live.lo == low.x, "left")
            .join(high, live.hi == high.y, "left")
            .select(F.coalesce("px", "lo").alias("u"), F.coalesce("py", "hi").alias("v"))
            .filter("u != v")
            .select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo"))
            .distinct()
        )
        new_live = staged(contracted, "edges")
        dropped(live)
        dropped(parent)
        if labels is not None:
            dropped(labels)
        live, labels = new_live, new_labels
    if labels is None:
        return spark.createDataFrame([], T.StructType([T.StructField("id", kind), T.StructField("component", kind)]))
    roots = labels.select(F.col("component").alias("id"), "component").distinct()
    return labels.unionByName(roots)


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row begins (one more: the end). Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together have about ``most`` bytes; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, at = raw_texts(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


#: A side is broadcast if its rows have been counted to take at most so many bytes; a larger one is shuffled.
FEW_BYTES = 64 << 20


def n_bytes(df: DataFrame) -> int:
    """About how many bytes the rows take: 16 and 8 a column, and what strings and the elements of lists take."""
    each = F.lit(16 + 8 * len(df.columns)).cast("bigint")
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            each += F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            width = 8 + 16 * len(field.dataType.elementType) if isinstance(field.dataType.elementType, T.StructType) else 8
            each += F.greatest(F.size(field.name), F.lit(0)) * width
    return df.agg(F.sum(each)).first()[0] or 0


def small(df: DataFrame, most: int = FEW_BYTES) -> DataFrame:
    """``df`` (a staged table) marked for broadcast if its rows take at most ``most`` bytes, else as it is."""
    return F.broadcast(df) if n_bytes(df) <= most else df


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of the table needs (whatever its case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def solid_runs(column: pa.Array, solid: np.ndarray, replaced: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(row, code, terms)`` of every longest run of bytes that ``solid`` (a flag for each byte) holds for, in order.

    ``row`` is the number of its text, ``terms[code]`` the run itself as a string; equal runs have equal codes. ``replaced``
    gives each byte another (lower case, say). Runs end with their text.
    """
    data, at = raw_texts(column)
    keep = solid[data]
    before = np.concatenate(([False], keep[:-1])) if len(keep) else keep
    before[at[:-1][at[:-1] < len(data)]] = False
    begins = np.flatnonzero(keep & ~before)
    places = np.flatnonzero(keep)
    inside = data[places] if replaced is None else replaced[data[places]]
    ends = np.append(np.searchsorted(places, begins), len(places))
    runs = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(inside))])
    coded = runs.dictionary_encode()
    row = np.searchsorted(at, begins, side="right") - 1
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
