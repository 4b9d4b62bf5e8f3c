"""MinHash near-dedup with b-bit signatures.

Each document is its set of five-word shingles. ``HASHES`` minima are taken of the set's hashes; bands of
``ROWS`` whole minima (the first ``BANDS * ROWS``) generate candidates, and the lowest ``LOW_BITS`` bits of each minimum are packed into
longs. A candidate pair's similarity is estimated from the packed words by bit counts: equal positions have
share J + (1 - J) / 2^b, and inverting that corrects for chance collisions. Pairs whose estimate is below
``LEAST_ESTIMATE`` go; the rest are confirmed on the full shingle sets, so every link is exact.

Copies are collapsed first by the hash of their word sequence. Band keys are range-sorted, and only rows with a neighbour of
their key and of a size that fits go on. Members of a bucket meet hubs by turns (see ``linked``): a bucket of m near copies that
link costs about m pairs. Those that stay unconnected are copies just too different, mostly. Their shingles are ordered by how few of them have each, and
pairs meet that share one among the first: sets of 75 % similarity share one of the first seventh, and what is left behind the place of a shared one
bounds the overlap (an exact prefix filter). Copies that aren't similar enough have that many shingles of their own, and meet no one.

Chance of missing a pair of similarity 0.75: no common band (1 - 0.75^4)^32 = 5e-6; estimate below 0.65 at 256
hashes and 4 bits: 3.5 deviations, 2e-4; either matters only to a pair that nothing else connects.

Defined results: null and empty texts, and texts of whitespace, have no shingles, link with nothing and are kept;
a row without doc_id is kept, has no component and links with nothing; rows that repeat a doc_id are each judged
by their own text; ``kept`` marks every row whose doc_id is its component. Long texts count whole; ties go to the smallest doc_id;
columns besides doc_id and text don't matter, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import connected_components, crowded, dropped, linked, rarest, small, staged, unused

SHINGLE, THRESHOLD = 5, 75
BANDS, ROWS, LOW_BITS, HASHES = 32, 4, 4, 256
#: Pairs whose estimated similarity is less go unconfirmed.
LEAST_ESTIMATE = 0.65
#: Shingles are hashed in blocks of this many, which bounds memory for long texts.
BLOCK = 512

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_RNG = np.random.default_rng(2024)
_MULTIPLIERS = (_RNG.integers(0, 1 << 31, (HASHES, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_OFFSETS = _RNG.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


#: Random words for bytes (whitespace has none) and for places in a word, which make the hash of a word a sum.
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE[_SPACE] = 0
_IN_WORD = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def lowered(text: str | None) -> bytes:
    """The text's bytes with A-Z lowered."""
    return (text or "").encode().lower()


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words, in order, from whole-array operations over the bytes."""
    raw = np.frombuffer(data, np.uint8)
    solid = ~_SPACE[raw]
    starts = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1]))) if len(raw) else np.array([], np.int64)
    if not len(starts):
        return np.array([], np.uint64)
    lengths = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, lengths)
    terms = _BYTE[raw[starts[0] :]] * (_IN_WORD[place & 255] + (place >> 8).astype(np.uint64))
    return mixed(np.add.reduceat(terms, starts - starts[0]))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of the whole sequence if it is shorter."""
    w = word_hashes(lowered(text))
    if not len(w):
        return w
    n = min(SHINGLE, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h += w[i : len(w) - n + 1 + i] * _PLACE[i]
    h = np.sort(mixed(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each hash function (a x + b modulo 2^32, of the upper half of each hash) over the set."""
    upper = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(upper), BLOCK):
        values = upper[None, at : at + BLOCK] * _MULTIPLIERS
        values += _OFFSETS
        np.minimum(low, values.min(axis=1), out=low)
    return low.astype(np.uint64)


def packed(low: np.ndarray) -> np.ndarray:
    """The lowest bits of each (mixed) minimum, packed into 64-bit words; ``low`` has a row a document."""
    bits = mixed(low) & np.uint64((1 << LOW_BITS) - 1)
    per = 64 // LOW_BITS
    shift = (np.arange(HASHES, dtype=np.uint64) % np.uint64(per)) * np.uint64(LOW_BITS)
    return np.bitwise_or.reduce((bits << shift).reshape(len(low), HASHES // per, per), axis=2).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, of its minima and its number; ``low`` has a row a document."""
    rows = low[:, : BANDS * ROWS].reshape(len(low), BANDS, ROWS)
    key = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX), rows.shape[:2])
    for i in range(ROWS):
        key = mixed(key + rows[:, :, i])
    return key.view(np.int64)


def spread(rows: np.ndarray, some: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of equal length where ``some`` holds, nulls elsewhere."""
    ends = np.concatenate(([0], np.cumsum(some * rows.shape[1]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()), type=kind, mask=pa.array(~some))


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, version, n_shingles, copy, low_bits, bands`` for every row; ``version`` is the hash of its text, ``copy`` names the word sequence (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = part.column("text").to_pylist()
                sets = [shingles(t) for t in texts]
                some = np.array([len(s) > 0 for s in sets])
                low = np.array([minima(s) for s in sets if len(s)], np.uint64).reshape(-1, HASHES)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("version"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(b" ".join(lowered(t).split())) if x else None for t, x in zip(texts, some, strict=True)], pa.binary()),
                        spread(packed(low), some, longs),
                        spread(band_keys(low), some, longs),
                    ],
                    names=["doc_id", "version", "n_shingles", "copy", "low_bits", "bands"],
                )

    return versions(docs).mapInArrow(run, "doc_id bigint, version bigint, n_shingles bigint, copy binary, low_bits array<bigint>, bands array<bigint>")


def versions(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


#: Columns with the packed words.
WORDS = [f"w{i}" for i in range(HASHES * LOW_BITS // 64)]


def estimate(x: str, y: str) -> Column:
    """Similarity from packed low bits: unequal positions are folded to one bit each and counted. ``x`` and ``y`` are prefixes of the columns."""
    once = sum(1 << i for i in range(0, 64, LOW_BITS))
    once = once - (1 << 64) if once >= 1 << 63 else once

    def unequal(word: str) -> Column:
        d = F.col(x + word).bitwiseXOR(F.col(y + word))
        for s in (1 << i for i in range(LOW_BITS.bit_length() - 1)):
            d = d.bitwiseOR(F.shiftrightunsigned(d, s))
        return F.bit_count(d.bitwiseAND(F.lit(once).cast("bigint")))

    apart = sum((unequal(w) for w in WORDS), F.lit(0))
    equal, chance = 1 - apart / F.lit(float(HASHES)), 1 / (1 << LOW_BITS)
    return (equal - chance) / (1 - chance)


def alike(x: str, y: str) -> Column:
    """Whether two sets are candidates by their sizes and packed minima."""
    m, n = F.col(x + "shingles"), F.col(y + "shingles")
    return (100 * F.least(m, n) >= THRESHOLD * F.greatest(m, n)) & (estimate(x, y) >= LEAST_ESTIMATE)


def whole_sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``id, shingles``: the full sets of the documents at ``doc_id, version`` of each ``id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                sets = [shingles(t).view(np.int64) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets))).cast(pa.list_(pa.int64()))], names=["id", "shingles"])

    found = versions(docs).join(small(staged(places, "wanted")), ["doc_id", "version"]).select("id", "text").mapInArrow(run, "id bigint, shingles array<bigint>")
    # Rows with the same doc_id and text give their set twice.
    return staged(found.dropDuplicates(["id"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets have 100 |A and B| >= 75 |A or B|."""
    # Each set is once in a hash table; pairs, long rows once they have a set, are never sorted.
    side = lambda i, c: sets.select(F.col("id").alias(i), F.col("shingles").alias(c)).hint("shuffle_hash")
    full = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a")
    both = full.select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), F.size(F.array_intersect("x", "y")).alias("both"))
    return both.filter(100 * F.col("both") >= THRESHOLD * (F.col("sizes") - F.col("both"))).select("a", "b")


def rare_shingles(sets: DataFrame) -> DataFrame:
    """``id, key, place``: of each set, ordered by how few sets have a shingle, the first shingles, so many that two sets similar enough share one of them."""
    features = sets.select("id", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    placed = rarest(features.select("id", "key")).join(sets.select("id", F.size("shingles").alias("size")), "id")
    return placed.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * THRESHOLD / 100)).select("id", "key", "place")


def may_overlap(x: str, y: str) -> Column:
    """Whether sets that share a shingle at these places can have enough in common: what follows in either bounds it.

    Of the smaller set, the first n + 1 - a shingles hold one in common, where a is the least overlap with a set of its size or more.
    """
    m, n, i, j = F.col(x + "shingles"), F.col(y + "shingles"), F.col(x + "place"), F.col(y + "place")
    least = lambda sizes: F.ceil(sizes * THRESHOLD / (100 + THRESHOLD))
    x_smaller = (m < n) | ((m == n) & (F.col(x + "id") < F.col(y + "id")))
    early = F.when(x_smaller, i <= m - least(2 * m)).otherwise(j <= n - least(2 * n))
    return early & (F.least(m - i, n - j) >= least(m + n))


def components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, members)``: ``rows`` as of :func:`signed`, staged; ``members``: ``copy, component`` of every distinct word sequence."""
    rows = staged(signed(docs), "signatures")
    # One document stands for each word sequence.
    first = rows.filter("copy is not null and doc_id is not null").groupBy("copy").agg(F.min(F.struct("doc_id", "version")).alias("first"), F.count("*").alias("n"))
    firsts = staged(first.select("copy", "first.*", "n", F.monotonically_increasing_id().alias("id")), "firsts")
    at = rows.join(firsts, ["copy", "doc_id", "version"]).dropDuplicates(["copy", "doc_id", "version"])
    nodes = staged(at.select("id", "doc_id", "version", "n", F.col("n_shingles").alias("shingles"), "bands", *(F.col("low_bits")[i].alias(w) for i, w in enumerate(WORDS))), "nodes")
    buckets = crowded(nodes.select(F.explode("bands").alias("key"), F.col("shingles").alias("size"), "id"), 1 - THRESHOLD / 100).select("key", "id")
    sets = whole_sets(docs, nodes.join(buckets.select("id").distinct(), "id").select("id", "doc_id", "version"))
    finer = lambda ids: rare_shingles(sets.join(ids, "id"))
    links = linked(buckets, nodes.select("id", "n", "shingles", *WORDS), alike, lambda pairs, _: confirmed(pairs, sets), finer, may_overlap)
    dropped(sets)
    placed = staged(firsts.join(connected_components(links), "id", "left").select("copy", "doc_id", F.coalesce("component", "id").alias("group")), "placed")
    smallest = staged(placed.groupBy("group").agg(F.min("doc_id").alias("component")), "smallest")
    return rows, staged(placed.join(smallest, "group").select("copy", "component"), "members")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    rows, members = components(docs)
    joined = rows.select("doc_id", "n_shingles", "copy").join(members, "copy", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one whose doc_id names it (of its texts that with the smallest hash), once.

    What goes is named by doc_id and a hash of the text, so that texts aren't shuffled unless too much goes to be broadcast.
    """
    of, version = unused(docs.columns, "of", "version")
    rows, members = components(docs)
    judged = staged(rows.filter("copy is not null and doc_id is not null").groupBy("copy", "doc_id", "version").agg(F.count("*").alias("n")).join(members, "copy"), "judged")
    stays = staged(judged.groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("stays")), "stays")
    gone = judged.join(stays, "component").filter(F.struct("doc_id", "version") != F.col("stays")).select(F.col("doc_id").alias(of), F.col("version").alias(version))
    again = judged.join(stays, "component").filter((F.struct("doc_id", "version") == F.col("stays")) & (F.col("n") > 1)).select(F.col("doc_id").alias(of), F.col("version").alias(version))
    gone, again = staged(gone, "gone"), staged(again, "again")
    same = (F.col("doc_id").cast("bigint") == F.col(of)) & (F.xxhash64(F.col("text").cast("string")) == F.col(version))
    left = docs.join(small(gone), same, "left_anti")
    if again.isEmpty():
        return left
    # Rows repeated with their text: one stays.
    repeated = docs.join(small(again), same).dropDuplicates([of, version]).select(*docs.columns)
    return left.join(small(again), same, "left_anti").unionByName(repeated)
