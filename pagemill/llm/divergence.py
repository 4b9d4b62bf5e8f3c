"""Source divergence audit: how far the words of each source are from those of its language and of its other sources.

Terms are runs of letters (A-Z lowered; every character beyond ASCII is a letter). A language keeps the terms that occur in at least
``LEAST_DOCUMENTS`` of its documents. Each source of a language, and the language as a whole, gives term t the share
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), where V terms are kept and the group has N occurrences of them; the divergence of two shares
is f = floor((p - q)^2 / (p + q)). All arithmetic is of whole numbers.

Method: a count-min sketch of document frequencies comes first. Each task counts the documents of each (language, term) in ``DEPTH`` rows of
cells, one cell a row for ``CELL_BYTES`` bytes of text; sketches are added up piece by piece. A sketch never underestimates, so a term with a cell under the least document frequency can't be kept, and it is
discarded before anything is shuffled. Survivors are counted exactly, by (language, source, term), and those that collisions had let
through go then. Counts are sparse, so a pair of sources needs only the terms both have: for the others the sum of f depends on a
count alone, and is taken over the distinct counts of each source.

How it scales: a task holds the cells of its own terms only, each cell stops at 255 (over any threshold allowed), and the driver and the executors
hold one bit a cell, of at most ``WIDEST`` cells a row (48 MB); with more text than that is for, the sketch lets more terms through, and results stay the same. Counts are
combined in the task and by partial aggregation before the shuffle, by term, so a source or language with a third of all rows is spread over
all tasks. The pair join is by (language, term) and makes a row for each pair of sources that share the term, added up before it is shuffled.

Defined results: null text, lang and source are ''; a source with no kept term has its shares all the same; a language without kept terms
has pairs of value 0 and no terms; rows that repeat a doc_id are documents each; very long texts count whole; ties go by the
bytes of the item; other columns don't matter, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.minhash import mixed
from pagemill.llm.shared import dropped, slices, small, solid_runs, staged

LEAST_DOCUMENTS, TOP = 10, 10
#: Rows of the sketch, cells that are added up together, bytes of text for each cell of a row, and the most cells a row has.
DEPTH, PIECE, CELL_BYTES, WIDEST = 3, 1 << 12, 256, 1 << 27
SCALE = 1_000_000_000

_LETTER = np.array([chr(i).isalpha() if i < 128 else True for i in range(256)])
_LOWER = np.array([i | 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_BYTE = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_IN_TERM = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings that aren't empty, from whole-array operations over their bytes."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    if not len(strings):
        return np.array([], np.uint64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    place = np.arange(len(raw)) - np.repeat(at[:-1] - at[0], np.diff(at))
    return mixed(np.add.reduceat(_BYTE[raw] * (_IN_TERM[place & 255] + (place >> 8).astype(np.uint64)), at[:-1] - at[0]))


def cells(group: np.ndarray, term: np.ndarray, width: int) -> np.ndarray:
    """The cell in each row of the sketch (a row of the result each) of terms in groups, both given by their hashes; rows lie end to end."""
    own = mixed(group + term)
    return np.stack([(mixed(own + np.uint64(k)) % np.uint64(width)).astype(np.int64) + k * width for k in range(DEPTH)])


def _group_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's value, and the hashes of the values by number."""
    coded = column.cast(pa.large_string()).dictionary_encode()
    tagged = pa.array([f".{x}" for x in coded.dictionary.to_pylist()], pa.large_string())  # none is empty
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), string_hashes(tagged)


def by_words(docs: DataFrame) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(name("lang"), name("source"), name("text"))


def sketched(docs: DataFrame, least: int, width: int) -> np.ndarray:
    """One bit for each cell of the merged sketch: whether ``least`` documents and more may have what falls there."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, more = np.array([], np.int64), np.array([], np.int64), []

        def folded() -> tuple[np.ndarray, np.ndarray]:
            cell, which = np.unique(np.concatenate([held, *(c for c, _ in more)]), return_inverse=True)
            return cell, np.minimum(np.bincount(which, weights=np.concatenate([sums, *(n for _, n in more)])), 255).astype(np.int64)

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                row, code, terms = solid_runs(part.column("text"), _LETTER, _LOWER)
                n_terms = max(1, len(terms))
                lang, names = _group_hashes(part.column("lang"))
                once = np.unique(row * n_terms + code)
                pair, n = np.unique(lang[once // n_terms] * n_terms + once % n_terms, return_counts=True)
                at = cells(names[pair // n_terms], string_hashes(terms)[pair % n_terms], width)
                more.append((at.ravel(), np.tile(n, DEPTH)))
                if sum(len(c) for c, _ in more) > len(held) + (1 << 20):
                    (held, sums), more = folded(), []
        held, sums = folded()
        edges = np.flatnonzero(np.diff(held // PIECE, prepend=-1, append=-1))[: None if len(held) else 0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            packed = (held[a:b] % PIECE).astype(np.uint16).tobytes() + sums[a:b].astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([held[a] // PIECE], pa.int64()), pa.array([packed], pa.binary())], names=["piece", "cells"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(PIECE, np.int64)

        def flags() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["piece", "cells"])

        for batch in batches:
            for piece, packed in zip(batch.column("piece").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if piece != now:
                    if now is not None:
                        yield flags()
                    now, total = piece, np.zeros(PIECE, np.int64)
                n = len(packed) // 3
                total[np.frombuffer(packed, np.uint16, n)] += np.frombuffer(packed, np.uint8, n, 2 * n)
        if now is not None:
            yield flags()

    kinds = "piece bigint, cells binary"
    pieces = by_words(docs).select("lang", "text").mapInArrow(counted, kinds).repartition("piece").sortWithinPartitions("piece").mapInArrow(merged, kinds)
    bits = np.zeros((DEPTH * width // PIECE, PIECE // 8), np.uint8)
    for r in pieces.toLocalIterator():
        bits[r["piece"]] = np.frombuffer(r["cells"], np.uint8)
    return bits.ravel()


def term_counts(docs: DataFrame, least: int, width: int) -> DataFrame:
    """``lang, source, term, n, docs`` of every term the sketch lets through: its occurrences in the source's texts, and the documents that have it."""
    bits = docs.sparkSession.sparkContext.broadcast(sketched(docs, least, width).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                row, code, terms = solid_runs(part.column("text"), _LETTER, _LOWER)
                n_terms = max(1, len(terms))
                lang, names = _group_hashes(part.column("lang"))
                # What the sketch rules out goes, for each language and term once.
                seen, which = np.unique(lang[row] * n_terms + code, return_inverse=True)
                at = cells(names[seen // n_terms], string_hashes(terms)[seen % n_terms], width)
                stays = (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=0)[which]
                row, code = row[stays], code[stays]
                source = part.column("source").dictionary_encode()
                _, first, group = np.unique(lang * max(1, len(source.dictionary)) + source.indices.to_numpy(), return_index=True, return_inverse=True)
                key, n = np.unique(group[row] * n_terms + code, return_counts=True)
                once = np.unique(row * n_terms + code)
                n_docs = np.unique(group[once // n_terms] * n_terms + once % n_terms, return_counts=True)[1]
                of = pa.array(first[key // n_terms])
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang").take(of), part.column("source").take(of), terms.take(pa.array(key % n_terms)).cast(pa.string()), pa.array(n), pa.array(n_docs)],
                    names=["lang", "source", "term", "n", "docs"],
                )

    found = by_words(docs).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), null if nothing is kept; the product may need more than 64 bits."""
    product = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(kept > 0, 1 + F.call_function("div", product, (total + 2 * kept).cast("decimal(20,0)")))


def apart(p: Column, q: Column) -> Column:
    """The divergence of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audited(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source, how far it is from the others of its language (part ``pair``), and by what terms it
    is above its language as a whole (part ``term``, the first ``top``)."""
    if not 1 <= least <= 255:
        raise ValueError("a threshold from 1 to 255 documents can be asked for")
    groups = staged(by_words(docs).groupBy("lang", "source").agg(F.sum(F.octet_length("text").cast("bigint")).alias("bytes")), "groups")
    n_bytes = groups.agg(F.sum("bytes")).first()[0] or 0
    width = min(WIDEST, max(PIECE, 1 << (n_bytes // cell_bytes).bit_length()))
    counts = staged(term_counts(docs, least, width), "counts")
    kept = staged(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs"), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("total"))
    per = staged(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all"), "own")
    dropped(counts)
    of = per.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("terms"))
    told = groups.select("lang", "source").join(of, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["size", "terms", "v", "total"])
    told = small(staged(told.withColumn("p0", share(F.lit(0), F.col("size"), F.col("v"))), "told"))
    shares = per.join(told, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("size"), F.col("v")).alias("p"), "p0", share(F.col("all"), F.col("total"), F.col("v")).alias("q"))
    shares = staged(shares, "shares")

    rank = lambda: Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(rank())).filter(F.col("rank") <= top)

    x, y = told.alias("x"), told.alias("y")
    across = lambda a, b: (F.col(f"{a}.lang") == F.col(f"{b}.lang")) & (F.col(f"{a}.source") != F.col(f"{b}.source"))
    pair = lambda a, b, value: (F.col(f"{a}.lang").alias("lang"), F.col(f"{a}.source").alias("source"), F.col(f"{b}.source").alias("item"), F.coalesce(value, F.lit(0)).cast("bigint").alias("value"))
    # Terms that neither has; those of one, against the other's share of nothing; and what the terms of both make this wrong by.
    p0, q0 = F.col("x.p0"), F.col("y.p0")
    neither = x.join(y, across("x", "y")).select(*pair("x", "y", (F.col("x.v") - F.col("x.terms") - F.col("y.terms")) * apart(p0, q0)))
    levels = staged(shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m")), "levels").alias("h")
    of_one = F.col("m") * apart(F.col("h.p"), F.col("y.p0"))
    ones = levels.join(y, across("h", "y"))
    ones = ones.select(*pair("h", "y", of_one)).unionByName(ones.select(*pair("y", "h", of_one)))
    a, b = shares.alias("a"), shares.alias("b")
    met = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    p, q, p0, q0 = (F.col(c) for c in ("a.p", "b.p", "a.p0", "b.p0"))
    wrong = met.select(*pair("a", "b", apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0))).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    wrong = staged(wrong, "both")
    turned = wrong.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = neither.unionByName(ones).unionByName(wrong).unionByName(turned)
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(rank()))
    return pairs.select("lang", "source", "part", "item", "value", "rank").unionByName(terms)
