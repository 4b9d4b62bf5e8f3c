"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs with at most k edits keeps at least m - q + 1 - k q of its
q-grams, and they lie within k + 1 neighbouring diagonals (text position less passage position). So
for each document the q-grams shared with every passage are counted in overlapping bands of
2 (k + 1) diagonals; bands that reach the bound are retained and verified by an alignment confined
to the band. Nothing within the edit budget can be lost, and what is reported is exact.

The passages form an index that goes to every task. Its size is checked: passages are taken in blocks
of about ``block_chars`` characters, one pass over the documents each (one block in practice); a pass ends, its finds written
down, before the next block is read, so that one index is in memory at a time.

Text is compared after lower-casing single characters and reading every run of whitespace as one
space; reported spans are code points of the original text, end exclusive.

Defined results: null and empty texts and items match nothing; passages under ``LEAST_CHARS`` characters
are no evidence and are left out; repeated rows of documents repeat their rows; repeated item ids
are each searched; ties between overlapping finds of an item go to fewer edits, then the earlier; other columns, whatever their names,
don't matter; empty tables give empty tables. Long texts are read whole, in overlapping pieces, and monotonous ones in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import received, sent, staged

Q, EDIT_RATE, LEAST_CHARS = 8, 0.1, 32
BLOCK_CHARS = 8_000_000
PIECE = 1 << 18
#: So many pairs of a gram and its place in a passage are counted at a time (a gram's own places always together).
RUN = 1 << 20

_MULTIPLY = np.uint64(0xBF58476D1CE4E5B9)
#: By rule: the lower-case form of each character of the basic plane that has a single one; whitespace is a space.
_PLAIN = np.array([32 if chr(i).isspace() else ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x10000)], np.uint32)


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points and the original position of each."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = np.where(raw < 0x10000, _PLAIN[np.minimum(raw, 0xFFFF)], raw)
    space = plain == 32
    kept = np.flatnonzero(~(space & np.concatenate(([True], space[:-1])))) if len(raw) else np.array([], np.int64)
    if len(kept) and plain[kept[-1]] == 32:
        kept = kept[:-1]
    return plain[kept], kept


def grams(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position."""
    if len(points) < Q:
        return np.array([], np.uint64)
    h, width, factor = points.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while width < Q:  # from the hashes of halves: Q is a power of two
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    h *= _MULTIPLY
    return h ^ (h >> np.uint64(29))


@dataclass
class Index:
    """Passages and where each of their q-grams occurs."""

    ids: list
    passages: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    table: np.ndarray  # one bit for each value of a gram's upper bits
    shift: np.uint64
    keys: np.ndarray  # distinct grams, sorted
    first: np.ndarray  # of each key in items and places
    items: np.ndarray
    places: np.ndarray


def build_index(rows: list[tuple[int, str]]) -> Index | None:
    kept = [(i, p) for i, t in rows if t and len(p := folded(t)[0]) >= LEAST_CHARS]
    if not kept:
        return None
    sizes = np.array([len(p) for _, p in kept])
    budget = np.minimum((EDIT_RATE * sizes).astype(np.int64), (sizes - Q) // Q)
    hashes = [grams(p) for _, p in kept]
    flat = np.concatenate(hashes)
    items = np.repeat(np.arange(len(kept)), [len(h) for h in hashes])
    places = np.concatenate([np.arange(len(h)) for h in hashes])
    order = np.argsort(flat, kind="stable")
    keys, first = np.unique(flat[order], return_index=True)
    bits = max(16, int(np.ceil(np.log2(len(keys) * 32))))
    shift = np.uint64(64 - bits)
    slots = np.unique((keys >> shift).astype(np.int64))
    table = np.zeros(1 << (bits - 3), np.uint8)
    np.bitwise_or.at(table, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return Index([i for i, _ in kept], [p for _, p in kept], budget, sizes - Q + 1 - budget * Q, table, shift, keys, np.append(first, len(flat)), items[order].astype(np.int32), places[order].astype(np.int32))


def candidates(points: np.ndarray, index: Index) -> list[tuple[int, int, int]]:
    """``(item, low, high)``: diagonals low to high - 1 hold enough of the item's q-grams."""
    h = grams(points)
    slots = (h >> index.shift).astype(np.int64)
    at = np.flatnonzero(index.table[slots >> 3] & (1 << (slots & 7)).astype(np.uint8))
    where = np.searchsorted(index.keys, h[at])
    real = index.keys[np.minimum(where, len(index.keys) - 1)] == h[at]
    at, where = at[real], where[real]
    if not len(at):
        return []
    counts = index.first[where + 1] - index.first[where]
    # Grams times their places in passages may be many in a monotonous text: they are counted in runs of a bounded number.
    keys, n = np.array([], np.int64), np.array([], np.int64)
    cuts = np.searchsorted(np.cumsum(counts), np.arange(RUN, counts.sum() + RUN, RUN), side="left") + 1
    begin = 0
    for end in np.unique(np.minimum(cuts, len(at))):
        times = counts[begin:end]
        flat = np.repeat(index.first[where[begin:end]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        items = index.items[flat].astype(np.int64)
        band = (np.repeat(at[begin:end], times) - index.places[flat]) // (index.budget[items] + 1)
        key = items * (1 << 32) + band + (1 << 31)
        some, m = np.unique(np.concatenate((key, key - 1)), return_counts=True)
        both, where_in = np.unique(np.concatenate((keys, some)), return_inverse=True)
        keys, n = both, np.bincount(where_in, weights=np.concatenate((n, m))).astype(np.int64)
        begin = end
    item, band = keys >> 32, (keys & 0xFFFFFFFF) - (1 << 31)
    good = n >= index.bound[item]
    return [(int(i), int(b * (index.budget[i] + 1)), int((b + 2) * (index.budget[i] + 1))) for i, b in zip(item[good], band[good], strict=True)]


def exact(points: np.ndarray, passage: np.ndarray, low: int, high: int) -> int | None:
    """The first diagonal of the band along which the passage occurs without any edit."""
    last = min(high, len(points) - len(passage) + 1)
    begins = np.arange(max(0, low), max(0, low, last))
    begins = begins[points[begins] == passage[0]]
    return next((int(b) for b in begins if np.array_equal(points[b : b + len(passage)], passage)), None)


def within(points: np.ndarray, passage: np.ndarray, low: int, high: int, budget: int) -> bool:
    """Whether the passage ends anywhere in the band's text with at most ``budget`` edits.

    Differences of a whole matrix column are two bit vectors, so a text character costs a few operations on
    long integers. Most bands that reach the bound by chance end here; the alignment sees the rest.
    """
    masks: dict[int, int] = {}
    for i, c in enumerate(passage.tolist()):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(passage)) - 1, 1 << (len(passage) - 1)
    more, less, score = full, 0, len(passage)
    for c in points[max(0, low - budget) : max(0, high + budget + len(passage))].tolist():
        eq = masks.get(c, 0)
        zero = (((eq & more) + more) ^ more) | eq | less
        up, down = less | (full & ~(zero | more)), more & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score <= budget:
            return True
        up, down = up << 1 & full, down << 1 & full
        more, less = down | (full & ~(zero | up)), up & zero
    return False


def aligned(points: np.ndarray, passage: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best ``(edits, start, end)`` in ``points`` of the whole passage along diagonals near [low, high); None if over budget.

    Row i of the matrix holds, for each diagonal d, the edits of passage[:i] ending before text position i + d.
    A step down the same diagonal compares characters; from d + 1 above it skips a passage character; from
    d - 1 in the same row it skips a text character, which a running minimum settles for a whole row.
    """
    low, high = low - budget, high + budget
    d = np.arange(low, high)
    far = np.int64(1 << 30)
    inside = lambda i: (d + i >= 0) & (d + i <= len(points))
    cost = np.where(inside(0), 0, far)
    start = np.where(inside(0), d, 0)
    steps = np.arange(len(d))
    padded = np.concatenate((points, [0]))
    for i in range(1, len(passage) + 1):
        at = d + i - 1
        same = (at >= 0) & (at < len(points))
        down = cost + np.where(same & (padded[np.clip(at, 0, len(points))] == passage[i - 1]), 0, 1) + np.where(same, 0, far)
        skip = np.append(cost[1:], far) + 1
        up = skip < down
        cost, begun = np.where(up, skip, down), np.where(up, np.append(start[1:], 0), start)
        # The running minimum of (cost - steps) carries skips of text characters along; its place tells whose start it is.
        key = (cost - steps) * (1 << 20) + steps
        best = np.minimum.accumulate(key)
        origin = best & ((1 << 20) - 1)
        cost, start = np.where(inside(i), (best >> 20) + steps, far), begun[origin]
    at = int(np.argmin(cost))
    if cost[at] > budget:
        return None
    return int(cost[at]), int(start[at]), int(d[at] + len(passage))


def matches(text: str | None, index: Index) -> list[tuple[int, int, int, int]]:
    """``(item id, start, end, edits)`` of each passage found, by place; overlapping finds of one item give the best."""
    if not text:
        return []
    points, origin = folded(text)
    reach = 2 * max(len(p) for p in index.passages)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for begin in range(0, max(1, len(points)), PIECE):
        piece = points[begin : begin + PIECE + reach]
        for item, low, high in candidates(piece, index):
            passage, budget = index.passages[item], int(index.budget[item])
            if (at := exact(piece, passage, low, high)) is not None:
                hit = (0, at, at + len(passage))
            else:
                hit = aligned(piece, passage, low, high, budget) if within(piece, passage, low, high, budget) else None
            if hit:
                edits, s, e = hit
                found.setdefault(item, []).append((edits, begin + s, begin + e))
    out = []
    for item, hits in found.items():
        taken: list[tuple[int, int]] = []
        for edits, s, e in sorted(hits):
            if all(e <= ts or te <= s for ts, te in taken):
                taken.append((s, e))
                out.append((index.ids[item], int(origin[s]), int(origin[e - 1]) + 1, edits))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def contains(text: str | None, index: Index) -> bool:
    """Whether any passage is found; ends at the first one, and needs no alignment."""
    if not text:
        return False
    points, _ = folded(text)
    reach = 2 * max(len(p) for p in index.passages)
    for begin in range(0, max(1, len(points)), PIECE):
        piece = points[begin : begin + PIECE + reach]
        for item, low, high in candidates(piece, index):
            passage = index.passages[item]
            if exact(piece, passage, low, high) is not None or within(piece, passage, low, high, int(index.budget[item])):
                return True
    return False


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """``item_id, text`` of the items, dealt by hash into tables of about half of ``block_chars`` characters each (or the longest item's); one table if all have no more than that."""
    rows = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).filter("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if total <= block_chars:
        return [rows]
    parts = -(-2 * total // block_chars)
    return [rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) for i in range(parts)]


def index_of(block: DataFrame) -> Index | None:
    return build_index([tuple(r) for r in block.orderBy("item_id").collect()])


def find_passages(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, start, end, edits``: every benchmark passage in every document, within the edit budget."""
    schema = "doc_id bigint, item_id bigint, start bigint, end bigint, edits int"
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found, parts = None, blocks(benchmark, block_chars)
    for block in parts:
        if (index := index_of(block)) is None:
            continue
        shared = sent(spark.sparkContext, index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
            index = received(shared)
            for batch in batches:
                rows = [(d.as_py(), *m) for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True) for m in matches(t.as_py(), index)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k.type) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], schema=kinds)

        part = texts.mapInArrow(run, schema)
        if len(parts) > 1:
            part = staged(part, "passages")
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def decontaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no passage occurs. The decision is made row by row where the text is, without a join."""
    out, parts = docs, blocks(benchmark, block_chars)
    for block in parts:
        if (index := index_of(block)) is None:
            continue
        shared = sent(docs.sparkSession.sparkContext, index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = received(shared)
            for batch in batches:
                clean = [not contains(t.as_py(), index) for t in batch.column(batch.schema.get_field_index("text"))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, out.schema)
        if len(parts) > 1:
            out = staged(out, "clean")
            shared.unpersist()
    return out
