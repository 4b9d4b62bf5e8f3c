"""Chat formatting: conversations as a prefix tree, shared turns emitted once, with positions and attention.

Conversations that begin with the same turns share those nodes. The tree is laid out depth-first as one
long sequence per root: a node's text stands right after its parent's, so tokens of a shared beginning
occur once. Each node carries ``position`` (where its text would begin in an unmerged conversation:
position ids start there) and ``attends``, the intervals of the sequence that hold its ancestors, which
together with its own earlier tokens are all that its tokens may attend to.

How it is made without gathering a tree or a root's conversations in one task: turns are folded in
sorted order, one at a time, into chain hashes that name nodes; conversations are range-sorted by their
chains, which is depth-first order; a node is emitted by the first conversation that has it; offsets
are running sums of sorted pieces. The longest chain kept together is one conversation's hashes.

Template: control strings inside a text are broken by a backslash after their first character and
backslashes are doubled, so no text can end its own turn, and the reader undoes it exactly.

Defined results: null text and null role count as empty; rows of a conversation go by turn (nulls
first), then role, then text, and repeated rows are turns like others; a null conv_id is one
conversation; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.shared import staged

#: Opening and closing marks by role; other roles are written into their opening mark.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<|", "|>", "<|end|>")
CONTROL = re.compile("|".join(re.escape(c) for c in sorted({*sum(MARKS.values(), ()), *OTHER}, key=len, reverse=True)))
LOSS_ROLE = "assistant"

_SEGMENT = re.compile("|".join(f"{re.escape(a)}(?P<{r}>.*?){re.escape(b)}" for r, (a, b) in MARKS.items()) + r"|<\|(?P<role>.*?)\|>(?P<other>.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def segment(role: str, text: str) -> str:
    """One turn in the template."""
    if role in MARKS:
        return MARKS[role][0] + escape(text) + MARKS[role][1]
    return OTHER[0] + escape(role) + OTHER[1] + escape(text) + OTHER[2]


def read_segment(written: str) -> tuple[str, str, int, int]:
    """Role, text, and where the escaped text begins and ends: the reverse of :func:`segment`."""
    m = _SEGMENT.fullmatch(written)
    role = next(r for r in (*MARKS, "other") if m[r] is not None)
    start, end = m.span(role)
    return unescape(m["role"]) if role == "other" else role, unescape(m[role]), start, end


def _folded(rows: DataFrame, columns: list[str], step, schema: str) -> DataFrame:
    """Rows of each conversation in order through ``step(conv_id, row, state) -> (state, rows out)``.

    Rows arrive sorted in one partition and are taken one after another; only ``state`` is kept.
    ``step`` gets ``row=None`` after the last row of a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if begun and row["conv_id"] != now:
                    out += step(now, None, state)[1]
                    state = None
                now, begun = row["conv_id"], True
                state, more = step(now, row, state)
                out += more
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if begun and (last := step(now, None, state)[1]):
            yield pa.RecordBatch.from_pylist(last, arrow)

    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<struct<start:bigint,end:bigint>>": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    arrow = pa.schema([(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in schema.split(", ")])
    return rows.repartition("conv_id").sortWithinPartitions(*columns).mapInArrow(run, schema)


def build_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(turns, nodes)``.

    ``turns``: ``conv_id, seq, node, position``, one row a turn, naming its node.
    ``nodes``: ``node, root, offset, length, position, content, loss_start, loss_end, attends`` once each, in
    depth-first order by ``root`` and ``offset``. Offsets count code points within the root's sequence.
    """
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def chain(conv, row, state):
        seq, at, path = state or (0, 0, b"")
        if row is None:
            return None, [{"conv_id": conv, "seq": -1, "node": path}]
        content = segment(row["role"], row["text"])
        node = xxhash.xxh3_128_digest(path[-16:] + content.encode())
        out = {"conv_id": conv, "seq": seq, "node": node, "parent": path[-16:], "position": at, "content": content, "length": len(content)}
        return (seq + 1, at + len(content), path + node), [out]

    folded = staged(
        _folded(rows, ["conv_id", "turn", "role", "text"], chain, "conv_id bigint, seq bigint, node binary, parent binary, position bigint, content string, length bigint"),
        "turns",
    )
    pieces = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chains = folded.filter("seq < 0").select("conv_id", F.col("node").alias("path"))
    ranked = staged(chains.repartitionByRange(pieces, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", F.monotonically_increasing_id().alias("place")), "places")
    turns = folded.filter("seq >= 0")
    placed = turns.join(ranked, turns.conv_id.eqNullSafe(ranked.conv_id)).select(turns.conv_id, "seq", "node", "length", "position", "place")
    owners = placed.groupBy("node").agg(F.min("place").alias("place"), F.min("seq").alias("seq"), F.min("length").alias("length"))
    laid = staged(
        owners.repartitionByRange(pieces, "place", "seq").sortWithinPartitions("place", "seq").select("node", "place", "seq", "length", F.monotonically_increasing_id().alias("mark")),
        "order",
    ).withColumn("piece", F.shiftright("mark", 33))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy("piece").agg(F.sum("length").alias("sum"))
    base = sums.select("piece", F.coalesce(F.sum("sum").over(before.orderBy("piece")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("length").over(before.partitionBy("piece").orderBy("mark")), F.lit(0))
    offsets = staged(laid.withColumn("inside", inside).join(F.broadcast(base), "piece").select("node", "place", "seq", (F.col("base") + F.col("inside")).alias("offset")), "offsets")
    # The owner of each node walks down its conversation and so knows the node's ancestors.
    known = placed.select("conv_id", "seq", "node", "length", F.col("place").alias("walker")).join(offsets.select("node", "offset", "place"), "node")

    def ancestors(conv, row, state):
        if row is None:
            return None, []
        root, seen = state or ((row["node"], row["offset"]), [])
        start = row["offset"] - root[1]
        mine = [{"node": row["node"], "root": root[0], "offset": start, "attends": [dict(x) for x in seen]}] if row["owns"] else []
        if seen and seen[-1]["end"] == start:
            seen = seen[:-1] + [{"start": seen[-1]["start"], "end": start + row["length"]}]
        else:
            seen = [*seen, {"start": start, "end": start + row["length"]}]
        return (root, seen), mine

    walks = known.select("conv_id", "seq", "node", "length", "offset", (F.col("place") == F.col("walker")).cast("bigint").alias("owns"))
    owned = _folded(walks, ["conv_id", "seq"], ancestors, "node binary, root binary, offset bigint, attends array<struct<start:bigint,end:bigint>>")
    texts = turns.join(ranked, turns.conv_id.eqNullSafe(ranked.conv_id)).join(offsets.select(F.col("node").alias("n"), F.col("place").alias("p")), (F.col("node") == F.col("n")) & (F.col("place") == F.col("p"))).select("node", "content", "length", "position")
    spans = _loss(texts)
    nodes = staged(spans.join(owned, "node").select("node", "root", "offset", "length", "position", "content", "loss_start", "loss_end", "attends"), "nodes")
    return turns.select("conv_id", "seq", "node", "position"), nodes


def _loss(texts: DataFrame) -> DataFrame:
    """With the span of each node's content that counts in the loss; null where none does."""
    opening, closing = MARKS[LOSS_ROLE]
    counts = F.startswith("content", F.lit(opening))
    return texts.withColumn("loss_start", F.when(counts, F.lit(len(opening)).cast("bigint"))).withColumn("loss_end", F.when(counts, F.col("length") - len(closing)))


def read_back(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each conversation's digest from the emitted nodes alone: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    rows = turns.select("conv_id", "seq", "node").join(nodes.select("node", "content", "loss_start", "loss_end"), "node").select("conv_id", "seq", "content", "loss_start", "loss_end")

    def digest(conv, row, state):
        n, chars, loss, every, counted = state or (0, 0, 0, hashlib.sha256(), hashlib.sha256())
        if row is None:
            return None, [{"conv_id": conv, "n_turns": n, "turns_sha256": every.hexdigest(), "loss_chars": loss, "loss_sha256": counted.hexdigest(), "formatted_chars": chars}]
        role, text, _, _ = read_segment(row["content"])
        every.update(f"{role}\n{text}\n".encode())
        if row["loss_start"] is not None:
            learnt = unescape(row["content"][row["loss_start"] : row["loss_end"]])
            counted.update(learnt.encode())
            loss += len(learnt)
        return (n + 1, chars + len(row["content"]), loss, every, counted), []

    return _folded(rows, ["conv_id", "seq"], digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations, read back from their prefix tree."""
    return read_back(*build_tree(conversations))
