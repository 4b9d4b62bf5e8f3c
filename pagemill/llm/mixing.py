"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Targets: each source gets its weight's share of the word budget, but at most ``max_repeats`` times its
own words; what is cut off goes to the others by weight. The answer is one water level: with sources
sorted by the level at which they fill up, running sums tell which are full, with no iteration.

Curriculum: source s's sampling weight at training time t in [0, 1] runs linearly from ``early`` to
``late``. Its integral is the cumulative demand D_s(t), scaled so that D_s(1) is the target. A document
whose words begin after c words of its source is due when D_s(t) = c: a quadratic with one root in [0, 1].
Documents are range-sorted by that position.

Words are counted off along a hash order inside each source. Running sums over a source with a third
of all rows don't go through one task: sums of hash blocks are added up first, then each block alone.

Defined results: null text has size 0; null source is a source of its own, the last; a source without
words has target 0; repeated rows are each a document; an empty table gives an empty table; columns
besides doc_id, text and source are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.shared import WORD, staged

#: Production parameters: weights repeat over the sources in code point order; the budget is a share of all words.
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_REPEATS = 2
#: Sampling weight at the start and at the end of training, repeating over the sources like WEIGHTS.
SCHEDULES = ((1.0, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Hash blocks of a source hold about this many rows.
BLOCK_ROWS = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(doc_id: Column) -> Column:
    """A fixed number in [0, 2^60) from the document's id: the first 15 hex digits of its SHA-1."""
    return F.conv(F.substring(F.sha1(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, n_rows, place, weight, target``, one row per source of ``sizes`` (source, size)."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = total.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod("place", F.lit(len(weights))) + 1))
    filled = ranked.withColumn("cap", F.col("source_size") * repeats).withColumn("full_at", F.col("cap") / F.col("weight"))
    everyone = Window.partitionBy()
    before = Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    # If this and all later sources were not full, the level would be what is left over their weights.
    level = filled.select(
        "*",
        ((F.sum("source_size").over(everyone) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    # The first source that its level doesn't fill sets the level of all.
    water = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))).over(everyone)["level"]
    target = F.round(F.least(F.col("cap").cast("double"), F.coalesce(water, F.lit(float("inf"))) * F.col("weight")), 6)
    return level.select("source", "source_size", "n_rows", "place", "weight", target.alias("target"))


def inverse_demand(share: Column, early: Column, late: Column) -> Column:
    """t with (early t + (late - early) t^2 / 2) / ((early + late) / 2) = share, in the form that is stable near a flat schedule."""
    asked = share * (early + late) / 2
    return F.least(F.lit(1.0), 2 * asked / (early + F.sqrt(F.greatest(F.lit(0.0), early * early + 2 * (late - early) * asked))))


def running_start(rows: DataFrame, group: Sequence[str], n_rows: Column, order: Column, ties: Sequence[str], value: str, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same group that come earlier by ``order`` (uniform in [0, 2^60)).

    A group is cut into as many equal ranges of ``order`` as its row count asks for. Sums of whole
    ranges form a small table; the window inside a range never sees more than about ``block_rows`` rows.
    """
    blocks = F.ceil(n_rows / block_rows).cast("bigint")
    cut = rows.withColumn("_block", F.floor(order / F.lit(float(1 << 60)) * blocks).cast("bigint"))
    sums = cut.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col("_block") == F.col("_b")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    inside = Window.partitionBy(*group, "_block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, on)
    return joined.withColumn(out, F.col("_base") + F.col("_inside")).drop("_block", "_inside", "_b", "_base", *(f"_{g}" for g in group))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, repeats: int = MAX_REPEATS,
        schedules: Sequence[tuple[float, float]] = SCHEDULES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, size, source_size, target, taken, position, repeat_position``, sorted by training position.

    ``taken`` counts the words the mix takes of the document over all passes: whole passes first, then,
    along the hash order, until the source's target is met, so the source's sum is its target to a word.
    ``position`` is when its first words are due, ``repeat_position`` when they are due again.
    """
    sizes = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw(F.col("doc_id")).alias("_draw")), "sizes")
    plan = source_targets(sizes, weights, budget, repeats).select(F.col("source").alias("_source"), "source_size", "n_rows", "place", "target")
    rows = sizes.join(F.broadcast(plan) if _few(plan) else plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = running_start(rows, ["source"], F.col("n_rows"), F.col("_draw"), ["doc_id", "size"], "size", "_start", block_rows)
    goal = F.round("target").cast("bigint")
    taken = sum((F.greatest(F.lit(0), F.least("size", goal - F.col("source_size") * k - F.col("_start"))) for k in range(repeats)), F.lit(0)).cast("bigint")
    curve = F.element_at(F.array(*(F.struct(F.lit(a).alias("early"), F.lit(b).alias("late")) for a, b in schedules)), (F.pmod("place", F.lit(len(schedules))) + 1).cast("int"))
    due = lambda k: F.when(
        (F.col("_start") + F.col("source_size") * k < goal) & (F.col("size") > 0),
        inverse_demand((F.col("_start") + F.col("source_size") * k) / F.greatest(goal, F.lit(1)), curve["early"], curve["late"]),
    )
    mixed = rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.round(due(0), 9).alias("position"), F.round(due(1), 9).alias("repeat_position"))
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


#: At most this many sources are broadcast; more are joined by shuffle.
FEW_SOURCES = 10_000


def _few(plan: DataFrame) -> bool:
    return plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
