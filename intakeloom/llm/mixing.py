"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is queued in a shuffled order, twice over.  A copy's
virtual finish time is its source's cumulative size up to it, divided by the
source's target.  The copies of all sources are taken in the order of that time
until the total budget is reached.

* Sources get the weights in turn by the order of their names, null last.  A
  target is at most ``cap`` times the source's size; what lies above is shared
  among the others by weight until none is above.
* The shuffled order is that of ``md5(id | text)``.  Rows equal in id, text and
  source stand at one place and are taken together, so reruns agree.
* The copy in which the budget is reached is taken if at least half of it fits.
* Documents without words have size 0 and are never taken.  A null text has
  size 0, a null source is a source of its own, an empty table gives no rows.
* Columns of the input other than id, text and source are passed through by
  ``mixed_documents`` and play no part; clashing names do no harm.

A third of all rows may be one source: cumulative sums are taken within 4,096
slices of a source and put together from the sums of the slices, so no task
sorts a whole source.  Only (source, key, size) is shuffled, never a text; the
result is one cut in each source's order, a table with a row per source, which
documents join in ``SALTS`` parts a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intakeloom.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
STEPS = 4096  # slices of virtual time in which the budget's end is looked for
LAST_STEP = 4 * STEPS
SALTS = 32  # parts in which a source's documents meet its cut


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place(doc_id: Column, text: Column) -> Column:
    """Where a document stands in its source's shuffled order."""
    return F.md5(
        F.concat(
            F.coalesce(doc_id.cast("string"), F.lit("")),
            F.lit("|"),
            F.coalesce(text, F.lit("")),
        ).cast("binary")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int) -> DataFrame:
    """Target of each row of (no_source, source, source_size).

    Sources sorted by size a weight reach their caps first, so with ``m`` capped
    ones the rest shares what is left by weight; the first source that stays
    below its cap at its own ``m`` fixes the level for all after it.  One row per
    source: the windows see the aggregated table only.
    """
    by_name = Window.orderBy("no_source", "source")
    weighed = sizes.withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(w).cast("bigint") for w in weights]),
            ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
        ),
    )
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "no_source", "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onwards = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    over, under = share
    levels = weighed.select(
        "*",
        (
            F.sum("source_size").over(everything) * over
            - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap * under
        ).alias("left_over"),
        (F.sum("weight").over(onwards) * under).alias("left_weight"),
    )
    below = F.col("left_over") * F.col("weight") <= F.col("source_size") * cap * F.col("left_weight")
    first = F.first(F.when(below, F.struct("left_over", "left_weight")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        levels.withColumn("level", first)
        .withColumn(
            "target",
            F.when(
                F.col("level").isNull(), (F.col("source_size") * cap).cast("double")
            ).otherwise(
                (F.col("level.left_over") * F.col("weight")).cast("double")
                / F.col("level.left_weight").cast("double")
            ),
        )
        .select("no_source", "source", "source_size", "target")
    )


def _narrow(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = F.col(f"`{source_col}`")
    return documents.select(
        source.isNull().alias("no_source"),
        F.coalesce(source.cast("string"), F.lit("")).alias("source"),
        place(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("place"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
    )


def cuts(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    cap: int = 2,
) -> DataFrame:
    """Per source: size, target and the last copy taken (``turn`` from 0, ``upto``)."""
    of_source = ["no_source", "source"]
    units = written(
        _narrow(documents, id_col, text_col, source_col)
        .groupBy(*of_source, "place")
        .agg(F.sum("size").alias("size")),
        "mixing-units",
    ).withColumn("slice", F.substring("place", 1, 3))
    slices = units.groupBy(*of_source, "slice").agg(F.sum("size").alias("slice_size"))
    sizes = slices.groupBy(*of_source).agg(F.sum("slice_size").alias("source_size"))
    goals = targets(sizes, weights, share, cap)
    starts = slices.withColumn(
        "start",
        F.sum("slice_size").over(Window.partitionBy(*of_source).orderBy("slice")) - F.col("slice_size"),
    ).drop("slice_size")
    within = Window.partitionBy(*of_source, "slice").orderBy("place")
    copies = written(
        units.where("size > 0")
        .withColumn("reached", F.sum("size").over(within))
        .join(starts, [*of_source, "slice"])
        .join(goals, of_source)
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
        .withColumn(
            "finish",
            (F.col("start") + F.col("reached") + F.col("turn") * F.col("source_size")).cast("double")
            / F.col("target"),
        )
        .withColumn("step", F.least(F.floor(F.col("finish") * STEPS), F.lit(LAST_STEP)))
        .select(*of_source, "place", "turn", "size", "finish", "step"),
        "mixing-copies",
    )
    over, under = share
    budget = sizes.agg((F.sum("source_size") * over).alias("budget"))  # times ``under``
    steps = (
        copies.groupBy("step")
        .agg(F.sum("size").alias("step_size"))
        .withColumn("total", F.sum("step_size").over(Window.orderBy("step")))
    )
    cut = (
        steps.join(F.broadcast(budget))  # one row
        .where(F.col("total") * under >= F.col("budget"))
        .agg(F.min(F.struct("step", "total", "step_size", "budget")).alias("cut"))
        .select(
            F.col("cut.step").alias("cut_step"),
            (F.col("cut.total") - F.col("cut.step_size")).alias("before"),
            F.col("cut.budget").alias("budget"),
        )
    )
    near = copies.join(F.broadcast(cut), copies["step"] <= cut["cut_step"])  # one row
    in_order = Window.orderBy("finish", *of_source, "turn", "place")
    last = (
        near.where("step = cut_step")
        .withColumn("middle", (F.col("before") + F.sum("size").over(in_order)) * 2 - F.col("size"))
        .where(F.col("middle") * under <= F.col("budget") * 2)
    )
    columns = [*of_source, "turn", "place"]
    taken = (
        near.where("step < cut_step")
        .select(*columns)
        .unionByName(last.select(*columns))
        .groupBy(*of_source)
        .agg(F.max(F.struct("turn", "place")).alias("last"))
    )
    return goals.join(taken, of_source, "left").select(
        *of_source,
        "source_size",
        "target",
        F.col("last.turn").alias("turn"),
        F.col("last.place").alias("upto"),
    )


def mixed(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    **rules,
) -> DataFrame:
    """The documents with ``mix_size``, ``mix_source_size``, ``mix_target`` and
    ``mix_copies``, the number of times the mix takes each."""
    found = cuts(documents, id_col, text_col, source_col, **rules)
    found = found.select(
        *[F.col(c).alias(f"mix_cut_{c}") for c in found.columns],
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("mix_cut_salt"),
    )
    kept = [F.col(f"`{c}`") for c in documents.columns]
    source = F.col(f"`{source_col}`")
    placed = documents.select(
        *kept,
        place(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("mix_place"),
        word_count(F.col(f"`{text_col}`")).alias("mix_size"),
        source.isNull().alias("mix_no_source"),
        F.coalesce(source.cast("string"), F.lit("")).alias("mix_source"),
    ).withColumn("mix_salt", F.pmod(F.xxhash64("mix_place"), F.lit(SALTS)).cast("int"))
    copies = F.when(
        (F.col("mix_size") > 0) & F.col("mix_cut_turn").isNotNull(),
        F.col("mix_cut_turn") + (F.col("mix_place") <= F.col("mix_cut_upto")).cast("int"),
    ).otherwise(0)
    return placed.join(
        found,
        (F.col("mix_no_source") == F.col("mix_cut_no_source"))
        & (F.col("mix_source") == F.col("mix_cut_source"))
        & (F.col("mix_salt") == F.col("mix_cut_salt")),
    ).select(
        *kept,
        "mix_size",
        F.col("mix_cut_source_size").alias("mix_source_size"),
        F.col("mix_cut_target").alias("mix_target"),
        copies.alias("mix_copies"),
    )


def mixed_documents(documents: DataFrame, **columns) -> DataFrame:
    """The mix itself: the columns of ``documents``, a row for each copy taken."""
    names = [F.col(f"`{c}`") for c in documents.columns]
    return (
        mixed(documents, **columns)
        .where("mix_copies > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
        .select(*names)
    )
