"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed-point ones of an expected copy; ranks up to 2**37 stay exact in a long.
UNIT_BITS = 24


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources from (source, source_size): weights repeat along code-point order, null last.

    Targets add up to share times all sizes and stop at most times a source's size; what is above is
    shared again by weight. That is the level at which all uncapped sources stand alike, found in one
    pass: with sources in the order of cap over weight, the level is the largest of the levels that
    hold if just the sources before are capped. One row per source takes part, no document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_need = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("_cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("_w").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    weighed = weighed.withColumn("_level", (budget - capped) / open_w)
    level = F.max("_level").over(Window.partitionBy())
    return weighed.withColumn("target", F.least(F.col("_cap"), level * F.col("_w"))).select("source", "source_size", "target")


def start_of(source: Column, seed: str) -> Column:
    """The source's random offset in fixed point, the same in each run."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))))
    return F.conv(F.substring(mark, 1, UNIT_BITS // 4), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    size: Column | None = None,
) -> DataFrame:
    """Adds mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the row).

    Every document of a source has the same expected copies, target over source size. They are added up
    along (size, doc_id) within the source, a random offset is added, and a row is emitted once for each
    integer that its stretch crosses: copies differ from the expectation by less than one, and since
    neighbours are of like size the words taken stay within about one large document of the target.

    Null text: size 0. Null source: a source of its own, last. Empty table: no rows. Sources without
    words: target 0, no copies. Equal rows are mixed each for itself. Other columns pass through; names
    that clash with the four new ones are replaced.
    """
    wanted = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    wanted = wanted.withColumn("mix_size", common.word_count(F.col(text)) if size is None else size)
    x = common.free_prefix(wanted)
    place, whose, step, start = x + "place", x + "source", x + "step", x + "start"
    laid = common.ranked(wanted, [source], ["mix_size", doc_id], place)
    sums = laid.groupBy(F.col(source).alias("source")).agg(F.sum("mix_size").alias("source_size"))
    rate = F.floor(F.col("target") / F.col("source_size") * F.lit(float(1 << UNIT_BITS)))
    targets = source_targets(sums, weights, share, most).select(
        F.col("source").alias(whose), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        F.when(F.col("source_size") > 0, rate).otherwise(F.lit(0)).cast("long").alias(step), start_of(F.col("source"), seed).alias(start),
    )
    met = laid.join(targets, laid[source].eqNullSafe(targets[whose]))

    def copies(first: Column) -> Column:
        return F.shiftright((F.col(place) + 1) * F.col(step) + first, UNIT_BITS) - F.shiftright(F.col(place) * F.col(step) + first, UNIT_BITS)

    return met.withColumn("mix_copies", copies(F.col(start))).drop(place, whose, step, start)


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns it came with.

    Rows that are not taken, so all without words, are out. Copies of a row are equal.
    """
    kept, turn = mixed.filter("mix_copies > 0"), common.free_name(mixed, "_turn")
    turns = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias(turn)
    return kept.select("*", turns).drop("mix_size", "mix_source_size", "mix_target", "mix_copies", turn)
