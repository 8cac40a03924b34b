"""Shared-folder tables, distributed ranks and the word rules that several operators use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import arrow_rows, saved  # noqa: F401

#: White space of the word contracts (U+0020, U+0009 to U+000D); everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, compared without case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def free_prefix(df: DataFrame) -> str:
    """A prefix with which no column of df begins, compared without case."""
    prefix = "_lf"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds the long column `name`: each row's place, from 0, in its group by order (nulls first).

    No group is ever gathered in one task. Rows are range-partitioned by (group, order), sorted where they
    are, numbered per partition and written; the offsets come from one small row per partition and group.
    Equal rows get neighbouring places in any order.
    """
    x = free_prefix(df)
    at, part, there, off = x + "at", x + "part", x + "there", x + "off"
    cols = [F.col(c) for c in (*group, *order)]
    laid = saved(
        df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn(at, F.monotonically_increasing_id()),
        "ranked",
    ).withColumn(part, F.shiftright(at, 33))
    names = [f"{x}g{i}" for i in range(len(group))]
    spans = laid.groupBy(*[F.col(c).alias(n) for c, n in zip(group, names)], F.col(part).alias(there)).agg(
        F.min(at).alias("lo"), F.count(F.lit(1)).alias("n")
    )
    before = Window.partitionBy(*names).orderBy(there).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn(off, F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lo")).drop("lo", "n")
    same = laid[part] == spans[there]
    for c, n in zip(group, names):
        same = same & laid[c].eqNullSafe(spans[n])
    return laid.join(spans, same).withColumn(name, F.col(at) + F.col(off)).drop(at, part, there, off, *names)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(word: Column) -> Column:
    """Lower-cases A-Z alone; the quick lower() serves where all characters are single bytes."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))
