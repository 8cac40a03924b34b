"""Training labels of detection boxes, from the true items of their image."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from .likeness import Likeness


def is_stop(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(fixed.LABEL_STOPS))


def is_header(c: Column) -> Column:
    return text.strip(c).rlike(fixed.LABEL_HEADER)


def is_junk(c: Column) -> Column:
    return text.strip(c).rlike(fixed.LABEL_JUNK)


def in_joined(c: Column, items: Column) -> Column:
    """Whether a box text of three characters or more, without marks at its end, stands in the joined items."""
    needle = F.regexp_replace(text.low(c), r"[.,;:)]+$", "")
    return (F.length(needle) >= 3) & F.array_join(F.transform(items, F.lower), " ").contains(needle)


def contained(c: Column, items: Column) -> Column:
    """Whether box text and an item hold one the other; texts under two characters match nothing."""
    needle = text.low(c)
    return (F.length(needle) >= 2) & F.exists(items, lambda x: text.low(x).contains(needle) | needle.contains(text.low(x)))


def likened(threshold: float = fixed.LABEL_RATIO):
    """(text, items): whether the ratio of matching blocks with an item reaches the threshold."""

    @F.pandas_udf("boolean")
    def test(texts: pd.Series, lists: pd.Series) -> pd.Series:
        like, needles = Likeness(), [(t or "").lower().strip() for t in texts]
        return pd.Series([len(n) > 1 and any(like.ratio(n, x.lower().strip(), threshold) >= threshold for x in items) for n, items in zip(needles, lists)], dtype=bool)

    return test


def matches_truth(c: Column, items: Column, threshold: float = fixed.LABEL_RATIO) -> Column:
    """Box text ~ an item: one holds the other, or their ratio reaches the threshold (asked only where neither holds)."""
    held = contained(c, items)
    none = F.array().cast("array<string>")
    return held | likened(threshold)(c, F.when(held, none).otherwise(items))


def labelled(boxes: DataFrame, truth: DataFrame, threshold: float = fixed.LABEL_RATIO) -> DataFrame:
    """Boxes (image_id, text) of images with true items (image_id, items): label 1 or 0.

    In this order: blank, header, junk and stop texts are 0; texts in the joined items are 1; then those that match
    an item. Images without items are left out. Only texts that no earlier rule decides leave the JVM.
    """
    known = truth.filter(F.size("items") > 0).select(F.col("image_id").alias("_image"), F.col("items").alias("_items"))
    rows = boxes.join(known, F.col("image_id") == F.col("_image"))
    c, items = F.coalesce("text", F.lit("")), F.col("_items")
    zero = (text.strip(c) == "") | is_header(c) | is_junk(c) | is_stop(c)
    rows = rows.withColumn("_sure", F.when(zero, 0).when(in_joined(c, items) | contained(c, items), 1))
    open_items = F.when(F.col("_sure").isNull(), items).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("label", F.coalesce("_sure", likened(threshold)(c, open_items).cast("int"))).drop("_image", "_items", "_sure")
