"""Extraction quality: exact, containment and fuzzy precision, recall and F1, and summaries of runs."""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..ranks import at_places
from .likeness import Likeness


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def _set(items: Column) -> Column:
    return F.array_distinct(F.transform(items, text.low))


def set_precision(pred: Column, true: Column) -> Column:
    return F.when(F.size(pred) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(_set(pred), _set(true))) / F.size(_set(pred)))


def set_recall(pred: Column, true: Column) -> Column:
    none = F.when(F.size(pred) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.size(true) == 0, none).otherwise(F.size(F.array_intersect(_set(pred), _set(true))) / F.size(_set(true)))


def _held(items: Column, whole: Column) -> Column:
    joined = text.joinable(F.array_join(F.transform(whole, text.low), " "))
    return F.size(F.filter(items, lambda x: joined.contains(text.joinable(x))))


def contained_precision(pred: Column, true: Column) -> Column:
    return F.when(F.size(pred) == 0, F.lit(0.0)).otherwise(_held(pred, true) / F.size(pred))


def contained_recall(pred: Column, true: Column) -> Column:
    none = F.when(F.size(pred) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.size(true) == 0, none).otherwise(_held(true, pred) / F.size(true))


def word_accuracy(pred: Column, true: Column) -> Column:
    p, t = (F.array_distinct(text.pieces(F.lower(c), r"\s+")) for c in (pred, true))
    return F.when(true == "", F.when(pred == "", 1.0).otherwise(0.0)).when(pred == "", 0.0).when(F.size(t) == 0, F.when(F.size(p) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(p, t)) / F.size(t))


def greedy_matches(pred: Iterable[str], true: Iterable[str], threshold: float, like: Likeness | None = None) -> int:
    """Predictions that find a true item, each its likest free one (the first on ties), in order."""
    like = like or Likeness()
    free: list[str | None] = [t.lower().strip() for t in true]
    found = 0
    for p in pred:
        p, best, at = p.lower().strip(), 0.0, None
        for k, t in enumerate(free):
            # A ratio under the threshold matches nothing, and one that only equals the best comes too late.
            if t is not None and (r := like.ratio(p, t, max(best, threshold))) > best:
                best, at = r, k
        if at is not None and best >= threshold:
            free[at] = None
            found += 1
    return found


def fuzzy(rows: DataFrame, pred: str = "predicted", true: str = "truth", threshold: float = 0.8) -> DataFrame:
    """Adds fuzzy_precision, fuzzy_recall, fuzzy_f1 by greedy one-to-one matching of each row's lists."""

    @F.pandas_udf("int")
    def matches(a: pd.Series, b: pd.Series) -> pd.Series:
        like = Likeness()
        return pd.Series([greedy_matches(x, y, threshold, like) for x, y in zip(a, b)])

    p, t, n = F.size(pred), F.size(true), F.col("_n")
    out = rows.withColumn("_n", matches(pred, true))
    precision = F.when(t == 0, F.when(p == 0, 1.0).otherwise(0.0)).when(p == 0, 0.0).otherwise(n / p)
    recall = F.when(t == 0, 1.0).when(p == 0, 0.0).otherwise(n / t)
    out = out.withColumns({"fuzzy_precision": precision, "fuzzy_recall": recall})
    return out.withColumn("fuzzy_f1", F.when(t == 0, F.when(p == 0, 1.0).otherwise(0.0)).otherwise(f1(F.col("fuzzy_precision"), F.col("fuzzy_recall")))).drop("_n")


def char_accuracy(pred: Column, true: Column) -> Column:
    """Likeness of two texts by their matching blocks, without case."""

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(float(not p) if not t else 0.0 if not p else difflib.SequenceMatcher(None, p.lower(), t.lower()).ratio()) for p, t in zip(a.fillna(""), b.fillna(""))])

    return likeness(pred, true)


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / total length), by the longest common subsequence in bit rows."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return 100.0 * 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one (cut at its ends)."""
    a, b = sorted((a, b), key=len)
    n = len(a)
    if not n:
        return 0.0 if b else 100.0
    cuts = {b[max(0, k) : k + n] for k in range(1 - n, len(b))}
    return max(indel_ratio(a, c) for c in cuts if c)


def best_fuzzy_score(item: str, whole: str) -> float:
    """100 if the item is in the text; else the best of the plain, partial, sorted-token and token-set ratios."""
    if not item or not whole:
        return 0.0
    if item in whole:
        return 100.0
    x, y = item.split(), whole.split()
    sx, sy = set(x), set(y)
    both, dx, dy = (" ".join(sorted(s)) for s in (sx & sy, sx - sy, sy - sx))
    sets = 100.0 if both and (not dx or not dy) else max(indel_ratio(f"{both} {dx}".strip(), f"{both} {dy}".strip()), *((indel_ratio(both, f"{both} {dx}".strip()), indel_ratio(both, f"{both} {dy}".strip())) if both else (0.0,)))
    return max(partial_ratio(item, whole), sets, indel_ratio(" ".join(sorted(x)), " ".join(sorted(y))), indel_ratio(item, whole))


def fuzzy_counts(rows: DataFrame, items: str, whole: str, threshold: float) -> Column:
    @F.pandas_udf("int")
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sum(best_fuzzy_score(i, w) >= threshold for i in x) for x, w in zip(a, b)])

    return count(F.transform(items, text.fuzzy_form), text.fuzzy_form(F.col(whole)))


def indexed_percentiles(rows: DataFrame, value: str, by: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """by and a column for each share p: the value at place int(n * p) of the group's order, the last at most; no interpolation.

    Places are counted out over range partitions, so no group is ever gathered. Nulls are no values; a group of none has nulls.
    """
    n = rows.groupBy(*by).agg(F.count(value).alias("_n"))
    wanted = F.array(*[F.struct(F.lit(k).alias("_name"), F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1).cast("long").alias("_place")) for k, p in shares.items()])
    found = at_places(rows, by, value, n.select(*by, F.inline(wanted)), "_place")
    return _with(n, found, by, {k: F.max(F.when(F.col("_name") == k, F.col(value))) for k in shares}).drop("_n")


def latency(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """by, mean, min, max, median, stdev (of a sample, 0 for one value) and n of the values of each group.

    The median is the mean of the one or two values in the middle, found by their places (see indexed_percentiles).
    """
    v = F.col(value)
    sums = rows.groupBy(*by).agg(F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 4).alias("stdev"), F.count(v).alias("n"))
    middle = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    found = at_places(rows, by, value, sums.select(*by, F.explode(middle).alias("_place")), "_place")
    return _with(sums, found, by, {"median": F.round(F.avg(v), 4)}).select(*by, "mean", "min", "max", "median", "stdev", "n")


def _with(groups: DataFrame, found: DataFrame, by: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """groups with the columns that aggregate found; null keys are equal."""
    if not by:
        return groups.crossJoin(F.broadcast(found.agg(*[c.alias(k) for k, c in columns.items()])))
    got = found.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(*[c.alias(k) for k, c in columns.items()])
    same = F.lit(True)
    for c in by:
        same = same & groups[c].eqNullSafe(got[f"_by_{c}"])
    return groups.join(got, same, "left").drop(*[f"_by_{c}" for c in by])


def threshold_sweep(rows: DataFrame, prob: str = "pred_prob", label: str = "label") -> DataFrame:
    """threshold, precision, recall, f1, best for the 13 thresholds 0.20 to 0.80; the first best f1 wins.

    One pass: counts by the number of thresholds that a row reaches, then sums from above.
    """
    steps = [F.lit(k / 20) for k in range(4, 17)]
    reached = F.size(F.filter(F.array(*steps), lambda t: F.col(prob) >= t))
    held = rows.groupBy(reached.alias("r")).agg(F.count_if(F.col(label) == 1).alias("tp"), F.count_if(F.col(label) != 1).alias("fp"))
    marks = rows.sparkSession.createDataFrame([(k - 3, k / 20) for k in range(4, 17)], "k int, threshold double")
    total = held.agg(F.sum("tp").alias("pos"))
    out = marks.join(held, F.col("r") >= F.col("k"), "left").groupBy("k", "threshold").agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp")).crossJoin(total)
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0)
    out = out.select("threshold", p.alias("precision"), r.alias("recall")).withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return out.withColumn("best", F.row_number().over(Window.orderBy(F.desc(F.round("f1", 9)), "threshold")) == 1)
