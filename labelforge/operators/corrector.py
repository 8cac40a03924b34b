"""Correction of misread ingredient strings against a vocabulary, as staged joins.

Each distinct string is corrected once. Cheap steps come first; only what they leave open reaches the
similarity joins, which meet over deletion variants (an equi join) and are verified then.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..session import saved
from .metrics import indel_ratio

DISTANCE, PREFIX, RATIO, ERRORS = 2, 7, 90.0, 0.12


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


def variants(word: str) -> list[str]:
    """The word's prefix with up to DISTANCE characters deleted."""
    p = word[:PREFIX]
    return sorted({"".join(c for k, c in enumerate(p) if k not in gone) for n in range(DISTANCE + 1) for gone in combinations(range(len(p)), min(n, len(p)))})


def _variants(word: Column | str) -> Column:
    @F.pandas_udf("array<string>")
    def of(words: pd.Series) -> pd.Series:
        return words.map(variants)

    return of(word)


def _osa(a: str, b: str) -> Column:
    @F.pandas_udf("int")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([osa(p, q, DISTANCE) for p, q in zip(x, y)])

    return of(a, b)


def _ratio(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(p, q) for p, q in zip(x, y)])

    return of(a, b)


def _safe(pairs: DataFrame, src: str, dst: str) -> DataFrame:
    blocked = pairs.sparkSession.createDataFrame(list(fixed.BLOCKED), f"{src} string, {dst} string")
    return pairs.join(F.broadcast(blocked), [src, dst], "left_anti")


def closest(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, term, distance: the closest term within the distance allowed for the word's length, then the weightiest, then by name."""
    w = words.select("word", F.explode(_variants("word")).alias("v"))
    t = vocabulary.select("term", "weight", F.explode(_variants("term")).alias("_v"))
    near = F.abs(F.length("word") - F.length("term")) <= DISTANCE
    met = w.join(t, (F.col("v") == F.col("_v")) & near).select("word", "term", "weight").distinct()
    met = met.filter(F.levenshtein("word", "term", 2 * DISTANCE) >= 0).withColumn("distance", _osa("word", "term")).filter(F.col("distance") <= DISTANCE)
    best = Window.partitionBy("word").orderBy("distance", F.desc("weight"), "term")
    return met.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("word", "term", "distance")


def _allowed(word: Column) -> Column:
    return F.when(F.length(word) <= 5, 1).otherwise(DISTANCE)


def counted_weights(truth: DataFrame, vocabulary: DataFrame, items: str = "items") -> DataFrame:
    """term, weight: one more than the number of times that the term stands in the true lists. Terms are distinct."""
    terms = vocabulary.select("term").distinct()
    seen = truth.select(F.explode(items).alias("item")).groupBy(text.low(F.col("item")).alias("term")).agg(F.count(F.lit(1)).alias("_n"))
    return terms.join(seen, "term", "left").select("term", (F.coalesce("_n", F.lit(0)) + 1).cast("long").alias("weight"))


def _bare(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def _grams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))


def splittable(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The words that differ from some term by no more than the error rate allows, spaces apart. No other can be split into a term.

    An edit touches two of 2e + 1 equal slices at most, so with e edits one slice stands in both; at the error rate slices
    have three characters or more, and words meet terms over their trigrams. Words too short for an error are out: without
    one they would be the term itself.
    """
    w = words.select("word", _bare(F.col("word")).alias("own")).withColumn("edits", F.floor(F.length("own") * F.lit(ERRORS)).cast("int")).filter("edits > 0")
    t = vocabulary.select(_bare(F.col("term")).alias("bare")).distinct()
    met = w.select("word", "own", "edits", F.explode(_grams(F.col("own"))).alias("g")).join(t.select("bare", F.explode(_grams(F.col("bare"))).alias("_g")), F.col("g") == F.col("_g"))
    # A swap of neighbours is one edit here and two for the plain distance.
    near = (F.abs(F.length("own") - F.length("bare")) <= F.col("edits")) & (F.levenshtein("own", "bare") <= 2 * F.col("edits"))
    return met.filter(near).select("word").distinct()


def edges(words: DataFrame, vocabulary: DataFrame, longest: int) -> DataFrame:
    """word and its parts by end: for each place of the word without spaces all parts that end there, with start, text, cost and score.

    A part becomes the closest term within DISTANCE (then the weightiest, then by name) at the cost of the edits; without
    one it stays and costs its length. Each space of the word inside a part costs one, and so does each cut where the word
    has no space. Scores are logarithms of the terms' shares of all weight (in millionths, so that they add up exactly);
    a part that is no term scores as ten over ten to its length.
    """
    places = F.filter(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.when(F.substring("word", i, F.lit(1)) == " ", i)), lambda i: i.isNotNull())
    w = words.select("word", _bare(F.col("word")).alias("own"), F.transform(places, lambda i, k: i - 1 - k).alias("gaps"))
    ends = w.select("*", F.explode(F.sequence(F.lit(1), F.length("own"))).alias("stop"))
    cut = ends.select("*", F.explode(F.sequence(F.greatest(F.col("stop") - longest, F.lit(0)), F.col("stop") - 1)).alias("start"))
    cut = cut.withColumn("part", F.expr("substring(own, start + 1, stop - start)"))
    total = vocabulary.agg(F.sum("weight").alias("total"))
    told = closest(cut.select(F.col("part").alias("word")).distinct(), vocabulary).join(vocabulary.select("term", "weight"), "term").select(F.col("word").alias("part"), "term", "distance", "weight")
    rows = cut.join(told, "part", "left").crossJoin(F.broadcast(total))
    n = F.length("part")
    inside = F.size(F.filter("gaps", lambda g: (g > F.col("start")) & (g < F.col("stop"))))
    opens = F.when((F.col("start") == 0) | F.array_contains("gaps", F.col("start")), 0).otherwise(1)
    share = F.when(F.col("term").isNotNull(), F.log10(F.col("weight") / F.col("total"))).otherwise(F.log10(10 / F.col("total")) - n)
    edge = F.struct(
        F.col("start"), F.coalesce("term", "part").alias("text"), (F.coalesce("distance", n) + inside + opens).cast("int").alias("cost"), F.round(share * 1_000_000).cast("long").alias("score"),
    )
    by_end = rows.select("word", "stop", edge.alias("e")).groupBy("word", "stop").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return by_end.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("stop", "es"))), lambda x: x["es"]).alias("ends"))


def cheapest_cut(ends: Column) -> Column:
    """text, cost, score of the cheapest sequence of parts; the highest score on ties, then the first by text.

    One fold over the word's places: the best way to a place is that to the start of its last part, and that part.
    """
    first = F.array(F.struct(F.lit(0).alias("cost"), F.lit(0).cast("long").alias("loss"), F.lit("").alias("text")))

    def step(best: Column, parts: Column) -> Column:
        ways = F.transform(parts, lambda e: F.struct((F.element_at(best, e["start"] + 1)["cost"] + e["cost"]).alias("cost"), (F.element_at(best, e["start"] + 1)["loss"] - e["score"]).alias("loss"), F.concat_ws(" ", F.nullif(F.element_at(best, e["start"] + 1)["text"], F.lit("")), e["text"]).alias("text")))
        return F.concat(best, F.array(F.array_min(ways)))

    last = F.element_at(F.aggregate(ends, first, step), -1)
    return F.struct(last["text"].alias("text"), last["cost"].alias("cost"), (-last["loss"]).alias("score"))


def cuts(words: DataFrame, vocabulary: DataFrame, longest: int | None = None) -> DataFrame:
    """word, text, cost, score: each word cut into terms (see edges and cheapest_cut). Words are distinct and not empty."""
    if longest is None:
        longest = vocabulary.agg(F.coalesce(F.max(F.length("term")), F.lit(1))).first()[0] + DISTANCE
    return edges(words, vocabulary, longest).select("word", cheapest_cut(F.col("ends")).alias("c")).select("word", "c.*")


def segmented(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, term: words whose cheapest cut is a term, within the error rate."""
    found = cuts(splittable(words, vocabulary), vocabulary)
    allowed = F.col("cost") / F.greatest(F.length(_bare(F.col("word"))), F.lit(1)) <= ERRORS
    return found.filter(allowed).join(F.broadcast(vocabulary.select(F.col("term").alias("text")).distinct()), "text").select("word", F.col("text").alias("term"))


def likest(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, term: the term of the highest ratio of at least RATIO (95 up to four characters), by name on ties.

    A ratio of 90 leaves at most a tenth of both lengths as edits, so one of few equal slices must agree: words
    meet terms over the slices that the edits cannot all touch.
    """
    edits = F.floor((1 - RATIO / 100) * 2 * F.length("word") / (1 - (1 - RATIO / 100)) + 1).cast("int")
    w = words.withColumn("_e", edits)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 2, F.lit(1))), lambda i: F.substring("word", i, F.lit(3)))
    term_grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("term") - 2, F.lit(1))), lambda i: F.substring("term", i, F.lit(3)))
    met = w.select("word", "_e", F.explode(F.array_distinct(grams)).alias("g")).join(vocabulary.select("term", F.explode(F.array_distinct(term_grams)).alias("_g")), F.col("g") == F.col("_g"))
    met = met.select("word", "term", "_e").distinct().filter((F.abs(F.length("word") - F.length("term")) <= F.col("_e")) & (F.levenshtein("word", "term") <= F.col("_e")))
    met = met.withColumn("ratio", _ratio("word", "term")).filter((F.col("ratio") >= RATIO) & ((F.length("word") > 4) | (F.col("ratio") >= 95)))
    best = Window.partitionBy("word").orderBy(F.desc("ratio"), "term")
    return met.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("word", "term")


def corrections(candidates: DataFrame, vocabulary: DataFrame, aliases: DataFrame) -> DataFrame:
    """raw, fixed, step for the distinct candidates (column raw). vocabulary: term, weight; aliases: wrong, canonical.

    Steps: alias, known, code, short, near, split, like, words, kept.
    """
    words = candidates.select("raw").distinct().withColumn("word", text.clean_ocr(F.col("raw")))
    known = F.broadcast(vocabulary.select(F.col("term").alias("_known")).distinct())
    rows = words.join(F.broadcast(aliases), F.col("word") == F.col("wrong"), "left").join(known, F.col("word") == F.col("_known"), "left")
    code = text.additive_code(F.col("word"))
    rows = rows.withColumn("_code", code).join(F.broadcast(vocabulary.select(F.col("term").alias("_kc")).distinct()), (F.col("_code") == F.col("_kc")) & (F.col("_code") != F.col("word")), "left")
    step = F.when(F.length("word") < 2, "kept").when(F.col("canonical").isNotNull(), "alias").when(F.col("_known").isNotNull(), "known").when(F.col("_kc").isNotNull(), "code").when(F.length("word") <= 3, "short")
    value = F.when(F.length("word") == 0, F.col("raw")).when(step == "alias", F.col("canonical")).when(step == "code", F.col("_kc")).otherwise(F.col("word"))
    rows = rows.select("raw", "word", step.alias("step"), value.alias("fixed"))
    done = rows.filter("step is not null").select("raw", "fixed", "step")
    left = rows.filter("step is null").select("word").distinct()
    near = _safe(closest(left, vocabulary).filter(F.col("distance") <= _allowed(F.col("word"))).select("word", "term"), "word", "term").withColumn("step", F.lit("near")).withColumn("rank", F.lit(1))
    split = _safe(segmented(left, vocabulary), "word", "term").withColumn("step", F.lit("split")).withColumn("rank", F.lit(2))
    like = _safe(likest(left, vocabulary), "word", "term").withColumn("step", F.lit("like")).withColumn("rank", F.lit(3))
    parts = left.filter(F.col("word").contains(" ")).select(F.col("word").alias("phrase"), F.posexplode(F.split("word", " ")).alias("pos", "word"))
    single = _safe(closest(parts.filter(F.length("word") > 3).select("word").distinct(), vocabulary).filter(F.col("distance") <= _allowed(F.col("word"))).select("word", "term"), "word", "term")
    mended = parts.join(single, "word", "left").groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("term", "word").alias("w")))), lambda x: x["w"]), " ").alias("term"))
    mended = mended.filter("phrase <> term").select(F.col("phrase").alias("word"), "term", F.lit("words").alias("step"), F.lit(4).alias("rank"))
    found = near.unionByName(split).unionByName(like).unionByName(mended)
    best = found.groupBy("word").agg(F.min(F.struct("rank", "term", "step")).alias("b")).select("word", "b.term", F.col("b.step").alias("_step"))
    rest = rows.filter("step is null").select("raw", "word").join(best, "word", "left").select("raw", F.coalesce("term", "word").alias("fixed"), F.coalesce("_step", F.lit("kept")).alias("step"))
    return done.unionByName(rest)


def corrected_lists(lists: DataFrame, vocabulary: DataFrame | None, aliases: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, items: junk out, cleaned, corrected (only with a vocabulary), aliases, no repeats, post-processed."""
    rows = lists.select(key, F.posexplode("items").alias("pos", "raw")).withColumn("raw", text.strip(F.col("raw"))).filter((F.col("raw") != "") & ~text.is_junk_item(F.col("raw")))
    if vocabulary is None:
        rows = rows.withColumn("fixed", text.clean_ocr(F.col("raw")))
    else:
        rows = rows.join(corrections(rows.select("raw"), vocabulary, aliases).select("raw", "fixed"), "raw")
    rows = rows.filter(F.length("fixed") >= 2).join(F.broadcast(aliases), F.col("fixed") == F.col("wrong"), "left").withColumn("fixed", F.coalesce("canonical", "fixed"))
    made = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fixed"))), lambda x: x["fixed"]).alias("items"))
    tidy = F.filter(F.transform(F.filter(text.distinct_items(F.col("items")), lambda x: ~text.is_warning_prefix(x)), text.post_process), lambda x: F.length(x) > 1)
    none = F.array().cast("array<string>")
    return lists.select(key).join(made.withColumn("items", tidy), key, "left").withColumn("items", F.coalesce("items", none))


def corrected_text(rows: DataFrame, column: str, vocabulary: DataFrame | None, aliases: DataFrame) -> DataFrame:
    """Rows with the text split into items, corrected and joined again; texts that leave no item stay as they are.

    Each distinct text is split, corrected and joined once. Its items are written, as all steps read them, and so is the
    result, whose size tells how the rows meet it.
    """
    texts = rows.select(F.col(column).alias("_was")).filter(F.col("_was").isNotNull()).distinct()
    items = saved(texts.select("_was", text.split_ingredients(F.col("_was")).alias("items")), "items")
    made = saved(corrected_lists(items, vocabulary, aliases, "_was").select("_was", F.array_join("items", ", ").alias("_text")), "texts")
    out = rows.join(made, rows[column] == F.col("_was"), "left")
    return out.withColumn(column, F.coalesce(F.nullif("_text", F.lit("")), F.col(column))).drop("_was", "_text")
