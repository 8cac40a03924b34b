"""Verdict and warnings of ingredient lists against dietary profiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.terms import TERMS


def term_pattern(term: Column) -> Column:
    """The pattern of a term: several words anywhere, one word between characters that are no ASCII letter or digit."""
    t = text.low(term)
    quoted = F.regexp_replace(t, r"([\\\[\]{}().*+?^$|-])", r"\\$1")
    return F.when(t.contains(" "), quoted).otherwise(F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])")))


def contains_term(item: Column, term: Column) -> Column:
    """Whether an item holds a term; blank items and terms hold and are nothing."""
    i, t = text.low(item), text.low(term)
    return (i != "") & (t != "") & F.when(t.contains(" "), i.contains(t)).otherwise(F.rlike(i, term_pattern(term)))


#: The index of all terms: those of one plain word stand for themselves; those of several are known by the two characters
#: around their first space, those of one word with marks by the word inside.
ALL_TERMS = tuple(dict.fromkeys(t for ts in TERMS.values() for t in ts))
PLAIN = tuple(t for t in ALL_TERMS if re.fullmatch("[a-z0-9]+", t))
PHRASES = tuple(t for t in ALL_TERMS if " " in t)
MARKED = tuple(t for t in ALL_TERMS if t not in {*PLAIN, *PHRASES})


def around_space(words: Column) -> Column:
    """The characters before and after each space between two words, from the words of one item."""
    pairs = F.arrays_zip(F.slice(words, F.lit(1), F.size(words) - 1).alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"))
    return F.transform(pairs, lambda p: F.concat(F.right(p["a"], F.lit(1)), F.lit(" "), F.left(p["b"], F.lit(1))))


def with_term_hits(rows: DataFrame, items: str = "items", name: str = "_hits") -> DataFrame:
    """Adds the terms, of any category and in the index's order, that any of the row's items holds.

    Items are taken apart once: words of letters and digits meet the plain terms, the characters around spaces meet the
    phrases' keys, both by hashed intersection; only phrases whose key is met are searched. A phrase holds its key, so none
    is missed. The steps are columns of their own, as lambdas work out what stands in them for each element.
    """
    none = F.array().cast("array<string>")
    low, words, keys = name + "_low", name + "_words", name + "_keys"
    rows = rows.withColumn(low, F.transform(F.array_compact(F.coalesce(items, none)), F.lower))
    rows = rows.withColumn(words, F.array_distinct(F.flatten(F.transform(low, lambda i: F.split(i, "[^a-z0-9]+")))))
    rows = rows.withColumn(keys, F.array_intersect(F.array_distinct(F.flatten(F.transform(low, lambda i: around_space(F.split(i, " "))))), F.array(*[F.lit(k) for k in dict.fromkeys(map(_key, PHRASES))])))
    by_key: dict[str, list[str]] = {}
    for t in PHRASES:
        by_key.setdefault(_key(t), []).append(t)
    table = F.create_map(*[x for k, ts in by_key.items() for x in (F.lit(k), F.array(*map(F.lit, ts)))])
    likely = F.flatten(F.transform(keys, lambda k: F.element_at(table, k)))
    phrases = F.filter(likely, lambda t: F.exists(low, lambda i: i.contains(t)))
    plain = F.array_intersect(F.array(*map(F.lit, PLAIN)), F.col(words))
    marked = [F.when(F.array_contains(words, re.search("[a-z0-9]+", t)[0]) & F.exists(low, lambda i: F.rlike(i, F.lit(_plain_pattern(t)))), t) for t in MARKED]  # noqa: B023
    return rows.withColumn(name, F.array_compact(F.concat(plain, phrases, F.array(*marked).cast("array<string>")))).drop(low, words, keys)


def _key(phrase: str) -> str:
    at = phrase.index(" ")
    return phrase[at - 1 : at + 2]


def _plain_pattern(term: str) -> str:
    return f"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])"


def of_category(hits: Column, category: str) -> Column:
    """The hits that are terms of the category, in the category's order."""
    return F.array_intersect(F.array(*map(F.lit, TERMS[category])), hits)


def rule_warnings(hits: Column, items: Column, profile: dict[str, Column] | None = None) -> Column:
    """Warnings in order: flags as in RULES, terms in their order, then one for all matched own allergens."""
    of = profile or {flag: F.col(flag) for flag, _, _ in fixed.RULES} | {"allergens": F.col("allergens")}
    none = F.array().cast("array<string>")
    parts = [F.when(of[flag], _worded(of_category(hits, cat), words)).otherwise(none) for flag, cat, words in fixed.RULES]
    own = F.filter(F.coalesce(of["allergens"], none), lambda a: F.exists(items, lambda i: contains_term(i, a)))
    parts.append(F.when(F.size(own) > 0, F.array(F.concat(F.lit("Contains your allergens: "), F.array_join(own, ", ")))).otherwise(none))
    return F.concat(*parts)


def _worded(terms: Column, words: str) -> Column:
    return F.transform(terms, lambda t: F.concat(F.lit(words), t))


def with_verdict(rows: DataFrame, items: str = "items", has_profile: Column | None = None) -> DataFrame:
    """Adds is_safe, warnings, analysis_result. Without a profile: unsafe, with a fixed warning."""
    out = with_term_hits(rows, items)
    out = out.withColumn("warnings", F.coalesce(rule_warnings(F.col("_hits"), F.col(items)), F.array().cast("array<string>"))).drop("_hits")
    known = F.lit(True) if has_profile is None else has_profile
    out = out.withColumn("warnings", F.when(known, F.col("warnings")).otherwise(F.array(F.lit(fixed.NO_PROFILE[0]))))
    told = F.when(F.size("warnings") == 0, fixed.SAFE).otherwise(F.concat(F.lit(fixed.UNSAFE + "\n"), F.array_join("warnings", "\n")))
    return out.withColumns({"is_safe": F.size("warnings") == 0, "analysis_result": F.when(known, told).otherwise(F.lit(fixed.NO_PROFILE[1]))})


def analyze(scans: DataFrame, profiles: DataFrame, replies: DataFrame | None = None, key: str = "scan_id") -> DataFrame:
    """Scans (key, user_id, items) with their user's profile; a checked reply of a model goes before the rules."""
    rows = scans.join(profiles.withColumn("_known", F.lit(True)), "user_id", "left")
    out = with_verdict(rows, has_profile=F.coalesce("_known", F.lit(False)))
    if replies is not None:
        r = replies.select(F.col(key), F.struct("is_safe", "warnings", "analysis_result").alias("_reply"))
        out = out.join(r, key, "left")
        use = F.col("_reply").isNotNull() & F.col("_known").isNotNull()
        out = out.withColumns({c: F.when(use, F.col("_reply")[c]).otherwise(F.col(c)) for c in ("is_safe", "warnings", "analysis_result")})
    return out.select(key, "user_id", "is_safe", "warnings", "analysis_result")


def overlay_product(rows: DataFrame, allergens: str = "product_allergens", traces: str = "product_traces") -> DataFrame:
    """Appends a product's allergens and traces as warnings if absent; safe only if it was and nothing was appended."""
    new = F.concat(_worded(F.col(allergens), "Contains allergen: "), _worded(F.col(traces), "May contain traces of: "))
    more = F.concat("warnings", F.filter(new, lambda x: ~F.array_contains(F.col("warnings"), x)))
    return rows.withColumn("_all", more).withColumns({"is_safe": F.col("is_safe") & (F.size("_all") == F.size("warnings")), "warnings": F.col("_all")}).drop("_all")


def checked_replies(replies: DataFrame) -> DataFrame:
    """Model replies (key columns, raw): is_safe, warnings, analysis_result; null struct fields where one of the three is missing.

    Warnings that are no list become none; any warning makes the reply unsafe.
    """
    field = {k: F.get_json_object("raw", f"$.{k}") for k in ("is_safe", "warnings", "analysis_result")}
    whole = field["is_safe"].isNotNull() & field["warnings"].isNotNull() & field["analysis_result"].isNotNull()
    listed = F.when(field["warnings"].startswith("["), F.from_json(field["warnings"], "array<string>")).otherwise(F.array().cast("array<string>"))
    safe = field["is_safe"].isin("true", "1") & (F.size(listed) == 0)
    return replies.withColumns({"valid": whole, "is_safe": F.when(whole, safe), "warnings": F.when(whole, listed), "analysis_result": F.when(whole, field["analysis_result"])})
