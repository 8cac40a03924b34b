"""Verdicts, as queries: each document is a scan of one of the users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.terms import TERMS
from ..operators import analysis as op
from ..session import table
from ..sources import views
from . import sqltext as s
from .catalog import add


def scans(spark, d):
    users = table(spark, d, "customer").count()
    return views.lists(spark, d).select(F.col("doc_id").alias("scan_id"), (F.col("doc_id") % users).alias("user_id"), "items")


_SCAN = "scan AS (SELECT doc_id AS scan_id, doc_id % (SELECT count(*) FROM customer) AS user_id, items FROM v_lists)"
#: Categories of the rules in their order, then those that no rule asks for.
_CATEGORIES = [(cat, words) for _, cat, words in fixed.RULES] + [(cat, "") for cat in TERMS if cat not in {c for _, c, _ in fixed.RULES}]
_TERMS = "terms(rank, ord, cat, words, term) AS (VALUES " + ", ".join(f"({r}, {o}, '{cat}', {s.q(words)}, {s.q(t)})" for r, (cat, words) in enumerate(_CATEGORIES) for o, t in enumerate(TERMS[cat])) + ")"
_MATCH = "CASE WHEN contains(trim({t}), ' ') THEN contains(lower({i}), lower({t})) ELSE regexp_matches(lower({i}), '(^|[^a-z0-9])' || regexp_escape(lower({t})) || '([^a-z0-9]|$)') END"
_ON = " OR ".join(f"(t.cat = '{cat}' AND p.{flag})" for flag, cat, _ in fixed.RULES)


#: Each distinct item meets the terms once.
_HIT = "hit AS (SELECT i, t.* FROM (SELECT DISTINCT unnest(items) AS i FROM {of}) JOIN terms t ON " + _MATCH.format(t="t.term", i="i") + ")"


def _verdict(scan: str, known: str = "p.user_id IS NOT NULL") -> str:
    """SQL of the verdict over a relation scan(scan_id, user_id, items)."""
    own = _MATCH.format(t="a", i="i")
    return (
        f"WITH {views.SQL_LISTS}, {views.SQL_PROFILES}, {_TERMS}, {scan}, "
        f"{_HIT.format(of='scan')}, w AS (SELECT DISTINCT scan_id, rank, ord, words || term AS w FROM (SELECT scan_id, user_id, unnest(items) AS i FROM scan) JOIN hit t USING (i) JOIN v_profiles p USING (user_id) WHERE {_ON} "
        f"UNION ALL SELECT scan_id, 9, 0, 'Contains your allergens: ' || array_to_string(own, ', ') FROM (SELECT scan_id, list_filter(p.allergens, lambda a: len(list_filter(items, lambda i: {own})) > 0) AS own FROM scan JOIN v_profiles p USING (user_id)) WHERE len(own) > 0), "
        "l AS (SELECT scan_id, string_agg(w, chr(10) ORDER BY rank, ord) AS warnings FROM w GROUP BY scan_id) "
        f"SELECT scan.scan_id, scan.user_id, CASE WHEN {known} THEN l.warnings IS NULL ELSE false END AS is_safe, CASE WHEN {known} THEN coalesce(l.warnings, '') ELSE '{fixed.NO_PROFILE[0]}' END AS warnings, "
        f"CASE WHEN NOT ({known}) THEN '{fixed.NO_PROFILE[1]}' WHEN l.warnings IS NULL THEN '{fixed.SAFE}' ELSE '{fixed.UNSAFE}' || chr(10) || l.warnings END AS analysis_result FROM scan LEFT JOIN v_profiles p USING (user_id) LEFT JOIN l USING (scan_id)"
    )


def _flat(df):
    return df.withColumn("warnings", F.array_join("warnings", "\n"))


add("a2_analyze_ingredients", lambda sp, d: _flat(op.analyze(scans(sp, d), views.profiles(sp, d))), _verdict(_SCAN))
add(
    "a1_rule_analysis",
    lambda sp, d: _flat(op.with_verdict(scans(sp, d).join(views.profiles(sp, d), "user_id")).select("scan_id", "user_id", "is_safe", "warnings", "analysis_result")),
    _verdict(_SCAN) + " WHERE p.user_id IS NOT NULL",
)
add(
    "a4_joined_element",
    lambda sp, d: _flat(op.analyze(scans(sp, d).withColumn("items", F.array(F.array_join("items", ", "))), views.profiles(sp, d))),
    _verdict(_SCAN.replace("user_id, items FROM", "user_id, [array_to_string(items, ', ')] AS items FROM")),
)
add(
    "j1_term_matches",
    lambda sp, d: op.with_term_hits(views.lists(sp, d)).select("doc_id", F.explode(F.flatten(F.array(*[F.transform(op.of_category(F.col("_hits"), c), (lambda c: lambda t: F.concat(F.lit(c + ":"), t))(c)) for c in TERMS]))).alias("hit")),
    f"WITH {views.SQL_LISTS}, {_TERMS}, {_HIT.format(of='v_lists')} SELECT DISTINCT doc_id, cat || ':' || term AS hit FROM (SELECT doc_id, unnest(items) AS i FROM v_lists) JOIN hit USING (i)",
)
add(
    "j2_scan_profile",
    lambda sp, d: scans(sp, d).join(views.profiles(sp, d), "user_id", "left").select("scan_id", "user_id", "vegan", "halal"),
    f"WITH {views.SQL_LISTS}, {views.SQL_PROFILES}, {_SCAN} SELECT scan_id, user_id, vegan, halal FROM scan LEFT JOIN v_profiles USING (user_id)",
)
_OVER = "CASE WHEN scan_id % 3 = 0 THEN ['Contains allergen: Milk', 'May contain traces of: Nuts'] ELSE []::VARCHAR[] END"


def _overlay(sp, d):
    rows = op.with_verdict(scans(sp, d).join(views.profiles(sp, d), "user_id"))
    third, none = F.col("scan_id") % 3 == 0, F.array().cast("array<string>")
    rows = rows.withColumns({"product_allergens": F.when(third, F.array(F.lit("Milk"))).otherwise(none), "product_traces": F.when(third, F.array(F.lit("Nuts"))).otherwise(none)})
    return _flat(op.overlay_product(rows)).select("scan_id", "is_safe", "warnings")


add("a3_product_overlay", _overlay, f"SELECT scan_id, is_safe AND scan_id % 3 <> 0 AS is_safe, array_to_string(list_concat(CASE WHEN warnings = '' THEN []::VARCHAR[] ELSE string_split(warnings, chr(10)) END, {_OVER}), chr(10)) AS warnings FROM ({_verdict(_SCAN)} WHERE p.user_id IS NOT NULL)")
add(
    "a5_path_choice",
    lambda sp, d: scans(sp, d).select("scan_id", F.when(F.col("scan_id") % 4 == 0, "model").when(F.size("items") > 5, "boxes").otherwise("fallback").alias("path"), F.when((F.col("scan_id") % 4 == 0) & (F.col("scan_id") % 8 == 0), 0).otherwise(F.size("items")).alias("n")),
    f"WITH {views.SQL_LISTS}, {_SCAN} SELECT scan_id, CASE WHEN scan_id % 4 = 0 THEN 'model' WHEN len(items) > 5 THEN 'boxes' ELSE 'fallback' END AS path, CASE WHEN scan_id % 8 = 0 THEN 0 ELSE len(items) END AS n FROM scan",
)
add(
    "a8_compliance",
    lambda sp, d: op.analyze(scans(sp, d), views.profiles(sp, d)).groupBy((F.col("scan_id") % 2 == 0).alias("expected_safe")).agg(F.count_if(F.col("is_safe") == (F.col("scan_id") % 2 == 0)).alias("correct"), F.count(F.lit(1)).alias("n")),
    f"SELECT scan_id % 2 = 0 AS expected_safe, count(*) FILTER (WHERE is_safe = (scan_id % 2 = 0)) AS correct, count(*) AS n FROM ({_verdict(_SCAN)}) GROUP BY 1",
)
_RAW = "CASE WHEN user_id % 4 = 0 THEN '{\"is_safe\": true, \"warnings\": [\"a\", \"b\"], \"analysis_result\": \"r\"}' WHEN user_id % 4 = 1 THEN '{\"is_safe\": true, \"warnings\": [], \"analysis_result\": \"r\"}' WHEN user_id % 4 = 2 THEN '{\"is_safe\": true}' ELSE '{\"is_safe\": false, \"warnings\": \"x\", \"analysis_result\": \"r\"}' END"
add(
    "x2_checked_replies",
    lambda sp, d: _flat(op.checked_replies(table(sp, d, "customer").select(F.col("c_custkey").alias("user_id")).withColumn("raw", F.expr(_RAW)))).select("user_id", "valid", "is_safe", F.coalesce("warnings", F.lit("")).alias("warnings")),
    f"SELECT user_id, json_extract(raw, '$.warnings') IS NOT NULL AS valid, CASE WHEN json_extract(raw, '$.warnings') IS NOT NULL THEN user_id % 4 = 1 END AS is_safe, CASE WHEN user_id % 4 = 0 THEN 'a' || chr(10) || 'b' ELSE '' END AS warnings FROM (SELECT c_custkey AS user_id, {_RAW.replace('user_id', 'c_custkey')} AS raw FROM customer)",
)
add("s14_restriction_terms", lambda sp, d: sp.createDataFrame([(c, o, t) for c, ts in TERMS.items() for o, t in enumerate(ts)], "cat string, ord long, term string"), f"WITH {_TERMS} SELECT cat, ord, term FROM terms")
add(
    "k5_edit_items",
    lambda sp, d: _flat(op.analyze(scans(sp, d).withColumn("items", F.filter(F.transform(F.slice("items", 2, 20), text.strip), lambda x: x != "")), views.profiles(sp, d))),
    _verdict(_SCAN.replace("user_id, items FROM", f"user_id, list_filter(list_transform(items[2:], lambda x: {s.strip('x')}), lambda x: x <> '') AS items FROM")),
)
