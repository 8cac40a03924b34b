"""Tests on label strings, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..session import table
from ..sources import views
from . import sqltext as s
from .catalog import add


def by_term(name: str, expr, sql: str) -> None:
    """A function of each term: doc_id, pos, value."""
    add(name, lambda spark, d: views.ingredients(spark, d).select("doc_id", "pos", expr(F.col("term")).alias("value")), f"WITH {views.SQL_INGREDIENTS} SELECT doc_id, pos, {sql} AS value FROM v_ingredients")


def by_box(name: str, expr, sql: str) -> None:
    """A test of each box text: the boxes that pass."""
    add(name, lambda spark, d: views.boxes(spark, d).filter(expr(F.col("text"))).select("image_id", "box_id", "text"), f"WITH {views.SQL_BOXES} SELECT image_id, box_id, text FROM v_boxes WHERE {sql}")


by_term("p4_header", text.is_header, s.is_header("term"))
by_term("p5_bad_hint", text.has_bad_hint, s.has_bad_hint("term"))
by_box("p6_junk_fragment", text.is_junk_fragment, s.is_junk_fragment("text"))
by_term("p7_continuation", text.is_continuation, s.is_continuation("term"))
by_term("p11_section_start", text.is_start, s.is_start("term"))
by_term("p12_section_stop", text.is_stop, s.is_stop("term"))
by_term("p13_garbage", text.is_garbage, s.is_garbage("term"))
by_term("p14_allergen_warning", text.is_warning, s.is_warning("term"))
by_term("p15_valid_item", text.is_valid_item, s.is_valid_item("term"))
by_term("p16_image_line", lambda c: text.is_image_line(F.concat(F.lit("!["), c, F.lit("](a)"))), s.has(s.strip("'![' || term || '](a)'"), r"^!\[[^\]]*\]\([^)]*\)\s*$"))
by_term("p17_junk_item", text.is_junk_item, s.is_junk_item("term"))
by_term("p18_warning_prefix", text.is_warning_prefix, s.is_warning_prefix("term"))

add(
    "p3_confidence",
    lambda spark, d: views.boxes(spark, d).filter((text.strip(F.col("text")) != "") & (F.coalesce("confidence", F.lit(1.0)) >= 0.3)).select("image_id", "box_id", text.strip(F.col("text")).alias("text")),
    f"WITH {views.SQL_BOXES} SELECT image_id, box_id, {s.strip('text')} AS text FROM v_boxes WHERE {s.strip('text')} <> '' AND coalesce(confidence, 1.0) >= 0.3",
)
add(
    "p8_positive_boxes",
    lambda spark, d: views.boxes(spark, d).filter(
        (F.col("pred_prob") >= fixed.THRESHOLD) & ~text.is_header(F.col("text")) & ~(text.is_junk_fragment(F.col("text")) & (F.col("pred_prob") < fixed.STRONG)) & ~(text.has_bad_hint(F.col("text")) & (F.col("pred_prob") < fixed.HINTED))
    ).select("image_id", "box_id", "pred_prob"),
    f"WITH {views.SQL_BOXES} SELECT image_id, box_id, pred_prob FROM v_boxes WHERE pred_prob >= 0.4 AND NOT {s.is_header('text')} AND NOT ({s.is_junk_fragment('text')} AND pred_prob < 0.8) AND NOT ({s.has_bad_hint('text')} AND pred_prob < 0.92)",
)
add(
    "p19_barcode",
    lambda spark, d: table(spark, d, "part").select("p_partkey", text.strip(F.when(F.col("p_partkey") % 7 == 0, F.lit("  ")).when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("a"), F.col("p_partkey").cast("string"))).otherwise(F.lpad(F.col("p_partkey").cast("string"), 13, "0"))).alias("code")).select(
        "p_partkey", "code", F.when(F.col("code") == "", "empty").when(~F.col("code").rlike("^[0-9]+$"), "not digits").otherwise("ok").alias("status")
    ),
    "WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN 'a' || p_partkey ELSE lpad(p_partkey::VARCHAR, 13, '0') END AS code FROM part) SELECT p_partkey, code, CASE WHEN code = '' THEN 'empty' WHEN NOT regexp_matches(code, '^[0-9]+$') THEN 'not digits' ELSE 'ok' END AS status FROM c",
)
_BLOCKED = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in fixed.BLOCKED) + ")"


def _blocked(spark, d):
    """Proposed corrections (each term to the next of its list) without the blocked pairs."""
    rows = views.lists(spark, d).select("doc_id", F.explode(F.arrays_zip(F.slice("items", 1, F.size("items") - 1).alias("src"), F.slice("items", 2, F.size("items")).alias("dst"))).alias("p")).select("doc_id", F.lower("p.src").alias("src"), F.lower("p.dst").alias("dst"))
    rows = rows.unionAll(table(spark, d, "documents").select("doc_id", F.lit("salt").alias("src"), F.when(F.col("doc_id") % 2 == 0, "malt").otherwise("salts").alias("dst")))
    return rows.join(F.broadcast(spark.createDataFrame(list(fixed.BLOCKED), "src string, dst string")), ["src", "dst"], "left_anti").select("doc_id", "src", "dst")


add(
    "p20_blocked_corrections",
    _blocked,
    f"WITH {views.SQL_LISTS}, p AS (SELECT doc_id, lower(unnest(items[:len(items) - 1])) AS src, lower(unnest(items[2:])) AS dst FROM v_lists UNION ALL SELECT doc_id, 'salt', CASE WHEN doc_id % 2 = 0 THEN 'malt' ELSE 'salts' END FROM documents) SELECT doc_id, src, dst FROM p WHERE (src, dst) NOT IN (SELECT * FROM {_BLOCKED} t(a, b))",
)
add(
    "p21_skip_segments",
    lambda spark, d: (lambda v: v.join(v.filter(F.col("pos") % 2 == 0).select("doc_id", text.squeeze(F.lower("term")).alias("key")).distinct(), "doc_id").filter(text.squeeze(F.lower("term")) == F.col("key")).select("doc_id", "pos", "term"))(views.ingredients(spark, d)),
    f"WITH {views.SQL_INGREDIENTS} SELECT doc_id, pos, term FROM v_ingredients v WHERE EXISTS (SELECT 1 FROM v_ingredients k WHERE k.doc_id = v.doc_id AND k.pos % 2 = 0 AND {s.squeeze('lower(k.term)')} = {s.squeeze('lower(v.term)')})",
)
add("p23_english", lambda spark, d: table(spark, d, "documents").filter((F.trim("text") != "") & (F.col("lang") == "en")).select("doc_id"), "SELECT doc_id FROM documents WHERE trim(text) <> '' AND lang = 'en'")
_EIGHT = ("milk", "egg", "fish", "shellfish", "tree nut", "peanut", "wheat", "soy")
by_term("p25_common_allergen", lambda c: F.lower(c).rlike(text.phrases(_EIGHT)), "(" + " OR ".join(f"contains(lower(term), '{w}')" for w in _EIGHT) + ")")
by_term("p24_highlight", lambda c: F.exists(F.filter(F.transform(F.split(F.lit("milk, egg and nuts"), r",| and "), text.strip), lambda w: F.length(w) >= 3), lambda w: F.lower(c).contains(w)), "(contains(lower(term), 'milk') OR contains(lower(term), 'egg') OR contains(lower(term), 'nuts'))")
add(
    "p27_declared_allergens",
    lambda spark, d: views.ingredients(spark, d).join(views.profiles(spark, d), F.col("doc_id") == F.col("user_id")).filter(F.exists("allergens", lambda a: F.lower("term").contains(F.lower(a)))).select("doc_id", "pos", "term"),
    f"WITH {views.SQL_INGREDIENTS}, {views.SQL_PROFILES} SELECT doc_id, pos, term FROM v_ingredients JOIN v_profiles ON doc_id = user_id WHERE len(list_filter(allergens, lambda a: contains(lower(term), lower(a)))) > 0",
)
