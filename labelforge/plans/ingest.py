"""Sources, products, replies and correction, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import corrector, products
from ..session import table
from ..sources import readers, views
from . import sqltext as s
from .catalog import add



def _responses(sp, d):
    """Product replies of the parts, as JSON text."""
    e = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.initcap("p_name"))
    product = F.struct(
        F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("product_name"), e.alias("product_name_en"), F.col("p_brand").alias("brands"),
        F.concat(F.lit("Ingredients: "), F.col("p_name"), F.lit(" 30%, salt (sea, rock), x,  milk. ")).alias("ingredients_text"), F.lit("en:milk,en:tree-nuts").alias("allergens"),
        F.array(F.lit("en:milk"), F.lit("en:tree-nuts"), F.lit("en:soy-beans")).alias("allergens_tags"), F.when(F.col("p_partkey") % 2 == 0, "en:egg").alias("traces"),
    )
    return table(sp, d, "part").select(F.col("p_partkey").cast("string").alias("code"), F.to_json(F.struct(F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(1).alias("status"), product.alias("product"))).alias("raw"))


def _lookup(sp, d):
    replies = _responses(sp, d).withColumn("r", F.from_json("raw", f"status int, product struct<{products.PRODUCT}>")).select("code", "r.status", "r.product")
    scans = table(sp, d, "part").select(F.col("p_partkey").alias("scan_id"), F.when(F.col("p_partkey") % 7 == 0, " ").when(F.col("p_partkey") % 11 == 0, "a1").otherwise(F.concat(F.lit(" "), F.col("p_partkey").cast("string"))).alias("code"))
    return products.lookup(scans, replies)


_PART = "p AS (SELECT p_partkey AS scan_id, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN 'a1' ELSE p_partkey::VARCHAR END AS code, p_name, p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS found FROM part)"
add("a7_barcode_lookup", lambda sp, d: _lookup(sp, d).select("scan_id", "status"), f"WITH {_PART} SELECT scan_id, CASE WHEN code = '' THEN 'empty' WHEN code = 'a1' THEN 'not digits' WHEN NOT found THEN 'not found' ELSE 'ok' END AS status FROM p")
add("s9_product_join", lambda sp, d: _lookup(sp, d).select("scan_id", "brands"), "SELECT p_partkey AS scan_id, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 THEN p_brand END AS brands FROM part")
_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
add("f33_english_first", lambda sp, d: _lookup(sp, d).select("scan_id", "name"), f"WITH {_PART} SELECT scan_id, CASE WHEN found THEN CASE WHEN scan_id % 3 = 0 THEN p_name ELSE {_TITLE} END END AS name FROM p")
add("f34_allergens_traces", lambda sp, d: _lookup(sp, d).select("scan_id", F.array_join("allergens", "|").alias("allergens"), F.array_join("traces", "|").alias("traces")), f"WITH {_PART} SELECT scan_id, CASE WHEN found THEN 'Milk|Tree-Nuts|Tree Nuts|Soy Beans' END AS allergens, CASE WHEN found THEN CASE WHEN scan_id % 2 = 0 THEN 'Egg' ELSE '' END END AS traces FROM p")
add("f2_parse_products", lambda sp, d: _lookup(sp, d).select("scan_id", F.array_join("ingredients", "|").alias("items")), f"WITH {_PART} SELECT scan_id, CASE WHEN found THEN p_name || '|salt (sea, rock)|milk' END AS items FROM p")

_CORE = "'{\"items\":[\"a\",\"' || conv_id || '\"]}'"
_REPLY = f"CASE conv_id % 5 WHEN 0 THEN {_CORE} WHEN 1 THEN '```json\n' || {_CORE} || '\n```' WHEN 2 THEN 'Sure, here it is: ' || {_CORE} || ' Bye' WHEN 3 THEN 'list [\"a\",\"' || conv_id || '\"] end' ELSE 'none' END"


def _replies(sp, d):
    return table(sp, d, "conversations").select("conv_id", "turn").withColumn("raw", F.expr(_REPLY.replace("\n", "\\n")))


add("x1_repair", lambda sp, d: _replies(sp, d).select("conv_id", "turn", products.repaired(F.col("raw")).alias("value")), f"SELECT conv_id, turn, CASE WHEN conv_id % 5 < 4 THEN {_CORE} END AS value FROM conversations")
add("x3_extraction_reply", lambda sp, d: _replies(sp, d).select("conv_id", "turn", F.array_join(F.from_json(products.repaired(F.col("raw")), "items array<string>")["items"], "|").alias("items")), "SELECT conv_id, turn, CASE WHEN conv_id % 5 < 4 THEN 'a|' || conv_id END AS items FROM conversations")
add("x4_text_field", lambda sp, d: readers.json_lines(table(sp, d, "events").select(F.when(F.col("event_id") % 10 == 0, "{bad").otherwise(F.col("props")).alias("line"), "event_id"), "k int").filter("ok").select("event_id", "row.k"), "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events WHERE event_id % 10 <> 0")
add("s5_line_counters", lambda sp, d: readers.json_lines(table(sp, d, "events").select(F.when(F.col("event_id") % 10 == 0, "{bad").when(F.col("event_id") % 10 == 1, "  ").otherwise(F.col("props")).alias("line")), "k int").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad")), "SELECT count(*) FILTER (WHERE event_id % 10 > 1) AS good, count(*) FILTER (WHERE event_id % 10 = 0) AS bad FROM events")
add("s2_truth_lists", lambda sp, d: readers.truth_lists(views.pairs(sp, d).select(F.col("doc_id").cast("string").alias("image"), F.when(F.size("truth") > 0, F.concat("truth", F.array(F.lit("  ")))).alias("true_ingredients"))).select("image", F.array_join("true_ingredients", "|").alias("items")), f"WITH {views.SQL_PAIRS} SELECT doc_id::VARCHAR AS image, array_to_string(truth, '|') AS items FROM v_pairs")
add("s3_detection_map", lambda sp, d: readers.detection_map(table(sp, d, "labels").select(F.concat(F.lit('{"_meta": [], "img'), F.col("doc_id").cast("string"), F.lit('": [{"bbox": [[0, 0], [4, 0], [4, 2], [0, 2]], "text": "t", "confidence": 0.5}]}')).alias("raw"))).select("image_id", F.size("detections").alias("n")), "SELECT 'img' || doc_id AS image_id, 1 AS n FROM labels")
add("s8_uploads", lambda sp, d: readers.accepted_uploads(table(sp, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "text/plain").otherwise("image/png").alias("mime"), (F.col("n_chars") * 4000).alias("length"))).select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND n_chars * 4000 <= 10485760")
add("s13_vocabulary", lambda sp, d: readers.vocabulary(sp), "SELECT term, weight FROM (VALUES " + ", ".join(f"({s.q(t)}, {w})" for t, w in readers.VOCABULARY) + ") t(term, weight)")
add("f28_normalized_scan", lambda sp, d: table(sp, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(", a\n b ,"))).otherwise(F.to_json(F.array("p_name", F.lit("  "), F.lit("z")))).alias("raw")).select("p_partkey", F.array_join(readers.as_list(F.col("raw")), "|").alias("items")), "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_name || '|a|b' ELSE p_name || '|z' END AS items FROM part")


def _weighed(sp, d):
    """The vocabulary, weighed by how often its terms stand in the true lists."""
    return corrector.counted_weights(views.pairs(sp, d).select(F.col("truth").alias("items")), readers.vocabulary(sp))


_TERMS = ", ".join(f"({s.q(t)})" for t, _ in readers.VOCABULARY)
add("f15_term_weights", _weighed, f"WITH {views.SQL_PAIRS}, n AS (SELECT {s.strip('lower(i)')} AS term, count(*) AS n FROM (SELECT unnest(truth) AS i FROM v_pairs) GROUP BY 1) SELECT term, coalesce(n, 0) + 1 AS weight FROM (VALUES {_TERMS}) v(term) LEFT JOIN n USING (term)")


def _run_together(sp, d):
    """Items of two terms that stand together without their space, as recognition often gives them."""
    return views.ingredients(sp, d).select(F.replace(text.clean_ocr(F.col("term")), F.lit(" "), F.lit("")).alias("word")).filter("length(word) > 3").distinct()


add("f15_split_terms", lambda sp, d: corrector.segmented(_run_together(sp, d), _weighed(sp, d)))
add("f15_corrections", lambda sp, d: corrector.corrections(views.ingredients(sp, d).select(F.col("term").alias("raw")), _weighed(sp, d), readers.aliases(sp)))
add("f16_corrected_lists", lambda sp, d: corrector.corrected_lists(views.lists(sp, d), _weighed(sp, d), readers.aliases(sp)).select("doc_id", F.array_join("items", "|").alias("items")))
add("j12_closest_terms", lambda sp, d: corrector.closest(views.ingredients(sp, d).select(text.clean_ocr(F.col("term")).alias("word")).distinct(), readers.vocabulary(sp)))
add("j13_likest_terms", lambda sp, d: corrector.likest(views.ingredients(sp, d).select(text.clean_ocr(F.col("term")).alias("word")).distinct(), readers.vocabulary(sp)))
add("f8_expanded", lambda sp, d: views.lists(sp, d).select("doc_id", F.array_join(products.expanded(F.col("items")), "|").alias("items")))
