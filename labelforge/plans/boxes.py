"""Box pipeline steps, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import boxes as op
from ..sources import views
from . import sqltext as s
from .catalog import add

_B = f"WITH {views.SQL_BOXES}, b AS (SELECT *, x2 - x1 AS width, y2 - y1 AS height, (x1 + x2) / 2 AS x_center, (y1 + y2) / 2 AS y_center FROM v_boxes)"
_H = f"h AS (SELECT image_id, text AS header_text, y_center AS header_y, y2 AS header_y2 FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y_center, x1, box_id) AS r FROM b WHERE {s.is_header('text')}) WHERE r = 1)"
_P = "p AS (SELECT * FROM b WHERE pred_prob >= 0.4)"
_C = "c AS (SELECT *, sum(new) OVER (PARTITION BY image_id ORDER BY y_center, x1, box_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM (SELECT *, CASE WHEN y_center - lag(y_center) OVER (PARTITION BY image_id ORDER BY y_center, x1, box_id) > 90 THEN 1 ELSE 0 END AS new FROM p))"
_G = (
    "k AS (SELECT image_id, cluster, min(y1) AS top, max(y2) AS low FROM c GROUP BY ALL), "
    "m AS (SELECT image_id, cluster, sum(CASE WHEN top - before > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY cluster ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM (SELECT *, max(low) OVER (PARTITION BY image_id ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)), "
    "g AS (SELECT c.*, m.grp FROM c JOIN m USING (image_id, cluster))"
)
_S = (
    f"s AS (SELECT image_id, grp, count(*) AS size, sum(pred_prob) AS sp, count(*) FILTER (WHERE {s.has_bad_hint('text')}) AS bad, avg(length({s.strip('text')})) AS len, min(y1) AS top FROM g GROUP BY ALL), "
    "z AS (SELECT s.image_id, grp, size, sp / size AS mean_prob, sp + 0.18 * size - 0.8 * bad + least(len / 50, 0.6) - coalesce(0.002 * greatest(0.0, top - header_y2), 0.0) AS score FROM s LEFT JOIN h USING (image_id))"
)


def _prepared(spark, d):
    return op.prepared(views.boxes(spark, d))


def _kept(spark, d):
    return _prepared(spark, d).filter("pred_prob >= 0.4")


def _grouped(spark, d):
    return op.merged_clusters(op.row_clusters(_kept(spark, d)))


def _scored(spark, d):
    return op.group_scores(_grouped(spark, d), op.headers(_prepared(spark, d)))


add("m1_geometry", lambda sp, d: _prepared(sp, d).select("image_id", "box_id", "width", "height", "x_center", "y_center"), f"{_B} SELECT image_id, box_id, width, height, x_center, y_center FROM b")
_CTX = "x AS (SELECT *, lag(text, 1, '') OVER w AS prev_text, lead(text, 1, '') OVER w AS next_text FROM b WINDOW w AS (PARTITION BY image_id ORDER BY y_center, x1, box_id))"
add("w1_context", lambda sp, d: op.with_context(_prepared(sp, d)).select("image_id", "box_id", "context_text"), f"{_B}, {_CTX} SELECT image_id, box_id, prev_text || ' [SEP] ' || text || ' [SEP] ' || next_text AS context_text FROM x")


def _hint(c: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {s.q(w)})" for w in words) + ")::INT"


_HINTS = ", ".join(f"{_hint(side + 'text', words)} AS {side}{name}" for side in ("", "prev_", "next_") for name, words in (("has_ingredient_hint", fixed.INGREDIENT_HINTS), ("has_noningredient_hint", fixed.OTHER_HINTS), ("has_header_hint", fixed.HEADER_HINTS)))
_FEATURES = ["ocr_confidence", "char_len", "word_count", "digit_count", "comma_count", "percent_count", "paren_count", "colon_count", "is_all_caps", "width", "height", "x_center", "y_center"] + [f"{side}{n}" for side in ("", "prev_", "next_") for n in ("has_ingredient_hint", "has_noningredient_hint", "has_header_hint")]
add(
    "m2_features",
    lambda sp, d: op.features(op.with_context(_prepared(sp, d))).select("image_id", "box_id", *_FEATURES),
    f"{_B}, {_CTX} SELECT image_id, box_id, confidence AS ocr_confidence, length(text) AS char_len, len(regexp_extract_all(text, '\\S+')) AS word_count, {s.count('text', '[0-9]')} AS digit_count, {s.count('text', ',')} AS comma_count, {s.count('text', '%')} AS percent_count, {s.count('text', '[()]')} AS paren_count, {s.count('text', ':')} AS colon_count, (upper(text) = text AND lower(text) <> text)::INT AS is_all_caps, width, height, x_center, y_center, {_HINTS} FROM x",
)
add("w5_first_header", lambda sp, d: op.headers(_prepared(sp, d)), f"{_B}, {_H} SELECT * FROM h")
add("j16_header_to_boxes", lambda sp, d: _prepared(sp, d).join(op.headers(_prepared(sp, d)), "image_id", "left").select("image_id", "box_id", "header_y"), f"{_B}, {_H} SELECT image_id, box_id, header_y FROM b LEFT JOIN h USING (image_id)")
add("p9_header_constraint", lambda sp, d: op.below_header(_kept(sp, d), op.headers(_prepared(sp, d))).select("image_id", "box_id"), f"{_B}, {_H}, {_P} SELECT image_id, box_id FROM p LEFT JOIN h USING (image_id) WHERE header_y IS NULL OR y_center >= header_y - 25")
_NEAR = "(SELECT count(*) FROM p o WHERE o.image_id = p.image_id AND o.box_id <> p.box_id AND abs(o.y_center - p.y_center) <= 120 AND abs(o.x_center - p.x_center) <= 900)"
add("j5_neighbours", lambda sp, d: op.neighbours(_kept(sp, d)), f"{_B}, {_P} SELECT * FROM (SELECT image_id, box_id, {_NEAR} AS near FROM p) WHERE near > 0")
add("p10_isolated", lambda sp, d: op.without_isolated(_kept(sp, d)).select("image_id", "box_id"), f"{_B}, {_P} SELECT image_id, box_id FROM p WHERE (SELECT count(*) FROM p o WHERE o.image_id = p.image_id) <= 1 OR pred_prob >= 0.75 OR {_NEAR} >= 1 OR {s.is_continuation('text')}")
add("w2_row_clusters", lambda sp, d: op.row_clusters(_kept(sp, d)).select("image_id", "box_id", "cluster"), f"{_B}, {_P}, {_C} SELECT image_id, box_id, cluster FROM c")
add("w3_merged_clusters", lambda sp, d: _grouped(sp, d).select("image_id", "box_id", "cluster", F.col("group").alias("grp")), f"{_B}, {_P}, {_C}, {_G} SELECT image_id, box_id, cluster, grp FROM g")
add("g4_group_scores", lambda sp, d: _scored(sp, d).select("image_id", F.col("group").alias("grp"), "size", F.round("mean_prob", 6).alias("mean_prob"), F.round("score", 6).alias("score")), f"{_B}, {_H}, {_P}, {_C}, {_G}, {_S} SELECT image_id, grp, size, round(mean_prob, 6) AS mean_prob, round(score, 6) AS score FROM z")
add("w6_best_group", lambda sp, d: op.best_groups(_scored(sp, d)).select("image_id", F.col("group").alias("grp"), "size"), f"{_B}, {_H}, {_P}, {_C}, {_G}, {_S} SELECT image_id, grp, size FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 9) DESC, grp) AS r FROM z) WHERE r = 1")
add("g15_median_height", lambda sp, d: _prepared(sp, d).groupBy("image_id").agg(F.percentile(F.col("height") + F.col("box_id") % 3, F.lit(0.5)).alias("median_height")), f"{_B} SELECT image_id, quantile_cont(height + box_id % 3, 0.5) AS median_height FROM b GROUP BY image_id")
add("w9_reading_order", lambda sp, d: _prepared(sp, d).groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y_center", "x1", "box_id", "text"))), lambda b: b["text"]), " ").alias("value")), f"{_B} SELECT image_id, string_agg(text, ' ' ORDER BY y_center, x1, box_id) AS value FROM b GROUP BY image_id")


def _detections(sp, d):
    box = F.struct(F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"), F.array("x1", "y2")).alias("bbox"), F.when(F.col("box_id") % 4 == 1, "  ").otherwise(F.col("text")).alias("text"), F.when(F.col("box_id") % 3 != 0, F.col("confidence")).alias("confidence"))
    raw = views.boxes(sp, d).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("box_id", box.alias("b")))), lambda x: x["b"]).alias("detections"))
    return op.from_detections(raw).select("image_id", "box_id", "confidence", "x1", "y1", "x2", "y2")


add("w8_detections", _detections, f"WITH {views.SQL_BOXES} SELECT image_id, box_id, CASE WHEN box_id % 3 <> 0 THEN confidence ELSE 1.0 END AS confidence, x1, y1, x2, y2 FROM v_boxes WHERE box_id % 4 <> 1 AND {s.strip('text')} <> ''")
add("w4_text_lines", lambda sp, d: op.assigned_rows(_prepared(sp, d)).select("image_id", F.inline("placed")))
add("g3_regions", lambda sp, d: op.regions(views.boxes(sp, d)))
