"""Metrics and summaries, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import learning
from ..operators import metrics as op
from ..session import table
from ..sources import views
from . import sqltext as s
from .catalog import add

P, T = "predicted", "truth"
_LOW = "list_distinct(list_transform({}, lambda x: " + s.low("x") + "))"
_SP, _ST = _LOW.format("predicted"), _LOW.format("truth")
_BOTH = f"len(list_intersect({_SP}, {_ST}))"
_NONE = "CASE WHEN len(predicted) = 0 THEN 1.0 ELSE 0.0 END"
_PREC = f"CASE WHEN len(predicted) = 0 THEN 0.0 ELSE {_BOTH} / len({_SP}) END"
_REC = f"CASE WHEN len(truth) = 0 THEN {_NONE} ELSE {_BOTH} / len({_ST}) END"
_F1 = "CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END"


def _held(items: str, whole: str) -> str:
    joined = s.joinable(f"array_to_string(list_transform({whole}, lambda y: {s.low('y')}), ' ')")
    return f"len(list_filter({items}, lambda x: contains({joined}, {s.joinable('x')})))"


_CP = f"CASE WHEN len(predicted) = 0 THEN 0.0 ELSE {_held('predicted', 'truth')} / len(predicted) END"
_CR = f"CASE WHEN len(truth) = 0 THEN {_NONE} ELSE {_held('truth', 'predicted')} / len(truth) END"


def scored(sp, d):
    return views.pairs(sp, d).select("doc_id", "predicted", "truth", op.set_precision(P, T).alias("p"), op.set_recall(P, T).alias("r"))


_SCORED = f"v AS (SELECT doc_id, predicted, truth, {_PREC} AS p, {_REC} AS r FROM v_pairs)"
_W = f"WITH {views.SQL_PAIRS}, {_SCORED}"


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


add("m4_set_precision_recall", lambda sp, d: _rounded(scored(sp, d).select("doc_id", "p", "r"), "p", "r"), f"{_W} SELECT doc_id, round(p, 6) AS p, round(r, 6) AS r FROM v")
add("m3_f1", lambda sp, d: scored(sp, d).select("doc_id", F.round(op.f1(F.col("p"), F.col("r")), 6).alias("f1")), f"{_W} SELECT doc_id, round({_F1}, 6) AS f1 FROM v")
add("m5_containment", lambda sp, d: views.pairs(sp, d).select("doc_id", F.round(op.contained_precision(P, T), 6).alias("p"), F.round(op.contained_recall(P, T), 6).alias("r")), f"WITH {views.SQL_PAIRS} SELECT doc_id, round({_CP}, 6) AS p, round({_CR}, 6) AS r FROM v_pairs")
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(array_to_string({}, ' ')), '\\s+'), lambda x: x <> ''))"
add("m6_word_accuracy", lambda sp, d: views.pairs(sp, d).select("doc_id", F.round(op.word_accuracy(F.array_join(P, " "), F.array_join(T, " ")), 6).alias("value")), f"WITH {views.SQL_PAIRS} SELECT doc_id, round(CASE WHEN len(truth) = 0 THEN {_NONE} WHEN len(predicted) = 0 THEN 0.0 ELSE len(list_intersect({_WORDS.format('predicted')}, {_WORDS.format('truth')})) / len({_WORDS.format('truth')}) END, 6) AS value FROM v_pairs")
add("m7_char_accuracy", lambda sp, d: views.pairs(sp, d).select("doc_id", F.round(op.char_accuracy(F.array_join(P, " "), F.array_join(T, " ")), 6).alias("value")))
add("m8_fuzzy_accuracy", lambda sp, d: _rounded(op.fuzzy(views.pairs(sp, d)).drop("predicted", "truth"), "fuzzy_precision", "fuzzy_recall", "fuzzy_f1"))
add("m10_fuzzy_recall", lambda sp, d: (lambda v: v.select("doc_id", F.size("truth").alias("n"), op.fuzzy_counts(v, "truth", "whole", 85.0).alias("hits")))(views.pairs(sp, d).withColumn("whole", F.array_join("predicted", ", "))))
add("m11_resize", lambda sp, d: table(sp, d, "part").select("p_partkey", (F.col("p_size") * 90 + 200).alias("w"), (F.col("p_size") * 40 + 300).alias("h")).withColumn("scale", F.round(F.least(F.greatest(F.lit(1.0), 1000 / F.least("w", "h")), 2400 / F.greatest("w", "h")), 6)).select("p_partkey", "scale"), "SELECT p_partkey, round(least(greatest(1.0, 1000 / least(w, h)), 2400 / greatest(w, h)), 6) AS scale FROM (SELECT p_partkey, p_size * 90 + 200 AS w, p_size * 40 + 300 AS h FROM part)")
add("j4_missing_truth", lambda sp, d: scored(sp, d).join(table(sp, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.when(F.col("quality").isNotNull(), F.round("r", 6)).alias("r")), f"{_W} SELECT doc_id, CASE WHEN quality IS NOT NULL THEN round(r, 6) END AS r FROM v LEFT JOIN labels USING (doc_id)")
add("g5_macro_mean", lambda sp, d: scored(sp, d).select(F.when(F.size("truth") > 0, F.col("r")).otherwise(F.lit(float("nan"))).alias("r"), "p").agg(F.round(F.avg(F.nanvl("r", F.lit(None).cast("double"))), 6).alias("recall"), F.round(F.avg("p"), 6).alias("precision")), f"{_W} SELECT round(avg(CASE WHEN len(truth) > 0 THEN r END), 6) AS recall, round(avg(p), 6) AS precision FROM v")
add("g6_macro_rounded", lambda sp, d: scored(sp, d).agg(F.round(F.avg("p"), 2).alias("p"), F.round(F.avg("r"), 2).alias("r"), F.round(F.avg(op.f1(F.col("p"), F.col("r"))), 2).alias("f1")), f"{_W} SELECT round(avg(p), 2) AS p, round(avg(r), 2) AS r, round(avg({_F1}), 2) AS f1 FROM v")


def _pooled(sp, d):
    v = views.pairs(sp, d).agg(F.sum(op._held(P, T)).alias("hp"), F.sum(F.size("predicted")).alias("np"), F.sum(op._held(T, P)).alias("ht"), F.sum(F.size("truth")).alias("nt"))
    v = v.select(F.round(F.col("hp") / F.col("np"), 2).alias("p"), F.round(F.col("ht") / F.col("nt"), 2).alias("r"))
    return v.withColumn("f1", F.round(op.f1(F.col("p"), F.col("r")), 2))


add("g7_pooled_containment", _pooled, f"WITH {views.SQL_PAIRS} SELECT p, r, round({_F1}, 2) AS f1 FROM (SELECT round(sum({_held('predicted', 'truth')}) / sum(len(predicted)), 2) AS p, round(sum({_held('truth', 'predicted')}) / sum(len(truth)), 2) AS r FROM v_pairs)")
add("g8_split_gap", lambda sp, d: scored(sp, d).agg(F.round(F.avg(op.contained_recall(P, T) - F.col("r")), 6).alias("gap")), f"{_W} SELECT round(avg({_CR} - r), 6) AS gap FROM v")
add("n3_worst_f1", lambda sp, d: scored(sp, d).select("doc_id", F.round(op.f1(F.col("p"), F.col("r")), 6).alias("f1")).orderBy("f1", "doc_id").limit(10), f"{_W} SELECT doc_id, round({_F1}, 6) AS f1 FROM v ORDER BY f1, doc_id LIMIT 10")
# Every third prediction is one joined item: its parts are contained, but not split.
add("n4_largest_gap", lambda sp, d: scored(sp, d).select("doc_id", F.round(op.contained_recall(P, T) - F.when(F.col("doc_id") % 3 == 0, 0.0).otherwise(F.col("r")), 6).alias("gap")).filter("gap > 0").orderBy(F.desc("gap"), "doc_id").limit(10), f"{_W} SELECT doc_id, round({_CR} - CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE r END, 6) AS gap FROM v WHERE gap > 0 ORDER BY gap DESC, doc_id LIMIT 10")
add("n5_worst_precision", lambda sp, d: scored(sp, d).select("doc_id", F.round("p", 6).alias("p")).orderBy("p", "doc_id").limit(15), f"{_W} SELECT doc_id, round(p, 6) AS p FROM v ORDER BY p, doc_id LIMIT 15")
_KIND = "CASE event_type WHEN 'view' THEN 'ocr' WHEN 'click' THEN 'ocr' WHEN 'error' THEN 'compliance' ELSE 'extraction' END"
add("g9_summary_by_type", lambda sp, d: table(sp, d, "events").groupBy(F.expr(_KIND).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(F.col("value") > 50).alias("correct")), f"SELECT {_KIND} AS type, count(*) AS n, round(avg(value), 4) AS avg, min(value) AS min, max(value) AS max, count(*) FILTER (WHERE value > 50) AS correct FROM events GROUP BY 1")
add("g10_targets", lambda sp, d: table(sp, d, "events").agg(F.coalesce(F.avg("value") / 100 >= 0.9, F.lit(False)).alias("ocr"), F.coalesce(F.avg(F.when(F.col("event_type") == "none", F.col("value"))) >= 0.95, F.lit(False)).alias("compliance")), "SELECT coalesce(avg(value) / 100 >= 0.9, false) AS ocr, coalesce(avg(CASE WHEN event_type = 'none' THEN value END) >= 0.95, false) AS compliance FROM events")
_LAT = "round(avg(value), 4) AS mean, min(value) AS min, max(value) AS max, round(median(value), 4) AS median, round(coalesce(stddev_samp(value), 0.0), 4) AS stdev, count(value) AS n"
add("g11_latency", lambda sp, d: op.latency(table(sp, d, "events"), "value", ["event_type"]), f"SELECT event_type, {_LAT} FROM events GROUP BY event_type")
add("g21_latency_by_stage", lambda sp, d: op.latency(table(sp, d, "events").withColumn("stage", F.col("user_id") % 3), "value", ["event_type", "stage"]), f"SELECT event_type, user_id % 3 AS stage, {_LAT} FROM events GROUP BY 1, 2")
add("g12_indexed_percentiles", lambda sp, d: op.indexed_percentiles(table(sp, d, "events"), "value", ["event_type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "SELECT event_type, " + ", ".join(f"list_sort(list(value))[least(floor(count(value) * {p})::BIGINT, count(value) - 1) + 1] AS {n}" for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM events GROUP BY event_type")
add("g13_extrapolation", lambda sp, d: table(sp, d, "events").agg(F.round(F.sum("value") * 1000000 / F.count("value"), 2).alias("total")), "SELECT round(sum(value) * 1000000 / count(value), 2) AS total FROM events")
add("g14_speedup", lambda sp, d: table(sp, d, "events").agg(F.round(F.avg(F.when(F.col("event_type") == "view", F.col("value"))) / F.avg(F.when(F.col("event_type") == "click", F.col("value"))), 6).alias("ratio")), "SELECT round(avg(value) FILTER (WHERE event_type = 'view') / avg(value) FILTER (WHERE event_type = 'click'), 6) AS ratio FROM events")
_LAB = "CASE WHEN (image_id * 7 + box_id * 3) % 100 < pred_prob * 100 THEN 1 ELSE 0 END"
add("g1_label_counts", lambda sp, d: views.boxes(sp, d).withColumn("label", F.expr(_LAB)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("pos"), F.round(100 * F.count_if(F.col("label") == 1) / F.count(F.lit(1)), 4).alias("percent")), f"WITH {views.SQL_BOXES} SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS pos, round(100 * count(*) FILTER (WHERE label = 1) / count(*), 4) AS percent FROM (SELECT {_LAB} AS label FROM v_boxes)")
_TP, _FP, _FN = "count(*) FILTER (WHERE pred_prob >= t AND label = 1)", "count(*) FILTER (WHERE pred_prob >= t AND label = 0)", "count(*) FILTER (WHERE pred_prob < t AND label = 1)"
_SIDE = "SELECT {c} AS class, count(*) FILTER (WHERE label = {c}) AS support, count(*) FILTER (WHERE told = {c}) AS said, count(*) FILTER (WHERE label = {c} AND told = {c}) AS hit FROM x"
add(
    "g18_report",
    lambda sp, d: _rounded(learning.report(views.boxes(sp, d).withColumn("label", F.expr(_LAB)).withColumn("pred_label", (F.col("pred_prob") >= 0.5).cast("int"))), "precision", "recall", "f1"),
    f"WITH {views.SQL_BOXES}, x AS (SELECT {_LAB} AS label, (pred_prob >= 0.5)::INT AS told FROM v_boxes), r AS ({_SIDE.format(c=0)} UNION ALL {_SIDE.format(c=1)}), "
    "p AS (SELECT class, support, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM r) "
    "SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p",
)
add(
    "g19_threshold_sweep",
    lambda sp, d: _rounded(op.threshold_sweep(views.boxes(sp, d).withColumn("label", F.expr(_LAB))), "precision", "recall", "f1"),
    f"WITH {views.SQL_BOXES}, b AS (SELECT pred_prob, {_LAB} AS label FROM v_boxes), c AS (SELECT t, {_TP} AS tp, {_FP} AS fp, {_FN} AS fn FROM b, (SELECT unnest(range(4, 17)) / 20 AS t) GROUP BY t), "
    f"m AS (SELECT t AS threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c), f AS (SELECT *, {_F1} AS f1 FROM m) "
    "SELECT threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, row_number() OVER (ORDER BY round(f1, 9) DESC, threshold) = 1 AS best FROM f",
)
add("g20_counters", lambda sp, d: table(sp, d, "documents").agg(F.count_if(F.col("doc_id") % 3 == 1).alias("hits"), F.count_if(F.col("doc_id") % 3 != 1).alias("new"), F.count_if(F.trim("text") == "").alias("blank"), F.count_if(F.col("lang") != "en").alias("dropped")), "SELECT count(*) FILTER (WHERE doc_id % 3 = 1) AS hits, count(*) FILTER (WHERE doc_id % 3 <> 1) AS new, count(*) FILTER (WHERE trim(text) = '') AS blank, count(*) FILTER (WHERE lang <> 'en') AS dropped FROM documents")
