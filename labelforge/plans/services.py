"""Services, prompts, training labels and writers, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.terms import BANNED
from ..operators import corrector, labelling, prompts, services
from ..session import shared_path, table
from ..sources import readers, sinks, views
from . import sqltext as s
from .catalog import add

# --- training labels --------------------------------------------------------------------------------


def _truth(sp, d):
    return views.pairs(sp, d).select(F.col("doc_id").alias("image_id"), F.col("truth").alias("items"))


def _patterns(sp, d):
    c = F.col("text")
    return views.boxes(sp, d).select("image_id", "box_id", labelling.is_stop(c).alias("stop"), labelling.is_header(c).alias("header"), labelling.is_junk(c).alias("junk"))


_STOPS = s.q("(?i)" + "|".join(fixed.LABEL_STOPS))
add("p26_label_patterns", _patterns, f"WITH {views.SQL_BOXES} SELECT image_id, box_id, regexp_matches(text, {_STOPS}) AS stop, regexp_matches({s.strip('text')}, {s.q(fixed.LABEL_HEADER)}) AS header, regexp_matches({s.strip('text')}, {s.q(fixed.LABEL_JUNK)}) AS junk FROM v_boxes")
add("j15_box_truth", lambda sp, d: views.boxes(sp, d).join(_truth(sp, d), "image_id").select("image_id", "box_id", labelling.matches_truth(F.col("text"), F.col("items")).alias("matches")))
add("a9_box_labels", lambda sp, d: labelling.labelled(views.boxes(sp, d), _truth(sp, d)).select("image_id", "box_id", "label"))

# --- recognition and models -------------------------------------------------------------------------


def _images(sp, d):
    box = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))])
    lines = F.transform(F.split("text", "\n"), lambda t: F.struct(box.alias("bbox"), t.alias("text"), F.lit(0.5).alias("confidence")))
    return table(sp, d, "documents").select("doc_id", F.to_json(lines).cast("binary").alias("content"))


add(
    "s10_detections",
    lambda sp, d: services.with_detections(_images(sp, d)).select("doc_id", F.size("detections").alias("n"), F.md5(F.array_join(F.transform("detections", lambda x: x["text"]), "\n").cast("binary")).alias("digest")),
    "SELECT doc_id, len(string_split(text, chr(10)))::INT AS n, md5(text) AS digest FROM documents",
)
add(
    "s11_page_text",
    lambda sp, d: table(sp, d, "documents").select("doc_id", F.md5(services.page_text(F.array("text", F.lit(""), F.lit(None).cast("string"), F.concat(F.lit("\n\n\n"), F.col("text")))).cast("binary")).alias("digest")),
    f"SELECT doc_id, md5({s.strip(s.re_all('text || chr(10) || repeat(chr(10), 3) || text', chr(92) + 'n{3,}', chr(10) * 2))}) AS digest FROM documents",
)
_STATUS = "CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 END"
add(
    "s11_retry_delays",
    lambda sp, d: table(sp, d, "events").select("event_id", services.retry_delay(F.expr(_STATUS), (F.col("event_id") % 7).cast("int"), 6).alias("seconds")),
    f"SELECT event_id, CASE WHEN event_id % 5 IN (1, 2, 4) AND event_id % 7 < 5 THEN least(2 ** (event_id % 7), 8)::INT END AS seconds FROM (SELECT event_id, {_STATUS} AS status FROM events)",
)
_NAME = "CASE c_custkey % 5 WHEN 0 THEN 'LMStudio' WHEN 1 THEN 'Groq' WHEN 2 THEN 'ollama' WHEN 3 THEN 'none' ELSE 'OPENAI' END"
add("s12_provider_names", lambda sp, d: table(sp, d, "customer").select("c_custkey", services.provider_name(F.expr(_NAME)).alias("provider")), "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'local_llm' WHEN 1 THEN 'groq' WHEN 2 THEN 'ollama' WHEN 3 THEN NULL ELSE 'openai' END AS provider FROM customer")


def silent(asked: list[str]) -> list[str | None]:
    """A provider that answers prompts of an even length alone, and not always with JSON."""
    return [None if len(p) % 2 else ('{"ingredients": ["first"]}' if len(p) % 4 else "no idea") for p in asked]


_FOUND = "[" + ", ".join(s.q(w) for w in services.FOUND) + "]"
_SPOTTED = f"list_transform(list_filter({_FOUND}, lambda w: contains(lower(prompt), w)), lambda w: upper(w[1]) || w[2:])"
add(
    "s12_first_reply",
    lambda sp, d: services.with_replies(views.lists(sp, d).select("doc_id", F.array_join("items", ", ").alias("prompt")), "prompt", [("silent", silent), ("stand_in", services.stand_in)]).select("doc_id", "provider", F.array_join(F.from_json("reply", "ingredients array<string>")["ingredients"], "|").alias("items")),
    f"WITH {views.SQL_LISTS}, p AS (SELECT doc_id, array_to_string(items, ', ') AS prompt FROM v_lists) SELECT doc_id, CASE WHEN length(prompt) % 4 = 2 THEN 'silent' ELSE 'stand_in' END AS provider, CASE WHEN length(prompt) % 4 = 2 THEN 'first' ELSE array_to_string({_SPOTTED}, '|') END AS items FROM p",
)
add(
    "a6_extracted_items",
    lambda sp, d: services.extracted(views.lists(sp, d).select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.lit("  ")).otherwise(F.array_join("items", ", ")).alias("raw")), "raw").select("doc_id", "success", F.array_join("items", "|").alias("items")),
    f"WITH {views.SQL_LISTS}, p AS (SELECT doc_id, array_to_string(items, ', ') AS prompt FROM v_lists) SELECT doc_id, doc_id % 6 <> 0 AS success, CASE WHEN doc_id % 6 = 0 THEN '' ELSE array_to_string({_SPOTTED}, '|') END AS items FROM p",
)

# --- prompts and other texts ------------------------------------------------------------------------


def _diet(sp, d):
    users = table(sp, d, "customer").count()
    rows = views.lists(sp, d).withColumn("user_id", F.col("doc_id") % users).join(views.profiles(sp, d), "user_id", "left")
    flags = {f: F.coalesce(F.col(f), F.lit(False)) for f, _ in prompts.FLAGS}
    custom = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("Palm oil"), F.lit("MILK")))
    return rows.select("doc_id", prompts.diet_prompt(F.col("items"), flags, F.col("allergens"), custom).alias("prompt"))


_TERMS_OF = ", ".join(f"CASE WHEN coalesce(p.{f}, false) THEN [" + ", ".join(s.q(t) for t in BANNED[n]) + "] ELSE []::VARCHAR[] END" for f, n in prompts.FLAGS)
_NAMES_OF = ", ".join(f"CASE WHEN coalesce(p.{f}, false) THEN ['{n}'] ELSE []::VARCHAR[] END" for f, n in prompts.FLAGS)
_OWN, _CUSTOM = "coalesce(p.allergens, []::VARCHAR[])", "CASE WHEN doc_id % 7 = 0 THEN ['Palm oil', 'MILK'] ELSE []::VARCHAR[] END"
add(
    "f37_diet_prompt",
    _diet,
    f"WITH {views.SQL_LISTS}, {views.SQL_PROFILES}, a AS (SELECT doc_id, 'Ingredients: ' || array_to_string(items, ', ') AS listed, flatten([{_TERMS_OF}, {_OWN}, {_CUSTOM}]) AS banned, "
    f"flatten([{_NAMES_OF}, CASE WHEN len({_OWN}) > 0 THEN ['allergic to ' || array_to_string({_OWN}, ', ')] ELSE []::VARCHAR[] END, CASE WHEN len({_CUSTOM}) > 0 THEN ['custom: ' || array_to_string({_CUSTOM}, ', ')] ELSE []::VARCHAR[] END]) AS diet "
    "FROM v_lists LEFT JOIN v_profiles p ON p.user_id = doc_id % (SELECT count(*) FROM customer)), "
    "b AS (SELECT *, list_transform(banned, lambda t: lower(t)) AS low FROM a) "
    f"SELECT doc_id, CASE WHEN len(diet) = 0 THEN listed || {s.q(prompts.NO_DIET)} ELSE 'Is this food safe for someone who is ' || array_to_string(diet, ', ') || '?' || chr(10) || 'NOT ALLOWED: ' "
    f"|| array_to_string(list_filter(banned, lambda t, i: list_position(low, lower(t)) = i), ', ') || chr(10) || listed || {s.q(prompts.REPLY)} END AS prompt FROM b",
)
add(
    "f36_error_text",
    lambda sp, d: views.lists(sp, d).select("doc_id", prompts.error_text(F.when(F.col("doc_id") % 3 == 0, F.transform("items", lambda x: F.struct(x.alias("msg")))), F.when(F.col("doc_id") % 3 == 1, F.get("items", F.lit(0)))).alias("message")),
    f"WITH {views.SQL_LISTS} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN array_to_string(items, ', ') WHEN 1 THEN items[1] ELSE 'Validation error' END AS message FROM v_lists",
)
_CHAR = "label[i]"
_H = f"((('0x' || substr(md5('7:' || label || ':' || (i - 1)), 1, 8))::BIGINT) % 300)"  # noqa: F541
_SWAP = "CASE " + _CHAR + "".join(f" WHEN '{a}' THEN '{b}'" for a, b in fixed.NOISE.items()) + f" ELSE {_CHAR} END"
add(
    "f38_noisy_labels",
    lambda sp, d: views.lists(sp, d).select("doc_id", prompts.noisy(prompts.label_text(F.col("items")), 7, 20).alias("label")),
    f"WITH {views.SQL_LISTS}, t AS (SELECT doc_id, 'Ingredients: ' || array_to_string(items, ', ') AS label FROM v_lists), c AS (SELECT doc_id, label, unnest(range(1, length(label) + 1)) AS i FROM t), h AS (SELECT doc_id, i, {_CHAR} AS ch, {_H} AS h, {_SWAP} AS swapped FROM c) "
    "SELECT doc_id, string_agg(CASE WHEN h >= 60 THEN ch WHEN h % 3 = 0 THEN swapped WHEN h % 3 = 1 THEN '' ELSE ch || ch END, '' ORDER BY i) AS label FROM h GROUP BY doc_id",
)
add("f39_corrected_text", lambda sp, d: corrector.corrected_text(views.lists(sp, d).select("doc_id", F.array_join("items", ", ").alias("raw")), "raw", readers.vocabulary(sp), readers.aliases(sp)).select("doc_id", "raw"))
add(
    "d3_stored_at",
    lambda sp, d: table(sp, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("given")).select("event_id", (prompts.stored_at(F.col("given")) == F.coalesce("given", F.current_timestamp())).alias("stored"), F.col("given").isNull().alias("is_default")),
    "SELECT event_id, true AS stored, event_id % 3 = 0 AS is_default FROM events",
)
add("k14_image_names", lambda sp, d: table(sp, d, "customer").select("c_custkey", prompts.image_name(F.col("c_custkey"), F.md5("c_name")).alias("path")), "SELECT c_custkey, c_custkey || '_' || substr(md5(c_name), 1, 8) || '_image.jpg' AS path FROM customer")

# --- writers, read back -----------------------------------------------------------------------------


def _appended(sp, d):
    path = shared_path(sp, "scans")
    rows = table(sp, d, "events").select(F.col("event_id").alias("id"), "user_id", F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("created_at"))
    sinks.append_scans(rows.filter("id % 3 = 0"), path)
    return sinks.append_scans(rows.filter("id % 3 > 0"), path).select("id", "user_id", F.col("created_at").isNotNull().alias("stored"))


add("k1_append_scans", _appended, "SELECT event_id AS id, user_id, true AS stored FROM events")


def _csv(sp, d):
    path = shared_path(sp, "csv")
    sinks.write_csv(table(sp, d, "documents").select("lang", "text", "doc_id"), path, ["doc_id", "text"])
    return sinks.read_csv(sp, path, "doc_id long, text string").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


add("k11_csv_round_trip", _csv, "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")


def _report(sp, d):
    path = shared_path(sp, "report")
    rows = views.pairs(sp, d)
    sinks.write_report(rows.agg(F.count(F.lit(1)).alias("total")), rows, path)
    total = sp.read.schema("total long").json(f"{path}/summary")
    return sp.read.schema("doc_id long, predicted array<string>, truth array<string>").json(f"{path}/details").join(F.broadcast(total)).select("doc_id", F.array_join("truth", "|").alias("truth"), "total")


add("k12_report_round_trip", _report, f"WITH {views.SQL_PAIRS} SELECT doc_id, array_to_string(truth, '|') AS truth, count(*) OVER () AS total FROM v_pairs")


def _cache(sp, d):
    path = shared_path(sp, "cache")
    rows = table(sp, d, "documents").select(F.concat(F.lit("img"), F.col("doc_id").cast("string")).alias("image_id"), F.concat_ws(" ", "lang", "source").alias("value"))
    sinks.replace_lines(rows.filter("length(image_id) % 2 = 0"), path)
    old = sinks.read_lines(sp, path, rows.schema)
    return sinks.write_cache(old, rows.filter("value like 'en%'").withColumn("value", F.lit("fresh")), path)


add("k12_cache_write_back", _cache, "SELECT 'img' || doc_id AS image_id, CASE WHEN lang = 'en' THEN 'fresh' ELSE concat_ws(' ', lang, source) END AS value FROM documents WHERE lang = 'en' OR (3 + length(doc_id::VARCHAR)) % 2 = 0")


def _lines(sp, d):
    path = shared_path(sp, "lines")
    rows = table(sp, d, "documents").select("doc_id", "lang", "text")
    sinks.replace_lines(rows, path)
    lines = sp.read.text(sinks.current_version(sp, path)).withColumnRenamed("value", "line")
    kept, _ = sinks.kept_lines(lines, "doc_id long, lang string, text string", F.col("row.lang") == "en")
    sinks.replace_lines(kept, path)
    return sinks.read_lines(sp, path, "doc_id long, text string").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


add("k13_lines_in_place", _lines, "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents WHERE lang = 'en'")
add("s7_first_images", lambda sp, d: readers.chosen_images(table(sp, d, "documents").select(F.concat(F.lit("Img"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".JPG")).alias("name")), 50), "SELECT 'Img' || doc_id || '.JPG' AS name FROM documents WHERE doc_id % 3 <> 0 ORDER BY doc_id LIMIT 50")
