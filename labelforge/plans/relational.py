"""Accounts, history and table changes, as queries: customers are users, events are scans and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import accounts as op
from ..session import table
from ..sources import views
from . import sqltext as s
from .catalog import add

NOW = "TIMESTAMP '2024-01-20 12:00:00'"
_DEFAULTS = {"halal": False, "vegan": False, "nut_free": False}


def users(sp, d):
    return table(sp, d, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("username"), F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"))


def scans(sp, d):
    return table(sp, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), "event_type", "value")


def tokens(sp, d):
    return table(sp, d, "events").select(F.col("event_id").alias("token"), "user_id", F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("revoked_at"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))


_TOKENS = "tokens AS (SELECT event_id AS token, user_id, CASE WHEN event_id % 5 = 0 THEN ts END AS revoked_at, ts + INTERVAL 7 DAYS AS expires_at FROM events)"
_USERS = "users AS (SELECT c_custkey AS id, lower(c_name) AS username, lower(c_name) || '@example.com' AS email FROM customer)"


def _profiles(sp, d):
    return views.profiles(sp, d).select("user_id", *_DEFAULTS)


def _patch(sp, d):
    k = F.col("c_custkey")
    return table(sp, d, "customer").filter(k % 3 == 0).select(k.alias("user_id"), F.when(k % 2 == 0, True).alias("halal"), F.when(k % 5 == 0, False).alias("vegan"), F.lit(None).cast("boolean").alias("nut_free"))


_PATCH = "patch AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN true END AS halal, CASE WHEN c_custkey % 5 = 0 THEN false END AS vegan, NULL::BOOLEAN AS nut_free FROM customer WHERE c_custkey % 3 = 0)"
add("k3_partial_merge", lambda sp, d: op.merged(_profiles(sp, d), _patch(sp, d), "user_id", _DEFAULTS), f"WITH {views.SQL_PROFILES}, {_PATCH} SELECT coalesce(p.user_id, o.user_id) AS user_id, " + ", ".join(f"coalesce(p.{c}, o.{c}, false) AS {c}" for c in _DEFAULTS) + " FROM v_profiles o FULL JOIN patch p ON o.user_id = p.user_id")
add("k2_full_replace", lambda sp, d: op.merged(_profiles(sp, d), _patch(sp, d), "user_id", _DEFAULTS, full=True), f"WITH {views.SQL_PROFILES}, {_PATCH} SELECT coalesce(p.user_id, o.user_id) AS user_id, " + ", ".join(f"CASE WHEN p.user_id IS NOT NULL THEN coalesce(p.{c}, false) ELSE o.{c} END AS {c}" for c in _DEFAULTS) + " FROM v_profiles o FULL JOIN patch p ON o.user_id = p.user_id")
add("k4_get_or_default", lambda sp, d: op.with_defaults(users(sp, d).withColumnRenamed("id", "user_id"), _profiles(sp, d), "user_id", _DEFAULTS), f"WITH {views.SQL_PROFILES} SELECT c_custkey AS user_id, " + ", ".join(f"coalesce({c}, false) AS {c}" for c in _DEFAULTS) + " FROM customer LEFT JOIN v_profiles ON c_custkey = user_id")
_NEWU = "n AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN (SELECT min(username) FROM users) ELSE 'new' || s_suppkey END AS username, 'mail' || (s_suppkey % 4) || '@example.com' AS email FROM supplier)"


def _candidates(sp, d):
    k = F.col("s_suppkey")
    least = users(sp, d).agg(F.min("username").alias("least"))
    return table(sp, d, "supplier").crossJoin(F.broadcast(least)).select(k.cast("long").alias("id"), F.when(k % 2 == 0, F.col("least")).otherwise(F.concat(F.lit("new"), k.cast("string"))).alias("username"), F.concat(F.lit("mail"), (k % 4).cast("string"), F.lit("@example.com")).alias("email"))


add("k7_unique_insert", lambda sp, d: op.unique_inserts(_candidates(sp, d), users(sp, d), ["email", "username"]).select("id", "username", "email"), f"WITH {_USERS}, {_NEWU}, f AS (SELECT * FROM n WHERE email NOT IN (SELECT email FROM users) AND username NOT IN (SELECT username FROM users)), g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY email ORDER BY id) = 1) SELECT id, username, email FROM g QUALIFY row_number() OVER (PARTITION BY username ORDER BY id) = 1")
add("k6_rename_user", lambda sp, d: users(sp, d).join(users(sp, d).select(F.col("username").alias("taken")), F.concat("username", F.lit("1")) == F.col("taken"), "left").select("id", F.when(F.col("taken").isNull(), F.concat("username", F.lit("1"))).otherwise(F.col("username")).alias("username")), f"WITH {_USERS} SELECT id, CASE WHEN username || '1' IN (SELECT username FROM users) THEN username ELSE username || '1' END AS username FROM users")
add("p2_live_tokens", lambda sp, d: op.live_tokens(tokens(sp, d), F.expr(NOW)).select("token", "user_id"), f"WITH {_TOKENS} SELECT token, user_id FROM tokens WHERE revoked_at IS NULL AND expires_at > {NOW}")
add("j3_token_user", lambda sp, d: tokens(sp, d).join(users(sp, d), F.col("user_id") == F.col("id")).select("token", "username"), f"WITH {_TOKENS}, {_USERS} SELECT token, username FROM tokens JOIN users ON user_id = id")
add("k8_token_rotation", lambda sp, d: op.rotated(tokens(sp, d).select("token", "user_id"), op.live_tokens(tokens(sp, d), F.expr(NOW)), op.live_tokens(tokens(sp, d), F.expr(NOW)).select((F.col("token") + 1000000).alias("token"), "user_id")), f"WITH {_TOKENS}, live AS (SELECT * FROM tokens WHERE revoked_at IS NULL AND expires_at > {NOW}) SELECT token, user_id FROM tokens WHERE token NOT IN (SELECT token FROM live) UNION ALL SELECT token + 1000000, user_id FROM live")
add("k9_cascade_delete", lambda sp, d: op.without_children(scans(sp, d), views.profiles(sp, d).filter("vegan").select("user_id"), "user_id").select("id", "user_id"), f"WITH {views.SQL_PROFILES} SELECT event_id AS id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM v_profiles WHERE vegan)")
add("k10_schema_evolution", lambda sp, d: views.profiles(sp, d).withColumn("plant_based", F.coalesce("vegan", F.lit(False)) | F.coalesce("vegetarian", F.lit(False))).drop("vegan", "vegetarian").select("user_id", "plant_based", "halal"), f"WITH {views.SQL_PROFILES} SELECT user_id, coalesce(vegan, false) OR coalesce(vegetarian, false) AS plant_based, halal FROM v_profiles")
add("p1_owned_scans", lambda sp, d: scans(sp, d).join(scans(sp, d).select(F.col("id").alias("rid"), (F.col("id") % 15).alias("claimed")), (F.col("id") == F.col("rid")) & (F.col("user_id") == F.col("claimed"))).select("id", "user_id"), "SELECT event_id AS id, user_id FROM events WHERE user_id = event_id % 15")
add("n2_history_page", lambda sp, d: op.history_page(scans(sp, d), 3, 5, 20).select("id", "created_at"), "SELECT event_id AS id, ts AS created_at FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5")
add("n7_pages_of_all", lambda sp, d: op.history_pages(scans(sp, d), 5, 20).select("id", "user_id", "place", "has_more"), "SELECT id, user_id, place, count(*) OVER (PARTITION BY user_id) = 20 AS has_more FROM (SELECT event_id AS id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place BETWEEN 6 AND 25")
add("n8_append_page", lambda sp, d: op.history_page(scans(sp, d), 3, 0, 20).unionByName(op.history_page(scans(sp, d), 3, 20, 20)).filter("id % 10 <> 0").select("id"), "SELECT id FROM (SELECT event_id AS id FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 40) WHERE id % 10 <> 0")
add("n1_natural_key", lambda sp, d: table(sp, d, "part").select("p_partkey", op.natural_key(F.concat("p_name", F.lit(" IMG"), F.col("p_partkey").cast("string"), F.lit(".jpg"))).alias("key")), "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name || ' IMG' || p_partkey || '.jpg'), '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(r, 12, '0') ELSE r END), '') AS key FROM part")
add("n6_first_names", lambda sp, d: table(sp, d, "part").select("p_partkey", op.natural_key(F.concat(F.lit("img"), F.col("p_partkey").cast("string"))).alias("key")).orderBy("key").limit(25), "SELECT p_partkey, 'img' || lpad(p_partkey::VARCHAR, 12, '0') AS key FROM part ORDER BY key LIMIT 25")
add("d1_expiry", lambda sp, d: scans(sp, d).select("id", (F.col("created_at") + F.expr("INTERVAL 30 MINUTES")).alias("expires_at")), "SELECT event_id AS id, ts + INTERVAL 30 MINUTES AS expires_at FROM events")
add("d2_relative_time", lambda sp, d: scans(sp, d).select("id", op.ago(F.date_trunc("second", "created_at"), F.expr("TIMESTAMP '2024-01-31 00:00:00'")).alias("ago")), "SELECT id, CASE WHEN n < 60 THEN n || 'm ago' WHEN n < 1440 THEN n // 60 || 'h ago' WHEN n < 10080 THEN n // 1440 || 'd ago' ELSE strftime(ts, '%b ') || day(ts) END AS ago FROM (SELECT event_id AS id, ts, epoch(TIMESTAMP '2024-01-31 00:00:00' - date_trunc('second', ts))::BIGINT // 60 AS n FROM events)")
add("j9_cache_probe", lambda sp, d: op.cached_or_new(table(sp, d, "documents").select("doc_id"), table(sp, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, " ").when(F.col("doc_id") % 3 == 1, "hit").alias("value")), "doc_id", lambda m: m.withColumn("value", F.lit("new"))).select("doc_id", "value", "cached"), "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'hit' ELSE 'new' END AS value, doc_id % 3 = 1 AS cached FROM documents")
add("j6_common_images", lambda sp, d: views.boxes(sp, d).select("image_id").distinct().join(table(sp, d, "labels").select(F.col("doc_id").alias("image_id")), "image_id", "left_semi"), "SELECT doc_id AS image_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
add("j7_detections_with_truth", lambda sp, d: views.boxes(sp, d).join(views.pairs(sp, d).filter(F.size("truth") > 0).select(F.col("doc_id").alias("image_id")), "image_id").select("image_id", "box_id"), f"WITH {views.SQL_BOXES}, {views.SQL_PAIRS} SELECT image_id, box_id FROM v_boxes JOIN v_pairs ON image_id = doc_id WHERE len(truth) > 0")
add("j8_details_export", lambda sp, d: views.pairs(sp, d).select("doc_id", F.size("predicted").alias("n")).join(table(sp, d, "labels").select("doc_id", "quality"), "doc_id", "left"), f"WITH {views.SQL_PAIRS} SELECT doc_id, len(predicted) AS n, quality FROM v_pairs LEFT JOIN labels USING (doc_id)")
add("j10_alias", lambda sp, d: views.ingredients(sp, d).join(F.broadcast(sp.createDataFrame([("suger", "sugar"), ("watr", "water"), ("e 330", "citric acid"), ("e330", "citric acid")], "wrong string, right string")), text.low(F.col("term")) == F.col("wrong"), "left").select("doc_id", "pos", F.coalesce("right", "term").alias("term")), f"WITH {views.SQL_INGREDIENTS} SELECT doc_id, pos, CASE {s.low('term')} WHEN 'suger' THEN 'sugar' WHEN 'watr' THEN 'water' WHEN 'e 330' THEN 'citric acid' WHEN 'e330' THEN 'citric acid' ELSE term END AS term FROM v_ingredients")
add("u1_vocabulary", lambda sp, d: views.ingredients(sp, d).select(text.low(F.col("term")).alias("term")).unionAll(table(sp, d, "part").select(F.lower("p_name").alias("term"))).distinct().filter("term <> ''"), f"WITH {views.SQL_INGREDIENTS} SELECT DISTINCT term FROM (SELECT {s.low('term')} AS term FROM v_ingredients UNION ALL SELECT lower(p_name) FROM part) WHERE term <> ''")
add("j11_in_vocabulary", lambda sp, d: views.ingredients(sp, d).join(F.broadcast(sp.createDataFrame([("water",), ("sugar",), ("honey",)], "word string")), text.low(F.col("term")) == F.col("word"), "left_semi").select("doc_id", "pos", "term"), f"WITH {views.SQL_INGREDIENTS} SELECT doc_id, pos, term FROM v_ingredients WHERE {s.low('term')} IN ('water', 'sugar', 'honey')")
add("g2_images_per_split", lambda sp, d: views.boxes(sp, d).groupBy((F.col("image_id") % 10 >= 8).alias("held_out")).agg(F.countDistinct("image_id").alias("images"), F.count(F.lit(1)).alias("boxes")), f"WITH {views.SQL_BOXES} SELECT image_id % 10 >= 8 AS held_out, count(DISTINCT image_id) AS images, count(*) AS boxes FROM v_boxes GROUP BY 1")
add("g16_ordered_join", lambda sp, d: scans(sp, d).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "event_type"))), lambda x: x["event_type"]), ",").alias("events")), "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS events FROM events GROUP BY user_id")
add("g17_skip_keys", lambda sp, d: views.ingredients(sp, d).filter("pos % 2 = 0").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(text.low(F.col("term")))), "|").alias("keys")), f"WITH {views.SQL_INGREDIENTS} SELECT doc_id, string_agg(k, '|' ORDER BY k) AS keys FROM (SELECT DISTINCT doc_id, {s.low('term')} AS k FROM v_ingredients WHERE pos % 2 = 0) GROUP BY doc_id")
