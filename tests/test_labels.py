"""Analysis, boxes, correction, metrics, accounts, the classifier and streams."""

import datetime as dt
import difflib
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from labelforge.functions import fixed, text
from labelforge.operators import accounts, analysis, boxes, corrector, learning, metrics
from labelforge.sources import readers

H, G, V, E, N, D = "halal", "gluten_free", "vegetarian", "vegan", "nut_free", "dairy_free"
#: Flags, items, safe.
VERDICTS = [
    ([H], ["Water", "Rice", "Salt"], True), ([H], ["Water", "Pork"], False), ([H], ["Gelatin", "Sugar"], False), ([H], ["Lard"], False), ([H], ["Ethanol"], False),
    ([H], ["Wine"], False), ([H], ["Beer"], False), ([H], ["Beef", "Salt"], True), ([H, G], ["Rice", "Oil"], True), ([H, G], ["Pork", "Rice"], False),
    ([G], ["Rice", "Corn"], True), ([G], ["Wheat Flour"], False), ([G], ["Malt Extract"], False), ([G], ["Oats"], False), ([G], ["Barley Malt"], False),
    ([G], ["Quinoa", "Amaranth"], True), ([V], ["Milk", "Eggs", "Cheese"], True), ([V], ["Chicken"], False), ([V], ["Salmon"], False), ([V], ["Gelatin"], False),
    ([E], ["Water", "Sugar", "Soy Protein"], True), ([E], ["Milk"], False), ([E], ["Honey"], False), ([E], ["Egg Yolk"], False), ([E, V], ["Tofu", "Rice"], True),
    ([E, V], ["Chicken"], False), ([N], ["Water", "Sunflower Seeds"], True), ([N], ["Peanuts"], False), ([N], ["Almond Flour"], False), ([D], ["Water", "Oil"], True),
    ([D], ["Butter"], False), ([D], ["Whey Protein"], False), ([G, V], ["Rice", "Vegetables"], True), ([G, V], ["Wheat", "Lettuce"], False),
    (["sesame"], ["Tahini"], True), (["sesame"], ["Water"], True), (["mustard"], ["Mustard Seeds"], False), ([], ["Anything"], True),
    ([N], ["Coconut milk"], True), ([E], ["Eggplant"], True), (["(milk)"], ["cream (milk)"], False),
]
FLAGS = (H, G, V, E, N, D)


def test_verdicts(spark):
    rows = [(k, k, items, *[f in flags for f in FLAGS], [f for f in flags if f not in FLAGS]) for k, (flags, items, _) in enumerate(VERDICTS)]
    df = spark.createDataFrame(rows, "scan_id long, user_id long, items array<string>, " + ", ".join(f"{f} boolean" for f in FLAGS) + ", allergens array<string>")
    got = {r.scan_id: r for r in analysis.with_verdict(df).collect()}
    assert [got[k].is_safe for k in range(len(rows))] == [safe for _, _, safe in VERDICTS]
    assert got[0].analysis_result == fixed.SAFE and got[36].warnings == ["Contains your allergens: mustard"]
    assert got[1].analysis_result == fixed.UNSAFE + "\nNot halal: Contains pork"
    assert got[14].warnings == ["Contains gluten: malt", "Contains gluten: barley", "Contains gluten: barley malt"]


def test_no_profile_and_replies(spark):
    scans = spark.createDataFrame([(1, 1, ["Pork"]), (2, 2, ["Pork"]), (3, 1, [])], "scan_id long, user_id long, items array<string>")
    profiles = spark.createDataFrame([(1, *[True] * 6, None)], "user_id long, " + ", ".join(f"{f} boolean" for f in FLAGS) + ", allergens array<string>")
    replies = analysis.checked_replies(spark.createDataFrame([(3, '{"is_safe": true, "warnings": ["w"], "analysis_result": "r"}'), (1, "{}")], "scan_id long, raw string")).filter("valid")
    got = {r.scan_id: r for r in analysis.analyze(scans, profiles, replies).collect()}
    assert got[2].warnings == [fixed.NO_PROFILE[0]] and not got[2].is_safe and not got[1].is_safe
    assert (got[3].is_safe, got[3].warnings, got[3].analysis_result) == (False, ["w"], "r")


def test_product_overlay(spark):
    df = spark.createDataFrame([(1, True, [], ["Milk"], ["Nuts"]), (2, True, ["Contains allergen: Milk"], ["Milk"], [])], "k int, is_safe boolean, warnings array<string>, product_allergens array<string>, product_traces array<string>")
    got = {r.k: r for r in analysis.overlay_product(df).collect()}
    assert got[1].warnings == ["Contains allergen: Milk", "May contain traces of: Nuts"] and not got[1].is_safe and got[2].is_safe


def random_boxes(spark, images=40, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(images):
        y = 0.0
        for b in range(rng.randint(1, 25)):
            y += rng.choice([0, 5, 30, 44, 46, 80, 91, 130, 250])
            rows.append((i, b, f"Text{b}", 1.0, float(rng.randint(0, 500)), y, 600.0, y + rng.choice([10, 20, 90]), rng.random()))
    return rows, spark.createDataFrame(rows, "image_id long, box_id long, text string, confidence double, x1 double, y1 double, x2 double, y2 double, pred_prob double")


def by_image(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {i: sorted(v, key=lambda r: ((r[5] + r[7]) / 2, r[4], r[1])) for i, v in out.items()}


def test_clusters_match_folds(spark):
    rows, df = random_boxes(spark)
    got = {(r.image_id, r.box_id): (r.cluster, r.group) for r in boxes.merged_clusters(boxes.row_clusters(boxes.prepared(df))).collect()}
    for i, v in by_image(rows).items():
        clusters, last = [], None
        for r in v:
            y = (r[5] + r[7]) / 2
            if last is None or y - last > 90:
                clusters.append([])
            clusters[-1].append(r)
            last = y
        group, low, n = {}, None, -1
        for k, c in enumerate(clusters):
            if low is None or min(r[5] for r in c) - low > 120:
                n += 1
            low = max([low or -1e9] + [r[7] for r in c])
            group |= {r[1]: (k, n) for r in c}
        assert {b: got[i, b] for b in group} == group


def test_lines_match_fold(spark):
    rows, df = random_boxes(spark, seed=4)
    got = {(r.image_id, b.box_id): b.row_id for r in boxes.assigned_rows(boxes.prepared(df)).collect() for b in r.placed}
    for i, v in by_image(rows).items():
        heights = sorted(r[7] - r[5] for r in v)
        m = (heights[(len(heights) - 1) // 2] + heights[len(heights) // 2]) / 2
        limit, anchor, row = max(45, 0.7 * max(1, m)), None, -1
        for r in v:
            y = (r[5] + r[7]) / 2
            if anchor is None or abs(y - anchor) > limit:
                anchor, row = y, row + 1
            assert got[i, r[1]] == row


def test_neighbours_match_pairs(spark):
    rows, df = random_boxes(spark, seed=5)
    got = {(r.image_id, r.box_id): r.near for r in boxes.neighbours(boxes.prepared(df)).collect()}
    for i, v in by_image(rows).items():
        for a in v:
            n = sum(b is not a and abs(a[5] + a[7] - b[5] - b[7]) / 2 <= 120 and abs(a[4] - b[4]) / 2 <= 900 for b in v)
            assert got.get((i, a[1]), 0) == n


def test_region_end_to_end(spark):
    b = [(1, 0, "Ingredients:", 0.9, 0.0, 0.0, 90.0, 20.0, 0.9), (1, 1, "Sugar, Wheat", 0.9, 0.0, 25.0, 60.0, 45.0, 0.95), (1, 2, "Flour, Salt", 0.9, 70.0, 26.0, 120.0, 44.0, 0.9), (1, 3, "Best before 2025", 0.9, 0.0, 70.0, 90.0, 90.0, 0.5), (1, 4, "far away", 0.9, 0.0, 900.0, 50.0, 920.0, 0.5), (2, 0, "x", 0.9, 0.0, 0.0, 1.0, 1.0, 0.1)]
    df = spark.createDataFrame(b, "image_id long, box_id long, text string, confidence double, x1 double, y1 double, x2 double, y2 double, pred_prob double")
    got = {r.image_id: r for r in boxes.regions(df).collect()}
    assert got[1].final_text == "Sugar, Wheat Flour, Salt" and got[1].header_text == "Ingredients:" and got[1]["size"] == 2
    assert got[2].final_text == "" and got[2]["size"] is None


def test_detections(spark):
    raw = spark.createDataFrame([("a", '{"_m": [], "a": [{"bbox": [[1, 2], [5, 2], [5, 8], [1, 8]], "text": " t ", "confidence": null}, {"bbox": [[0, 0], [1, 1]], "text": " "}, {"bbox": [[0, 0], [1, 1]], "text": "u", "confidence": 0.2}]}')], "k string, raw string")
    got = boxes.from_detections(readers.detection_map(raw)).orderBy("box_id").collect()
    assert [(r.box_id, r.text, r.confidence, r.x1, r.y2) for r in got] == [(0, "t", 1.0, 1.0, 8.0), (2, "u", 0.2, 0.0, 1.0)]


def test_corrections(spark):
    cases = {"watr": ("water", "alias"), "sugar": ("sugar", "known"), "E 330": ("e330", "known"), "e-330": ("e330", "known"), "tea": ("tea", "short"), "slat": ("malt", "blocked"), "honye": ("honey", "near"), "palmoil": ("palm oil", "near"), "qqqqqq": ("qqqqqq", "kept"), "fresh hony": ("fresh honey", "words")}
    terms = readers.vocabulary(spark)
    got = {r.raw: (r.fixed, r.step) for r in corrector.corrections(spark.createDataFrame([(c,) for c in cases], "raw string"), terms, readers.aliases(spark)).collect()}
    for k, v in cases.items():
        if v[1] != "blocked":
            assert got[k] == v, k
    lists = spark.createDataFrame([(1, ["Watr", "42", "WATER", "Added sugar", "honye", " "]), (2, [])], "doc_id long, items array<string>")
    assert {r.doc_id: r["items"] for r in corrector.corrected_lists(lists, terms, readers.aliases(spark)).collect()} == {1: ["water", "honey"], 2: []}


def test_edit_distances():
    assert corrector.osa("teh", "the", 2) == 1 and corrector.osa("abc", "abc", 2) == 0 and corrector.osa("ca", "abc", 3) == 3 and corrector.osa("a", "abcd", 2) == 3
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in "xy")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        want = 200 * table[-1][-1] / (len(a) + len(b)) if a or b else 100
        assert abs(metrics.indel_ratio(a, b) - want) < 1e-9


def test_greedy_matching():
    rng = random.Random(2)
    for _ in range(60):
        p, t = ([rng.choice(["sugar", "suger", "salt", "sea salt", "oil", "palm oil"]) for _ in range(rng.randint(0, 5))] for _ in "pt")
        used, n = set(), 0
        for x in p:
            best, at = 0, None
            for k, y in enumerate(t):
                if k not in used and (r := difflib.SequenceMatcher(None, x, y).ratio()) > best:
                    best, at = r, k
            if at is not None and best >= 0.8:
                used.add(at)
                n += 1
        assert metrics.greedy_matches(p, t, 0.8) == n
    assert metrics.best_fuzzy_score("sugar", "raw sugar, salt") == 100 and metrics.best_fuzzy_score("sugar", "") == 0
    assert 79 < metrics.best_fuzzy_score("sugar", "raw suqar salt") < 100


def test_metric_edges(spark):
    df = spark.createDataFrame([(1, [], []), (2, ["a"], []), (3, [], ["a"]), (4, ["A ", "b"], ["a", "c"])], "k int, predicted array<string>, truth array<string>")
    p, t = F.col("predicted"), F.col("truth")
    got = {r.k: r for r in metrics.fuzzy(df.withColumns({"p": metrics.set_precision(p, t), "r": metrics.set_recall(p, t)})).collect()}
    assert [(got[k].p, got[k].r) for k in (1, 2, 3, 4)] == [(0, 1), (0, 0), (0, 0), (0.5, 0.5)]
    assert [(got[k].fuzzy_precision, got[k].fuzzy_recall, got[k].fuzzy_f1) for k in (1, 2, 3)] == [(1, 1, 1), (0, 1, 0), (0, 0, 0)]


def test_accounts(spark):
    old = spark.createDataFrame([(1, True, None), (2, False, True)], "user_id int, halal boolean, vegan boolean")
    patch = spark.createDataFrame([(2, None, False), (3, True, None)], "user_id int, halal boolean, vegan boolean")
    some = {r.user_id: (r.halal, r.vegan) for r in accounts.merged(old, patch, "user_id", {"halal": False, "vegan": False}).collect()}
    assert some == {1: (True, False), 2: (False, False), 3: (True, False)}
    now = F.lit(dt.datetime(2024, 1, 1))
    keys = spark.createDataFrame([("img10.JPG",), ("IMG2.jpg",), ("a",)], "n string").orderBy(accounts.natural_key(F.col("n"))).collect()
    assert [r.n for r in keys] == ["a", "IMG2.jpg", "img10.JPG"]
    times = [(dt.datetime(2023, 12, 31, 23, 59), "1m ago"), (dt.datetime(2023, 12, 31, 1), "23h ago"), (dt.datetime(2023, 12, 26), "6d ago"), (dt.datetime(2023, 12, 5), "Dec 5")]
    got = spark.createDataFrame([(t,) for t, _ in times], "t timestamp").select(accounts.ago(F.col("t"), now).alias("v")).collect()
    assert sorted(r.v for r in got) == sorted(v for _, v in times)


def test_classifier_round_trip(spark, tmp_path):
    rows = [(i, b, "sugar, salt" if (i + b) % 2 else "store below 20", 1.0, 0.0, b * 30.0, 50.0, b * 30 + 20.0, (i + b) % 2) for i in range(12) for b in range(6)]
    df = learning.inputs(spark.createDataFrame(rows, "image_id long, box_id long, text string, confidence double, x1 double, y1 double, x2 double, y2 double, label int"))
    model = learning.fit(df)
    got = learning.predict(model, df)
    assert got.filter("label = pred_label").count() > 0.9 * len(rows)
    learning.save(spark, model, 0.5, str(tmp_path))
    again = learning.predict(learning.load(spark, str(tmp_path))[0], df)
    assert got.exceptAll(again).isEmpty() and learning.predict(model, df.limit(0)).columns == got.columns


def test_streams(spark, tmp_path):
    from labelforge.streaming import scans as streams

    rows = [(k, k % 3, ["Pork"] if k % 2 else ["Rice"]) for k in range(20)]
    spark.createDataFrame(rows, "scan_id long, user_id long, items array<string>").write.parquet(str(tmp_path / "in"))
    profiles = spark.createDataFrame([(0, *[True] * 6, None), (1, *[False] * 6, ["rice"])], "user_id long, " + ", ".join(f"{f} boolean" for f in FLAGS) + ", allergens array<string>")
    src = spark.readStream.schema("scan_id long, user_id long, items array<string>").parquet(str(tmp_path / "in"))
    q = streams.verdicts(src, profiles).writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = analysis.analyze(spark.createDataFrame(rows, "scan_id long, user_id long, items array<string>"), profiles)
    assert spark.table("verdicts").exceptAll(batch).isEmpty() and spark.table("verdicts").count() == 20


@pytest.mark.parametrize("name", ["csv", "truth"])
def test_files(spark, tmp_path, name):
    p = tmp_path / name
    if name == "csv":
        p.write_text("image_id,box_id,text,confidence,x1,y1,x2,y2,label\na,1,,bad,1,2,3,4,1\n")
        r = readers.box_csv(spark, str(p)).first()
        assert (r.text, r.confidence, r.y2, r.label) == ("", 0.0, 4.0, 1)
    else:
        p.write_text('[{"image": "a", "true_ingredients": ["x", " "]}, {"image": "b", "true_ingredients": null}]')
        assert {r.image: r.true_ingredients for r in readers.truth_json(spark, str(p)).collect()} == {"a": ["x"], "b": []}


def test_regions_in_one_pass_equal_the_steps(spark):
    rng, rows = random.Random(9), []
    texts = ["Ingredients:", "sugar, salt", " palm  oil ", "best", "before", "12", "%", "and more", "www.x.com", "", "per 100g", "Text\u0085", "energy", "MILK powder"]
    for i in range(60):
        y = 0.0
        for b in range(rng.randint(1, 14)):
            y += rng.choice([0, 5, 30, 60, 91, 130, 250])
            x = float(rng.choice([0, 10, 950, 2000]))
            rows.append((i, b, rng.choice(texts), 1.0, x, y, x + 40, y + rng.choice([10, 20, 90]), rng.randint(30, 100) / 100))
    # A hint that stands in no box alone.
    rows += [(60, b, t, 1.0, 10.0 * b, 20.0, 10.0 * b + 9, 40.0, 0.9) for b, t in enumerate(["sugar", "best", "before"])]
    df = spark.createDataFrame(rows, "image_id long, box_id long, text string, confidence double, x1 double, y1 double, x2 double, y2 double, pred_prob double")
    made = boxes.regions(df)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Join" not in plan
    ready = boxes.prepared(df)
    heads = boxes.headers(ready)
    below = boxes.below_header(boxes.positive(ready), heads).drop("header_text", "header_y", "header_y2")
    near = below.join(boxes.neighbours(below), ["image_id", "box_id"], "left").withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("image_id")))
    kept = near.filter((F.col("many") <= 1) | (F.col("pred_prob") >= fixed.LONELY_KEEP) | (F.coalesce("near", F.lit(0)) >= 1) | text.is_continuation(F.col("text")))
    kept = boxes.merged_clusters(boxes.row_clusters(kept))
    best = {r.image_id: r for r in boxes.best_groups(boxes.group_scores(kept, heads)).collect()}
    told = kept.withColumn("out", text.is_junk_fragment(F.col("text")) & ~text.is_continuation(F.col("text"))).withColumn("words", text.squeeze(F.col("text"))).collect()
    raw = {}
    for i in range(61):
        own = sorted((r for r in told if r.image_id == i and r.group == best[i].group), key=lambda r: (r.y_center, r.x1, r.box_id)) if i in best else []
        limit = max(fixed.LINE_GAP, fixed.LINE_SHARE * max(1.0, statistics.median(r.height for r in own))) if own else 0
        lines = []
        for r in own:
            if not lines or abs(r.y_center - lines[-1][0].y_center) > limit:
                lines.append([])
            lines[-1].append(r)
        joined = [" ".join(r.words for r in sorted(x, key=lambda r: (r.x1, r.box_id)) if r.words and not r.out) for x in lines]
        raw[i] = "\n".join(x for x in joined if x)
    tidy = {r.i: r.t for r in spark.createDataFrame(list(raw.items()), "i long, raw string").select("i", text.tidy_text(F.col("raw")).alias("t")).collect()}
    first = {r.image_id: r for r in heads.collect()}
    got = {r.image_id: r for r in made.collect()}
    assert len(got) == 61 and len(best) > 40 and raw[60] == "sugar best before" and tidy[60] == "sugar"
    for i, r in got.items():
        assert (r.header_text, r.header_y) == ((first[i].header_text, first[i].header_y) if i in first else (None, None))
        assert (r.size, r.mean_prob and round(r.mean_prob, 9)) == ((best[i].size, round(best[i].mean_prob, 9)) if i in best else (None, None))
        assert (r.raw_text, r.final_text) == (raw[i], tidy[i])
