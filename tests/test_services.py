"""Verdicts on golden labels, training labels, services, prompts and writers."""

import difflib
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from labelforge.functions import fixed, text
from labelforge.operators import analysis, corrector, labelling, learning, likeness, products, prompts, services
from labelforge.session import shared_path
from labelforge.sources import readers, sinks

def test_terms_with_marks(spark):
    df = spark.createDataFrame([(["butter (milk)", "x"],), (["milky way"],), (["skim milk"],), ([],), (None,), ([None, "Milk"],)], "items array<string>")
    got = [r[0] for r in analysis.with_term_hits(df).select(analysis.of_category(F.col("_hits"), "dairy")).collect()]
    assert got == [["milk", "butter", "(milk)"], [], ["milk", "skim milk"], [], [], ["milk"]]


def test_term_hits_equal_a_search_for_each_term(spark):
    rng = random.Random(4)
    bits = [w for t in analysis.ALL_TERMS for w in (t, t[1:], t + "s", t.upper(), t.replace(" ", "  "))] + ["xx", "(milk)s", "a(milk)", "-", "é", ""]
    lists = [["".join(rng.choice(bits) + rng.choice([" ", ", ", "", "-"]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 4))] for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, items array<string>")

    def held(t, i):
        return t in i.lower() if " " in t else bool(re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", i.lower()))

    for r in analysis.with_term_hits(df).collect():
        assert set(r._hits) == {t for t in analysis.ALL_TERMS if any(held(t, i) for i in lists[r.k])}


def plain_label(text, items):
    low = text.lower().strip()
    if not low or labelling_re("header", text) or labelling_re("junk", text) or labelling_re("stop", text):
        return 0
    needle = low.rstrip(".,;:)")
    if len(needle) >= 3 and needle in " ".join(x.lower() for x in items):
        return 1
    if len(low) < 2:
        return 0
    return int(any(low in x.lower().strip() or x.lower().strip() in low or difflib.SequenceMatcher(None, low, x.lower().strip()).ratio() >= 0.55 for x in items))


def labelling_re(kind, text):
    pattern = {"header": fixed.LABEL_HEADER, "junk": fixed.LABEL_JUNK, "stop": "(?i)" + "|".join(fixed.LABEL_STOPS)}[kind]
    return bool(re.search(pattern, text if kind == "stop" else text.strip()))


def test_box_labels(spark):
    items = ["Sugar", "Wheat Flour", "Palm oil", "Salt"]
    texts = ["", "Ingredients:", "AB", "42", "kcal", "store in a cool place", "sugar,", "wheat flou", "Palmm oil", "unrelated words", "s", "flour, palm", "salt & vinegar crisps"]
    boxes = spark.createDataFrame([(i, k, t) for i in (1, 2) for k, t in enumerate(texts)], "image_id long, box_id int, text string")
    truth = spark.createDataFrame([(1, items), (2, [])], "image_id long, items array<string>")
    got = labelling.labelled(boxes, truth).orderBy("box_id").collect()
    assert [(r.image_id, r.label) for r in got] == [(1, plain_label(t, items)) for t in texts]
    met = boxes.filter("image_id = 1").select("box_id", labelling.matches_truth(F.col("text"), F.array(*[F.lit(x) for x in items])).alias("m")).orderBy("box_id").collect()
    assert [r.m for r in met] == [len(t.strip()) > 1 and any(t.lower().strip() in x.lower() or x.lower() in t.lower().strip() or difflib.SequenceMatcher(None, t.lower().strip(), x.lower()).ratio() >= 0.55 for x in items) for t in texts]


def test_services(spark):
    # A column of repaired replies was made and used before: a model call must still go to executors.
    assert spark.createDataFrame([('x {"a": 1} y',)], 'r string').select(products.repaired(F.col("r"))).first()[0] == '{"a":1}'
    df = spark.createDataFrame([(1, "Sugar and SALT"), (2, None), (3, "nothing known"), (4, " ")], "id int, raw string")
    got = {r.id: (r.success, r.items) for r in services.extracted(df, "raw").collect()}
    assert got == {1: (True, ["Sugar", "Salt"]), 2: (False, []), 3: (True, []), 4: (False, [])}
    bad = services.extracted(df, "raw", [("bad", lambda ps: ["no json"] * len(ps))]).collect()
    assert all(not r.success and r.items == [] and r.provider is None for r in bad)
    waits, answers = [], iter([(503, ""), (None, ""), (200, "text")])
    assert services.retrying(lambda b: next(answers), 3, waits.append)(b"") == "text" and waits == [1, 2]
    with pytest.raises(RuntimeError):
        services.retrying(lambda b: (404, ""), 3, waits.append)(b"")


def test_noise_is_repeatable(spark):
    df = spark.createDataFrame([("Ingredients: sugar, lemon oil, salt" * 5,)], "t string")
    a, b, c = (df.select(prompts.noisy(F.col("t"), seed, percent)).first()[0] for seed, percent in ((1, 20), (1, 20), (2, 20)))
    assert a == b != c and df.select(prompts.noisy(F.col("t"), 1, 0)).first()[0] == df.first()[0]


def test_writers(spark):
    path = shared_path(spark, "lines")
    one, two = (spark.createDataFrame([(k, f't "{k}"\n, x')], "id int, text string") for k in (1, 2))
    sinks.replace_lines(one, path)
    sinks.replace_lines(two, path)
    assert sinks.read_lines(spark, path, one.schema).first().id == 2
    sinks.point_at(spark, path, sinks.versions(spark, path)[0])
    assert sinks.read_lines(spark, path, one.schema).first().id == 1
    at = shared_path(spark, "csv")
    sinks.write_csv(one, at, ["text", "id"])
    assert sinks.read_csv(spark, at, "text string, id int").collect() == one.select("text", "id").collect()
    lines = spark.createDataFrame([('{"lang": "en", "n": 1}',), ("{bad",), ('{"lang": "de", "n": 2}',), ("",)], "line string")
    kept, counts = sinks.kept_lines(lines, "lang string, n int", F.col("row.lang") == "en")
    assert [tuple(r) for r in kept.collect()] == [("en", 1)] and tuple(counts.first()) == (1, 1, 1)


def test_readers_never_meet_a_missing_path(spark):
    path, bad, stop = shared_path(spark, "looped"), [], threading.Event()
    schema = "id int, text string"
    assert sinks.read_lines(spark, path, schema).count() == 0 and sinks.current_version(spark, path) is None
    sinks.replace_lines(spark.createDataFrame([(0, "a"), (0, "b")], schema), path)

    def read():
        while not stop.is_set():
            try:
                got = {r.id for r in sinks.read_lines(spark, path, schema).collect()}
                if len(got) != 1:
                    bad.append(got)
            except Exception as e:  # noqa: BLE001
                bad.append(e)

    readers_ = [threading.Thread(target=read) for _ in range(2)]
    for t in readers_:
        t.start()
    for k in range(1, 50):
        sinks.replace_lines(spark.createDataFrame([(k, "a"), (k, "b")], schema), path)
    stop.set()
    for t in readers_:
        t.join()
    assert not bad and sinks.read_lines(spark, path, schema).first().id == 49 and len(sinks.versions(spark, path)) == sinks.VERSIONS
    with pytest.raises(Exception):
        sinks.replace_lines(spark.createDataFrame([(99, "a")], schema).withColumn("id", F.raise_error(F.lit("stop"))), path)
    assert sinks.read_lines(spark, path, schema).first().id == 49


def test_likeness_equals_the_plain_ratio():
    rng, like = random.Random(8), likeness.Likeness(kept=50)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abcde ", k=rng.choice([0, 3, 9, 30, 260]))) for _ in "xy")
        want = difflib.SequenceMatcher(None, a, b).ratio()
        assert like.ratio(a, b) == want and like.ratio(a, b, 0.5) == (want if want >= 0.5 else like.ratio(a, b, 0.5))
        assert (like.ratio(a, b, 0.5) >= 0.5) == (want >= 0.5)


def test_corrected_text(spark):
    df = spark.createDataFrame([(1, "suger, watr and salt"), (2, ""), (3, None)], "doc_id int, raw string")
    got = {r.doc_id: r.raw for r in corrector.corrected_text(df, "raw", readers.vocabulary(spark), readers.aliases(spark)).collect()}
    assert got == {1: "sugar, water, salt", 2: "", 3: None}


def test_corrected_text_takes_each_text_once(spark):
    texts = ["suger, watr and salt", "watr (suger, salt) or honye", "", None, "42"]
    df = spark.createDataFrame([(k // 2, texts[k % 5]) for k in range(40)], "doc_id int, raw string")
    out = corrector.corrected_text(df, "raw", readers.vocabulary(spark), readers.aliases(spark))
    # Rows meet the corrected texts in one join; no row's own text is split.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Generate" not in plan and "aggregate(" not in plan
    want = {"suger, watr and salt": "sugar, water, salt", "watr (suger, salt) or honye": "water (suger, salt), honey", "": "", None: None, "42": "42"}
    assert sorted((r.doc_id, str(r.raw)) for r in out.collect()) == sorted((k // 2, str(want[texts[k % 5]])) for k in range(40))


def test_splitting_by_runs_equals_splitting_by_characters(spark):
    rng, seps = random.Random(5), set(",;&·•\n")
    texts = ["".join(rng.choices(["a", "b c", " and ", " AND", " or ", " . ", ".", ",", ";", "(", ")", " ", "é", "\n", "\U0001f600"], k=rng.randint(0, 14))) for _ in range(300)]

    def plain(t):
        out, now, depth, k, t = [], "", 0, 0, t.strip(" \n")
        while k < len(t):
            word = next((w for w in (" and ", " or ", " . ") if t[k : k + len(w)].lower() == w), t[k])
            if depth == 0 and (word in seps or len(word) > 1):
                out, now = out + [now], ""
            else:
                depth = max(0, depth + (word == "(") - (word == ")"))
                now += t[k : k + len(word)]
            k += len(word)
        return [x.strip(" \n") for x in [*out, now] if x.strip(" \n")]

    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.split_ingredients(F.col("t")).alias("x")).collect()
    assert {r.k: r.x for r in got} == {k: plain(t) for k, t in enumerate(texts)}


def test_report_by_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, pred_label int")
    got = {r["class"]: (r.support, r.precision, r.recall) for r in learning.report(df).collect()}
    assert got == {0: (2, 2 / 3, 1.0), 1: (2, 1.0, 0.5)}
