"""Rules on single strings and lists, by hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from labelforge.functions import text
from labelforge.operators import products


def values(spark, fn, inputs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r.v for r in df.select("k", fn(F.col("x")).alias("v")).orderBy("k").collect()]


CASES = [
    (text.is_header, {"Ingredients:": True, " list of ingredients ": True, "ingredients: sugar": False, "Table of  ingredient": True}),
    (text.has_bad_hint, {"Best before end": True, "soy protein": True, "sugar": False, "a@b": True}),
    (text.is_junk_fragment, {"": True, "ab": True, "12345": True, "1a2": True, "--a--": True, "sugar": False, "A/B-123": True}),
    (text.is_continuation, {"(milk": True, "12,5%": True, "and salt": True, "flour": True, "Flour": False, "": False, "flour of very long grained rice": False}),
    (text.is_start, {"## **Ingredients**:": True, "INGREDIENTS: sugar": True, "see ingredients in bold": False, "ingrodlonts tea": True}),
    (text.is_stop, {"for allergens see bold": True, "sugar": False, "Contains: wheat": True}),
    (text.is_garbage, {"42": True, "x": True, "100 g": True, "30 %": True, "100% natural": True, "sugar": False, "--": True}),
    (text.is_warning, {"Contains:": True, "may contain traces of nuts": True, "contains sugar": False}),
    (text.is_warning_prefix, {"Added sugar": True, "contains milk": True, "containers": False}),
    (text.is_valid_item, {"sugar": True, "a": False, "x" * 90: True, "lifestyle " + "x" * 90: False}),
    (text.is_image_line, {"![a](b)": True, "![a](b) c": False}),
    (text.is_junk_item, {"42": True, "may contain nuts": True, "sugar": False, "1 - 2": True}),
    (text.strip_prefixes, {"Ingredients: sugar": "sugar", "ingrodlonts tea": "tea", "salt": "salt"}),
    (text.before_stop, {"sugar, salt. For allergens see": "sugar, salt.", "For allergens": "", " oil ": "oil"}),
    (text.bare_line, {"## **Ingredients** ": "Ingredients", "a*b": "a*b"}),
    (text.post_process, {"Butter milk": "butter (milk)", "unsalted butter milk solids": "unsalted butter milk solids", "[Crème] *": "(Creme)", "sugar (12.5 %*)": "sugar", " (a; ": "(a)", ".salt,": "salt", "a &amp; b": "a & b"}),
    (text.additive_code, {"E 330": "e330", "e-471A": "e471a", "e33": "e33", "E3300 x": "E3300 x"}),
    (text.clean_ocr, {" E 330 Sugar!! ": "e330 sugar", "a  b?": "a b"}),
    (text.normalize_text, {"a , b\n( c ) ;": "a, b (c)", "x :": "x"}),
    (text.trim_tail, {"sugar, energy 3": "sugar,", "energy": "energy", "soy protein, salt": "soy"}),
    (text.drop_junk_lines, {"sugar\n\n42\nstore in fridge\nsalt ": "sugar\nsalt"}),
    (text.comparable, {"Wheat  Flour (12%)": "wheatflour", "Soy [a]: b.": "soya (a) b", "12%": ""}),
    (text.joinable, {"Palm / Rape  oil": "palm rape oil"}),
    (text.section, {"Front\nIngredients: sugar\nsalt. For allergens x\noil": "sugar salt.", "just text": "just text", "Ingredients:\n![a](b)\noil": "oil", "Ingredients: a\nIngredients: b best before": "a b best before"}),
]


@pytest.mark.parametrize("fn,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_rules(spark, fn, cases):
    assert dict(zip(cases, values(spark, fn, cases))) == cases


LISTS = [
    (text.split_ingredients, {"a, b and c": ["a", "b", "c"], "Emulsifier (E322 and E476), x": ["Emulsifier (E322 and E476)", "x"], "a) , b": ["a)", "b"], "A OR b . c & d;e·f\ng": ["A", "b", "c", "d", "e", "f", "g"], " ": []}),
    (text.split_commas, {"a, b (c, d), ": ["a", "b (c, d)"], "a), b": ["a), b"]}),
    (text.parse_product_list, {"Ingredients: sugar 30%, b, milk (40%), c d.": ["sugar", "milk ()", "c d"], "contains: aa, bb) , cc": ["aa", "bb) , cc"], "": []}),
    (text.strip_functional, {"Raising Agent: E450, E501": ["E450", "E501"], "Colour: x": ["Colour: x"], "acid: ": [], " ": []}),
]


@pytest.mark.parametrize("fn,cases", LISTS, ids=[f.__name__ for f, _ in LISTS])
def test_splitters(spark, fn, cases):
    assert dict(zip(cases, values(spark, fn, cases))) == cases


def test_list_functions(spark):
    row = spark.range(1).select(
        text.distinct_items(F.array(*map(F.lit, ["Salt", " salt ", "oil", "SALT", "Oil"]))).alias("a"),
        products.named_list(F.lit("en:milk, en:tree-nuts,"), F.array(F.lit("en:tree-nuts"), F.lit("en:milk"))).alias("b"),
        products.title(F.lit("o'neil's ECLAIR")).alias("c"),
    ).first()
    assert row.a == ["Salt", "oil"] and row.b == ["Milk", "Tree-Nuts", "Tree Nuts"] and row.c == "O'Neil'S Eclair"


def test_compound_phrases():
    assert products.expand_phrase("chocolate (sugar, cocoa (a, b), milk)") == ["sugar", "a", "b", "milk"]
    assert products.expand_phrase("oil (palm)") == ["oil (palm)"] and products.expand_phrase("colour: x (a, b)") == ["colour: x (a, b)"]
    assert products.expand_phrase("Emulsifiers: E322, E471") == ["E322", "E471"] and products.expand_phrase("bad (a, b") == ["bad (a, b"]


REPLIES = {
    '{"a": 1}': '{"a":1}', '```json\n{"a": [1]}\n```': '{"a":[1]}', 'Sure: {"a": "}\\""} bye {"b": 2}': '{"a":"}\\""}', "list [1, 2] end": '{"items":[1,2]}',
    "nothing": None, "": None, None: None, '{"a": 1': None,
}


def test_json_repair(spark):
    assert {k: products.repaired_json(k) for k in REPLIES} == REPLIES
    assert dict(zip(REPLIES, values(spark, products.repaired, REPLIES))) == REPLIES
