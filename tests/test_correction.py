"""Splitting words that run together, against brute force over all cuts."""

import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from labelforge.operators import corrector
from labelforge.sources import readers

TERMS = {"sea salt": 5, "salt": 40, "sea": 3, "palm oil": 9, "oil": 70, "palm": 2, "wheat flour": 12, "flour": 30, "wheat": 8, "whole wheat flour": 2, "milk": 50, "skim milk powder": 1, "a": 1, "cocoa butter": 4}


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame(list(TERMS.items()), "term string, weight long")


def part_of(part):
    """Text, cost, score of a part: the closest term, then the weightiest, then by name."""
    total = sum(TERMS.values())
    near = min(((corrector.osa(part, t, 2), -w, t) for t, w in TERMS.items()), default=(3,))
    if near[0] > 2:
        return part, len(part), round((math.log10(10 / total) - len(part)) * 1e6)
    return near[2], near[0], round(math.log10(-near[1] / total) * 1e6)


def all_cuts(word):
    """(cost, -score, text) of every way to cut the word."""
    own, gaps = "", set()
    for c in word:
        if c == " ":
            gaps.add(len(own))
        else:
            own += c
    for marks in product((False, True), repeat=len(own) - 1):
        at = [0, *[k + 1 for k, m in enumerate(marks) if m], len(own)]
        texts, cost, score = [], 0, 0
        for a, b in zip(at, at[1:]):
            t, c, s = part_of(own[a:b])
            texts.append(t)
            cost += c + sum(a < g < b for g in gaps) + (a > 0 and a not in gaps)
            score += s
        yield cost, -score, " ".join(texts)


def test_the_cheapest_of_all_cuts(spark, vocabulary):
    rng = random.Random(5)
    words = {"seasalt", "palmoil", "se asalt", "wheatflour", "palm oill", "oilsalt", "zzzz", "a", "milkoilsea", "cocoabuttr"}
    while len(words) < 40:
        w = "".join(rng.choice([*TERMS, "x", "q "]) for _ in range(rng.randint(1, 2))).strip()
        k = rng.randrange(len(w))
        w = rng.choice([w, w.replace(" ", ""), w[:k] + rng.choice("aelt ") + w[k + 1 :]]).strip()
        if 0 < len(w.replace(" ", "")) <= 12:
            words.add(" ".join(w.split()))
    got = {r.word: r for r in corrector.cuts(spark.createDataFrame([(w,) for w in words], "word string"), vocabulary).collect()}
    assert set(got) == words
    for w in words:
        ways = sorted(all_cuts(w))
        assert (got[w].cost, -got[w].score) == ways[0][:2], w
        if len(ways) == 1 or ways[1][:2] != ways[0][:2]:
            assert got[w].text == ways[0][2]


def test_no_word_that_splits_into_a_term_is_left_out(spark, vocabulary):
    rng = random.Random(6)
    words = set()
    for t in TERMS:
        for _ in range(30):
            w = t.replace(" ", "") if rng.random() < 0.7 else t
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + w[k + 1 : k + 2] + w[k] + w[k + 2 :]]) or "x"
            words.add(" ".join(w.split()) or "x")
    df = spark.createDataFrame([(w,) for w in words], "word string")
    every = corrector.cuts(df, vocabulary)
    allowed = F.col("cost") / F.length(F.replace("word", F.lit(" "), F.lit(""))) <= corrector.ERRORS
    # At no cost at all the word is the term itself, which an earlier step takes.
    want = {(r.word, r.text) for r in every.filter(allowed & (F.col("cost") > 0)).collect() if r.text in TERMS}
    assert {(r.word, r.term) for r in corrector.segmented(df, vocabulary).collect() if r.word != r.term} == want and want


def test_ladder_order(spark, vocabulary):
    raw = ["SeaSalt", "wholewheatflour", "skimmilkpowder", "oil", "sea salt", "zz", "unknownthing", "palm oli"]
    got = {r.raw: (r.fixed, r.step) for r in corrector.corrections(spark.createDataFrame([(r,) for r in raw], "raw string"), vocabulary, readers.aliases(spark)).collect()}
    more = [*TERMS.items(), ("unsweetened", 2), ("condensed", 2), ("coconut", 3), ("unsweetened condensed coconut milk", 1)]
    long = corrector.corrections(spark.createDataFrame([("unsweetenedcondensedcoconutmilk",), ("unsweetenedcoconutcondensedmilk",)], "raw string"), spark.createDataFrame(more, "term string, weight long"), readers.aliases(spark))
    assert {r.raw: r.step for r in long.collect()} == {"unsweetenedcondensedcoconutmilk": "split", "unsweetenedcoconutcondensedmilk": "kept"}
    # One missing space is within the distance of a whole term; three are not, but within the error rate.
    assert got["SeaSalt"] == ("sea salt", "near") and got["oil"][1] == got["sea salt"][1] == "known" and got["zz"][1] == "short"
    assert got["wholewheatflour"] == ("whole wheat flour", "near") and got["unknownthing"] == ("unknownthing", "kept") and got["palm oli"] == ("palm oil", "near")


def test_weights_are_counts_of_true_items(spark, vocabulary):
    truth = spark.createDataFrame([(["Salt", " salt ", "none"],), ([],), (None,), (["Oil"],)], "items array<string>")
    got = {r.term: r.weight for r in corrector.counted_weights(truth, vocabulary).collect()}
    assert (got["salt"], got["oil"], got["sea"]) == (3, 2, 1) and set(got) == set(TERMS)
