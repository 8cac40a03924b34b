"""Label tables derived from the driver tables by integer arithmetic, as DataFrames and as equal SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexicon import LEXICON
from ..session import table

N = len(LEXICON)
FLAGS = ("halal", "gluten_free", "vegetarian", "vegan", "nut_free", "dairy_free")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL_LEXICON = "[" + ", ".join(map(sql_text, LEXICON)) + "]"


def _term(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in LEXICON]), (index % N + 1).cast("int"))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, items: 3 to 11 terms of the lexicon per document."""
    last = (2 + F.col("doc_id") % 9).cast("int")
    items = F.transform(F.sequence(F.lit(0), last), lambda p: _term(F.col("doc_id") * 7 + p * 13))
    return table(spark, sf_dir, "documents").select("doc_id", items.alias("items"))


SQL_LISTS = f"v_lists AS (SELECT doc_id, list_transform(range(0, 3 + doc_id % 9), lambda p: ({SQL_LEXICON})[(doc_id * 7 + p * 13) % {N} + 1]) AS items FROM documents)"


def ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists(spark, sf_dir).select("doc_id", F.posexplode("items").alias("pos", "term"))


SQL_INGREDIENTS = SQL_LISTS + ", v_ingredients AS (SELECT doc_id, unnest(range(0, len(items))) AS pos, unnest(items) AS term FROM v_lists)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, predicted and true items: shifted picks, so that some agree."""
    def pick(n: Column, start: Column, step: int) -> Column:
        return F.transform(F.sequence(F.lit(0), n.cast("int")), lambda p: _term(start + p * step))

    d = F.col("doc_id")
    none = F.array().cast("array<string>")
    predicted = F.when(d % 11 == 0, none).otherwise(pick(1 + d % 6, d * 7, 13))
    true = F.when(d % 13 == 0, none).otherwise(pick(1 + d % 7, d * 7 + (d % 3) * 13, 13))
    return table(spark, sf_dir, "documents").select("doc_id", predicted.alias("predicted"), true.alias("truth"))


SQL_PAIRS = (
    f"v_pairs AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN []::VARCHAR[] ELSE list_transform(range(0, 2 + doc_id % 6), lambda p: ({SQL_LEXICON})[(doc_id * 7 + p * 13) % {N} + 1]) END AS predicted, "
    f"CASE WHEN doc_id % 13 = 0 THEN []::VARCHAR[] ELSE list_transform(range(0, 2 + doc_id % 7), lambda p: ({SQL_LEXICON})[(doc_id * 7 + (doc_id % 3) * 13 + p * 13) % {N} + 1]) END AS truth FROM documents)"
)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    flags = [(k % (n + 2) == 0).alias(f) for n, f in enumerate(FLAGS)]
    allergens = F.when(k % 5 == 0, F.array(F.lit("mustard"), F.lit("sesame"))).when(k % 5 == 1, F.array(F.lit("(milk)"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").filter(k % 10 != 7).select(k.alias("user_id"), *flags, allergens.alias("allergens"))


SQL_PROFILES = (
    "v_profiles AS (SELECT c_custkey AS user_id, " + ", ".join(f"(c_custkey % {n + 2} = 0) AS {f}" for n, f in enumerate(FLAGS))
    + ", CASE WHEN c_custkey % 5 = 0 THEN ['mustard', 'sesame'] WHEN c_custkey % 5 = 1 THEN ['(milk)'] ELSE []::VARCHAR[] END AS allergens FROM customer WHERE c_custkey % 10 <> 7)"
)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, box_id, text, confidence, corners and pred_prob: the lines of each document as boxes."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    d, i = F.col("doc_id"), F.col("i").cast("long")
    y1 = i * 37 + (d * i) % 60 + F.expr("70 * (i div 7)") + F.expr("160 * (i div 21)")
    text = F.when((d + i) % 5 == 0, _term(d * 7 + i * 13)).otherwise(F.col("line"))
    return rows.select(
        d.alias("image_id"), i.alias("box_id"), text.alias("text"), (((d * 17 + i * 29) % 100) / 100).alias("confidence"), (10 * (i % 3)).cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (10 * (i % 3) + 40).cast("double").alias("x2"), (y1 + 20).cast("double").alias("y2"), (((d * 31 + i * 17) % 100) / 100).alias("pred_prob"),
    )


SQL_BOXES = (
    "v_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents), "
    f"v_boxes AS (SELECT doc_id AS image_id, i AS box_id, CASE WHEN (doc_id + i) % 5 = 0 THEN ({SQL_LEXICON})[(doc_id * 7 + i * 13) % {N} + 1] ELSE line END AS text, "
    "((doc_id * 17 + i * 29) % 100) / 100 AS confidence, (10 * (i % 3))::DOUBLE AS x1, (i * 37 + (doc_id * i) % 60 + 70 * (i // 7) + 160 * (i // 21))::DOUBLE AS y1, "
    "(10 * (i % 3) + 40)::DOUBLE AS x2, (i * 37 + (doc_id * i) % 60 + 70 * (i // 7) + 160 * (i // 21) + 20)::DOUBLE AS y2, ((doc_id * 31 + i * 17) % 100) / 100 AS pred_prob FROM v_lines)"
)
