"""The box classifier: character n-gram TF-IDF and box features into a balanced logistic regression."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ranks import ranked
from ..session import arrow_rows, saved
from . import boxes as op
from . import logistic, ngrams

FEATURES = tuple(
    sorted(
        ["ocr_confidence", "char_len", "word_count", "digit_count", "comma_count", "percent_count", "paren_count", "colon_count", "is_all_caps", "width", "height", "x_center", "y_center"]
        + [f"{side}{h}" for side in ("", "prev_", "next_") for h in ("has_ingredient_hint", "has_noningredient_hint", "has_header_hint")]
    )
)
#: Split of images by a hash of their id: eight, one and one of ten buckets.
TRAIN, VALID = 8, 9
#: Blocks in an Arrow batch, and how they are written: a task reads a row group of them at once.
BLOCKS, WRITTEN = 8, {"parquet.block.size": str(64 << 20), "parquet.page.size.row.check.min": "4"}


def inputs(boxes: DataFrame) -> DataFrame:
    """Features and the lower-cased context of each box, runs of white space as one space."""
    rows = op.features(op.with_context(op.prepared(boxes)))
    return rows.withColumn("chars", F.regexp_replace(F.lower("context_text"), r"(?U)\s\s+", " ")).drop("prev_text", "next_text", "context_text")


def bucket_of(image: Column, seed: int = 42) -> Column:
    """0 to 9 by a hash of the image's id, so that all boxes of an image are of one split."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), image.cast("string")).cast("binary"))
    return F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % 10


def image_splits(rows: DataFrame, image: str = "image_id", seed: int = 42, held_out: float = 0.2) -> DataFrame:
    """image and split: of all images the first by a seeded hash, rounded up, are held out; half of these (rounded up) test, the rest valid."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col(image).cast("string")).cast("binary"))
    laid = ranked(rows.select(image).distinct().withColumn("_mark", mark), [], ["_mark", image], "_place")
    out = laid.agg(F.count(F.lit(1)).alias("_n")).select(F.ceil(F.col("_n") * held_out).alias("_out"))
    part = F.when(F.col("_place") >= F.col("_out"), "train").when(F.col("_place") < F.ceil(F.col("_out") / 2), "test").otherwise("valid")
    return laid.crossJoin(F.broadcast(out)).select(image, part.alias("split"))


def with_split(rows: DataFrame, image: str = "image_id", seed: int = 42, held_out: float = 0.2) -> DataFrame:
    """Adds split; all rows of an image are of one."""
    return rows.join(image_splits(rows, image, seed, held_out), image)


@dataclass
class BoxModel:
    """A vocabulary, its weights, the features' weights and the intercept; the last gradient's largest entry and the passes it took."""

    words: ngrams.Vocabulary
    weights: np.ndarray
    features: np.ndarray
    intercept: float
    gradient: float = 0.0
    passes: int = 0


def _dense(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in FEATURES])


def fit(rows: DataFrame, min_texts: int = ngrams.MIN_TEXTS, least: float = logistic.GRADIENT, steps: int = logistic.NEWTON) -> BoxModel:
    """The model of inputs with label, with all n-grams that min_texts boxes hold, at the optimum.

    Both classes weigh the same; the penalty is half the squares of all coefficients but the intercept, beside the sum of
    weighted losses. It ends where no entry of the mean loss's gradient is larger than `least`. Rows are written once as
    sparse blocks, which every pass reads; lost tasks are run again. Blocks are of so many characters, and few go together.
    """
    held = saved(rows.select("chars", "label", *FEATURES), "labelled")
    n, positive = held.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 1)).first()
    if not n:
        raise ValueError("no labelled boxes")
    with arrow_rows(held.sparkSession, ngrams.TEXTS):
        words = ngrams.vocabulary(held, "chars", min_texts)
    sent = held.sparkSession.sparkContext.broadcast((words.alphabet, words.codes, words.idf()))
    share = {1: n / (2 * max(1, positive)), 0: n / (2 * max(1, n - positive))}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, codes, idf = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for low, high in ngrams.pieces(texts):
                b = batch.slice(low, high - low)
                y = (b.column(1).to_numpy(zero_copy_only=False) == 1).astype(float)
                found = ngrams.vectors(texts[low:high], alphabet, codes, idf)
                yield logistic.block_batch([logistic.block_row(*found, _dense(b), y, np.where(y == 1, share[1], share[0]))])

    with arrow_rows(held.sparkSession, ngrams.TEXTS):
        made = saved(held.mapInArrow(blocks, logistic.BLOCK), "blocks", **WRITTEN)
    with arrow_rows(held.sparkSession, BLOCKS):
        problem = logistic.Problem(made, words.idf(), len(FEATURES))
        c, norm = logistic.minimise(problem, least, steps)
    k = len(words.codes)
    return BoxModel(words, c[:k], c[k:-1], float(c[-1]), norm, problem.passes)


def predict(model: BoxModel, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds pred_prob and pred_label; an empty table keeps both columns."""
    w = model.words
    sent = rows.sparkSession.sparkContext.broadcast((w.alphabet, w.codes, w.idf(), model.weights, model.features, model.intercept))
    kept = [c for c in ("image_id", "box_id", "text", "label", "split") if c in rows.columns]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, codes, idf, weights, features, intercept = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("chars")).to_pylist()]
            for low, high in ngrams.pieces(texts):
                b = batch.slice(low, high - low)
                starts, ids, n, scale = ngrams.vectors(texts[low:high], alphabet, codes, idf)
                total = np.concatenate([[0.0], np.cumsum(n * (weights * idf)[ids])])
                margin = (total[starts[1:]] - total[starts[:-1]]) * scale + _dense(b) @ features + intercept
                prob = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], pa.array(prob), pa.array((prob >= threshold).astype(np.int32))], [*kept, "pred_prob", "pred_label"])

    out = rows.select(*kept, "chars", *FEATURES).mapInArrow(work, f"{fields}, pred_prob double, pred_label int")
    front = [c for c in ("image_id", "box_id", "text") if c in kept]
    return out.select(*front, "pred_prob", "pred_label", *[c for c in kept if c not in front])


def report(rows: DataFrame, label: str = "label", pred: str = "pred_label") -> DataFrame:
    """Per class 0 and 1: support, precision, recall, F1 of 0/1 predictions (0 where there is nothing to divide by)."""
    t, p = F.col(label), F.col(pred)
    sums = rows.agg(*[F.count_if((t == a) & (p == b)).alias(f"_{a}{b}") for a in (0, 1) for b in (0, 1)])
    one = lambda c: F.struct(F.lit(c).alias("class"), F.col(f"_{c}{c}").alias("hit"), (F.col(f"_{c}0") + F.col(f"_{c}1")).alias("support"), (F.col(f"_0{c}") + F.col(f"_1{c}")).alias("told"))
    out = sums.select(F.explode(F.array(one(0), one(1))).alias("r")).select("r.*")
    precision = F.when(F.col("told") > 0, F.col("hit") / F.col("told")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(F.lit(0.0))
    both = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return out.select("class", "support", precision.alias("precision"), recall.alias("recall"), both.alias("f1"))


def save(spark: SparkSession, model: BoxModel, threshold: float, path: str) -> None:
    """The bundle: a table of n-grams with their counts and weights, and what is small as JSON."""
    w = model.words
    terms = pa.table({"code": w.codes, "texts": w.held, "weight": model.weights})
    spark.createDataFrame(terms).write.mode("overwrite").parquet(f"{path}/terms")
    meta = {"texts": w.texts, "alphabet": "".join(map(chr, w.alphabet)), "weights": dict(zip(FEATURES, model.features.tolist())), "intercept": model.intercept, "threshold": threshold, "features": list(FEATURES)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[BoxModel, float]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if missing := {"texts", "alphabet", "weights", "intercept", "threshold", "features"} - set(meta):
        raise ValueError(f"model bundle lacks {sorted(missing)}")
    terms = spark.read.parquet(f"{path}/terms").orderBy("code").toArrow()
    words = ngrams.Vocabulary(meta["texts"], np.array([ord(c) for c in meta["alphabet"]], np.uint32), terms["code"].to_numpy(), terms["texts"].to_numpy())
    return BoxModel(words, terms["weight"].to_numpy(), np.array([meta["weights"][f] for f in FEATURES]), meta["intercept"]), meta["threshold"]
