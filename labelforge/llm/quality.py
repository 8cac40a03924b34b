"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows used for fitting, those of the least xxhash64(doc_id); all rows are scored.
SAMPLE_ROWS = 20_000
#: Texts in an Arrow batch of the fit.
ARROW_ROWS = 1_000
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "mean_word", "long_words", "upper", "lower", "digit", "space", "newline", "stop_marks",
    "marks", "bars", "symbols", "non_ascii", "distinct_words", "top_word", "repeats", "upper_words", "marked_words",
    "bare_marks", "dup_lines", "line_words", "digit_words", "top_mark", "byte_entropy", "word_entropy", "pair_repeats",
)


def statistics(text: str | None) -> list[float]:
    """FEATURES of a whole text; null counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    hist = np.bincount(raw, minlength=256)
    words = text.split()
    nw = max(1, len(words))
    counts = Counter(words)
    top = np.fromiter(counts.values(), float, len(counts)) if counts else np.ones(1)
    share = top / top.sum()
    lines = [x for x in text.split("\n") if x]
    nl = max(1, len(lines))
    marks = np.r_[hist[33:48], hist[58:65], hist[91:97], hist[123:127]]
    p = hist[hist > 0] / n
    last = Counter(w[-1] for w in words)
    spoken = sum(v for c, v in last.items() if not c.isalnum() and c not in ".,;:")
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / nw, sum(v for w, v in counts.items() if len(w) > 14) / nw,
        hist[65:91].sum() / n, hist[97:123].sum() / n, hist[48:58].sum() / n, hist[32] / n, hist[10] / n,
        (hist[44] + hist[46]) / n, marks.sum() / n, hist[124] / n, (hist[35:39].sum() + hist[33] + hist[42]) / n,
        hist[128:].sum() / n, len(counts) / nw, top.max() / nw if counts else 0.0,
        sum(a == b for a, b in zip(words, words[1:])) / nw, sum(v for w, v in counts.items() if len(w) > 1 and w.isupper()) / nw,
        spoken / nw, sum(v for w, v in counts.items() if len(w) == 1 and not w.isalnum()) / nw, 1 - len(set(lines)) / nl if lines else 0.0,
        len(words) / nl, sum(v for w, v in counts.items() if w[0].isdigit()) / nw, marks.max() / n,
        -(p * np.log(p)).sum() if len(p) else 0.0, -(share * np.log(share)).sum() / np.log1p(nw), 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
    ]


@dataclass
class Forest:
    """Complete trees of one depth as flat arrays: node k of a tree has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2**depth
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """All trees go down a level at a time; leaves are added up in the order of the trees."""
        rows, trees, inner = np.arange(len(x))[:, None], np.arange(len(self.feature)), self.feature.shape[1]
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        leaves = np.concatenate([np.full((len(x), 1), self.base), self.value[trees, node - inner]], 1)
        return 1 / (1 + np.exp(-np.clip(leaves.cumsum(1)[:, -1], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, least: float = 2.0, ridge: float = 1.0) -> Forest:
    """Boosts logistic loss; splits are found on histograms of at most `bins` quantile bins per feature.

    least: least sum of hessians on each side of a split. Without rows or with one class the forest is
    empty and scores the share of label 1 (one half without rows).
    """
    prior = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base, inner = float(np.log(prior / (1 - prior))), 2**depth - 1
    empty = Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if len(y) == 0 or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    coded = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    width = bins
    raw = np.full(len(y), base)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut, threshold = np.zeros(inner, int), np.full(inner, width), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            for f in range(x.shape[1]):
                at = (node - first) * width + coded[:, f]
                gs = np.bincount(at, g, n * width).reshape(n, width).cumsum(1)
                hs = np.bincount(at, h, n * width).reshape(n, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(n), k] > best
                for m in np.flatnonzero(better):
                    best[m] = gain[m, k[m]]
                    feature[first + m], cut[first + m], threshold[first + m] = f, k[m], edges[f][k[m]]
            node = 2 * node + 1 + (coded[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        raw += value[leaf]
        out.append((feature, threshold, value))
    return Forest(*[np.stack(a) for a in zip(*out)], base)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Forest:
    """Fits on at most `rows` labelled documents that are not held out, by the documents' texts alone.

    Null labels and ids are left out; ids labelled more than once take the rounded mean.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    pairs = texts.join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).select("doc_id", "_text", "_label")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["_label"], "x": [statistics(t) for t in b["_text"]]})

    with common.arrow_rows(docs.sparkSession, ARROW_ROWS):
        got = pairs.mapInPandas(work, "doc_id long, label int, x array<double>").toPandas()
    got = got.assign(x=[tuple(v) for v in got["x"]]).sort_values(["doc_id", "x"], kind="stable")
    return fit(np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES)), got["label"].to_numpy(float))


def scored(docs: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """Adds the probability of label 1 for each whole text; null and empty texts are scored alike.

    Texts go to Python by the hundred, as Spark sends rows to a plain function: Arrow batches would hold a whole
    partition's texts in the executor and again in each worker, and their size is the session's when the result is written.
    """
    model = docs.sparkSession.sparkContext.broadcast((forest.feature, forest.threshold, forest.value, forest.base))

    @F.udf("double", useArrow=False)
    def score(text: str | None) -> float:
        return float(Forest(*model.value).score(np.array([statistics(text)], float))[0])

    return docs.withColumn(name, score(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Equal texts score alike; an empty table gives no rows."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with their columns.

    Null and empty texts are scored like all others; equal texts go or stay alike. Without labels all are scored one half
    and stay. An empty table stays empty; further columns, whatever their names, pass through.
    """
    name = common.free_name(docs, "_score")
    return scored(docs, train(docs, labels), name).filter(F.col(name) >= threshold).drop(name)
