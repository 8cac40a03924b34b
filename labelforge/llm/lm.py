"""Masked pseudo-likelihood: a bidirectional window network in numpy scores documents.

Words stand for one of a number of slots that grows with the square root of the corpus: the most frequent words of all
documents have their own, the rest share hashed ones. Each token is predicted from REACH tokens on either side,
itself masked:
    hidden = tanh(sum over offsets of position weight * embedding),
    P(word) = P(class of slot | hidden) * P(slot | class, hidden) * P(word | slot),
the last by the counts of all documents. A document's score is the sum of these conditional log-probabilities over
all its tokens.

Training sees every token of every document once. Documents are dealt by a hash of id and text to rounds and, in each,
to shards, whose number follows the tokens; a shard is gone through in the order of that hash. So the result does not
depend on how the table's files lie. Shards of a round start from the same parameters, which are averaged by tokens in
a tree of small groups, and the mean starts the next round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

WIDTH, REACH = 8, 2
#: Slots at least; of all slots this share are own ones, and so many times more words have a count of their own.
LEAST_SLOTS, OWN_SHARE, LISTED = 256, 0.625, 4
#: Rounds of training, the step, tokens in a step, and tokens of a shard in a round, about.
ROUNDS, STEP, BATCH, SHARD_TOKENS = 4, 0.5, 4096, 1_000_000
#: Parameter vectors that the driver averages at once, at most.
FEW = 64
PIECE_BYTES = 1 << 21
RARE = 8
#: Logits are cut at so much on either side.
LOGIT = 60.0
OFFSETS = tuple(d for d in range(-REACH, REACH + 1) if d)


@dataclass
class Vocabulary:
    """Slots and what the corpus's counts say of them."""

    classes: int
    members: int
    words: list[str]  # by count; the first `own` have slots of their own
    own: int
    tokens: int  # of all documents
    share: np.ndarray  # of all tokens, by slot
    listed: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log P(word | slot) of words
    other: np.ndarray = field(default_factory=lambda: np.zeros(0))  # the same of a word that is not listed, by slot

    @property
    def edge(self) -> int:
        """The slot beyond a document's ends."""
        return self.classes * self.members - 1

    @property
    def kind(self) -> str:
        """How a slot is stored: two bytes where that will do, else four."""
        return "<u2" if self.edge < 1 << 16 else "<u4"

    @property
    def width(self) -> int:
        return int(self.kind[-1])

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        c, m = self.classes, self.members
        return {"emb": (c * m, WIDTH), "pos": (len(OFFSETS), WIDTH), "bias": (WIDTH,), "cls": (c, WIDTH), "clsb": (c,), "out": (c, m, WIDTH), "outb": (c, m)}

    def plain(self, words: bool = False) -> tuple:
        """The fields: broadcasts name classes by their module, which executors need not have. The network needs no words."""
        none = np.zeros(0)
        return self.classes, self.members, self.words if words else [], self.own, self.tokens, self.share, self.listed if words else none, self.other if words else none

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[k] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def hashed(self, words) -> np.ndarray:
        """Slots of words without one of their own."""
        own = self.own
        return own + (pd.util.hash_array(np.asarray(words, object), categorize=False) % np.uint64(self.edge - own)).astype(np.int64)


def words_of(texts: pa.Array) -> pa.Array:
    """Each text's words, lower-cased, split at ASCII white space (with empty ones at the ends). Null: none."""
    return pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of PIECE_BYTES at most (or one longer text)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    low = 0
    while low < len(sizes):
        high, held = low + 1, int(sizes[low])
        while high < len(sizes) and held + sizes[high] <= PIECE_BYTES:
            held += int(sizes[high])
            high += 1
        yield low, high
        low = high


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all documents; counted per piece before anything is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in pieces(batch.column(0)):
                met = pc.value_counts(words_of(batch.column(0).slice(low, high - low)).flatten())
                yield pa.RecordBatch.from_arrays([met.field("values"), met.field("counts")], ["word", "n"])

    made = docs.select("text").mapInArrow(work, "word string, n long").filter("word <> ''")
    return saved(made.groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary(docs: DataFrame) -> Vocabulary:
    """From the counts of all documents. The driver gets as many words as the square root of the tokens, in proportion."""
    counts = word_counts(docs)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(int(math.log2(LEAST_SLOTS)), math.ceil(math.log2(max(1, total)) / 2) - 2)
    slots, own = 1 << bits, int(OWN_SHARE * (1 << bits))
    top = counts.orderBy(F.desc("n"), "word").limit(own * (1 + LISTED)).collect()
    out = Vocabulary(1 << bits // 2, 1 << bits - bits // 2, [r[0] for r in top], own, total, np.zeros(slots))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = out.hashed(batch.column(0).to_numpy(zero_copy_only=False))
            n = np.bincount(at, batch.column(1).to_numpy(), slots).astype(np.int64)
            words = np.bincount(at, minlength=slots).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(words)), pa.array(n[words > 0]), pa.array(words[words > 0])], ["slot", "n", "words"])

    # Words in hashed slots: all but the own ones.
    least = (top[own - 1][1], top[own - 1][0]) if len(top) >= own else (0, "")
    rest = counts.filter((F.col("n") < least[0]) | ((F.col("n") == least[0]) & (F.col("word") > least[1])))
    n, words = np.zeros(slots), np.zeros(slots)
    for r in rest.mapInArrow(work, "slot long, n long, words long").groupBy("slot").agg(F.sum("n"), F.sum("words")).collect():
        n[r[0]], words[r[0]] = r[1], r[2]
    seen = np.array([r[1] for r in top], float)
    n[: min(own, len(top))] = seen[:own]
    out.share = (n + 0.5) / (n + 0.5).sum()
    at = out.hashed(out.words[own:]) if len(top) > own else np.zeros(0, np.int64)
    # An unseen word counts half a token in its slot.
    listed_n, listed_w = np.bincount(at, seen[own:], slots), np.bincount(at, minlength=slots)
    out.listed = np.concatenate([np.zeros(min(own, len(top))), np.log(seen[own:] / (n[at] + 0.5))])
    out.other = np.log((n - listed_n + 0.5) / (n + 0.5) / np.maximum(1, words - listed_w))
    return out


def first_parameters(v: Vocabulary, seed: int = 7) -> np.ndarray:
    """Random embeddings; the output biases start at the slots' shares of all tokens, the output weights at 0."""
    rng = np.random.default_rng(seed)
    flat = rng.normal(0, 0.1, sum(int(np.prod(s)) for s in v.shapes.values())).astype(np.float32)
    p = v.unpack(flat)
    p["pos"][:] = 1
    p["bias"][:] = 0
    p["cls"][:] = 0
    p["out"][:] = 0
    by_class = v.share.reshape(v.classes, v.members)
    p["clsb"][:] = np.log(by_class.sum(1))
    p["outb"][:] = np.log(by_class / by_class.sum(1, keepdims=True))
    return flat


def slots(texts: pa.Array, v: Vocabulary, listed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens as slots, the number of each text's tokens, and the sum of log P(word | slot) over them."""
    parts = words_of(texts)
    coded = pc.dictionary_encode(parts.flatten())
    words = coded.dictionary
    at = pc.index_in(words, value_set=listed).fill_null(-1).to_numpy().astype(np.int64)
    slot, log = at.copy(), np.zeros(len(at))
    log[at >= 0] = v.listed[at[at >= 0]]
    rest = np.flatnonzero((at < 0) | (at >= v.own))
    if len(rest):
        slot[rest] = v.hashed(words.take(pa.array(rest)).to_numpy(zero_copy_only=False))
    log[at < 0] = v.other[slot[at < 0]]
    rows = coded.indices.to_numpy(zero_copy_only=False)
    full = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)[rows] if len(rows) else np.zeros(0, bool)
    edge = np.concatenate([[0], np.cumsum(full)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    sums = np.concatenate([[0.0], np.cumsum(log[rows[full]])])[edge]
    return slot[rows[full]], np.diff(edge), np.diff(sums)


def prepared(docs: DataFrame, v: Vocabulary, shards: int, rounds: int) -> DataFrame:
    """Per row: doc_id, turn, shard, place (a hash of id and text), n_tokens, inner (log P of words in slots), ids (v.kind)."""
    sent = docs.sparkSession.sparkContext.broadcast(v.plain(words=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*sent.value)
        listed = pa.array(v.words, pa.string())
        for batch in batches:
            for low, high in pieces(batch.column(2)):
                ids, sizes, inner = slots(batch.column(2).slice(low, high - low), v, listed)
                ends = np.cumsum(sizes) * v.width
                whole = ids.astype(v.kind).tobytes()
                held = [whole[low:high] for low, high in zip(ends - sizes * v.width, ends)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(low, high - low) for k in (0, 1)], pa.array(sizes.astype(np.int64)), pa.array(inner), pa.array(held, pa.binary())],
                    ["doc_id", "place", "n_tokens", "inner", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("place"), "text")
    made = rows.mapInArrow(work, "doc_id long, place long, n_tokens long, inner double, ids binary")
    turn, shard = F.pmod("place", F.lit(rounds)), F.pmod(F.shiftright("place", 16), F.lit(shards))
    return saved(made.withColumn("turn", turn.cast("int")).withColumn("shard", shard.cast("int")), "slots")


def stream_of(ids: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of documents with REACH edge slots before and after each, and where the tokens stand."""
    sizes = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // v.width
    flat = np.frombuffer(b"".join(ids.to_pylist()), v.kind)
    at = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)) * 2 * REACH + REACH, sizes)
    out = np.full(len(flat) + 2 * REACH * len(sizes), v.edge, np.int64)
    out[at] = flat
    return out, at


def forward(v: Vocabulary, p: dict[str, np.ndarray], stream: np.ndarray, at: np.ndarray):
    """Log-probabilities of the tokens at these places, in the order of their classes, and what the gradient needs."""
    cls, member = np.divmod(stream[at], v.members)
    order = np.argsort(cls.astype(np.int16) if v.classes < 1 << 15 else cls, kind="stable")
    at, cls, member = at[order], cls[order], member[order]
    cuts = np.searchsorted(cls, np.arange(v.classes + 1))
    near = stream[at + np.array(OFFSETS)[:, None]]
    seen = p["emb"][near]
    hidden = np.einsum("dnw,dw->nw", seen, p["pos"])
    hidden += p["bias"]
    np.tanh(hidden, out=hidden)
    a = hidden @ p["cls"].T
    a += p["clsb"]
    b = np.empty((len(at), v.members), np.float32)
    for c in np.flatnonzero(np.diff(cuts)):
        r = slice(cuts[c], cuts[c + 1])
        np.matmul(hidden[r], p["out"][c].T, out=b[r])
        b[r] += p["outb"][c]
    rows = np.arange(len(at))
    logs = a[rows, cls] + b[rows, member]
    # Weights are small: logits stay far from where exp overflows, LOGIT at most.
    np.clip(a, -LOGIT, LOGIT, out=a)
    np.clip(b, -LOGIT, LOGIT, out=b)
    np.exp(a, out=a)
    np.exp(b, out=b)
    sa, sb = a @ np.ones(v.classes, np.float32), b @ np.ones(v.members, np.float32)
    logs -= np.log(sa) + np.log(sb)
    return logs, order, (near, seen, hidden, cls, member, a, b, sa, sb, cuts)


def learn(v: Vocabulary, flat: np.ndarray, stream: np.ndarray, at: np.ndarray, step: float = STEP) -> None:
    """Stochastic gradient steps on the tokens at these places, in place."""
    p = v.unpack(flat)
    size = v.classes * v.members
    for low in range(0, len(at), BATCH):
        some = at[low : low + BATCH]
        _, _, (near, seen, hidden, cls, member, a, b, sa, sb, cuts) = forward(v, p, stream, some)
        rate, rows = np.float32(step / len(some)), np.arange(len(some))
        a /= sa[:, None]
        b /= sb[:, None]
        a[rows, cls] -= 1
        b[rows, member] -= 1
        back = a @ p["cls"]
        # Classes and slots see few of a step's tokens: their sums count up to RARE times, but never for more than their mean.
        by_class = np.float32(step) / np.maximum(np.diff(cuts), len(some) / RARE).astype(np.float32)
        by_slot = np.float32(step) / np.maximum(np.bincount(near.ravel(), minlength=size), len(some) / RARE).astype(np.float32)
        for c in np.flatnonzero(np.diff(cuts)):
            r = slice(cuts[c], cuts[c + 1])
            back[r] += b[r] @ p["out"][c]
            p["out"][c] -= by_class[c] * (b[r].T @ hidden[r])
        p["outb"] -= by_class[:, None] * np.add.reduceat(np.concatenate([b, np.zeros((1, v.members), np.float32)]), cuts[:-1]) * (np.diff(cuts) > 0)[:, None]
        p["cls"] -= rate * (a.T @ hidden)
        p["clsb"] -= rate * a.sum(0)
        back *= 1 - hidden * hidden
        p["bias"] -= rate * back.sum(0)
        for d in range(len(OFFSETS)):
            moved = back * p["pos"][d]
            p["pos"][d] -= rate * np.einsum("nw,nw->w", seen[d], back)
            for w in range(WIDTH):
                p["emb"][:, w] -= by_slot * np.bincount(near[d], moved[:, w], size).astype(np.float32)


def train(rows: DataFrame, v: Vocabulary, shards: int, rounds: int) -> np.ndarray:
    """Parameters after the rounds, from prepared rows: each token of each document is a target once."""
    sc, flat = rows.sparkSession.sparkContext, first_parameters(v)
    for turn in range(rounds):
        sent = sc.broadcast((v.plain(), flat))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plain, start = sent.value
            v = Vocabulary(*plain)
            shard, flat, n, held, size = None, start, 0, [], 0

            def take() -> None:
                nonlocal n, size
                if held:
                    stream, at = stream_of(pa.concat_arrays(held), v)
                    learn(v, flat, stream, at)
                    n, size = n + len(at), 0
                    held.clear()

            def told() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["part", "n", "flat"])

            for batch in batches:
                names = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(names)) + 1), len(names)]
                for low, high in zip(cuts, cuts[1:]):
                    if high > low and names[low] != shard:
                        if shard is not None:
                            take()
                            yield told()
                        shard, flat, n = int(names[low]), start.copy(), 0
                    # Steps are of the same tokens however rows come in batches: a step starts anew only every PIECE.
                    for k in range(low, high):
                        held.append(batch.column(1).slice(k, 1))
                        size += len(held[-1][0].as_py())
                        if size >= PIECE_BYTES:
                            take()
            if shard is not None:
                take()
                yield told()

        part = rows.filter(F.col("turn") == turn).select("shard", "ids", "place", "doc_id").repartition(shards, "shard").sortWithinPartitions("shard", "place", "doc_id", "ids")
        made = saved(part.select("shard", "ids").mapInArrow(work, "part long, n long, flat binary"), "parameters")
        many = made.count()
        while many > FEW:
            many = -(-many // FEW)
            made = saved(made.groupBy(F.pmod(F.col("part"), F.lit(many)).alias("part")).applyInPandas(_mean, "part long, n long, flat binary"), "parameters")
        got = made.orderBy("part").toPandas()
        if got["n"].sum():
            flat = np.frombuffer(_mean(got)["flat"][0], np.float32).copy()
        sent.unpersist()
    return flat


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")
    total = np.zeros(len(pdf["flat"].iloc[0]) // 4)
    for n, flat in zip(pdf["n"], pdf["flat"]):
        total += n * np.frombuffer(flat, np.float32).astype(float)
    n = int(pdf["n"].sum())
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "n": [n], "flat": [(total / max(1, n)).astype(np.float32).tobytes()]})


def scores(rows: DataFrame, v: Vocabulary, flat: np.ndarray) -> DataFrame:
    """Per prepared row: doc_id, n_tokens, log_prob (their sum), mean_log_prob, perplexity."""
    sent = rows.sparkSession.sparkContext.broadcast((v.plain(), flat))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, flat = sent.value
        v = Vocabulary(*plain)
        p = v.unpack(flat)
        for batch in batches:
            for low, high in pieces(batch.column(3)):
                ids = batch.column(3).slice(low, high - low)
                stream, at = stream_of(ids, v)
                logs = np.zeros(len(at))
                for k in range(0, len(at), BATCH):
                    found, order, _ = forward(v, p, stream, at[k : k + BATCH])
                    logs[k + order] = found
                sizes = batch.column(1).slice(low, high - low).to_numpy()
                sums = np.diff(np.concatenate([[0.0], np.cumsum(logs)])[np.concatenate([[0], np.cumsum(sizes)])])
                sums = sums + batch.column(2).slice(low, high - low).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sizes), pa.array(sums)], ["doc_id", "n_tokens", "log_prob"])

    out = rows.select("doc_id", "n_tokens", "inner", "ids").mapInArrow(work, "doc_id long, n_tokens long, log_prob double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return out.withColumn("mean_log_prob", mean).withColumn("perplexity", F.exp(-F.col("mean_log_prob")))


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, n_tokens, log_prob, mean_log_prob, perplexity of a model trained on all these documents.

    Null text counts as empty: no tokens, log_prob 0, the last two null. Equal texts have equal scores up to rounding.
    Rows that repeat are learned from and scored each for itself. Words of equal count are taken in their own order.
    Columns other than doc_id and text are not read; an empty table gives no rows.
    """
    v = vocabulary(docs)
    shards = max(1, round(v.tokens / rounds / SHARD_TOKENS))
    rows = prepared(docs, v, shards, rounds)
    return scores(rows, v, train(rows, v, shards, rounds))
