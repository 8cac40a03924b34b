"""Document fingerprints of closed syncmers, in DataFrame functions alone.

A text is cut into tokens whose ends follow from the characters themselves: after an ASCII vowel or digit, after any
character beyond ASCII, and at white space. Of its k-mers of tokens those are chosen
whose least inner s-mer (by hash) is the first or the last: that depends on the k-mer alone, so equal passages choose
equal anchors wherever they stand, spaced or not. A fingerprint is the list of all anchors of the whole text in page
order, each hashed with its distance from the anchor before; likeness is the share of such placed anchors that both
have (Jaccard), so it tells texts with the same passages in another arrangement apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A token ends after one of these, or after RUN other characters (all of them in ASCII: narrow classes match fast).
ENDS = r"aeiouAEIOU0-9\x80-\x{10FFFF}"
OTHERS = r"\x00-\x08\x0E-\x1F!-/:-@B-DF-HJ-NP-TV-Z\x5B-\x60b-df-hj-np-tv-z\x7B-\x7F"
RUN = 8
TOKEN = rf"[{OTHERS}]{{0,{RUN - 1}}}+[{ENDS}]|[{OTHERS}]{{1,{RUN}}}"
K, S = 6, 2
#: Documents of a bucket of neighbours, about, and buckets at most (a bucket is sorted and read as a stream).
BUCKET_ROWS, BUCKETS = 256, 50_000
_INNER = K - S
#: From so many tokens on one k-mer at least is chosen: of any _INNER neighbours, the least s-mer ends or starts one.
SURE = K + _INNER - 1
#: Texts of fewer tokens have their tokens in the fingerprint besides the anchors.
SHORT = 3 * SURE


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def smer_hashes(tokens: Column) -> Column:
    """Hashes of the s-mers (S = 2) of an array of token hashes."""
    return F.transform(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(tokens, i + 1)))


def _closed(smers: Column, x: Column, i: Column) -> Column:
    return F.least(x, F.get(smers, i + _INNER)) <= F.least(*[F.get(smers, i + d) for d in range(1, _INNER)])


def _hash(smers: Column, x: Column, i: Column) -> Column:
    return F.xxhash64(x, *[F.get(smers, i + d) for d in range(S, _INNER + 1, S)])


def anchors(smers: Column) -> Column:
    """Closed syncmers with their places, for positional matching: array of (pos, hash)."""
    chosen = F.transform(smers, lambda x, i: F.when((i + _INNER < F.size(smers)) & _closed(smers, x, i), F.struct(i.alias("pos"), _hash(smers, x, i).alias("hash"))))
    return F.array_compact(chosen)


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the placed anchors of a text as 32-bit hashes, in page order; after them the tokens of a short text.

    Every text with a token has a fingerprint that is not empty; without a token it is.
    """
    tok, smer, at = f"_t_{name}", f"_s_{name}", f"_a_{name}"
    out = df.withColumn(tok, token_hashes(F.col(text))).withColumn(smer, smer_hashes(F.col(tok))).withColumn(at, anchors(F.col(smer)))
    gap = lambda x, i: x["pos"] - F.coalesce(F.get(at, i - 1)["pos"], x["pos"])
    placed = F.transform(at, lambda x, i: F.shiftrightunsigned(F.xxhash64(x["hash"], gap(x, i)), 32))
    tokens = F.transform(tok, lambda t: F.shiftrightunsigned(t, 32))
    whole = F.when(F.size(tok) < SHORT, F.concat(placed, tokens)).otherwise(placed)
    return out.withColumn(name, whole).drop(tok, smer, at)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; two empty fingerprints are alike, an empty and another one are not."""
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.hex(x)), "-")


def matches(a: DataFrame, b: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Positional matching: pairs of documents of a and b with the shift (in tokens) that most anchors share."""

    def side(df: DataFrame, c: str) -> DataFrame:
        df = df.select(F.col(doc_id).alias(f"id_{c}"), token_hashes(F.col(text)).alias("_t")).withColumn("_s", smer_hashes(F.col("_t")))
        return df.select(f"id_{c}", F.explode(anchors(F.col("_s"))).alias("_a")).select(f"id_{c}", F.col("_a.pos").alias(f"pos_{c}"), F.col("_a.hash").alias(f"hash_{c}"))

    met = side(a, "a").join(side(b, "b"), F.col("hash_a") == F.col("hash_b"))
    shifts = met.groupBy("id_a", "id_b", (F.col("pos_b") - F.col("pos_a")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    best = shifts.groupBy("id_a", "id_b").agg(F.max(F.struct("n", -F.col("shift"))).alias("m"))
    return best.select("id_a", "id_b", F.col("m.n").alias("n_anchors"), (-F.col("m.col2")).alias("shift"))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """The last bound that is not above key, found in a coarse and then in a fine array."""
    step = max(1, math.isqrt(len(bounds)))
    every = F.array(*[F.lit(b) for b in bounds[::step]])
    coarse = F.size(F.filter(every, lambda b: b <= key)) - 1
    if step == 1:
        return coarse
    fine = F.slice(F.array(*[F.lit(b) for b in bounds]), coarse * step + 1, step)
    return coarse * step + F.size(F.filter(fine, lambda b: b <= key)) - 1


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch and those of the next document by ascending doc_id; after the last, the first.

    Documents are dealt to buckets of neighbouring ids by bounds that are ids themselves; a bucket's first
    document is dealt to the bucket before as well (the very first to the last bucket), so each finds its
    follower in its bucket and texts are shuffled once. Null ids come first; equal ids by hash of the text. Buckets
    beyond BUCKETS grow instead of becoming more; rows of one id lie in one bucket.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_k"))
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_k"))
    n = keys.count()
    parts = max(1, min(BUCKETS, n // BUCKET_ROWS))
    low, cuts = keys.agg(F.min("_k"), F.percentile_approx("_k", [k / parts for k in range(1, parts)] or [0.5], F.lit(max(10_000, 10 * parts)))).first()
    bounds = sorted({low, *cuts}) if n and parts > 1 else [low if n else 0]
    rows = rows.withColumn("_b", _bucket(F.col("_k"), bounds).cast("int"))
    opens = F.col("_k") == F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("_b") + 1)
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("guest"), F.lit(0).alias("late"))
    guest = F.struct(F.when(F.col("_b") == 0, len(bounds) - 1).otherwise(F.col("_b") - 1).cast("int").alias("b"), F.lit(True).alias("guest"), (F.col("_b") == 0).cast("int").alias("late"))
    dealt = rows.select("doc_id", "text", "_k", F.explode(F.when(opens, F.array(own, guest)).otherwise(F.array(own))).alias("_d"))
    dealt = dealt.select("doc_id", "text", "_k", "_d.b", "_d.guest", "_d.late").repartition(F.col("b"))
    dealt = with_sketch(dealt, "text", "sketch")
    by_id = Window.partitionBy("b").orderBy("late", "_k", F.col("doc_id").isNotNull(), F.xxhash64("text"))
    out = dealt.withColumn("next_text", F.lead("text").over(by_id)).withColumn("next_sketch", F.lead("sketch").over(by_id))
    return out.filter("not guest").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def edited(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty. Equal texts have equal fingerprints. Rows that repeat an id follow each other by the
    hash of their texts, and equal rows give equal results up to the last one's follower. Columns other than doc_id
    and text are not read. Empty table: no rows.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    rows = with_sketch(rows, "_edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
