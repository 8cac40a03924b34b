"""Benchmark decontamination on a positional inverted index, in DataFrame functions alone.

Postings are made and stored for the terms that decide: of each window of test words the term that is
rarest in the training texts. A posting carries its document's following and preceding words by position,
so the other terms' offset-adjusted positions are met at once: the window occurs where all agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved

#: Words of the contract before A-Z are lowered: digits, letters and everything beyond ASCII. Java asks a negated union of
#: ranges several times for each character; these two classes take a few steps.
WORDS = r"[\p{Alnum}[^\p{ASCII}]]+"
WINDOW = 13
#: Test terms or windows sent to all executors, at most; beyond it they are joined by shuffling.
SENT_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_ROWS else df


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a key of the text (rows that repeat an id with another text stay apart), whole words."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), words_of(F.col(text)).alias("words"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms (column term) occurs in all training texts; absent terms have no row."""
    rows = docs.select(F.explode(words_of(F.col("text"))).alias("word")).select(ascii_lower(F.col("word")).alias("_term"))
    return rows.join(_sent(terms, terms.count()), F.col("_term") == F.col("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame, rows: int, reach: int = WINDOW - 1) -> DataFrame:
    """The stored positional index for the given terms: doc_id, key, term, pos (from 0), around.

    around holds the document's words from `reach` before pos (or its first) to `reach` after.
    """
    at = keyed(docs).select("doc_id", "key", "words", F.posexplode_outer("words").alias("pos", "_word"))
    at = at.withColumn("_word", ascii_lower(F.col("_word")))
    met = at.join(_sent(terms.select("term"), rows), F.col("_word") == F.col("term"))
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    return saved(met.select("doc_id", "key", "term", "pos", F.slice("words", first + 1, F.col("pos") - first + reach + 1).alias("around")), "postings")


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """Distinct windows (n, phrase, items): `length` consecutive words, or a shorter item as a whole."""
    words = items.select(F.col("item_id").cast("string").alias("item"), F.transform(words_of(F.col("text")), ascii_lower).alias("words")).filter("size(words) > 0")
    last = F.greatest(F.size("words") - length, F.lit(0))
    cut = words.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, length))).alias("words"))
    return cut.groupBy(F.concat_ws(" ", "words").alias("phrase")).agg(F.first(F.size("words")).alias("n"), F.collect_set("item").alias("items"))


def phrase_hits(docs: DataFrame, phrases: DataFrame, length: int = WINDOW) -> DataFrame:
    """Exact occurrences of phrases (phrase, n <= length, items): per doc_id and key, hits of (start, n, items).

    Every phrase is looked up from its rarest term in the training texts. Phrases with a term that never
    occurs are out at once.
    """
    phrases = saved(phrases, "phrases")
    parts = phrases.select("phrase", "n", F.posexplode(F.split("phrase", " ")).alias("offset", "word"))
    counts = saved(term_counts(docs, parts.select(F.col("word").alias("term")).distinct()), "terms")
    rare = (
        parts.join(counts.withColumnRenamed("n", "times"), F.col("word") == F.col("term"))
        .groupBy(F.col("phrase").alias("_phrase"))
        .agg(F.min(F.struct("times", "term", "offset")).alias("least"), F.count(F.lit(1)).alias("met"))
    )
    anchored = phrases.join(rare, F.col("phrase") == F.col("_phrase")).filter("met = n")
    anchors = saved(
        anchored.groupBy(F.col("least.term").alias("term")).agg(F.collect_list(F.struct(F.col("least.offset").alias("offset"), "n", "phrase", "items")).alias("wanted")),
        "anchors",
    )
    many = anchors.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]

    at = F.least("pos", F.lit(length - 1))  # the place of the posting's term in around

    def occurs(w: Column) -> Column:
        here = F.transform(F.slice("around", at - w["offset"] + 1, w["n"]), ascii_lower)
        return F.when(at >= w["offset"], F.concat_ws(" ", here) == w["phrase"]).otherwise(F.lit(False))

    met = F.transform(F.filter("wanted", occurs), lambda w: F.struct((F.col("pos") - w["offset"]).cast("long").alias("start"), w["n"].cast("long").alias("n"), w["items"].alias("items")))
    index = postings(docs, anchors, many, length - 1)
    listed = _sent(anchors.withColumnRenamed("term", "_term"), many)
    found = index.join(listed, F.col("term") == F.col("_term")).select("doc_id", "key", met.alias("hits"))
    return found.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("hits")).alias("hits")).filter("size(hits) > 0")


def within(docs: DataFrame, terms: list[str], width: int) -> DataFrame:
    """Proximity matches: doc_id, key, start, stop of stretches of at most width words with all the terms.

    Stretches are the least ones that end at each occurrence of a term. Terms are given in lower case.
    """
    names = list(dict.fromkeys(terms))
    wanted = docs.sparkSession.createDataFrame([(t,) for t in names], "term string")
    no = F.array_position(F.array(*[F.lit(t) for t in names]), F.col("term")) - 1
    at = postings(docs, wanted, len(names), 0).select("doc_id", "key", no.alias("no"), "pos")
    lists = at.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("pos", "no"))).alias("met"))

    def back(x: Column) -> Column:
        def latest(k: int) -> Column:
            return F.array_max(F.transform(F.filter("met", lambda y: (y["no"] == k) & (y["pos"] <= x["pos"])), lambda y: y["pos"]))

        last = [latest(k) for k in range(len(names))]
        least = F.array_min(F.array(*last))
        full = last[0].isNotNull()
        for c in last[1:]:
            full = full & c.isNotNull()
        return F.when(full, F.struct(least.alias("start"), x["pos"].alias("stop")))

    spans = lists.select("doc_id", "key", F.explode(F.array_compact(F.transform("met", back))).alias("s"))
    return spans.filter(F.col("s.stop") - F.col("s.start") < width).select("doc_id", "key", "s.start", "s.stop")


def report(docs: DataFrame, items: DataFrame, length: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the text's key.

    n_hit counts words inside any occurrence of a window. Null or wordless texts: no words, not
    contaminated. Null or wordless items have no windows. Rows that repeat id and text get equal results.
    """
    hits = phrase_hits(docs, windows(items, length), length)
    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["n"]).alias("stop")))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["stop"]).alias("end")),
        lambda a: a["n"],
    )
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    told = hits.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), covered.alias("n_hit"), names.alias("_items"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("n_words"))
    out = rows.join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("_items", F.array().cast("array<string>"))).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "key",
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns.

    Null texts stay. Rows that repeat go or stay alike. Without items, or of an empty table, all rows stay; further columns,
    whatever their names, pass through.
    """
    bad = saved(report(docs, items).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_key"]), "left_anti")
