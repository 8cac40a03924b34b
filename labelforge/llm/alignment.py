"""Alignment of the tokens of two tokenizers by the bytes they cover, in DuckDB on each Arrow batch.

Texts are taken apart into stretches whose ends are ends of tokens in both tokenizers (see stretches). Token interval
tables hold each distinct stretch of a batch once; what is found in it counts for all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .stretches import batches, bpe_encode, byte_table, cut, flattened, lasting
from .tokens import _Known, spread

#: Rows of an Arrow batch between Spark and Python, which holds whole texts or all links of them.
ARROW_ROWS = 1000
#: Links whose counts are looked up at once.
SCORED_LINKS = 1 << 18
#: A batch's text; distinct pairs whose counts a task holds before it gives them out; pairs that are broadcast at most.
BATCH_BYTES = 1 << 20
HELD_PAIRS = 1 << 20
SENT_PAIRS = 2_000_000
#: Distinct stretches that each side keeps, at most, and the memory of DuckDB in a task.
KEPT = 250_000
MEMORY = "200MB"
SPACE = "▁"

#: Intervals of tokens lie one behind the other over all distinct stretches of a batch, so one order serves all joins.
#: met: the token of b that holds the last byte of each token of a; where both end there, a group ends.
#: own, other: tokens with their group. Groups of b's tokens come from the last cut before them.
GROUPS = """
CREATE OR REPLACE TEMP TABLE met AS
  SELECT a.s, a.i, a.start, a.stop, a.id AS a, b.id AS b, b.stop = a.stop AS cut, b.stop = a.stop AND b.start = a.start AS same FROM a ASOF JOIN b ON a.stop > b.start;
CREATE OR REPLACE TEMP TABLE own AS
  SELECT *, (count_if(cut) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cut::INT)::BIGINT AS g FROM met;
CREATE OR REPLACE TEMP TABLE other AS
  SELECT b.s, b.i, b.start, b.stop, b.id, coalesce(c.g + 1, 0) AS g FROM b ASOF LEFT JOIN (SELECT stop, g FROM own WHERE cut) c ON b.start >= c.stop;
DROP TABLE met;
"""
TOKENS = "SELECT s, g, side, id FROM (SELECT s, g, 0 AS side, i, a AS id FROM own UNION ALL SELECT s, g, 1, i, id FROM other) ORDER BY g, side, i"
LINKS = "SELECT s, a::BIGINT * $size + b AS pair, same FROM own WHERE cut ORDER BY i"
#: Tokens that cover the same bytes are a group by themselves; only the others can overlap in part.
OVERLAPS = """
SELECT x.s, count(*) AS n FROM (SELECT s, start, stop FROM own WHERE NOT same) x
JOIN (SELECT start, stop FROM other WHERE g IN (SELECT g FROM own WHERE NOT same)) y ON x.start < y.stop AND y.start < x.stop GROUP BY x.s
"""
COUNTS = "SELECT pair, sum(c)::BIGINT AS n FROM (SELECT s, count(*) AS c FROM used GROUP BY s) JOIN links USING (s) GROUP BY pair"

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups string, pairs array<{pair}>, counts array<long>"


class Side:
    """Token ids of stretches by one tokenizer; a stretch whose tokens' bytes are not its own has none."""

    def __init__(self, encode, bytes_of: list[bytes], spaced: bool) -> None:
        self._encode, self._spaced = encode, spaced
        self.sizes = np.array([len(b) for b in bytes_of], np.int64)
        self._bytes, self._starts = np.frombuffer(b"".join(bytes_of), np.uint8), (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self._known = _Known(self._checked, KEPT)

    def _checked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spaced = [f" {w}" for w in words]
        flat, lens = self._encode(spaced if self._spaced else words)
        whole = [w.encode() for w in spaced]
        size = np.fromiter(map(len, whole), np.int64, len(whole))
        ends = np.concatenate([[0], np.cumsum(lens)])
        good = np.diff(np.concatenate([[0], np.cumsum(self.sizes[flat])])[ends]) == size
        ids = flat[np.repeat(good, lens)]
        made = spread(self._bytes, self._starts[ids], self.sizes[ids].astype(np.int32))[0]
        given = np.frombuffer(b"".join([w for w, g in zip(whole, good.tolist()) if g]), np.uint8)
        kept = np.flatnonzero(good)
        good[np.repeat(kept, size[kept])[made != given]] = False
        return flat[np.repeat(good, lens)], np.where(good, lens, 0).astype(np.int32)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self._known.rows(words)
        lens = self._known.lens[rows]
        return spread(self._known.ids, self._known.starts[rows], lens)[0], lens


def sides(tokenizer_json: str, model: bytes) -> tuple[Side, Side]:
    import json

    import sentencepiece

    entries, decoded = json.loads(tokenizer_json)["model"]["vocab"], byte_table()
    of_a = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        of_a[i] = bytes(decoded[c] for c in entry) if all(c in decoded for c in entry) else entry.encode()
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    of_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(pieces.id_to_piece, range(pieces.get_piece_size())))]
    return Side(bpe_encode(tokenizer_json, plain=True), of_a, True), Side(lambda texts: flattened(pieces.encode(texts, num_threads=1)), of_b, False)


def intervals(ids: np.ndarray, lens: np.ndarray, sizes: np.ndarray, stretches: np.ndarray) -> pa.Table:
    """Tokens with their stretch, place and bytes. Arrow's strings, and so the bytes of a batch, end below 2 GB."""
    stop = np.cumsum(sizes[ids])
    columns = {"s": np.repeat(stretches, lens), "i": np.arange(len(ids)), "id": ids, "start": stop - sizes[ids], "stop": stop}
    return pa.table({k: v.astype(np.int32) for k, v in columns.items()})


class Aligner:
    """One task's DuckDB and the two tokenizers."""

    def __init__(self, tokenizer_json: str, model: bytes) -> None:
        self._a, self._b = sides(tokenizer_json, model)
        self.size = len(self._b.sizes)

    def align(self, con, texts: pa.Array, digest: bool) -> tuple[list[pa.Array], pa.Table]:
        """Columns of the batch's documents from n_a to pairs, and its pairs with their numbers of links."""
        words, edges = cut(texts)
        coded = pc.dictionary_encode(words)
        distinct, at = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
        (a, lens_a), (b, lens_b) = self._a.of(distinct), self._b.of(distinct)
        fit = (lens_a > 0) & (lens_b > 0)
        # A document with a stretch that has no tokens has none at all.
        whole = np.add.reduceat(~fit[at], edges[:-1]) == 0 if len(texts) else np.zeros(0, bool)
        runs = np.where(whole, np.diff(edges), 0)
        at = at[np.repeat(whole, np.diff(edges))]
        edges = np.concatenate([[0], np.cumsum(runs)])
        places = np.flatnonzero(fit).astype(np.int32)
        con.register("a", intervals(a[np.repeat(fit, lens_a)], lens_a[fit], self._a.sizes, places))
        con.register("b", intervals(b[np.repeat(fit, lens_b)], lens_b[fit], self._b.sizes, places))
        con.register("used", pa.table({"s": at}))
        con.execute(GROUPS)
        links = con.sql(LINKS.replace("$size", str(self.size))).to_arrow_table()
        con.register("links", links)
        n = len(distinct)
        n_links = np.bincount(links["s"].to_numpy(), minlength=n)
        crossed = con.sql(OVERLAPS).to_arrow_table()
        n_overlaps = np.bincount(links["s"].to_numpy()[links["same"].to_numpy()], minlength=n)
        n_overlaps[crossed["s"].to_numpy()] += crossed["n"].to_numpy()
        shown = grouped(con.sql(TOKENS).to_arrow_table(), n)
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), shown.take(pa.array(at))), ";")
        if digest:
            groups = pa.array([hashlib.sha256(g.as_buffer()).hexdigest() if w else "" for g, w in zip(groups, whole.tolist())], pa.string())
        totals = [np.diff(np.concatenate([[0], np.cumsum(v[at], dtype=np.int64)])[edges]) for v in (lens_a, lens_b, n_links, n_links, n_overlaps)]
        starts = np.cumsum(n_links) - n_links
        pairs, ends = spread(links["pair"].to_numpy(), starts[at].astype(np.int32), n_links[at].astype(np.int32))
        offsets = np.concatenate([np.zeros(1, np.int32), ends])[edges]
        return [*map(pa.array, totals), groups, pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs))], con.sql(COUNTS).to_arrow_table()


def grouped(tokens: pa.Table, n: int) -> pa.Array:
    """For each of n stretches `a1,a2|b1;a3|b2,b3` from its tokens in that order."""
    s, g, side = (tokens[c].to_numpy() for c in ("s", "g", "side"))
    marks = np.full(len(s), 3, np.int8)
    if len(s):
        marks[1:][side[1:] != side[:-1]] = 2
        marks[1:][g[1:] != g[:-1]] = 1
        marks[1:][s[1:] != s[:-1]] = 0
        marks[0] = 0
    ids = tokens["id"].combine_chunks()
    parts = pc.binary_join_element_wise(pa.array(["", ";", "|", ","]).take(pa.array(marks)), ids.cast(pa.string()), "")
    ends = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), parts), "")


def connection():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False, "temp_directory": ""})


def merged(counted: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counted).group_by("pair").aggregate([("n", "sum")]).rename_columns(["pair", "n"])


def aligned(docs: DataFrame, tokenizer_path: str, model_path: str, digest: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored table: a row per document with n_a, n_b, n_groups, n_links, n_overlaps, groups and pairs, and rows of pair counts.

    groups is `a1,a2|b1;a3|b2,b3`, or its SHA-256 with digest. pairs holds a code a * (number of b's ids) + b for each
    link. n_overlaps counts the pairs of tokens that share a byte. Rows of pair counts have counts, one for each of
    their pairs, and no n_a: what one task has seen. Documents without tokens (null or empty text, or bytes that differ
    from the text's) have zeros and ''. Null doc_id and equal rows stay. Empty table: no rows. A stretch of text without
    single spaces is encoded as a whole, however long.
    """
    with open(tokenizer_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        known = f.read(), g.read()
    digest_of = hashlib.sha256(known[0].encode() + known[1]).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(known)
    import json

    import sentencepiece

    most = (max(json.loads(known[0])["model"]["vocab"].values()) + 1) * sentencepiece.SentencePieceProcessor(model_proto=known[1]).get_piece_size()
    kind = ("int", pa.int32()) if most < 1 << 31 else ("long", pa.int64())
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, con, held = lasting(f"alignment {digest_of}", lambda: Aligner(*sent.value)), connection(), []
        schema = pa.schema([(n, pa.string() if n == "groups" else pa.list_(kind[1] if n == "pairs" else pa.int64()) if n in ("pairs", "counts") else pa.int64()) for n in names])

        def counts() -> pa.RecordBatch:
            t = held[0]
            one = [None] * 6 + [None]
            lists = [pa.array([t["pair"].to_pylist()], schema.field("pairs").type), pa.array([t["n"].to_pylist()], schema.field("counts").type)]
            return pa.RecordBatch.from_arrays([*[pa.array([x], schema.types[k]) for k, x in enumerate(one)], *lists], schema=schema)

        for batch in source:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for low, high in batches(sizes, BATCH_BYTES):
                some = batch.slice(low, high - low)
                columns, counted = aligner.align(con, some.column(1), digest)
                columns = [some.column(0), *columns, pa.nulls(high - low, schema.field("counts").type)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)
                pa.default_memory_pool().release_unused()
                held = [merged([*held, counted])]
                if len(held[0]) >= HELD_PAIRS:
                    yield counts()
                    held = []
        con.close()
        pa.default_memory_pool().release_unused()
        if held and len(held[0]):
            yield counts()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with common.arrow_rows(docs.sparkSession, ARROW_ROWS):
        return common.saved(rows.mapInArrow(work, ALIGNED.format(pair=kind[0])), "aligned")


def pair_counts(made: DataFrame) -> DataFrame:
    """pair, n (links corpus-wide) and best (whether n is the highest of its b id), from the parts of all tasks.

    Only pairs are ranked within a b id: at most as many rows as there are a ids.
    """
    parts = made.filter("counts is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").cast("long").alias("pair"), F.col("x.counts").alias("n"))
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame, size: int) -> DataFrame:
    top = counts.groupBy((F.col("pair") % size).alias("b")).agg(F.max("n").alias("top"))
    return counts.withColumn("b", F.col("pair") % size).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def scored(made: DataFrame, size: int, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """Adds n_best and count_sum to the documents of an aligned table.

    Up to sent_pairs distinct pairs go to the tasks as sorted arrays; beyond that documents' pairs meet their counts in a shuffle.
    """
    spark, docs = made.sparkSession, made.filter("n_a is not null").drop("counts")
    counts = common.saved(with_best(pair_counts(made), size), "pairs")
    if counts.count() > sent_pairs:
        x = F.monotonically_increasing_id()
        keyed = common.saved(docs.withColumn("_row", x), "keyed")
        links = keyed.select("_row", F.explode("pairs").alias("pair")).groupBy("_row", "pair").count()
        sums = links.join(counts, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("count")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("n")).alias("count_sum"))
        return keyed.join(sums, "_row", "left").drop("_row", "pairs").fillna(0, ["n_best", "count_sum"])
    got = counts.orderBy("pair").toArrow()
    # Arrays, no objects of this package: broadcasts name classes by their module.
    sent = spark.sparkContext.broadcast(tuple(got[c].to_numpy() for c in ("pair", "n", "best")))
    kept = [c for c in docs.columns if c != "pairs"]

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        lasting("scored", lambda: None)  # the tokenizers and what they know are done with
        for batch in source:
            lists = batch.column(len(kept))
            links, edges = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = [np.zeros(len(lists), np.int64) for _ in range(2)]
            for low, high in batches(np.diff(edges), SCORED_LINKS):
                at, some = np.searchsorted(pairs, links[edges[low] : edges[high]]), edges[low : high + 1] - edges[low]
                for told, v in zip(sums, (best, n)):
                    told[low:high] = np.diff(np.concatenate([[0], np.cumsum(v[at], dtype=np.int64)])[some])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *map(pa.array, sums)], [*kept, "n_best", "count_sum"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    with common.arrow_rows(spark, ARROW_ROWS):
        return common.saved(docs.select(*kept, "pairs").mapInArrow(work, f"{fields}, n_best long, count_sum long"), "scored")


def align(docs: DataFrame, tokenizer_path: str, model_path: str, digest: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups, n_best, count_sum (see aligned and scored)."""
    import sentencepiece

    made = aligned(docs, tokenizer_path, model_path, digest, doc_id, text)
    return scored(made, sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size())
