"""MinHash near-duplicate classes with sequential Bayesian verification.

1. Each document's distinct shingles, signature and a 128-bit digest of its set (one pass, narrow rows).
2. Equal sets are one class; the class's least doc_id stands for it in all that follows.
3. Signatures are cut into bands. A bucket is what representatives share a band with.
4. What no text of a bucket shares with any other candidate cannot be common: texts and pairs that cannot reach the
   limit with what is left are out, exactly.
5. Hub rounds. In each bucket that still holds several components one hub (the member with the fewest shingles of
   its own that no hub of the bucket is linked with yet) is compared with all others. Pairs are pruned by the
   posterior of their likeness after each batch of hashes, survivors are confirmed on full sets, and confirmed links
   merge components. A group of copies so costs one pair per member.
6. What is left meets over its rarest shared shingles. In one order of all shingles, the rarest first, what two sets have
   from their first common one on bounds their intersection, so what a whole template shares makes no pair. With i shingles
   in common with the hub and s shared with anyone, two members have at most min(i, i') + min(s - i, s' - i') in common.
   Pairs of different components that share a band and that both bounds allow are compared.
7. Links are contracted by alternating large and small stars, in tables, never on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import arrow_rows, saved

BANDS, ROWS = 24, 5
#: Hashes compared before each test of the posterior, and the chance that a test drops a true link.
BATCH, MISS = 24, 1e-7
#: Rounds with one hub a bucket, before what is left meets over its rarest shingles.
HUB_ROUNDS = 2
#: Ids sent to all executors to pick out texts, at most; beyond it the texts are joined by shuffling.
SENT_IDS = 500_000
#: Rows (two texts each at most) in an Arrow batch while the pipeline's documents are compared.
ARROW_ROWS = 1_000
PIECE_BYTES = 1 << 20


def least_matches(percent: int, batch: int = BATCH, miss: float = MISS) -> dict[int, int]:
    """After n compared hashes, the fewest matches that leave P(likeness >= percent) at miss or more.

    The prior is uniform: the posterior is Beta(m + 1, n - m + 1), whose upper tail from t is the chance
    that a binomial of n + 1 trials at t gives m or fewer.
    """
    t, out = percent / 100, {}
    for n in range(batch, shingles.HASHES + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (two longs) and signature (null if the set is empty)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            low = 0
            while low < len(sizes):
                high, held = low + 1, int(sizes[low])
                while high < len(sizes) and held + sizes[high] <= PIECE_BYTES:
                    held += int(sizes[high])
                    high += 1
                found = shingles.sets(batch.column(1).slice(low, high - low))
                signed = iter(shingles.signatures([s for s in found if len(s)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array(np.array([s.sum(dtype=np.uint64) for s in found], np.uint64).view(np.int64)),
                        pa.array(np.array([np.bitwise_xor.reduce(shingles.mixed(s * np.uint64(0x9E3779B97F4A7C15))) if len(s) else 0 for s in found], np.uint64).view(np.int64)),
                        pa.array([next(signed).tobytes() if len(s) else None for s in found], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "s1", "s2", "sig"],
                )
                low = high

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(rows.mapInArrow(work, "doc_id long, n_shingles long, s1 long, s2 long, sig binary"), "profiles")


def _plausible(percent: int):
    floors = least_matches(percent)

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(-1, shingles.HASHES) for s in (a, b))
        left, matches, low = np.arange(len(x)), np.zeros(len(x), int), 0
        for n, floor in floors.items():
            matches[left] += (x[left, low:n] == y[left, low:n]).sum(1)
            left, low = left[matches[left] >= floor], n
        out = np.zeros(len(x), bool)
        out[left] = True
        return pd.Series(out)

    return test


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) to (a, b, i, n, m): the sizes of the intersection and of both full sets."""
    for batch in batches:
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        found, b = [], batch.column(1).to_pylist()
        for k in range(len(b)):
            if held[0] != b[k]:
                held = (b[k], shingles.sets(batch.column(3).slice(k, 1))[0])
            own = shingles.sets(batch.column(2).slice(k, 1))[0]
            found.append((len(np.intersect1d(own, held[1], assume_unique=True)), len(own), len(held[1])))
        sizes = np.array(found, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(sizes[:, k]) for k in range(3)]], ["a", "b", "i", "n", "m"])


def shingle_rows(texts: DataFrame) -> DataFrame:
    """rep, shingle: the distinct shingles of each of the texts (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            low = 0
            while low < len(sizes):
                high, held = low + 1, int(sizes[low])
                while high < len(sizes) and held + sizes[high] <= PIECE_BYTES:
                    held += int(sizes[high])
                    high += 1
                found = shingles.sets(batch.column(1).slice(low, high - low))
                ids = np.repeat(batch.column(0).slice(low, high - low).to_numpy(), [len(s) for s in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found).view(np.int64))], ["rep", "shingle"])
                low = high

    return texts.select("doc_id", "text").mapInArrow(work, "rep long, shingle long")


def unshared(texts: DataFrame) -> DataFrame:
    """rep, own: how many of a text's shingles no other of these texts (doc_id, text) has."""
    met = shingle_rows(texts).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep"))
    return met.filter("n = 1").groupBy(F.col("rep").alias("_rep")).agg(F.count(F.lit(1)).alias("own"))


def prefixes(reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """rep, comp, n, single, shingle, place, shared: the rarest of the shingles that each of reps has in common with another.

    They are in one order for all, by the number of reps that have them and then by hash; shared is how many a rep has, place
    counts them from 1. To be alike enough a set of n needs t * n in common with another, so the first shared - t * n + 1 will
    do; of ids that stand for several texts all do.
    """
    rows = saved(shingle_rows(texts.join(reps.select(F.col("rep").alias("_rep")), F.col("doc_id") == F.col("_rep"), "left_semi")).distinct(), "left_shingles")
    held = rows.groupBy(F.col("shingle").alias("_shingle")).agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    met = rows.join(held, F.col("shingle") == F.col("_shingle"))
    of_rep = Window.partitionBy("rep")
    met = met.withColumns({"place": F.row_number().over(of_rep.orderBy("held", "shingle")), "shared": F.count(F.lit(1)).over(of_rep)})
    met = met.join(reps.withColumnRenamed("rep", "_rep"), F.col("rep") == F.col("_rep"))
    return met.filter(~F.col("single") | (100 * (F.col("shared") - F.col("place") + 1) >= percent * F.col("n"))).select("rep", "comp", "n", "single", "shingle", "place", "shared")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if small:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).withColumn("_m", F.least("_u", "_m"))
    met = both.join(least, F.col("u") == F.col("_u"))
    if small:
        out = met.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionAll(least.select(F.col("_u").alias("u"), F.col("_m").alias("v")))
    else:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (u, v) with v the least id that u reaches, for all u but those least ids."""
    now, before = saved(edges.select("u", "v").filter("u <> v").distinct(), "links"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == before:
            return now
        before = tuple(mark)
        now = saved(_star(_star(now, False), True), "links")


_BUCKET = ("key", "band", "rep", "n", "s", "single", "met")


def _possible(common: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m elements with so many in common at most can be alike enough."""
    return 100 * common >= percent * (n + m - common)


def _bound(s: str, met: str, other_s: str, other_met: str) -> Column:
    """The most that two members of a bucket can have in common.

    Through a hub: what both have in common with it, and what they have beside it. Where one intersection is not
    known the other alone bounds the pair (least and array_min pass over nulls).
    """
    s, other_s = F.col(s), F.col(other_s)
    through = F.zip_with(met, other_met, lambda h, g: F.least(h["i"], g["i"]) + F.least(s - h["i"], other_s - g["i"]))
    return F.least(s, other_s, F.array_min(through))


def _with_components(df: DataFrame, found: DataFrame | None, rep: str = "rep", name: str = "comp") -> DataFrame:
    if found is None:
        return df.withColumn(name, F.col(rep))
    known = found.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    return df.join(known, F.col(rep) == F.col("_u"), "left").withColumn(name, F.coalesce("_v", rep)).drop("_u", "_v")


def open_members(buckets: DataFrame, found: DataFrame | None, percent: int) -> DataFrame:
    """Members of buckets with several components: comp, and of the bucket's next hub _hub, _n, _s, _met, _comp.

    The hub is a member that no hub before is linked with; null if there is none. Members that even the smallest set
    of the bucket could not be linked with are left out.
    """
    placed = _with_components(buckets, found)
    fresh = ~F.exists("met", lambda h: h["linked"])
    place = F.struct((F.col("n") - F.col("s")).alias("own"), "rep", "n", "s", "comp", "met")
    keys = placed.groupBy(F.col("key").alias("_key")).agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.min("n").alias("_least"), F.min(F.when(fresh, place)).alias("_h"))
    keys = keys.filter("_low < _high").select("_key", "_least", F.col("_h.rep").alias("_hub"), *[F.col(f"_h.{c}").alias(f"_{c}") for c in ("n", "s", "met", "comp")])
    return placed.join(keys, F.col("key") == F.col("_key")).filter(_possible(F.col("s"), F.col("n"), F.greatest("_least", "s"), percent)).drop("_key", "_least")


def compared(pairs: DataFrame, signed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the posterior does not prune: a, b, i (in common, null where it is not one number), ok."""
    x, y = (signed.select(F.col("rep").alias(f"_{c}"), F.col("sig").alias(f"_s{c}")) for c in "ab")
    likely = pairs.join(x, F.col("a") == F.col("_a")).join(y, F.col("b") == F.col("_b"))
    likely = likely.filter(_plausible(percent)(F.col("_sa"), F.col("_sb"))).select("a", "b").distinct()
    x, y = (texts.select(F.col("doc_id").alias(f"_{c}"), F.col("text").alias(f"_t{c}")) for c in "ab")
    both = likely.join(x, F.col("a") == F.col("_a")).join(y, F.col("b") == F.col("_b")).select("a", "b", "_ta", "_tb")
    got = both.mapInArrow(_common, "a long, b long, i long, n long, m long")
    got = got.withColumn("ok", _possible(F.col("i"), F.col("n"), F.col("m"), percent) & (F.col("n") > 0) & (F.col("m") > 0))
    one = F.when(F.count(F.lit(1)) == 1, F.max("i"))
    return got.groupBy("a", "b").agg(one.alias("i"), F.max("ok").alias("ok"))


def merged(told: DataFrame, found: DataFrame | None) -> DataFrame | None:
    """Components after the links that were found."""
    links = told.filter("ok").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return components(links if found is None else links.unionAll(found))


def left_over(buckets: DataFrame, found: DataFrame | None, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a band and one of their rarest shingles and that no bound excludes."""
    placed = _with_components(buckets, found)
    keys = placed.groupBy(F.col("key").alias("_key")).agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.min("n").alias("_least")).filter("_low < _high")
    placed = placed.join(keys, F.col("key") == F.col("_key")).filter(_possible(F.col("s"), F.col("n"), F.greatest("_least", "s"), percent))
    left = saved(placed.select("key", "rep", "comp", "n", "s", "single", "met"), "left")
    reps = saved(left.select("rep", "comp", "n", "single").distinct(), "left_reps")
    rare = saved(prefixes(reps, texts, percent), "prefixes")
    other = rare.select(F.col("rep").alias("b"), *[F.col(c).alias(f"_{c}") for c in ("comp", "n", "single", "shingle", "place", "shared")])
    # At the first shingle that two sets have in common, what they have from there on bounds what they have in common.
    after = F.least(F.col("shared") - F.col("place"), F.col("_shared") - F.col("_place")) + 1
    fits = ~F.col("single") | ~F.col("_single") | _possible(after, F.col("n"), F.col("_n"), percent)
    met = (F.col("shingle") == F.col("_shingle")) & (F.col("rep") < F.col("b")) & (F.col("comp") != F.col("_comp")) & fits
    pairs = saved(rare.join(other, met).select(F.col("rep").alias("a"), "b").distinct(), "rare_pairs")
    # Of these the ones that lie in a bucket together and that its hubs do not exclude.
    x = left.select("key", F.col("rep").alias("a"), "comp", "n", "s", "met")
    y = left.select(F.col("rep").alias("b"), *[F.col(c).alias(f"_{c}") for c in ("key", "comp", "n", "s", "met")])
    met = pairs.join(x, "a").join(y, ["b"]).filter((F.col("key") == F.col("_key")) & (F.col("comp") != F.col("_comp")))
    return met.filter(_possible(_bound("s", "met", "_s", "_met"), F.col("n"), F.col("_n"), percent)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, for links of 100 * intersection >= percent * union.

    Null and wordless texts have an empty set and stand alone. Rows that repeat an id share its
    component (and are kept alike). Null ids: component_id null, kept. Extra columns are not read.
    """
    rows = profiles(docs)
    sets = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = saved(
        sets.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("_least")).select("s1", "s2", "n_shingles", F.col("_least.doc_id").alias("rep"), F.col("_least.sig").alias("sig")),
        "classes",
    )
    cut = F.array(*[F.xxhash64(F.expr(f"substring(sig, {1 + 4 * ROWS * k}, {4 * ROWS})"), F.lit(k)) for k in range(BANDS)])
    banded = classes.select("rep", F.posexplode(cut).alias("band", "key"))
    shared = banded.groupBy(F.col("key").alias("_key")).agg(F.min("rep").alias("_a"), F.max("rep").alias("_b")).filter("_a < _b").select("_key")
    buckets = saved(banded.join(shared, F.col("key") == F.col("_key")).select("key", "band", "rep").distinct(), "buckets")
    signed = classes.select("rep", "sig", "n_shingles")
    members = buckets.select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if members.count() <= SENT_IDS:
        members = F.broadcast(members)
    texts = saved(texts.join(members, F.col("doc_id") == F.col("rep"), "left_semi"), "texts")

    # A text has at most its shared shingles in common with any other: most false candidates end here.
    lone = saved(unshared(texts), "unshared")
    # Ids that stand for several texts get the widest bounds.
    sized = signed.groupBy(F.col("rep").alias("_id")).agg(F.min("n_shingles").alias("n"), F.max("n_shingles").alias("most"), F.count(F.lit(1)).alias("texts"))
    buckets = buckets.join(sized, F.col("rep") == F.col("_id")).join(lone, F.col("rep") == F.col("_rep"), "left")
    most_shared = F.when(F.col("texts") > 1, F.col("most")).otherwise(F.col("n") - F.coalesce("own", F.lit(0)))
    no_hub = F.array().cast("array<struct<i:bigint,hub:bigint,linked:boolean>>")
    buckets = buckets.select("key", "band", "rep", "n", most_shared.alias("s"), (F.col("texts") == 1).alias("single"), no_hub.alias("met"))
    buckets = buckets.filter(100 * F.col("s") >= percent * F.col("n")).distinct()

    found: DataFrame | None = None  # rep to component, for those not their own
    for _ in range(HUB_ROUNDS):
        placed = saved(open_members(buckets, found, percent), "open")
        fits = _possible(_bound("s", "met", "_s", "_met"), F.col("n"), F.col("_n"), percent)
        pairs = saved(placed.filter("comp <> _comp and rep <> _hub").filter(fits).select(F.col("rep").alias("a"), F.col("_hub").alias("b")).distinct(), "pairs")
        if pairs.isEmpty():
            buckets = placed.select(*_BUCKET)
            break
        told = saved(compared(pairs, signed, texts, percent), "told")
        found = merged(told, found)
        told = told.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "i", "ok")
        placed = placed.join(told, (F.col("rep") == F.col("_a")) & (F.col("_hub") == F.col("_b")), "left")
        i = F.when(F.col("rep") == F.col("_hub"), F.when(F.col("single"), F.col("n"))).otherwise(F.col("i"))
        linked = (F.col("rep") == F.col("_hub")) | F.coalesce("ok", F.lit(False)) | (F.col("comp") == F.col("_comp"))
        one = F.struct(i.alias("i"), F.col("_hub").alias("hub"), linked.alias("linked"))
        buckets = saved(placed.withColumn("met", F.when(F.col("_hub").isNotNull(), F.array_append("met", one)).otherwise(F.col("met"))).select(*_BUCKET), "buckets")

    pairs = saved(left_over(buckets, found, texts, percent), "pairs")
    if not pairs.isEmpty():
        found = merged(saved(compared(pairs, signed, texts, percent), "told"), found)

    named = rows.join(classes.select(F.col("s1").alias("_1"), F.col("s2").alias("_2"), F.col("n_shingles").alias("_n"), "rep"), (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2")) & (F.col("n_shingles") == F.col("_n")), "left")
    comp = F.coalesce("rep", "doc_id")
    if found is not None:
        named = named.join(found, F.col("rep") == F.col("u"), "left")
        comp = F.coalesce("v", "rep", "doc_id")
    comp = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), comp).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group, with its columns; of rows that repeat a kept id one stays.

    Null ids are all kept.
    """
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        gone = saved(near_duplicates(docs, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left
    return left.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.filter("doc_id is null"))
