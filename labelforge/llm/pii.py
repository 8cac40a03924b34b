"""Personal data: exact patterns and bootstrapped contextual extraction, in DataFrame functions alone.

Seeds are the spans of the exact patterns. The words around a seed make lexical patterns: the last word before it (or
the label glued to it, as in tel:0207...), the last two, the next word after it, the next two. Pattern and instance
scores are computed in turn on the graph between them, until no instance is added:
    pattern:  the share of all its occurrences in the corpus that stand at a known instance;
    instance: 1 - product of (1 - score) over the good patterns that it stands at.
Patterns are good with SUPPORT different known instances and a score of SURE; instances become known at
ACCEPT. Candidates are strings of an identifier's shape that no exact pattern takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

KINDS = ("email", "ip", "card", "phone")
#: The kinds' patterns, equal to the plain ones but linear: a match can only start where the one before
#: ended or where no character precedes that would belong to it, and runs never give characters back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
IP_FORM = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
#: Candidates: digits with separators, strings around an @, hexadecimal groups with colons.
CANDIDATE = r"(?<![0-9A-Za-z])(?:[0-9(][0-9().\x20/-]{5,}[0-9]|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7})|(?<![^\x20\x09-\x0D<(\[\x22'])[^\x20\x09-\x0D@<>()\[\]\x22',;]{1,64}@[^\x20\x09-\x0D@<>()\[\]\x22',;]*[A-Za-z0-9]"
#: Shapes that a candidate must have to be taken for a kind.
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^(?:[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}|[0-9]{1,3}(?:[./ -][0-9]{1,3}){3})$",
    "card": r"^(?:[0-9][ /.-]?){11,18}[0-9]$",
    "phone": r"^[(]?(?:[0-9][ ()./-]{0,3}){6,14}[0-9]$",
}
SUPPORT, SURE, ACCEPT = 3, 0.5, 0.5
SPACE = r"[\x20\x09-\x0D]"
SENT_ROWS = 200_000
_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def placed(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, stop, value), offsets in code points.

    The pieces between matches tell where these are: both come from the same matcher.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    walked = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("p")),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["p"])).alias("start"), (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("stop"), x["m"].alias("value")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return walked


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_FORM)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _worth(kind: str, text: Column) -> Column:
    """A quick test that a text can hold the kind at all."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": text.contains("+")}[kind]


def base_spans(text: Column) -> Column:
    """All exact spans (start, kind, stop, value), kind as a number, by start and kind."""
    none = F.array().cast(_SPAN)

    def of(k: int, kind: str) -> Column:
        got = F.filter(placed(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
        named = F.transform(got, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["stop"].alias("stop"), s["value"].alias("value")))
        return F.when(_worth(kind, text), named).otherwise(none)

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def candidate_spans(text: Column, base: Column) -> Column:
    """Strings of an identifier's shape that overlap no exact span, with kind -1."""
    none = F.array().cast(_SPAN)
    free = F.filter(placed(text, CANDIDATE), lambda c: ~F.exists(base, lambda b: (c["start"] < b["stop"]) & (b["start"] < c["stop"])))
    named = F.transform(free, lambda s: F.struct(s["start"].alias("start"), F.lit(-1).alias("kind"), s["stop"].alias("stop"), s["value"].alias("value")))
    return F.when(text.rlike(r"[0-9].{4}|@"), named).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, base spans, and mentions: spans and candidates with the words around each.

    The text is cut at the mentions once; a mention's words are those of the pieces before and after it.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("free", candidate_spans(F.col("text"), F.col("base")))
    rows = rows.withColumn("all", F.array_sort(F.concat("base", "free"))).withColumn("low", F.lower("text"))

    def piece(i: Column) -> Column:
        """From the mention before place i to the one at i, or to the end of the text."""
        start = F.coalesce(F.get("all", i - 1)["stop"], F.lit(0))
        return F.substring("low", start + 1, F.greatest(F.coalesce(F.get("all", i)["start"], F.length("low")) - start, F.lit(0)))

    pieces = F.when(F.size("all") > 0, F.transform(F.sequence(F.lit(0), F.size("all")), piece))
    rows = rows.withColumn("pieces", pieces)
    # A word that begins or ends at a mention is no whole word; before a mention it is the label glued to it.

    def words(x: Column, i: Column) -> Column:
        after = F.when(i > 0, F.regexp_replace(x, r"^[^\x20\x09-\x0D]+", "")).otherwise(x)
        glued = F.regexp_extract(x, r"([^\x20\x09-\x0D]+)\z", 1)
        glued = F.when(i < F.size("all"), glued).otherwise(F.lit(""))
        own = F.filter(F.split(F.substring(after, F.lit(1), F.greatest(F.length(after) - F.length(glued), F.lit(0))), SPACE), lambda w: w != "")
        return F.struct(own.alias("own"), F.when(glued.rlike(r"[^\p{L}\p{N}]\z"), glued).otherwise(F.lit("")).alias("label"), (glued != "").alias("joined"))

    rows = rows.withColumn("around", F.transform("pieces", words))

    def mention(s: Column, i: Column) -> Column:
        before, after = F.get("around", i), F.get("around", i + 1)["own"]
        label, own = before["label"], before["own"]
        last = F.when(label != "", label).when(~before["joined"], F.get(own, F.size(own) - 1))
        prior = F.when(label != "", F.get(own, F.size(own) - 1)).when(~before["joined"], F.get(own, F.size(own) - 2))
        return F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value"),
            F.coalesce(last, F.lit("")).alias("last"), F.coalesce(prior, F.lit("")).alias("prior"), F.coalesce(F.get(after, F.lit(0)), F.lit("")).alias("next"), F.coalesce(F.get(after, F.lit(1)), F.lit("")).alias("second"),
        )

    return rows.select("doc_id", "key", "base", F.coalesce(F.transform("all", mention), F.array()).alias("mentions"))


def _patterns(mentions: DataFrame) -> DataFrame:
    """Each mention under its patterns (side, near, far): one word beside it, far empty, or two."""

    def of(side: str, near: str, far: str) -> Column:
        one = F.struct(F.lit(side).alias("side"), F.col(near).alias("near"), F.lit("").alias("far"))
        two = F.struct(F.lit(side).alias("side"), F.col(near).alias("near"), F.col(far).alias("far"))
        return F.when(F.col(near) == "", F.array().cast("array<struct<side:string,near:string,far:string>>")).when(F.col(far) == "", F.array(one)).otherwise(F.array(one, two))

    every = F.concat(of("before", "last", "prior"), of("after", "next", "second"))
    return mentions.withColumn("p", F.explode(every)).select("kind", "value", "p.side", "p.near", "p.far")


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each pattern's words stand in all texts: side, near, far, total.

    Before: whole words, and labels at the start of longer words that end in no letter or digit. After: whole words.
    """
    rows = docs.select(F.split(F.lower(F.coalesce("text", F.lit(""))), SPACE).alias("words")).select(F.filter("words", lambda w: w != "").alias("words"))
    rows = rows.select("words", F.posexplode("words").alias("pos", "word")).select("word", F.get("words", F.col("pos") - 1).alias("left"), F.get("words", F.col("pos") + 1).alias("right"))
    listed = patterns.select(F.col("side").alias("_side"), F.col("near").alias("_near"), F.col("far").alias("_far")).distinct()
    listed = F.broadcast(listed) if listed.count() <= SENT_ROWS else listed
    # Labels: what comes before each further character of a word, after a mark.
    ends = F.filter(F.sequence(F.lit(1), F.length("word") - 1), lambda n: F.substring("word", n, F.lit(1)).rlike(r"[^\p{L}\p{N}]"))
    labels = F.transform(ends, lambda n: F.struct(F.lit("before").alias("side"), F.substring("word", F.lit(1), n).alias("near"), F.col("left").alias("far")))
    labels = F.when((F.length("word") > 1) & F.col("word").rlike(r"[^\p{L}\p{N}]."), labels)
    whole = F.array(F.struct(F.lit("before").alias("side"), F.col("word").alias("near"), F.col("left").alias("far")), F.struct(F.lit("after").alias("side"), F.col("word").alias("near"), F.col("right").alias("far")))
    rows = rows.select(F.explode(F.concat(whole, F.coalesce(labels, F.array().cast("array<struct<side:string,near:string,far:string>>")))).alias("x")).select("x.*")
    met = rows.join(listed, (F.col("side") == F.col("_side")) & (F.col("near") == F.col("_near")) & ((F.col("_far") == "") | (F.col("_far") == F.col("far"))))
    return met.groupBy(F.col("_side").alias("side"), F.col("_near").alias("near"), F.col("_far").alias("far")).agg(F.count(F.lit(1)).alias("total"))


PATTERN = ["side", "near", "far"]


def bootstrap(docs: DataFrame, mentions: DataFrame, support: int = SUPPORT, sure: float = SURE, accept: float = ACCEPT) -> DataFrame:
    """Accepted instances beyond the seeds: kind, value. The graph's tables are aggregated; nothing is collected."""
    edges = saved(_patterns(mentions).groupBy(*PATTERN, "kind", "value").agg(F.count(F.lit(1)).alias("n")), "edges")
    seeds = edges.filter("kind >= 0").select("kind", "value").distinct()
    shapes = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("value").rlike(SHAPES[n]).alias("fits")) for k, n in enumerate(KINDS)])
    open_ = edges.filter("kind = -1").select(*PATTERN, "value", "n", F.explode(F.filter(shapes, lambda s: s["fits"])).alias("s")).select(*PATTERN, F.col("s.kind").alias("kind"), "value", "n")
    graph = saved(edges.filter("kind >= 0").select(*PATTERN, "kind", "value", "n").unionAll(open_), "graph")
    # Only patterns that could ever have the support are counted in the corpus.
    wide = graph.groupBy(*PATTERN, "kind").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= support)
    totals = saved(occurrences(docs, saved(wide, "wide")), "totals")
    known = saved(seeds, "known")
    size = known.count()
    while True:
        held = graph.join(known, ["kind", "value"]).groupBy(*PATTERN, "kind").agg(F.sum("n").alias("pos"), F.count(F.lit(1)).alias("m"))
        good = held.filter(F.col("m") >= support).join(totals, PATTERN).withColumn("score", F.least(F.col("pos") / F.col("total"), F.lit(0.999))).filter(F.col("score") >= sure)
        told = graph.join(saved(good.select(*PATTERN, "kind", "score"), "good"), [*PATTERN, "kind"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("score"))
        best = told.filter(F.col("score") >= accept).groupBy("value").agg(F.max(F.struct("score", -F.col("kind"))).alias("b")).select((-F.col("b.col2")).cast("int").alias("kind"), "value")
        known = saved(known.unionAll(best).distinct(), "known")
        now = known.count()
        if now == size:
            return known.join(seeds, ["kind", "value"], "left_anti")
        size = now


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base (exact spans) and found (spans that the contexts add), (start, kind, stop, value).

    Null text counts as empty. Equal rows have equal spans. Empty table: no rows.
    """
    scanned = saved(scan(docs), "scanned")
    mentions = scanned.select("doc_id", "key", F.explode("mentions").alias("m")).select("doc_id", "key", "m.*")
    extra = saved(bootstrap(docs, mentions), "extra").select(F.col("kind").alias("_kind"), F.col("value").alias("_value"))
    new = mentions.filter("kind = -1").join(extra, F.col("value") == F.col("_value"))
    span = F.struct("start", F.col("_kind").alias("kind"), "stop", "value")
    new = new.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.array_sort(F.collect_set(span)).alias("found"))
    out = scanned.join(new, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return out.select("doc_id", "base", F.coalesce("found", F.array().cast(_SPAN)).alias("found"))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, exact spans by kind, digest of the exact spans, and all spans as text.

    Null text counts as empty: no spans. Rows that repeat give equal rows; columns other than doc_id and text are not
    read; an empty table gives no rows.
    """
    rows = find(docs)

    def count(k: int, kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}")

    counts = [count(k, kind) for k, kind in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", "found"))
    return rows.select("doc_id", *counts, F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(every).alias("spans"))
