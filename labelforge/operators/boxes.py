"""From detection boxes of label images to ingredient text.

Every step keeps image_id as its only key, so one exchange serves all windows and aggregations of a plan.
Ties of position go by box_id. Steps take `by`: image_id, and what else parts the boxes that are clustered.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text

READING = ("y_center", "x1", "box_id")
IMAGE = ("image_id",)
FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def from_detections(raw: DataFrame) -> DataFrame:
    """Boxes of (image_id, detections of (bbox corners, text, confidence)); box_id is the place in the list.

    Blank texts and boxes of fewer than two corners are left out; no confidence counts as 1.
    """
    d = raw.select("image_id", F.posexplode("detections").alias("box_id", "d"))
    d = d.filter((text.strip(F.coalesce("d.text", F.lit(""))) != "") & (F.size("d.bbox") >= 2))
    xs, ys = F.transform("d.bbox", lambda p: F.get(p, 0)), F.transform("d.bbox", lambda p: F.get(p, 1))
    return d.select("image_id", "box_id", text.strip(F.col("d.text")).alias("text"), F.coalesce("d.confidence", F.lit(1.0)).alias("confidence"), F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def prepared(boxes: DataFrame) -> DataFrame:
    """Numbers that are none become 0, null texts empty; adds width, height and centres."""
    nums = {c: F.coalesce(F.expr(f"try_cast({c} AS double)"), F.lit(0.0)) for c in ("x1", "y1", "x2", "y2", "pred_prob", "confidence") if c in boxes.columns}
    out = boxes.withColumns(nums | {"text": F.coalesce("text", F.lit(""))})
    out = out if "confidence" in boxes.columns else out.withColumn("confidence", F.lit(1.0))
    return out.withColumns({"width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1"), "x_center": (F.col("x1") + F.col("x2")) / 2, "y_center": (F.col("y1") + F.col("y2")) / 2})


def with_context(boxes: DataFrame) -> DataFrame:
    w = Window.partitionBy("image_id").orderBy(*READING)
    out = boxes.withColumn("prev_text", F.lag("text", 1, "").over(w)).withColumn("next_text", F.lead("text", 1, "").over(w))
    return out.withColumn("context_text", F.concat_ws(" [SEP] ", "prev_text", "text", "next_text"))


def features(boxes: DataFrame) -> DataFrame:
    """Adds the 22 features of a box in its context."""

    def hint(c: str, words: tuple[str, ...]) -> Column:
        return F.lower(c).rlike(text.phrases(words)).cast("int")

    t = F.col("text")
    made = {
        "ocr_confidence": F.col("confidence"), "char_len": F.length(t), "word_count": F.regexp_count(t, F.lit(r"\S+")), "digit_count": F.regexp_count(t, F.lit("[0-9]")),
        "comma_count": F.regexp_count(t, F.lit(",")), "percent_count": F.regexp_count(t, F.lit("%")), "paren_count": F.regexp_count(t, F.lit("[()]")), "colon_count": F.regexp_count(t, F.lit(":")),
        "is_all_caps": ((F.upper(t) == t) & (F.lower(t) != t)).cast("int"),
    }
    for side in ("", "prev_", "next_"):
        made |= {f"{side}has_ingredient_hint": hint(f"{side}text", fixed.INGREDIENT_HINTS), f"{side}has_noningredient_hint": hint(f"{side}text", fixed.OTHER_HINTS), f"{side}has_header_hint": hint(f"{side}text", fixed.HEADER_HINTS)}
    return boxes.withColumns(made)


def headers(boxes: DataFrame) -> DataFrame:
    """The first header box of each image: image_id, header_text, header_y, header_y2."""
    found = boxes.filter(text.is_header(F.col("text")))
    first = F.min(F.struct("y_center", "x1", "box_id", "text", "y2"))
    return found.groupBy("image_id").agg(first.alias("h")).select("image_id", F.col("h.text").alias("header_text"), F.col("h.y_center").alias("header_y"), F.col("h.y2").alias("header_y2"))


def positive(boxes: DataFrame, threshold: float = fixed.THRESHOLD, strong: float = fixed.STRONG) -> DataFrame:
    t, p = F.col("text"), F.col("pred_prob")
    return boxes.filter((p >= threshold) & ~text.is_header(t) & ~(text.is_junk_fragment(t) & (p < strong)) & ~(text.has_bad_hint(t) & (p < fixed.HINTED)))


def below_header(boxes: DataFrame, heads: DataFrame, slack: float = fixed.HEADER_SLACK) -> DataFrame:
    """Boxes not above their image's header; all of an image without one. Adds the header's columns."""
    return boxes.join(heads, "image_id", "left").filter(F.col("header_y").isNull() | (F.col("y_center") >= F.col("header_y") - slack))


def neighbours(boxes: DataFrame, near_y: float = fixed.NEAR_Y, near_x: float = fixed.NEAR_X) -> DataFrame:
    """image_id, box_id, near: other boxes within the band. Bands of height near_y bound what meets."""
    band = F.floor(F.col("y_center") / near_y)
    own = boxes.select("image_id", "box_id", F.col("x_center").alias("x"), F.col("y_center").alias("y"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    other = boxes.select(F.col("image_id").alias("image"), F.col("box_id").alias("other"), F.col("x_center").alias("ox"), F.col("y_center").alias("oy"), band.alias("oband"))
    met = own.join(other, (F.col("image_id") == F.col("image")) & (F.col("band") == F.col("oband")) & (F.col("box_id") != F.col("other")) & (F.abs(F.col("y") - F.col("oy")) <= near_y) & (F.abs(F.col("x") - F.col("ox")) <= near_x))
    return met.groupBy("image_id", "box_id").agg(F.count(F.lit(1)).alias("near"))


def hinted(lowered: Column) -> Column:
    """text.has_bad_hint of texts in lower case; Arrow's expressions ask for all hints in one pass over a text."""
    pattern = text.phrases(fixed.BAD_HINTS)

    @F.arrow_udf("boolean")
    def test(texts: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        return pc.match_substring_regex(texts, pattern)

    return test(lowered)


def has_neighbour(by: tuple[str, ...] = IMAGE, near_y: float = fixed.NEAR_Y, near_x: float = fixed.NEAR_X) -> Column:
    """Whether another box is within the band, told from a window of its height."""
    # The frame is wider, so that rounding at its ends leaves none out.
    frame = Window.partitionBy(*by).orderBy("y_center").rangeBetween(-math.ceil(near_y) - 1, math.ceil(near_y) + 1)
    around = F.collect_list(F.struct("box_id", "y_center", "x_center")).over(frame)
    x, y = F.col("x_center"), F.col("y_center")
    return F.exists(around, lambda o: (o["box_id"] != F.col("box_id")) & (F.abs(y - o["y_center"]) <= near_y) & (F.abs(x - o["x_center"]) <= near_x))


def joined_by_others(continues: Column, by: tuple[str, ...] = IMAGE) -> Column:
    """Whether a box is sure, has a neighbour or continues a line, or is its image's only one."""
    many = F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy("y_center").rowsBetween(FIRST, LAST))
    return (many <= 1) | (F.col("pred_prob") >= fixed.LONELY_KEEP) | continues | has_neighbour(by)


def without_isolated(boxes: DataFrame) -> DataFrame:
    """Drops lonely, unsure boxes that continue no line; an image's only box stays."""
    return boxes.withColumn("_joined", joined_by_others(text.is_continuation(F.col("text")))).filter("_joined").drop("_joined")


def row_clusters(boxes: DataFrame, gap: float = fixed.ROW_GAP, by: tuple[str, ...] = IMAGE) -> DataFrame:
    """Adds cluster: a new one where the step to the box before is above gap."""
    w = Window.partitionBy(*by).orderBy(*READING)
    new = F.when(F.col("y_center") - F.lag("y_center").over(w) > gap, 1).otherwise(0)
    return boxes.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def merged_clusters(boxes: DataFrame, gap: float = fixed.CLUSTER_GAP, by: tuple[str, ...] = IMAGE) -> DataFrame:
    """Adds group: clusters whose top is within gap of the lowest point of all before are one."""
    own, w = Window.partitionBy(*by, "cluster").orderBy(*READING), Window.partitionBy(*by).orderBy("cluster", *READING)
    c = boxes.withColumns({"_top": F.min("y1").over(own.rowsBetween(FIRST, LAST)), "_place": F.row_number().over(own), "_before": F.max("y2").over(w.rowsBetween(FIRST, -1))})
    # A cluster's first box has all clusters before it, and no more, before it.
    new = F.when((F.col("_place") == 1) & (F.col("_top") - F.col("_before") > gap), 1).otherwise(0)
    return c.withColumn("_new", new).withColumn("group", F.sum("_new").over(w.rowsBetween(FIRST, 0))).drop("_top", "_place", "_before", "_new")


def _sums(bad: Column, length: Column) -> dict[str, Column]:
    return {"size": F.count(F.lit(1)), "_p": F.sum("pred_prob"), "_bad": F.count_if(bad), "_len": F.avg(length), "_top": F.min("y1")}


def _score() -> Column:
    far = F.coalesce(0.002 * F.greatest(F.lit(0.0), F.col("_top") - F.col("header_y2")), F.lit(0.0))
    return F.col("_p") + 0.18 * F.col("size") - 0.8 * F.col("_bad") + F.least(F.col("_len") / 50, F.lit(0.6)) - far


def group_scores(boxes: DataFrame, heads: DataFrame) -> DataFrame:
    """image_id, group, size, mean_prob, score."""
    sums = _sums(text.has_bad_hint(F.col("text")), F.length(text.strip(F.col("text"))))
    g = boxes.groupBy("image_id", "group").agg(*[c.alias(k) for k, c in sums.items()]).join(heads, "image_id", "left")
    return g.select("image_id", "group", "size", (F.col("_p") / F.col("size")).alias("mean_prob"), _score().alias("score"))


def best_groups(scores: DataFrame) -> DataFrame:
    """Each image's group of the highest score, the first on ties."""
    w = Window.partitionBy("image_id").orderBy(F.desc(F.round("score", 9)), "group")
    return scores.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def assigned_rows(boxes: DataFrame) -> DataFrame:
    """Text lines of each image's boxes: image_id, placed: (row_id, x1, box_id, text) of the boxes, by line.

    A box opens a new line when it is farther from the line's first box than the limit, so this is one fold
    over the boxes in reading order, not a gap rule.
    """
    box = F.struct("y_center", "x1", "box_id", "text")
    rows = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(box)).alias("b"), F.percentile("height", 0.5).alias("median"))
    return rows.withColumn("limit", _line_limit()).select("image_id", _placed().alias("placed"))


def _line_limit() -> Column:
    return F.greatest(F.lit(fixed.LINE_GAP), fixed.LINE_SHARE * F.greatest(F.lit(1.0), F.col("median")))


def _placed() -> Column:
    """The boxes `b` with the numbers of their lines, by `limit`."""
    item = "struct<row_id:int,x1:double,box_id:bigint,text:string>"
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast(f"array<{item}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = a["anchor"].isNull() | (F.abs(x["y_center"] - a["anchor"]) > F.col("limit"))
        row = a["row"] + new.cast("int")
        put = F.struct(row.alias("row_id"), x["x1"].alias("x1"), x["box_id"].cast("bigint").alias("box_id"), x["text"].alias("text"))
        return F.struct(F.when(new, x["y_center"]).otherwise(a["anchor"]).alias("anchor"), row.alias("row"), F.array_append(a["out"], put).alias("out"))

    return F.aggregate("b", start, step, lambda a: F.array_sort(a["out"]))


def _lines(kept: str) -> Column:
    """Lines joined by line ends, boxes of a line by spaces. kept: a column of boxes as placed, none blank."""
    before = lambda b, i: F.when(i == 0, "").when(F.get(kept, i - 1)["row_id"] == b["row_id"], " ").otherwise("\n")
    return F.array_join(F.transform(kept, lambda b, i: F.concat(before(b, i), b["text"])), "")


def regions(boxes: DataFrame) -> DataFrame:
    """The whole way, one row per image: header_text, header_y, size, mean_prob, raw_text, final_text.

    raw_text: lines joined by line ends, boxes of a line by spaces; junk that continues nothing is out. Images without a
    kept box have null sizes and empty texts.

    Texts are tested once, before the only exchange. Boxes that are out stay as marked rows, so that no image is lost; the
    windows of each step part the boxes that are in from those that are out.
    """
    p, t, in_ = F.col("pred_prob"), F.col("_t"), F.col("_in")
    rows = prepared(boxes).withColumn("_t", text.strip(F.col("text"))).withColumn("_low", F.lower("_t"))
    rows = rows.withColumn("_header", text.is_header(F.col("_low"))).withColumn("_in", (p >= fixed.THRESHOLD) & ~F.col("_header"))
    rows = rows.withColumn("_bad", F.coalesce(hinted(F.when(in_, F.col("_low"))), F.lit(False)))
    rows = rows.withColumns({"_junk": in_ & text.stripped_junk(t), "_continues": in_ & text.stripped_continuation(t)})
    rows = rows.withColumn("_in", in_ & ~(F.col("_junk") & (p < fixed.STRONG)) & ~(F.col("_bad") & (p < fixed.HINTED)))
    header = F.when(F.col("_header"), F.struct("y_center", "x1", "box_id", "text", "y2"))
    words = F.when(in_ & (~F.col("_junk") | F.col("_continues")), text.squeeze(t))
    needed = [F.when(in_, F.col(c)).alias(c) for c in (*READING, "x_center", "y1", "y2", "height", "pred_prob")]
    rows = rows.select("image_id", header.alias("_head"), "_in", "_bad", "_continues", F.when(in_, F.length(t)).alias("_n"), words.alias("text"), *needed).repartition("image_id")

    by, order = ("image_id", "_in"), Window.partitionBy("image_id", "_in").orderBy("cluster", *READING)
    rows = rows.withColumn("_head", F.min("_head").over(Window.partitionBy("image_id").orderBy("_in", "y_center").rowsBetween(FIRST, LAST)))
    rows = rows.withColumn("_in", in_ & (F.col("_head").isNull() | (F.col("y_center") >= F.col("_head.y_center") - fixed.HEADER_SLACK)))
    rows = rows.withColumn("_in", in_ & joined_by_others(F.col("_continues"), by))
    rows = merged_clusters(row_clusters(rows, by=by), by=by)
    group = Window.partitionBy(*by, "group").orderBy("cluster", *READING).rowsBetween(FIRST, LAST)
    rows = rows.withColumns({k: c.over(group) for k, c in _sums(F.col("_bad"), F.col("_n")).items()} | {"header_y2": F.col("_head.y2")})
    best = F.max(F.struct(F.round(_score(), 9).alias("score"), (-F.col("group")).alias("first"))).over(order.rowsBetween(FIRST, LAST))
    rows = rows.withColumn("_in", in_ & (best["first"] == -F.col("group")))

    one = lambda c: F.max(F.when(in_, c))
    box = F.when(in_, F.struct(*READING, "text"))
    made = rows.groupBy("image_id").agg(
        F.max("_head").alias("_head"), one(F.col("size")).alias("size"), one(F.col("_p") / F.col("size")).alias("mean_prob"), F.array_sort(F.collect_list(box)).alias("b"), F.percentile(F.when(in_, F.col("height")), 0.5).alias("median")
    )
    made = made.withColumn("limit", _line_limit()).withColumn("_kept", F.filter(_placed(), lambda b: b["text"] != "")).withColumn("raw_text", _lines("_kept"))
    made = made.drop("_kept", "b", "median", "limit").withColumn("_hinted", hinted(F.lower("raw_text")))
    return made.select("image_id", F.col("_head.text").alias("header_text"), F.col("_head.y_center").alias("header_y"), "size", "mean_prob", "raw_text", text.tidy_text(F.col("raw_text"), F.col("_hinted")).alias("final_text"))
