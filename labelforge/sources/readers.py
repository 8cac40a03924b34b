"""Readers of label files: CSV boxes, truth lists, detections, caches, JSON lines, images; and small dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.terms import TERMS
from ..operators.accounts import natural_key

BOX_CSV = "image_id string, box_id long, text string, confidence string, x1 string, y1 string, x2 string, y2 string, label string"
DETECTIONS = "array<struct<bbox:array<array<double>>,text:string,confidence:double>>"
MAX_UPLOAD = 10 * 1024 * 1024
IMAGES = "*.{jpg,jpeg,png,webp,bmp,JPG,JPEG,PNG}"

#: Own dictionary: term and weight; single words weigh less than whole phrases.
VOCABULARY = tuple(
    (t, 10_000_000 if k < 40 else 1_000_000)
    for k, t in enumerate(
        dict.fromkeys(
            ["water", "sugar", "salt", "wheat flour", "palm oil", "cocoa butter", "citric acid", "soya lecithin", "sea salt", "honey", "e330", "e471", "e322", "vanilla", "oats", "pepper", "rice", "corn", "tomato puree", "lactic acid", "oleic acid", "cheese", "peanuts", "sultanas", "mustard seeds", "sesame oil", "flavouring", "coconut", "eggplant", "white wine vinegar"]
            + [t for ts in TERMS.values() for t in ts]
        )
    )
)
ALIASES = (("watr", "water"), ("suger", "sugar"), ("soy lecithin", "soya lecithin"), ("natural flavoring", "natural flavouring"), ("oat flour", "oats"))


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VOCABULARY), "term string, weight long")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES), "wrong string, canonical string")


def box_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled boxes: null texts empty, numbers that are none 0."""
    rows = spark.read.schema(BOX_CSV).csv(path, header=True)
    nums = {c: F.coalesce(F.expr(f"try_cast({c} AS double)"), F.lit(0.0)) for c in ("confidence", "x1", "y1", "x2", "y2")}
    return rows.withColumns(nums | {"text": F.coalesce("text", F.lit("")), "label": F.expr("try_cast(label AS int)")})


def truth_lists(rows: DataFrame) -> DataFrame:
    """image, true_ingredients without blank items; null lists are empty."""
    none = F.array().cast("array<string>")
    return rows.select("image", F.filter(F.coalesce("true_ingredients", none), lambda x: text.strip(x) != "").alias("true_ingredients"))


def truth_json(spark: SparkSession, path: str) -> DataFrame:
    return truth_lists(spark.read.schema("image string, true_ingredients array<string>").json(path, multiLine=True))


def detection_map(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """image_id, detections of JSON objects of lists; names that start with _ are no images."""
    return rows.select(F.explode(F.from_json(raw, f"map<string,{DETECTIONS}>")).alias("image_id", "detections")).filter(~F.col("image_id").startswith("_"))


def ocr_cache(rows: DataFrame, raw: str = "raw") -> DataFrame:
    return rows.select(F.explode(F.from_json(raw, "map<string,string>")).alias("image_id", "value"))


def json_lines(rows: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """Lines that are not blank, with ok (valid JSON) and row."""
    full = rows.filter(text.strip(F.col(line)) != "")
    return full.withColumn("ok", F.try_parse_json(F.col(line)).isNotNull()).withColumn("row", F.from_json(line, schema))


def images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).option("recursiveFileLookup", "false").load(path)


def chosen_images(rows: DataFrame, limit: int | None = None, name: str = "name") -> DataFrame:
    """Rows whose name ends like an image's, in natural order (digit runs by number), the first ones if limit is given."""
    ends = F.lower(name).rlike(r"\.(?:jpg|jpeg|png|webp|bmp)$")
    out = rows.filter(ends).orderBy(natural_key(F.col(name)), name)
    return out if limit is None else out.limit(limit)


def jdbc_table(spark: SparkSession, url: str, name: str, by: str | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table; with a numeric column `by` it is read in so many ranges of that column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if by is None:
        return reader.load()
    low, high = spark.read.format("jdbc").options(url=url, query=f"SELECT min({by}) AS low, max({by}) AS high FROM {name}", **options).load().first()
    if low is None:
        return reader.load()
    return reader.options(partitionColumn=by, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


def accepted_uploads(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("mime").startswith("image/") & (F.col("length") <= MAX_UPLOAD))


def as_list(raw: Column) -> Column:
    """A stored list: JSON lists as they are, other texts cut at commas and line ends, null empty; blanks out."""
    none = F.array().cast("array<string>")
    listed = F.when(raw.isNull(), none).when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, "[,\n]"))
    return F.filter(F.transform(listed, text.strip), lambda x: x != "")
