"""Writers: scans, CSV, JSON summaries, caches and JSON lines. All go through Spark's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import saved


def append_scans(scans: DataFrame, path: str) -> DataFrame:
    """Adds rows to the stored scans and gives the table with them; a missing created_at is now."""
    made = F.coalesce("created_at", F.current_timestamp()) if "created_at" in scans.columns else F.current_timestamp()
    scans.withColumn("created_at", made).write.mode("append").parquet(path)
    return scans.sparkSession.read.parquet(path)


def _make_unique(spark: SparkSession, rows: DataFrame, url: str, name: str, unique: Sequence[Sequence[str]], options: dict[str, str]) -> None:
    """Makes the table with its constraints, from the driver, unless it is there."""
    held = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        if any(held.getMetaData().getTables(None, None, n, None).next() for n in (name, name.upper(), name.lower())):
            return
        spark.createDataFrame([], rows.schema).write.jdbc(url, name, properties=options)
        for k, cols in enumerate(unique):
            quoted = ", ".join(f'"{c}"' for c in cols)
            held.createStatement().execute(f"ALTER TABLE {name} ADD CONSTRAINT {name}_unique_{k} UNIQUE ({quoted})")
    finally:
        held.close()


def append_unique(rows: DataFrame, url: str, name: str, unique: Sequence[Sequence[str]], **options: str) -> DataFrame:
    """Appends rows to a database table, each set of `unique` columns at most once, and gives the rows that were refused.

    Of rows that share a key the first by all columns is taken; the sets are tested in turn, first in the rows and then against
    the table. Nulls are no keys. The table is made if it is missing, with a constraint for each set, so that a writer beside
    this one makes the append fail instead of storing a key twice; a failed append can be run again.
    """
    spark = rows.sparkSession
    given = saved(rows, "given")
    _make_unique(spark, rows, url, name, unique, options)
    kept = given
    for cols in unique:
        keyed = " AND ".join(f"`{c}` IS NOT NULL" for c in cols)
        place = Window.partitionBy(*cols).orderBy(*rows.columns)
        first = kept.filter(keyed).withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_place")
        stored = spark.read.jdbc(url, name, properties=options).select(*cols)
        kept = saved(first.join(stored, list(cols), "left_anti").select(*rows.columns).unionByName(kept.filter(f"NOT ({keyed})")), "kept")
    kept.write.mode("append").jdbc(url, name, properties=options)
    return given.exceptAll(kept)


def write_csv(rows: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """CSV with a header and the given fields in order; quotes inside values are doubled."""
    rows.select(*(fields or rows.columns)).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_report(summary: DataFrame, details: DataFrame, path: str) -> None:
    """A summary and its details as JSON, side by side under path."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").json(f"{path}/details")


def write_cache(cache: DataFrame, fresh: DataFrame, path: str, key: str = "image_id") -> DataFrame:
    """The cache with fresh rows in place of older ones of their key, written and read back; same columns in both."""
    old = cache.join(fresh.select(key).distinct(), key, "left_anti")
    replace_lines(old.unionByName(fresh), path)
    return read_lines(cache.sparkSession, path, cache.schema)


#: The folder of marks, of which the last names the version that holds; and how many versions stay.
MARKS, VERSIONS = "_marks", 8


def _files(spark: SparkSession, path: str):
    """Hadoop's file context for a path, and a maker of paths."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[str]:
    """The names of all whole versions under path, the oldest first."""
    fc, at = _files(spark, path)
    if not fc.util().exists(at(path)):
        return []
    names = [f.getPath().getName() for f in fc.util().listStatus(at(path))]
    return sorted(n for n in names if n.startswith("v") and fc.util().exists(at(f"{path}/{n}/_SUCCESS")))


def _marks(spark: SparkSession, path: str) -> list[str]:
    fc, at = _files(spark, path)
    if not fc.util().exists(at(f"{path}/{MARKS}")):
        return []
    return sorted(f.getPath().getName() for f in fc.util().listStatus(at(f"{path}/{MARKS}")))


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder that holds now, or None before the first write."""
    marks = _marks(spark, path)
    return f"{path}/{marks[-1].split('.', 1)[1]}" if marks else None


def read_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """The JSON lines of the version that holds now; no rows before the first write."""
    now = current_version(spark, path)
    return spark.read.schema(schema).json(now) if now else spark.createDataFrame([], schema)


def replace_lines(rows: DataFrame, path: str, kept: int = VERSIONS) -> str:
    """Writes JSON lines as a new version under path, then lets it hold by making one mark.

    A mark is made in one step and none is ever replaced, so a reader meets the old or the new version, never none, and goes
    on with the one it found: the last `kept` versions stay (the one before is the backup). Rows may come from the version
    that holds. A write that fails leaves all as it was.
    """
    spark = rows.sparkSession
    before = versions(spark, path)
    name = f"v{int(before[-1][1:].split('-')[0]) + 1 if before else 0:09d}-{uuid.uuid4().hex[:8]}"
    rows.write.json(f"{path}/{name}")
    point_at(spark, path, name)
    fc, at = _files(spark, path)
    for old in [v for v in versions(spark, path) if v != name][: -(kept - 1) or None]:
        fc.delete(at(f"{path}/{old}"), True)
    for old in _marks(spark, path)[:-kept]:
        fc.delete(at(f"{path}/{MARKS}/{old}"), True)
    return f"{path}/{name}"


def point_at(spark: SparkSession, path: str, name: str) -> None:
    """Lets a version of path hold, an older one too."""
    if name not in versions(spark, path):
        raise FileNotFoundError(f"{path}/{name}")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    marks = _marks(spark, path)
    following = int(marks[-1].split(".", 1)[0]) + 1 if marks else 0
    if not fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARKS}/{following:09d}.{name}")):
        raise OSError(f"cannot mark {name}")


def kept_lines(lines: DataFrame, schema: str, keep, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines that keep() holds for, and counts: kept, dropped, bad."""
    from .readers import json_lines

    parsed = json_lines(lines, schema, line)
    good = F.col("ok") & F.coalesce(keep, F.lit(False))
    counts = parsed.agg(F.count_if(good).alias("kept"), F.count_if(F.col("ok") & ~F.coalesce(keep, F.lit(False))).alias("dropped"), F.count_if(~F.col("ok")).alias("bad"))
    return parsed.filter(good).select("row.*"), counts
