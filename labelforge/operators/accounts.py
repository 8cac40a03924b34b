"""Users, profiles, tokens and scan history: changes as joins that give the new table, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(old: DataFrame, patch: DataFrame, key: str, defaults: dict[str, object], full: bool = False) -> DataFrame:
    """Rows of old overlaid by patch: null fields of a patch leave the old value (full: only the key decides).

    Keys that are new take defaults for what the patch leaves open.
    """
    cols = list(defaults)
    p = patch.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(p, old[key] == p["_key"], "full")

    def of(c: str) -> Column:
        low = F.lit(defaults[c]) if not isinstance(defaults[c], Column) else defaults[c]
        if full:
            return F.when(F.col("_new").isNotNull(), F.coalesce(f"_{c}", low)).otherwise(F.col(c))
        return F.coalesce(f"_{c}", F.when(F.col("_old").isNotNull(), F.col(c)), low)

    return both.select(F.coalesce("_key", key).alias(key), *[of(c).alias(c) for c in cols])


def with_defaults(users: DataFrame, profiles: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Each user's profile, or the default one."""
    return users.select(key).join(profiles, key, "left").select(key, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


def unique_inserts(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New rows none of whose keys is taken; of new rows that share a key the first by id stays."""
    for k in keys:
        new = new.join(old.select(k).distinct(), k, "left_anti")
    for k in keys:
        new = new.withColumn("_r", F.row_number().over(Window.partitionBy(k).orderBy("id"))).filter("_r = 1").drop("_r")
    return new


def live_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    return tokens.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > now))


def rotated(tokens: DataFrame, used: DataFrame, issued: DataFrame) -> DataFrame:
    """Tokens without the used ones, with the issued ones."""
    return tokens.join(used.select("token"), "token", "left_anti").unionByName(issued)


def without_children(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return children.join(gone.select(key), key, "left_anti")


def history_page(scans: DataFrame, user_id: int, skip: int = 0, limit: int = 50) -> DataFrame:
    """A user's scans, the newest first, ties by the higher id."""
    return scans.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.desc("id")).offset(skip).limit(limit)


def history_pages(scans: DataFrame, skip: int, limit: int) -> DataFrame:
    """The same page of every user, with has_more (the page is full)."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    page = scans.withColumn("place", F.row_number().over(w)).filter(F.col("place").between(skip + 1, skip + limit))
    return page.withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy("user_id")) == limit)


def natural_key(name: Column, width: int = 12) -> Column:
    """A key that sorts digit runs by number and the rest without case."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(F.regexp_replace(r, "^0+(?=[0-9])", ""), width, "0")).otherwise(r)), "")


def ago(then: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    n = F.floor(s / 60)
    return (
        F.when(n < 60, F.concat(n.cast("string"), F.lit("m ago")))
        .when(n < 1440, F.concat(F.floor(n / 60).cast("string"), F.lit("h ago")))
        .when(n < 10080, F.concat(F.floor(n / 1440).cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(then, "MMM d"))
    )


def cached_or_new(wanted: DataFrame, cache: DataFrame, key: str, compute) -> DataFrame:
    """Cached values where there are any that are not blank; the rest computed."""
    held = cache.filter(F.trim("value") != "").select(key, "value")
    hits = wanted.join(held, key).withColumn("cached", F.lit(True))
    return hits.unionByName(compute(wanted.join(held, key, "left_anti")).withColumn("cached", F.lit(False)), allowMissingColumns=True)
