"""Product documents and model replies: from JSON to columns and lists."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fixed import FUNCTIONAL_HEADS

PRODUCT = (
    "code string, product_name string, product_name_en string, generic_name string, generic_name_en string, brands string, categories string, "
    "categories_en string, ingredients_text string, ingredients_text_en string, ingredients_text_with_allergens string, "
    "ingredients_text_with_allergens_en string, allergens string, allergens_tags array<string>, traces string, traces_tags array<string>, "
    "image_front_url string, image_url string, nutrition_grades string, nova_group int, ecoscore_grade string, quantity string, countries string, "
    "labels string, labels_en string"
)


def first_full(*cols: str) -> Column:
    """The first of the fields that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])


def title(c: Column) -> Column:
    """Capitals after each character that is no letter, small letters elsewhere."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def named_list(plain: Column, tags: Column) -> Column:
    """Names of a comma list and of tags, without language prefix; tags only if not there yet, their dashes as spaces."""
    none = F.array().cast("array<string>")
    names = F.filter(F.transform(F.split(F.coalesce(plain, F.lit("")), ","), lambda x: text.strip(F.substring_index(x, ":", -1))), lambda x: x != "")
    listed = F.transform(names, title)
    more = F.transform(F.coalesce(tags, none), lambda x: title(F.translate(text.strip(F.substring_index(x, ":", -1)), "-", " ")))
    new = F.filter(F.array_distinct(more), lambda x: (x != "") & ~F.array_contains(listed, x))
    return F.concat(listed, new)


def product_columns(products: DataFrame) -> DataFrame:
    """code, name, brand, ingredients, allergens, traces and more of product documents, English fields first."""
    return products.select(
        "code", first_full("product_name_en", "product_name", "generic_name_en", "generic_name").alias("name"), "brands",
        first_full("ingredients_text_en", "ingredients_text", "ingredients_text_with_allergens_en", "ingredients_text_with_allergens").alias("ingredients_text"),
        first_full("categories_en", "categories").alias("categories"), first_full("image_front_url", "image_url").alias("image"), first_full("labels_en", "labels").alias("labels"),
        named_list(F.col("allergens"), F.col("allergens_tags")).alias("allergens"), named_list(F.col("traces"), F.col("traces_tags")).alias("traces"),
    ).withColumn("ingredients", text.parse_product_list(F.coalesce("ingredients_text", F.lit(""))))


def barcode_status(code: Column, found: Column) -> Column:
    c = text.strip(F.coalesce(code, F.lit("")))
    return F.when(c == "", "empty").when(~c.rlike("^[0-9]+$"), "not digits").when(~found, "not found").otherwise("ok")


def lookup(scans: DataFrame, responses: DataFrame) -> DataFrame:
    """Scans (code) with their product: responses are (code, status, product); found if status is 1 and there is a product."""
    found = responses.filter((F.col("status") == 1) & F.col("product").isNotNull())
    found = product_columns(found.select("code", "product.*", F.col("code").alias("_code")).drop("code").withColumnRenamed("_code", "code")).withColumn("_found", F.lit(True))
    rows = scans.withColumn("code", text.strip(F.col("code"))).join(found, "code", "left")
    return rows.withColumn("status", barcode_status(F.col("code"), F.coalesce("_found", F.lit(False)))).drop("_found")


PREAMBLES = tuple(
    re.compile(p, re.M)
    for p in (r"^[Hh]ere\s+(is|are)\s+(the\s+)?(JSON|result|response|answer)[:\s]*", r"^[Ss]ure[,!]?\s*(here\s+(is|are)\s+(the\s+)?)?", r"^[Oo]kay[,!]?\s*", r"^[Cc]ertainly[,!]?\s*", r"^[Ii]'ll\s+.*?:\s*", r"^\s*[Rr]esponse:\s*", r"^\s*[Oo]utput:\s*", r"^\s*[Jj][Ss][Oo][Nn]:\s*")
)  # fixed values
FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def balanced(s: str, left: str, right: str) -> str | None:
    """The first balanced stretch from left to right, brackets inside JSON strings apart."""
    start = s.find(left)
    if start < 0:
        return None
    depth, quoted, skip = 0, False, False
    for k in range(start, len(s)):
        c = s[k]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c == left:
            depth += 1
        elif c == right:
            depth -= 1
            if not depth:
                return s[start : k + 1]
    return None


def repaired_json(raw: str | None) -> str | None:
    """The JSON in a reply as compact text: direct, fenced, first object, first list (as items), cleaned; or null."""
    if not raw:
        return None

    def candidates():
        yield raw.strip(), False
        if m := FENCE.search(raw):
            yield m[1].strip(), False
        yield balanced(raw, "{", "}"), False
        yield balanced(raw, "[", "]"), True
        s = raw.strip()
        for p in PREAMBLES:
            s = p.sub("", s)
        s = s[: max(s.rfind("}"), s.rfind("]")) + 1] or s
        yield balanced(s, "{", "}") or balanced(s, "[", "]") or s.strip(), False

    for c, wrap in candidates():
        if c:
            try:
                got = json.loads(c)
            except ValueError:
                continue
            return json.dumps({"items": got} if wrap and isinstance(got, list) else got, separators=(",", ":"), ensure_ascii=False)
    return None


def repaired(raw: Column) -> Column:
    """Replies that are JSON as they stand, or in a fence, never leave the JVM; the rest is repaired."""

    @F.pandas_udf("string")
    def repair(replies: pd.Series) -> pd.Series:
        return pd.Series([repaired_json(r if isinstance(r, str) else None) for r in replies], dtype=object)

    whole, fenced = text.strip(raw), text.strip(F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1))
    valid = [F.when(F.try_parse_json(c).isNotNull() & (c != ""), F.to_json(F.try_parse_json(c))) for c in (whole, fenced)]
    return F.coalesce(*valid, repair(raw))


def expanded(items: Column) -> Column:
    """Compound items as their parts, at any depth."""

    @F.pandas_udf("array<string>")
    def expand(lists: pd.Series) -> pd.Series:
        return pd.Series([[p for x in xs for p in expand_phrase(x)] for xs in lists])

    return expand(items)


def top_level(s: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(s + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and (depth == 0 or k == len(s)):
            out.append(s[start:k].strip())
            start = k + 1
    return [x for x in out if x]


def expand_phrase(label: str) -> list[str]:
    """Parts of the first parenthesis if there are several, each expanded; else the phrase without a functional heading."""
    s = label.strip()
    if not s:
        return []
    at = s.find("(")
    if at >= 0 and ":" not in s[:at]:
        inner = balanced_parens(s, at)
        parts = top_level(inner) if inner is not None else []
        if len(parts) > 1:
            return [x for p in parts for x in expand_phrase(p)]
    head, colon, tail = s.partition(":")
    if not colon or " ".join(head.lower().split()) not in FUNCTIONAL_HEADS:
        return [s]
    return top_level(tail)


def balanced_parens(s: str, at: int) -> str | None:
    depth = 0
    for k in range(at, len(s)):
        depth += (s[k] == "(") - (s[k] == ")")
        if not depth:
            return s[at + 1 : k].strip()
    return None
