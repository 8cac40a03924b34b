"""Rewrites and splitters of label strings, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..sources import views
from . import sqltext as s
from .catalog import add
from .predicates import by_term

by_term("f9_functional_label", lambda c: F.array_join(text.strip_functional(c), "|"), "CASE WHEN lower(regexp_extract(term, '^([^:]*):', 1)) IN ('raising agent', 'acid') THEN array_to_string(list_filter(list_transform(string_split(substring(term, instr(term, ':') + 1), ','), lambda x: trim(x)), lambda x: x <> ''), '|') ELSE trim(term) END")
by_term("f10_post_process", text.post_process, s.post_process("term"))
by_term("f13_clean_ocr", text.clean_ocr, s.clean_ocr("term"))
by_term("f14_additive_code", text.additive_code, s.additive_code("term"))
by_term("f17_normalize_text", lambda c: text.normalize_text(F.concat(c, F.lit(" ,  ( b ) ;: "))), s.normalize_text("(term || ' ,  ( b ) ;: ')"))
by_term("f18_trim_tail", lambda c: text.trim_tail(F.concat(F.lit("list "), c)), s.trim_tail("('list ' || term)"))
by_term("f22_bare_line", lambda c: text.bare_line(F.concat(F.lit("## **"), c, F.lit("**"))), s.bare_line("('## **' || term || '**')"))
by_term("f23_strip_prefixes", text.strip_prefixes, s.strip_prefixes("term"))
_STOP = s.q(text.either(text.fixed.STOPS))
by_term(
    "f24_before_stop",
    text.before_stop,
    s.strip(f"CASE WHEN regexp_matches(lower(term), {_STOP}) THEN substring(term, 1, instr(lower(term), regexp_extract(lower(term), {_STOP})) - 1) ELSE term END"),
)
by_term("f29_comparable", text.comparable, s.comparable("term"))
by_term("f31_joinable", text.joinable, s.joinable("term"))
by_term("f32_fuzzy_form", text.fuzzy_form, s.fuzzy_form("term"))
by_term("f35_truncate", lambda c: F.when(F.length(c) > 12, F.concat(F.substring(c, 1, 12), F.lit("..."))).otherwise(c), "CASE WHEN length(term) > 12 THEN substring(term, 1, 12) || '...' ELSE term END")
by_term("f27_reply_item", lambda c: text.strip(F.regexp_replace(text.strip(c), r"(?i)^ingredients\s*:\s*", "")), s.strip(s.re_all(s.strip("term"), r"(?i)^ingredients\s*:\s*", "", "")))
by_term("f12_strip_accents", lambda c: text.strip_accents(F.concat(c, F.lit("éÈñçüÅ"))), "strip_accents(term || 'éÈñçüÅ')")

_JOINED = "array_to_string({}, '|')"


def by_list(name: str, expr, sql: str | None) -> None:
    add(name, lambda spark, d: views.lists(spark, d).select("doc_id", expr(F.col("items")).alias("value")), sql and f"WITH {views.SQL_LISTS} SELECT doc_id, {sql} AS value FROM v_lists")


_SPLIT = "list_filter(list_transform(regexp_split_to_array(array_to_string(items, '{}'), '{}'), lambda x: " + s.strip("x") + "), lambda x: x <> '')"
by_list("f4_split_segments", lambda a: F.array_join(text.pieces(F.array_join(a, " | "), r"[\n|;,]+"), "#"), f"array_to_string({_SPLIT.format(' | ', '[' + chr(92) + 'n|;,]+')}, '#')")
by_list("f5_split_lines", lambda a: F.array_join(text.pieces(F.replace(F.array_join(a, ", "), F.lit(","), F.lit("\n")), "\n"), "#"), f"array_to_string({_SPLIT.format(', ', '[,' + chr(92) + 'n]')}, '#')")
by_list("f6_skip_keys", lambda a: F.array_join(F.array_sort(F.array_distinct(F.filter(text.pieces(F.lower(F.array_join(a, ";")), "[,;·•]+"), lambda x: F.length(x) > 1))), "#"), f"array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(array_to_string(items, ';')), '[,;·•]+'), lambda x: {s.strip('x')}), lambda x: length(x) > 1))), '#')")
add(
    "f11_post_process_list",
    lambda sp, d: views.lists(sp, d).select("doc_id", F.array_join(F.filter(F.transform(F.filter("items", lambda x: ~text.is_warning_prefix(x)), text.post_process), lambda x: F.length(x) > 1), "|").alias("value")),
    f"WITH {views.SQL_INGREDIENTS}, e AS (SELECT doc_id, pos, {s.post_process('term')} AS value FROM v_ingredients WHERE NOT {s.is_warning_prefix('term')}), g AS (SELECT doc_id, string_agg(value, '|' ORDER BY pos) AS value FROM e WHERE length(value) > 1 GROUP BY doc_id) SELECT doc_id, coalesce(value, '') AS value FROM documents LEFT JOIN g USING (doc_id)",
)
by_list("f26_filter_items", lambda a: F.array_join(F.filter(F.transform(a, text.strip_prefixes), lambda x: (x != "") & text.is_valid_item(x)), "|"), f"array_to_string(list_filter(list_transform(items, lambda x: {s.strip_prefixes('x')}), lambda x: x <> '' AND {s.is_valid_item('x')}), '|')")
by_list("f30_expand_block", lambda a: F.array_join(F.when(F.size(a) == 3, text.pieces(F.regexp_replace(text.strip(F.get(a, 0)), r"(?i)^ingredients\s*:\s*", ""), ",")).otherwise(a), "|"), f"array_to_string(CASE WHEN len(items) = 3 THEN list_filter(list_transform(string_split({s.re_all(s.strip('items[1]'), r'(?i)^ingredients\s*:\s*', '', '')}, ','), lambda x: {s.strip('x')}), lambda x: x <> '') ELSE items END, '|')")
by_list("f20_join_row", lambda a: text.squeeze(F.array_join(F.filter(a, lambda x: text.strip(x) != ""), " ")), s.squeeze(f"array_to_string(list_filter(items, lambda x: {s.strip('x')} <> ''), ' ')"))
by_list("f19_drop_junk_lines", lambda a: text.drop_junk_lines(F.array_join(a, "\n")), s.strip(f"array_to_string(list_filter(list_transform(items, lambda x: {s.strip('x')}), lambda x: x <> '' AND NOT {s.has_bad_hint('x')} AND NOT {s.is_junk_fragment('x')}), chr(10))"))
by_list("w7_distinct_items", lambda a: F.array_join(text.distinct_items(F.concat(a, F.transform(a, F.upper))), "|"), "array_to_string(list_filter(list_concat(items, list_transform(items, lambda x: upper(x))), lambda x, i: list_position(list_transform(list_concat(items, list_transform(items, lambda y: upper(y))), lambda y: " + s.low("y") + "), " + s.low("x") + ") = i), '|')")
by_list("u2_common_items", lambda a: F.array_join(F.array_sort(F.array_intersect(a, F.slice(a, 2, 3))), "|"), "array_to_string(list_sort(list_distinct(list_intersect(items, items[2:4]))), '|')")
by_list("u3_missing_items", lambda a: F.array_join(F.array_sort(F.array_except(a, F.slice(a, 2, 3))), "|"), "array_to_string(list_sort(list_distinct(list_filter(items, lambda x: NOT list_contains(items[2:4], x)))), '|')")
by_list("u4_append_absent", lambda a: F.array_join(F.concat(a, F.filter(F.array(F.lit("SALT"), F.lit("sesame")), lambda x: ~F.exists(a, lambda y: F.lower(y) == F.lower(x)))), "|"), "array_to_string(list_concat(items, list_filter(['SALT', 'sesame'], lambda x: len(list_filter(items, lambda y: lower(y) = lower(x))) = 0)), '|')")
by_list("u5_append_exact", lambda a: F.array_join(F.concat(a, F.filter(F.array(F.lit("salt"), F.lit("sesame")), lambda x: ~F.array_contains(a, x))), "|"), "array_to_string(list_concat(items, list_filter(['salt', 'sesame'], lambda x: NOT list_contains(items, x))), '|')")
by_list("u6_add_remove", lambda a: F.array_join(F.filter(F.when(F.array_contains(a, "water"), a).otherwise(F.array_append(a, F.lit("water"))), lambda x, i: i != 1), "|"), "array_to_string(list_filter(CASE WHEN list_contains(items, 'water') THEN items ELSE list_append(items, 'water') END, lambda x, i: i <> 2), '|')")
# Splitters with depth are folds. In SQL separators inside parentheses are first changed to other characters and back in the parts.
_SEPS = ",;&·•. \n"


def _split(whole: str, pattern: str, deep: str) -> str:
    """SQL: whole split at the pattern where the depth of parentheses is 0."""
    hidden = "".join(chr(0xE000 + k) for k in range(len(_SEPS)))
    opened = "(length(v[:i]) - length(replace(v[:i], '(', ''))) - (length(v[:i]) - length(replace(v[:i], ')', '')))"
    masked = f"array_to_string(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN {opened} {deep} 0 THEN translate(v[i], {s.q(_SEPS)}, '{hidden}') ELSE v[i] END), '')"
    parts = f"list_filter(list_transform(regexp_split_to_array({masked}, {s.q(pattern)}), lambda x: {s.strip(f'translate(x, {chr(39)}{hidden}{chr(39)}, {s.q(_SEPS)})')}), lambda x: x <> '')"
    return f"list_transform([{whole}], lambda v: {parts})[1]"


_ITEMS = "(?i)(?: and | or | \\. |[,;&·•\\n\\r])"
by_list("f1_split_ingredients", lambda a: F.array_join(text.split_ingredients(F.array_join(a, ", ")), "#"), f"array_to_string({_split(s.strip(_JOINED.format('items').replace('|', ', ')), _ITEMS, '>')}, '#')")
by_list("f3_split_commas", lambda a: F.array_join(text.split_commas(F.array_join(a, ",")), "#"), f"array_to_string({_split(_JOINED.format('items').replace('|', ','), ',', '<>')}, '#')")
_PART = s.strip(s.re_all(s.re_all(s.re_all("y", r"\d+(\.\d+)?%", ""), r"^[ .,;:]+|[ .,;:]+$", ""), r"\([0-9%\s.,]+\)", ""))
by_list(
    "f2_product_list",
    lambda a: F.array_join(text.parse_product_list(F.concat(F.lit("Ingredients: "), F.array_join(a, ", "))), "#"),
    # A second prefix at the start of what is left goes as well, one of each kind.
    f"array_to_string(list_filter(list_transform({_split(s.strip(s.re_all(s.strip(s.re_all(s.strip(s.re_all(s.strip(_JOINED.format('items').replace('|', ', ')), '(?i)^ingredients', '', '')), '(?i)^contains:', '', '')), '^$', '', '')), ',', '<>')}, lambda y: {_PART}), lambda x: length(x) > 1), '#')",
)
by_list("f25_section", lambda a: text.section(F.array_join(a, "\n")), None)
_TIDY = f"list_filter(list_transform(string_split({s.trim_tail('u')}, chr(10)), lambda x: {s.strip('x')}), lambda x: x <> '' AND NOT {s.has_bad_hint('x')} AND NOT {s.is_junk_fragment('x')})"
by_list("f16_tidy_text", lambda a: text.tidy_text(F.array_join(a, "\n")), f"list_transform([array_to_string(items, chr(10))], lambda u: {s.normalize_text(f'array_to_string({_TIDY}, chr(10))')})[1]")
by_list("f8_first_group", lambda a: F.array_join(F.transform(a, lambda x: F.regexp_extract(x, r"\(([^()]*)\)", 1)), "#"), f"array_to_string(list_transform(items, lambda x: regexp_extract(x, '{chr(92)}(([^()]*){chr(92)})', 1)), '#')")
