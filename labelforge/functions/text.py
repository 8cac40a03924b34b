"""Label text: tests and rewrites of single strings, as column expressions.

White space, letters and digits are the ASCII ones unless a rule says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in " _" and ord(c) < 128 else c for c in text)


def either(patterns: Iterable[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def phrases(words: Iterable[str]) -> str:
    return either(quoted(w) for w in words)


def holds_any(c: Column, words: Iterable[str]) -> Column:
    """Whether any of the words is in a text, which is made once; words that hold another are not asked for."""
    words = list(dict.fromkeys(words))
    least = [w for w in words if not any(o != w and o in w for o in words)]
    return F.exists(F.array(c), lambda t: reduce(lambda a, w: a | t.contains(w), least[1:], t.contains(least[0])))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s\s+|[^\S ]", " "))


def low(c: Column) -> Column:
    return F.lower(strip(c))


def count(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, f"{chars}+", ""))


# --- box texts ----------------------------------------------------------------------------------


def is_header(c: Column) -> Column:
    return low(c).rlike("^" + either(fixed.HEADERS) + "$")


def has_bad_hint(c: Column) -> Column:
    return holds_any(low(c), fixed.BAD_HINTS)


def is_junk_fragment(c: Column) -> Column:
    return stripped_junk(strip(c))


def stripped_junk(t: Column) -> Column:
    """is_junk_fragment of a stripped text; what is cheap comes first."""
    n, alnum, digits = F.length(t), F.greatest(count(t, "[A-Za-z0-9]"), F.lit(1)), count(t, "[0-9]")
    alpha, symbol = count(t, "[A-Za-z]") / alnum, count(t, r"[^A-Za-z0-9\s]") / F.greatest(n, F.lit(1))
    return (n <= 2) | ((n <= 6) & (alpha < 0.25)) | ((n <= 8) & (symbol > 0.4)) | ((n <= 8) & t.rlike(r"^[A-Za-z0-9\-_/.]+$") & (alpha < 0.5)) | ((digits > 0) & (digits / alnum > 0.75))


def is_continuation(c: Column) -> Column:
    return stripped_continuation(strip(c))


def stripped_continuation(t: Column) -> Column:
    """is_continuation of a stripped text."""
    return (t != "") & (t.rlike(r"^[(\[%,;:&]") | t.rlike(r"^\(?\d+([.,]\d+)?%\)?$") | F.lower(t).rlike("^(?:and|with|from|of|or) ") | (t.rlike("^[a-z]") & (F.length(t) <= 20)))


# --- sections and list items --------------------------------------------------------------------


def bare_line(c: Column) -> Column:
    """A line without Markdown heading marks and surrounding asterisks."""
    t = F.regexp_replace(strip(c), r"^#{1,6}\s*", "")
    return strip(F.regexp_replace(F.regexp_replace(t, r"^\*+\s*", ""), r"\s*\*+$", ""))


def is_start(c: Column) -> Column:
    return low(bare_line(c)).rlike("^" + either(fixed.STARTS))


def is_stop(c: Column) -> Column:
    return low(c).rlike(either(fixed.STOPS))


def is_garbage(c: Column) -> Column:
    return strip(c).rlike("(?i)^" + either(fixed.GARBAGE))


def is_warning(c: Column) -> Column:
    return low(c).rlike(either(fixed.WARNINGS))


def is_blurb(c: Column, longer_than: int, words: Iterable[str]) -> Column:
    t = strip(c)
    return (F.length(t) > longer_than) & F.lower(t).rlike(phrases(words))


def is_valid_item(c: Column) -> Column:
    return (F.length(strip(c)) >= 2) & ~is_garbage(c) & ~is_stop(c) & ~is_warning(c) & ~is_blurb(c, 85, fixed.BLURBS)


def is_image_line(c: Column) -> Column:
    return strip(c).rlike(r"^!\[[^\]]*\]\([^)]*\)\s*$")


def is_junk_item(c: Column) -> Column:
    t = strip(c)
    digits_only = (count(t, "[A-Za-z]") == 0) & (count(t, "[0-9]") > 0)
    return (F.length(t) < 2) | F.lower(t).rlike(phrases(fixed.JUNK_PHRASES)) | is_garbage(c) | is_stop(c) | is_warning(c) | digits_only | is_blurb(c, 80, fixed.BLURBS[:6])


def is_warning_prefix(c: Column) -> Column:
    return c.rlike(r"(?i)^\s*(?:contains?|added|allergen|not suitable|may contain)\b")


def strip_prefixes(c: Column) -> Column:
    return reduce(lambda t, p: strip(F.regexp_replace(t, "(?i)^" + p, "")), fixed.PREFIXES, strip(c))


def before_stop(line: Column) -> Column:
    """The part of a line before its first stop pattern, stripped."""
    at = F.regexp_instr(F.lower(line), F.lit(either(fixed.STOPS)))
    return strip(F.when(at > 0, F.substring(line, F.lit(1), at - 1)).otherwise(line))


def after_start(line: Column) -> Column:
    """A start line's remainder: without the first start pattern that takes something away."""
    t = bare_line(line)
    out = t
    for p in reversed(fixed.STARTS):
        cut = strip(F.regexp_replace(t, "(?i)" + p, ""))
        out = F.when(cut != t, cut).otherwise(out)
    return out


def section(text: Column) -> Column:
    """The ingredient section of a text: start lines open it and give their remainder, a stop ends it.

    Without a section the whole text. One fold over the lines; the state is (open, done, lines).
    """
    state = F.struct(F.lit(False).alias("open"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, raw: Column) -> Column:
        line = strip(raw)
        rest = after_start(line)
        opened = F.struct(F.lit(True).alias("open"), F.lit(False).alias("done"), F.when(rest != "", F.array_append(a["out"], rest)).otherwise(a["out"]).alias("out"))
        kept = before_stop(line)
        stopped = F.lower(line).rlike(either(fixed.STOPS))
        inner = F.struct(F.lit(True).alias("open"), stopped.alias("done"), F.when(kept != "", F.array_append(a["out"], kept)).otherwise(a["out"]).alias("out"))
        return F.when(a["done"] | (line == ""), a).when(is_start(line), opened).when(~a["open"] | is_image_line(line), a).otherwise(inner)

    lines = F.aggregate(F.split(text, "\n"), state, step, lambda a: a["out"])
    return F.when(F.size(lines) == 0, text).otherwise(F.array_join(lines, " "))


# --- rewrites -----------------------------------------------------------------------------------


def replace_all(c: Column, rules: Iterable[tuple[str, str]], flags: str = "") -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, flags + r[0], r[1]), rules, c)


def post_process(c: Column) -> Column:
    """Normalises an item: alignments, brackets, percentages, accents, marks; closes one open parenthesis."""
    t = replace_all(c, fixed.ALIGNMENTS, "(?i)")
    t = F.translate(t, "[]{}", "()()")
    t = F.regexp_replace(F.regexp_replace(t, "&amp;", "&"), r"\*", "")
    t = F.regexp_replace(t, r"\s*\(\s*\d+(?:\.\d+)?\s*%\s*\*?\s*\)", "")
    t = strip_accents(t)
    t = strip(F.regexp_replace(t, "  +", " "))
    t = strip(F.regexp_replace(t, "^[.,;·]+|[.,;·]+$", ""))
    return F.when(count(t, r"\(") > count(t, r"\)"), F.concat(t, F.lit(")"))).otherwise(t)


#: Letters with marks of Latin-1 and Latin Extended-A that decompose, and their plain letters.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĚěĘęĞğĪīĽľŃńŇňŌōŐőŘřŚśŞşŠšŢţŤťŪūŮůŰűŹźŻżŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeGgIiLlNnNnOoOoRrSsSsSsTtTtUuUuUuZzZzZz"


def strip_accents(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"[̀-ͯ]", ""), MARKED, PLAIN)


def additive_code(c: Column) -> Column:
    t = strip(c)
    return F.when(t.rlike(r"(?i)^e[\s\-]*\d{3,4}[a-z]?$"), F.lower(F.regexp_replace(t, r"[\s\-]+", ""))).otherwise(c)


def clean_ocr(c: Column) -> Column:
    t = F.regexp_replace(low(c), r"\be[\s\-]+(\d{3,4}[a-z]?)\b", "e$1")
    return squeeze(F.regexp_replace(t, r"[^\w\s(),.:;/&%\-'+]", ""))


def normalize_text(c: Column) -> Column:
    t = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), ((" ,", ","), (" .", "."), (" ;", ";"), (" :", ":"), (" )", ")"), ("( ", "(")), c)
    return strip(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"[\s,;:]+$", ""))


def trim_tail(c: Column) -> Column:
    """Cuts at the least first place (not the very first) of any hint."""
    places = lambda t: F.array_min(F.filter(F.array(*[F.instr(t, h) for h in fixed.BAD_HINTS]), lambda i: i > 1))
    at = F.get(F.transform(F.array(F.lower(c)), lambda t: F.when(holds_any(t, fixed.BAD_HINTS), places(t))), F.lit(0))
    return F.when(at > 1, strip(F.substring(c, F.lit(1), at - 1))).otherwise(c)


def drop_junk_lines(c: Column, hints: bool = True) -> Column:
    """Without hints no line is asked for them; the text must hold none."""
    lines = F.transform(F.split(c, r"\r\n|[\n\r]"), strip)
    junk = lambda t: stripped_junk(t) | holds_any(F.lower(t), fixed.BAD_HINTS) if hints else stripped_junk(t)
    return strip(F.array_join(F.filter(lines, lambda t: (t != "") & ~junk(t)), "\n"))


def tidy_text(c: Column, hinted: Column | None = None) -> Column:
    """hinted: whether the text holds a bad hint, where that is known already."""
    whole = normalize_text(drop_junk_lines(trim_tail(c)))
    return whole if hinted is None else F.when(hinted, whole).otherwise(normalize_text(drop_junk_lines(c, hints=False)))


def comparable(c: Column) -> Column:
    """An item for comparison: no percentages, one bracket style, aligned spellings; may be empty."""
    t = F.regexp_replace(strip(F.regexp_replace(low(c), fixed.PERCENT, "")), ",+$", "")
    t = F.regexp_replace(F.translate(t, "[]{}", "()()"), r"\s*:\s*", " ")
    return replace_all(F.regexp_replace(squeeze(t), r"\.+$", ""), fixed.SPELLINGS)


def joinable(c: Column) -> Column:
    return squeeze(F.regexp_replace(low(c), r"\s*/\s*", " "))


def fuzzy_form(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(low(c), r"\s+", " "), r"[^a-z0-9%()\[\],;:.+\-\s]", " "))


# --- splitters ----------------------------------------------------------------------------------


def pieces(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda t: t != "")


def split_depth(c: Column, clamp: bool, seps: str, words: tuple[str, ...] = (), also: str = "") -> Column:
    """Splits at separators outside parentheses; one fold over tokens (words, separators, parentheses, runs of the rest).

    clamp: a stray closing parenthesis does not go below depth 0. Otherwise it stops all later splits.
    """
    # No word begins inside a run.
    run = f"[^(){seps}{also}" + "".join(quoted(w[0]) for w in words) + "]+"
    token = "(?is)" + "".join(quoted(w) + "|" for w in words) + f"[{seps}{also}]|[()]|{run}|."
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))
    cut = "(?is)^(?:" + "".join(quoted(w) + "|" for w in words) + f"[{seps}{also}])$"

    def step(a: Column, t: Column) -> Column:
        depth = a["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        depth = F.greatest(depth, F.lit(0)) if clamp else depth
        more = F.struct(depth.alias("depth"), F.concat(a["now"], t).alias("now"), a["out"].alias("out"))
        part = strip(a["now"])
        ended = F.struct(a["depth"].alias("depth"), F.lit("").alias("now"), F.when(part != "", F.array_append(a["out"], part)).otherwise(a["out"]).alias("out"))
        return F.when((a["depth"] == 0) & t.rlike(cut), ended).otherwise(more)

    def last(a: Column) -> Column:
        return F.when(strip(a["now"]) != "", F.array_append(a["out"], strip(a["now"]))).otherwise(a["out"])

    return F.aggregate(F.regexp_extract_all(c, F.lit(token), F.lit(0)), state, step, last)


def split_ingredients(c: Column) -> Column:
    """Items of a label text: at and, or, a lone period, &, commas, semicolons, dots and line ends, outside parentheses."""
    return split_depth(strip(c), True, r",;&·•\n\r\x0B\f\u0085  ", (" and ", " or ", " . "))


def split_commas(c: Column) -> Column:
    return split_depth(c, False, ",")


def parse_product_list(c: Column) -> Column:
    """Items of a product's ingredient text: prefixes off, commas outside parentheses, percentages and marks off."""
    t = strip(c)
    for p in ("ingredients:", "ingredients", "contains:"):
        t = F.when(F.lower(t).startswith(p), strip(F.substring(t, F.lit(len(p) + 1), F.length(t)))).otherwise(t)

    def clean(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r"\d+(\.\d+)?%", ""), r"^[ .,;:]+|[ .,;:]+$", "")
        return strip(F.regexp_replace(x, r"\([0-9%\s.,]+\)", ""))

    return F.filter(F.transform(split_commas(t), clean), lambda x: F.length(x) > 1)


def strip_functional(c: Column) -> Column:
    """Parts behind a functional heading; other texts as they are, in an array; none if blank."""
    t = strip(c)
    head = squeeze(F.lower(F.substring_index(t, ":", 1)))
    tail = strip(F.substring(t, F.instr(t, ":") + 1, F.length(t)))
    none = F.array().cast("array<string>")
    named = t.contains(":") & head.isin(*fixed.FUNCTIONAL_HEADS)
    return F.when(t == "", none).when(~named, F.array(t)).when(tail == "", none).otherwise(split_commas(tail))


def distinct_items(items: Column) -> Column:
    """Items without later ones that differ in case or outer white space alone."""
    keys = F.transform(items, low)
    return F.filter(items, lambda x, i: F.array_position(keys, low(x)) == i + 1)
