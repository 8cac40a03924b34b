"""Prompts for checking items against a diet, and other texts that are made from rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.terms import BANNED

#: Profile flags in the order in which a prompt names them.
FLAGS = (("vegan", "vegan"), ("vegetarian", "vegetarian"), ("halal", "halal"), ("gluten_free", "gluten-free"), ("dairy_free", "dairy-free"), ("nut_free", "nut-free"))
NO_DIET = '\nReply with JSON: {"is_safe": true, "warnings": [], "analysis_result": "No dietary restrictions set."}'
REPLY = '\nReply with JSON only: {"is_safe": true/false, "warnings": ["item: reason"], "analysis_result": "one sentence"}'


def diet_prompt(items: Column, flags: dict[str, Column], allergens: Column, custom: Column) -> Column:
    """The question whether items suit a profile; terms that are not allowed are named once, without regard to case."""
    none = F.array().cast("array<string>")
    own, more = F.coalesce(allergens, none), F.coalesce(custom, none)
    labels = [F.when(flags[f], F.array(F.lit(name))).otherwise(none) for f, name in FLAGS]
    labels.append(F.when(F.size(own) > 0, F.array(F.concat(F.lit("allergic to "), F.array_join(own, ", ")))).otherwise(none))
    labels.append(F.when(F.size(more) > 0, F.array(F.concat(F.lit("custom: "), F.array_join(more, ", ")))).otherwise(none))
    terms = [F.when(flags[f], F.array(*[F.lit(t) for t in BANNED[name]])).otherwise(none) for f, name in FLAGS]
    diet, banned = F.concat(*labels), F.concat(*terms, own, more)
    once = F.aggregate(banned, none, lambda a, t: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(t)), a).otherwise(F.array_append(a, t)))
    listed = F.concat(F.lit("Ingredients: "), F.array_join(items, ", "))
    asked = F.concat(F.lit("Is this food safe for someone who is "), F.array_join(diet, ", "), F.lit("?\nNOT ALLOWED: "), F.array_join(once, ", "), F.lit("\n"), listed, F.lit(REPLY))
    return F.when(F.size(diet) == 0, F.concat(listed, F.lit(NO_DIET))).otherwise(asked)


def error_text(details: Column, plain: Column) -> Column:
    """The messages of validation details joined; without details the plain one, or a fixed text."""
    return F.when(details.isNotNull(), F.array_join(F.transform(details, lambda d: d["msg"]), ", ")).otherwise(F.coalesce(F.nullif(plain, F.lit("")), F.lit("Validation error")))


def label_text(items: Column, form: str = "comma_separated") -> Column:
    """A label's text made from items, for tests: one line, or a line each."""
    joined = F.array_join(items, "\n" if form == "newline" else ", ")
    return F.concat(F.lit("Ingredients:\n" if form == "newline" else "Ingredients: "), joined)


def noisy(c: Column, seed: int, percent: int = 10) -> Column:
    """Misread characters by a hash of seed, text and place: substituted, dropped or doubled, a third each."""
    swap = F.create_map(*[F.lit(x) for pair in fixed.NOISE.items() for x in pair])

    def one(ch: Column, i: Column) -> Column:
        mark = F.md5(F.concat_ws(":", F.lit(str(seed)), c, i.cast("string")).cast("binary"))
        h = F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % 300
        hit = h < 3 * percent
        return F.when(hit & (h % 3 == 0), F.coalesce(swap[ch], ch)).when(hit & (h % 3 == 1), F.lit("")).when(hit, F.concat(ch, ch)).otherwise(ch)

    return F.array_join(F.transform(F.split(c, ""), one), "")


def stored_at(c: Column) -> Column:
    """A row's time, or now: the default of a table's column."""
    return F.coalesce(c, F.current_timestamp())


def image_name(user: Column, token: Column, suffix: str = "_image.jpg") -> Column:
    """Where an upload is stored: user, eight hexadecimal digits of a random token, suffix."""
    return F.concat(user.cast("string"), F.lit("_"), F.substring(F.replace(text.low(token), F.lit("-"), F.lit("")), 1, 8), F.lit(suffix))
