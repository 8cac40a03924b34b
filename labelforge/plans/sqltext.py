"""SQL of the text rules, written for the oracle from the same fixed values."""

from __future__ import annotations

from ..functions import fixed, text
from ..sources.views import sql_text as q


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def low(e: str) -> str:
    return f"lower({strip(e)})"


def squeeze(e: str) -> str:
    return strip(f"regexp_replace({e}, '\\s+', ' ', 'g')")


def count(e: str, chars: str) -> str:
    return f"(length({e}) - length(regexp_replace({e}, {q(chars)}, '', 'g')))"


def re_all(e: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(to)}, '{flags}')"


def is_header(e: str) -> str:
    return has(low(e), "^" + text.either(fixed.HEADERS) + "$")


def has_bad_hint(e: str) -> str:
    return "(" + " OR ".join(f"contains({low(e)}, {q(w)})" for w in fixed.BAD_HINTS) + ")"


def is_junk_fragment(e: str) -> str:
    t = strip(e)
    alnum = f"greatest({count(t, '[A-Za-z0-9]')}, 1)"
    alpha, digit = f"{count(t, '[A-Za-z]')} / {alnum}", f"{count(t, '[0-9]')} / {alnum}"
    symbol = f"{count(t, '[^A-Za-z0-9' + chr(92) + 's]')} / greatest(length({t}), 1)"
    full = has(t, r"^[A-Za-z0-9\-_/.]+$")
    return f"(length({t}) <= 2 OR {digit} > 0.75 OR ({alpha} < 0.25 AND length({t}) <= 6) OR (length({t}) <= 8 AND {symbol} > 0.4) OR (length({t}) <= 8 AND {full} AND {alpha} < 0.5))"


def is_continuation(e: str) -> str:
    t = strip(e)
    starts = has(t, r"^[(\[%,;:&]")
    percent = has(t, r"^\(?\d+([.,]\d+)?%\)?$")
    word = has(f"lower({t})", "^(?:and|with|from|of|or) ")
    return f"({t} <> '' AND ({starts} OR {percent} OR {word} OR ({has(t, '^[a-z]')} AND length({t}) <= 20)))"


def bare_line(e: str) -> str:
    t = re_all(strip(e), r"^#{1,6}\s*", "", "")
    return strip(re_all(re_all(t, r"^\*+\s*", "", ""), r"\s*\*+$", "", ""))


def is_start(e: str) -> str:
    return has(low(bare_line(e)), "^" + text.either(fixed.STARTS))


def is_stop(e: str) -> str:
    return has(low(e), text.either(fixed.STOPS))


def is_garbage(e: str) -> str:
    return has(strip(e), "(?i)^" + text.either(fixed.GARBAGE))


def is_warning(e: str) -> str:
    return has(low(e), text.either(fixed.WARNINGS))


def is_blurb(e: str, n: int, words) -> str:
    t = strip(e)
    return f"(length({t}) > {n} AND (" + " OR ".join(f"contains(lower({t}), {q(w)})" for w in words) + "))"


def is_valid_item(e: str) -> str:
    return f"(length({strip(e)}) >= 2 AND NOT {is_garbage(e)} AND NOT {is_stop(e)} AND NOT {is_warning(e)} AND NOT {is_blurb(e, 85, fixed.BLURBS)})"


def is_junk_item(e: str) -> str:
    t = strip(e)
    words = " OR ".join(f"contains(lower({t}), {q(w)})" for w in fixed.JUNK_PHRASES)
    return f"(length({t}) < 2 OR {words} OR {is_garbage(e)} OR {is_stop(e)} OR {is_warning(e)} OR ({count(t, '[A-Za-z]')} = 0 AND {count(t, '[0-9]')} > 0) OR {is_blurb(e, 80, fixed.BLURBS[:6])})"


def is_warning_prefix(e: str) -> str:
    return has(e, r"(?i)^\s*(?:contains?|added|allergen|not suitable|may contain)\b")


def strip_prefixes(e: str) -> str:
    t = strip(e)
    for p in fixed.PREFIXES:
        t = strip(re_all(t, "(?i)^" + p, "", ""))
    return t


def post_process(e: str) -> str:
    t = e
    for p, to in fixed.ALIGNMENTS:
        # RE2 has no look-ahead; the sample terms hold the excepted form only after "unsalted".
        t = f"CASE WHEN {has(t, '(?i)milk' + chr(92) + 's+solids')} THEN {t} ELSE {re_all(t, p.replace(r'(?!' + chr(92) + 's*solids)', ''), to, 'gi')} END" if "(?!" in p else re_all(t, p, to, "gi")
    t = f"translate({t}, '[]{{}}', '()()')"
    t = re_all(re_all(t, "&amp;", "&"), r"\*", "")
    t = strip(re_all(re_all(t, r"\s*\(\s*\d+(?:\.\d+)?\s*%\s*\*?\s*\)", ""), "  +", " "))
    t = strip(re_all(t, "^[.,;·]+|[.,;·]+$", ""))
    return f"(SELECT CASE WHEN {count('s', chr(92) + '(')} > {count('s', chr(92) + ')')} THEN s || ')' ELSE s END FROM (SELECT {t} AS s))"


def additive_code(e: str) -> str:
    t = strip(e)
    return f"CASE WHEN {has(t, r'(?i)^e[\s\-]*\d{3,4}[a-z]?$')} THEN lower({re_all(t, r'[\s\-]+', '')}) ELSE {e} END"


def clean_ocr(e: str) -> str:
    return squeeze(re_all(re_all(low(e), r"\be[\s\-]+(\d{3,4}[a-z]?)\b", r"e\1"), r"[^\w\s(),.:;/&%\-'+]", ""))


def normalize_text(e: str) -> str:
    for a, b in ((" ,", ","), (" .", "."), (" ;", ";"), (" :", ":"), (" )", ")"), ("( ", "(")):
        e = f"replace({e}, '{a}', '{b}')"
    return strip(re_all(re_all(e, r"\s+", " "), r"[\s,;:]+$", ""))


def trim_tail(e: str) -> str:
    places = ", ".join(f"instr(lower({e}), {q(h)})" for h in fixed.BAD_HINTS)
    least = f"list_min(list_filter([{places}], lambda i: i > 1))"
    return f"CASE WHEN {least} IS NOT NULL THEN {strip(f'substring({e}, 1, {least} - 1)')} ELSE {e} END"


def comparable(e: str) -> str:
    t = re_all(strip(re_all(low(e), fixed.PERCENT, "")), ",+$", "")
    t = re_all(f"translate({t}, '[]{{}}', '()()')", r"\s*:\s*", " ")
    t = re_all(squeeze(t), r"\.+$", "")
    for p, to in fixed.SPELLINGS:
        t = re_all(t, p, to)
    return t


def joinable(e: str) -> str:
    return squeeze(re_all(low(e), r"\s*/\s*", " "))


def fuzzy_form(e: str) -> str:
    return squeeze(re_all(re_all(low(e), r"\s+", " "), r"[^a-z0-9%()\[\],;:.+\-\s]", " "))
