"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

1. A page becomes a tree of its block elements with its texts. Runs of equal siblings (or of equal groups of siblings)
   fold into repeated groups: the page's own expression, without texts.
2. Distinct expressions of a host are aligned one after the other: what only some have becomes optional, what repeats
   in any becomes repeated. The result is the host's wrapper; its text places are numbered.
3. All pages of the host are aligned with the wrapper once more, now with their texts. At each place texts that differ
   from page to page are content (slots), a text that most pages of the place have is part of the template, and a
   place whose characters stand mostly in links is a menu.
4. Each page is read through its host's wrapper: texts in article or main elements count, but for the template's
   notices in fixed places. A page without these elements gives the content of the other places: neither template nor
   menu.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Distinct trees of a host that one task aligns; more are aligned in groups first, then the groups' wrappers.
ALIGNED = 256
#: Wrappers sent to all executors, at most; beyond it pages and wrappers are joined by shuffling, a host in SALTS parts.
SENT_HOSTS, SALTS = 2000, 16
#: Groups of siblings are tried as repeated groups up to this length; more than WIDE children that do not fold become
#: one repeated group of optional elements, ( a? b? c? )*. Elements below DEEP levels stand at that level.
PERIOD, WIDE, DEEP = 4, 64, 100
#: A text is the template's if so many pages, and this share of those with its place, have it there: outside article
#: and main; in them (at a place that does not repeat and is no heading).
OUTSIDE, INSIDE = (2, 0.5), (8, 0.9)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
TELLING = re.compile("class|id|role|hidden", re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
BLOCKS = frozenset(
    "html head body address article aside blockquote canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead title tr ul button textarea iframe object svg template label".split()
)
RAW = ("script", "style")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of the first kind ends where one of the second starts.
PARAGRAPHS = BLOCKS - {"option", "button", "label", "svg", "select", "textarea", "object"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements, roles and words of class or id that hold no main text.
DROPPED = frozenset("head title nav aside footer form button select option textarea label fieldset dialog menu noscript template iframe object svg canvas search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side aside widget widgets header masthead topbar footer foot copyright cookie cookies consent gdpr notice notices alert newsletter subscribe "
    "signup login popup modal overlay comment comments respond reply replies discussion disqus related recommended share sharing social pagination pager "
    "skip toolbar search form".split()
)
#: First parts of names that tell of something else than the element (no-sidebar, has-related).
OTHERS = frozenset("no not has have with without is in".split())
#: Classes and ids of reader comments, in which an article is a comment.
COMMENTS = frozenset("comments comment-list commentlist comments-area respond disqus_thread replies discussion".split())
#: What inline elements with text are out for, and articles whose whole class it is.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
ASIDES = ADVERTS | {"comment", "related", "recommended", "sidebar", "widget"}
ROOTS = ("article", "main")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def judged(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether name and attributes say that an element holds no main text, and that it holds reader comments."""
    bad, comments = name in DROPPED, False
    words = WORDS if name in BLOCKS else ADVERTS
    for key, *values in ATTRIBUTE.findall(attributes) if TELLING.search(attributes) else ():
        value, key = "".join(values).lower(), key.lower()
        if key in ("class", "id"):
            for one in value.split():
                parts = re.split(r"[^a-z0-9]+", one)
                comments = comments or one in COMMENTS
                if name in ROOTS:
                    bad = bad or one in ASIDES
                elif name not in ("html", "body"):
                    bad = bad or (parts[0] not in OTHERS and any(w in words for w in parts))
        elif key == "role":
            bad = bad or (value in ROLES and name in BLOCKS)
        elif key in ("hidden", "aria-hidden"):
            bad = bad or value in ("", "hidden", "true")
    return bad or comments, comments


class _Element:
    __slots__ = ("name", "bad", "comments", "root", "node")

    def __init__(self, name: str, bad: bool, comments: bool, node: list) -> None:
        self.name, self.bad, self.comments, self.root, self.node = name, bad, comments, name in ROOTS, node


def tree(page: str | None) -> list:
    """The page as [label, children]; a text is ["#" and its use, text, whether it is wholly in links].

    Use 2: in an article or main element; 1: outside; 0: in an element that holds no main text. Names of elements
    around the page's first article do not count against it (unless they hold comments).
    """
    page = page or ""
    root: list = ["", []]
    stack, text, links, outside = [_Element("", False, False, root)], [], 0, False
    muted, rooted, at, n = [], False, 0, len(page)

    def flush() -> None:
        nonlocal outside
        block = " ".join("".join(text).split())
        if block:
            use = 0 if any(e.bad for e in stack) else 2 if any(e.root for e in stack) else 1
            stack[-1].node[1].append([f"#{use}", block, not outside])
        text.clear()
        outside = False

    def add(piece: str) -> None:
        nonlocal outside
        if piece and not muted:
            text.append(html.unescape(piece))
            outside = outside or (not links and not piece.isspace())

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        add(page[at : m.start()])
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not end:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else n
        elif name == "a":
            links = 0 if end else 1
        elif name == "br":
            text.append(" ")
        elif name in BLOCKS:
            hidden = bool(muted)
            muted.clear()
            flush()
            if end:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
                continue
            if stack[-1].name == "p" and name in PARAGRAPHS:
                stack.pop()
            for other in CLOSES.get(name, ()):
                if stack[-1].name == other:
                    stack.pop()
            bad, comments = judged(name, attributes)
            inside = name == "header" and any(e.root for e in stack)
            bad = hidden or (not inside if name == "header" else bad)
            if name in ROOTS and not rooted and not bad and not any(e.comments for e in stack):
                rooted = True
                for e in stack:
                    e.bad = False
            node = [name + "!" * bad, []]
            stack[-1].node[1].append(node)
            if name not in VOID and not attributes.rstrip().endswith("/"):
                stack.append(_Element(name, bad, comments, node if len(stack) < DEEP else stack[-1].node))
        elif muted:
            # Within an inline element that holds no main text: up to its own end.
            if name == muted[0]:
                muted.pop() if end else muted.append(name)
        elif not end and name not in VOID and attributes and judged(name, attributes)[0]:
            muted.append(name)
    add(page[at:])
    flush()
    return root


# A wrapper node is [label, quantifier, children]: quantifier "" (once), "?", "+" or "*". Groups have the label "()".


def quantifier(optional: bool, repeated: bool) -> str:
    return "*" if optional and repeated else "?" if optional else "+" if repeated else ""


def _same(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] != "()" or [x[0] for x in a[2]] == [x[0] for x in b[2]])


def folded(items: list) -> list:
    """Equal neighbours and equal neighbouring groups become repeated; too many that stay apart, one group of all."""
    for period in range(1, PERIOD + 1):
        if len(items) <= period:
            break
        out: list = []
        k = 0
        while k < len(items):
            group = items[k : k + period]
            times = 1
            while len(group) == period and len(nxt := items[k + times * period : k + (times + 1) * period]) == period and all(_same(a, b) for a, b in zip(group, nxt)):
                group = [joined(a, b) for a, b in zip(group, nxt)]
                times += 1
            if times == 1:
                out.append(items[k])
                k += 1
                continue
            node = group[0] if period == 1 else ["()", "", group]
            out.append([node[0], quantifier(node[1] in ("?", "*"), True), node[2]])
            k += times * period
        items = out
    return items if len(items) <= WIDE else [["()", "*", mixed(items)]]


def mixed(items: list) -> list:
    """Each label once, optional, with what all its elements hold."""
    by: dict[str, list] = {}
    left = list(reversed(items))
    while left:
        x = left.pop()
        if x[0] == "()":
            left += reversed(x[2])
        else:
            by[x[0]] = joined(by[x[0]], x) if x[0] in by else x
    return [[x[0], quantifier(True, x[1] in ("+", "*")), x[2]] for x in by.values()]


def joined(a: list, b: list) -> list:
    """The least union-free expression found for both nodes, which are of one label."""
    marks = a[1] + b[1]
    return [a[0], quantifier("?" in marks or "*" in marks, "+" in marks or "*" in marks), aligned(a[2], b[2])]


def aligned(a: list, b: list) -> list:
    """Children of both (at most WIDE each): what a longest common subsequence of labels pairs is joined, the rest is optional."""
    if a == b:
        return a
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _same(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and _same(a[i], b[j]):
            out.append(joined(a[i], b[j]))
            i, j = i + 1, j + 1
        else:
            first = j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1])
            node = a[i] if first else b[j]
            i, j = i + first, j + (not first)
            out.append([node[0], quantifier(True, node[1] in ("+", "*")), node[2]])
    return folded(out)


def expression(node: list) -> list:
    """A page's own wrapper: its tree without texts, folded."""
    return [node[0], "", [] if node[0].startswith("#") else folded([expression(c) for c in node[1]])]


class Wrapper:
    """A host's expression as frames: what may stand in an element, in order, and its text places.

    A page's element may go to any of the places of its label, so each of these holds what all of them hold. Frames are
    made as pages lead to them. A place's number follows from the way to it.
    """

    def __init__(self, text: str) -> None:
        self._top = _Frame(json.loads(text), 1, False, False)

    def texts(self, page: list) -> Iterator[tuple[int, int, bool, str, bool]]:
        """(place, use, whether it is a fixed one, text, wholly in links) of a page of this host, in page order.

        Children go along the wrapper's elements; where none of their label is left they start again from its first,
        as in a repeated group. A label without a place is an error: every page has gone into its wrapper.
        """
        todo = [(iter(page[1]), self._top, 0)]
        while todo:
            children, frame, at = todo.pop()
            for node in children:
                spots = frame.where[node[0]]
                k = bisect_left(spots, at)
                spot = spots[k] if k < len(spots) else spots[0]
                many = frame.many[spot]
                at = spot if many else spot + 1
                if node[0].startswith("#"):
                    yield frame.number(spot), int(node[0][1:]), not (many or frame.again or frame.heading), node[1], node[2]
                elif node[1]:
                    todo.append((children, frame, at))
                    todo.append((iter(node[1]), frame.inner(node[0], spot), 0))
                    break


class _Frame:
    def __init__(self, node: list, number: int, again: bool, heading: bool) -> None:
        self._number, self.again, self.heading = number, again, heading
        self.many: list[bool] = []
        self.where: dict[str, list[int]] = {}
        self._nodes: dict[str, list[list]] = {}
        self._united: dict[str, list] = {}
        self._inner: dict[int, _Frame] = {}
        items = [(c, c[1] in ("+", "*")) for c in reversed(node[2])]
        while items:
            c, many = items.pop()
            if c[0] == "()":
                items += [(x, many or x[1] in ("+", "*")) for x in reversed(c[2])]
                continue
            self.where.setdefault(c[0], []).append(len(self.many))
            self._nodes.setdefault(c[0], []).append(c)
            self.many.append(many)

    def number(self, spot: int) -> int:
        return (self._number * 6364136223846793005 + spot + 1442695040888963407) & (1 << 63) - 1

    def inner(self, label: str, spot: int) -> _Frame:
        if spot not in self._inner:
            if label not in self._united:
                self._united[label] = reduce(joined, self._nodes[label])
            heading = self.heading or label in HEADINGS
            self._inner[spot] = _Frame(self._united[label], self.number(spot), self.again or self.many[spot], heading)
        return self._inner[spot]


def read(page: list, wrapper: Wrapper, template: dict[tuple[int, int], tuple[int, int]], menus: set[int]) -> str:
    """The main text of a page's tree through its host's wrapper, blocks joined by line ends.

    template: (place, hash of a text) to the pages that have it there and the pages that have the place; menus: places
    that are mostly links. Texts of use 2 count but for notices of the template; without any, those of use 1 that are
    neither template nor menu; where this leaves nothing, all of use 1 that is not wholly links.
    """
    found: list[list[str]] = [[], [], []]
    for place, use, fixed, text, linked in wrapper.texts(page):
        n, of = template.get((place, mark(text)), (0, 1))
        if use == 2:
            if not fixed or n < INSIDE[0] or n < INSIDE[1] * of:
                found[2].append(text)
        elif use == 1:
            if not linked:
                found[0].append(text)
            if place not in menus and (n < OUTSIDE[0] or n < OUTSIDE[1] * of):
                found[1].append(text)
    return "\n".join(found[2] or found[1] or found[0])


def mark(text: str) -> int:
    """A 64-bit hash of a text, the same in each process."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def _merge(texts) -> str:
    out = None
    for t in sorted(texts):
        node = json.loads(t)
        out = node if out is None else joined(out, node)
    return json.dumps(out, separators=(",", ":"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) of all hosts, inferred from all their pages.

    Pages are reduced to the distinct trees of their host first, so a hot host costs no more than it has
    different trees; these are aligned in groups of about ALIGNED, and the groups' wrappers again.
    """

    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "tree": [json.dumps(expression(tree(p)), separators=(",", ":")) for p in b["html"]]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "tree": [_merge(pdf["tree"])]})

    trees = saved(pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(outline, "host string, tree string").distinct(), "trees")
    most = trees.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > ALIGNED:
        groups = -(-most // ALIGNED)
        part = F.pmod(F.xxhash64("tree"), F.lit(groups)).alias("part")
        trees = saved(trees.groupBy("host", part).applyInPandas(merge, "host string, tree string"), "trees")
        most = groups
    return saved(trees.groupBy("host").applyInPandas(merge, "host string, tree string").withColumnRenamed("tree", "wrapper"), "wrappers")


def _with_models(pages: DataFrame, models: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) with their hosts' models. A host's pages are never all sent to one task."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("_host"))
    if models.count() <= SENT_HOSTS:
        return rows.join(F.broadcast(models), F.col("_host") == F.col("host"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)))
    models = models.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return rows.join(models, (F.col("_host") == F.col("host")) & (F.col("_salt") == F.col("salt")))


def places(pages: DataFrame, made: DataFrame) -> DataFrame:
    """What the texts of all pages say of the places of their host's wrapper: host, template, menus.

    template: (place, hash, n, pages) of texts on at least half of the pages that have the place, and on two at least:
    a place has few such texts, however many pages there are. Pages of equal html count as one.
    """

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Wrapper] = {}
        for b in batches:
            out = []
            for host, page, text in zip(b["host"], b["html"], b["wrapper"]):
                wrapper = known.get(text) or known.setdefault(text, Wrapper(text))
                own, page_mark = {}, mark(page or "")
                for place, use, _, block, linked in wrapper.texts(tree(page)):
                    if use:
                        own[place, mark(block)] = (len(block), len(block) * linked)
                out += [(host, page_mark, *k, *v) for k, v in own.items()]
            yield pd.DataFrame(out, columns=["host", "page", "place", "text", "chars", "linked"])

    rows = _with_models(pages, made).select("host", "html", "wrapper").mapInPandas(lay, "host string, page long, place long, text long, chars long, linked long")
    rows = saved(rows.distinct(), "places")
    whole = rows.groupBy("host", "place", "page").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked")).groupBy("host", "place").agg(F.count(F.lit(1)).alias("pages"), (2 * F.sum("linked") > F.sum("chars")).alias("menu"))
    whole = saved(whole, "places")
    texts = rows.groupBy(F.col("host").alias("_host"), F.col("place").alias("_place"), "text").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OUTSIDE[0])
    texts = texts.join(whole, (F.col("_host") == F.col("host")) & (F.col("_place") == F.col("place"))).filter(F.col("n") >= OUTSIDE[1] * F.col("pages"))
    texts = texts.groupBy("_host").agg(F.collect_list(F.struct("place", "text", "n", "pages")).alias("template"))
    menus = whole.filter("menu").groupBy(F.col("host").alias("_menu")).agg(F.collect_list("place").alias("menus"))
    out = made.join(texts, F.col("host") == F.col("_host"), "left").join(menus, F.col("host") == F.col("_menu"), "left")
    return saved(out.select("host", "wrapper", F.to_json(F.struct("template", "menus")).alias("seen")), "models")


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars; extra columns are not carried.

    Null html is empty and gives an empty text; null urls share one host; rows that repeat a page give equal rows (and
    count once for the template); an empty table gives no rows. Unclosed, very deep and very long pages are read whole.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}
        for b in batches:
            texts = []
            for page, text, seen in zip(b["html"], b["wrapper"], b["seen"]):
                if (text, seen) not in known:
                    told = json.loads(seen)
                    template = {(t["place"], t["text"]): (t["n"], t["pages"]) for t in told.get("template") or ()}
                    known[text, seen] = (Wrapper(text), template, set(told.get("menus") or ()))
                texts.append(read(tree(page), *known[text, seen]))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    models = places(pages, wrappers(pages))
    return _with_models(pages, models).select("page_id", "url", "html", "wrapper", "seen").mapInPandas(work, "page_id long, url string, text string, n_chars long")
