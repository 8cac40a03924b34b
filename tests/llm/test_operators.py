"""Each operator on small awkward tables, against brute force."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelforge.llm import common, decontam, fingerprints, html, lm, mixing, neardup, pii, quality, sharding, shingles, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _lfat string, words string, rep long, `_key` string, sig string"
PHRASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
LONG = " ".join(f"w{k % 977}x{k % 53}" for k in range(30_000))
TEXTS = [
    None, "", "  \n\t ", "alone", "Alone", PHRASE, PHRASE.upper() + " tail words here to end", "x " + PHRASE + " y", LONG, LONG + " more", LONG,
    "mail a.b@c-d.example.org, ip 10.0.0.255 and 300.1.1.1 card 4111 1111 1111 1111 or 4111-1111-1111-1112 tel +1 (212) 555-0100 é",
    "a@b.c_d@e.f 1.2.3.4.5.6.7.8", "naïve été " * 40, "the end. " * 30, "short one two three",
]


def rows_of(texts, sources=("a", "b", None)):
    return [(k, t, "en", sources[k % len(sources)], len(t or ""), "clash", "clash", 7, "clash", "clash") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of(TEXTS)
    return spark.createDataFrame(rows + [rows[5], rows[5], (None, "no id", "en", "a", 5, "c", "c", 1, "c", "c")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_low(t or ""))


def ascii_low(t):
    return t.translate(str.maketrans(common.UPPER, common.LOWER))


# 1 -----------------------------------------------------------------------------------------------
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(g):
    d = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(g))]
    return sum(x - 9 * (x > 9) for x in d) % 10 == 0


def valid(kind, v):
    g = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(x) < 256 for x in v.split(".")) if kind == "ip" else True, "card": 14 <= len(g) <= 19 and luhn(g), "phone": 10 <= len(g) <= 15}[kind]


def plain_spans(t):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t or "") if valid(kind, m.group()))


def test_pii_base_spans(docs, empty):
    for r in pii.find(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert [(s.start, s.kind, s.stop) for s in r.base] == plain_spans(r.text)
        assert r.found == []
    assert pii.report(docs).count() == docs.count() and pii.report(empty).count() == 0


def test_pii_contexts_find_unseen(spark):
    seeds = [f"text number {k} call phone: +1 212 555 {1000 + k} now" for k in range(6)]
    rows = [*seeds, "and then phone: 0207 946 0018 please", "the year 1234 567 890 was", "phone: nothing"]
    got = {r.doc_id: r.found for r in pii.find(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()}
    assert [rows[6][s.start : s.stop] for s in got[6]] == ["0207 946 0018"] and got[6][0].kind == 3
    assert not any(v for k, v in got.items() if k != 6)


def test_pii_planted_identifiers_are_found_and_clean_texts_left_alone(spark):
    """Recall and precision over planted unseen identifiers: long labels, glued labels, words after, chains of contexts."""
    long = "x" * 80
    rows = [f"{k} {long}: +1 212 555 {1000 + k} now" for k in range(6)] + [f"tel:+1 212 555 {2000 + k} a" for k in range(4)]
    rows += [f"r{k} +1 212 555 {7000 + k} anytime" for k in range(9)] + [f"{k} mobile 0207 946 {1000 + k} anytime" for k in range(4)]
    seeds = len(rows)
    planted = [f"a {long}: 0207 946 0018 b", "tel:0207 946 0019 and", "so 0207 946 0044 anytime", "my mobile 0207 946 0099 is new", "mobile 0161 496 0000"]
    clean = ["number 0207 946 0055 here", "the year 1234 567 890 was", "tel: nothing", "anytime 12.5 at 9.30", None, ""]
    rows += planted + clean
    got = {r.doc_id: {rows[r.doc_id][s.start : s.stop] for s in r.found} for r in pii.find(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()}
    want = {seeds: "0207 946 0018", seeds + 1: "0207 946 0019", seeds + 2: "0207 946 0044", seeds + 3: "0207 946 0099", seeds + 4: "0161 496 0000"}
    caught = sum(v in got[k] for k, v in want.items())
    assert caught >= 0.9 * len(want)
    assert not any(got[k] for k in range(seeds + len(planted), len(rows)))


# 2 -----------------------------------------------------------------------------------------------
ITEMS = [(1, PHRASE), (2, "seven eight nine"), (10, "Twelve, thirteen!"), (3, None), (4, "--"), (5, "never seen words at all in here"), (2, "alone")]


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_low(t or ""))


def plain_report(t, items):
    w, hit, names = plain_words(t), set(), set()
    for i, x in items:
        v = plain_words(x)
        for k in range(max(1, len(v) - 12) if v else 0):
            p = v[k : k + 13]
            for s in range(len(w) - len(p) + 1):
                if w[s : s + len(p)] == p:
                    hit |= set(range(s, s + len(p)))
                    names.add(str(i))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.report(docs, items).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == docs.count() - 1
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == plain_report(r.text, ITEMS)
    kept = decontam.keep_clean(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.contaminated} | {None}
    assert decontam.report(empty, items).count() == 0
    assert not decontam.report(docs, items.limit(0)).filter("contaminated").count()


def test_words_are_found_in_few_steps_a_character(spark):
    """The same characters as the contract's class, in well under the time that its union of ranges takes."""
    import time

    given, jvm = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", spark._jvm
    every = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([("".join(map(chr, every[k : k + 4096])),) for k in range(0, len(every), 4096)], "text string")
    both = rows.select(decontam.words_of(F.col("text")).alias("got"), F.regexp_extract_all("text", F.lit(given), F.lit(0)).alias("want"))
    assert both.filter("got <> want").count() == 0

    def seconds(pattern):
        text, best = "Some words, of 3 or 4 kinds; \u00e9t\u00e9 too. " * 20_000, 1e9
        for _ in range(6):
            began = time.perf_counter()
            jvm.java.util.regex.Pattern.compile(pattern).matcher(text).results().count()
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(decontam.WORDS) < 0.7 * seconds(given)


def test_proximity(docs):
    got = decontam.within(docs.filter("doc_id = 5").limit(1), ["three", "nine", "six"], 8).collect()
    assert [(r.start, r.stop) for r in got] == [(2, 8)]


# 3 -----------------------------------------------------------------------------------------------
#: Python writes code points in another way.
PLAIN_TOKEN = fingerprints.TOKEN.replace(r"\x{10FFFF}", "\U0010FFFF")


def plain_xx(*values):
    """Spark's xxhash64 of strings and longs."""
    import xxhash

    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), h & (2**64 - 1))
        h -= (h >= 2**63) << 64
    return h


def plain_int(value, seed):
    import xxhash

    h = xxhash.xxh64_intdigest(int(value).to_bytes(4, "little", signed=True), seed & (2**64 - 1))
    return h - ((h >= 2**63) << 64)


def plain_sketch(t):
    tok = [plain_xx(x) for x in re.findall(PLAIN_TOKEN, t or "")]
    smer = [plain_xx(a, b) for a, b in zip(tok, tok[1:])]
    w, last, out = fingerprints.K - fingerprints.S, None, []
    for i in range(len(smer) - w):
        if min(smer[i], smer[i + w]) <= min(smer[i + 1 : i + w]):
            h = plain_xx(*smer[i : i + w + 1 : 2])
            out.append((plain_int(i - (i if last is None else last), h if False else plain_xx(h)) & (2**64 - 1)) >> 32)
            last = i
    return out + [(x & (2**64 - 1)) >> 32 for x in tok] * (len(tok) < fingerprints.SHORT)


def plain_likeness(a, b):
    return len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0


def test_fingerprints(docs, empty):
    one = docs.dropDuplicates(["doc_id"])
    rows = sorted(one.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = {r.doc_id: r for r in fingerprints.edited(one).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = plain_sketch(t), plain_sketch(e), plain_sketch(n)
        assert got[i].fingerprint == "-".join(f"{x:X}" for x in a) and got[i].edited_fingerprint == "-".join(f"{x:X}" for x in b)
        assert math.isclose(got[i].near_edited, plain_likeness(a, b)) and math.isclose(got[i].near_next, plain_likeness(a, c))
    assert got[8].fingerprint == got[10].fingerprint and got[8].near_edited > 0.3 > got[8].near_edited - 0.6
    assert fingerprints.edited(docs).count() == docs.count() and fingerprints.edited(empty).count() == 0


def test_no_text_with_a_token_has_an_empty_fingerprint(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{x:04d}" for x in rng.integers(0, 10_000, n)) for n in range(1, 26) for _ in range(30)]
    df = fingerprints.with_sketch(spark.createDataFrame([(t, t[:-4] + "edit") for t in texts], "text string, changed string"), "text", "a")
    got = fingerprints.with_sketch(df, "changed", "b").withColumn("near", fingerprints.likeness(F.col("a"), F.col("b"))).collect()
    assert all(r.a and r.b for r in got) and all(0 <= r.near < 1 for r in got if len(r.text) < 28) and all(r.near > 0 for r in got if len(r.text) > 8)


def test_anchors_of_unspaced_texts_are_context_free(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(chr(0x4E00 + x) for x in rng.integers(0, 3000, 4000)), "".join(chr(97 + x) for x in rng.integers(0, 26, 4000)), "".join(chr(0x0E01 + x) for x in rng.integers(0, 40, 4000))]
    df = fingerprints.with_sketch(spark.createDataFrame([(t, "b" + t) for t in texts], "text string, moved string"), "text", "a")
    got = fingerprints.with_sketch(df, "moved", "b").select(fingerprints.likeness(F.col("a"), F.col("b")).alias("near"), F.size("a").alias("n")).collect()
    assert all(r.near > 0.95 and r.n > 100 for r in got)


def test_next_document_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 8)
    ids = [k * k % 997 for k in range(300)]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").distinct()
    order = sorted({*ids})
    nxt = {r.doc_id: r.next_text for r in fingerprints.with_next(df).collect()}
    assert nxt == {a: f"text {b}" for a, b in zip(order, order[1:] + order[:1])}


def test_closed_syncmers_are_context_free(spark):
    base = " ".join(f"tok{k * 7919 % 1009}" for k in range(200))
    df = spark.createDataFrame([("a", base), ("b", "other words first " + base)], "doc_id string, text string")
    got = fingerprints.matches(df.filter("doc_id = 'a'"), df.filter("doc_id = 'b'")).first()
    assert got.n_anchors > 50 and got["shift"] == len(re.findall(PLAIN_TOKEN, "other words first"))


# 4 -----------------------------------------------------------------------------------------------
def test_boosted_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.fit(x[:1500], y[:1500], trees=60)
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert quality.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert quality.fit(x[:9], np.ones(9)).score(x[:1])[0] > 0.9


def test_quality_query_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93


def test_quality_awkward(spark, docs, empty):
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(12)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(empty, labels).count() == 0 and quality.classify(docs, labels.limit(0)).filter("predicted = 1").count() == docs.count()


# 5 -----------------------------------------------------------------------------------------------
def plain_targets(sizes):
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing(spark, docs, empty):
    rows = rows_of([f"{'word ' * (1 + k * 37 % 50)}" for k in range(900)], ("b", "a", "ä", None, "a", "a", "z", "z", "z"))
    for df in (docs, spark.createDataFrame(rows, SCHEMA)):
        got = mixing.mix(df).collect()
        sizes = Counter()
        for r in got:
            assert r.mix_size == len(words(r.text)) and 0 <= r.mix_copies <= 2
            sizes[r.source] += r.mix_size
        want, taken, most = plain_targets(sizes), Counter(), Counter()
        for r in got:
            assert math.isclose(r.mix_target, want[r.source], abs_tol=1e-6) and r.mix_source_size == sizes[r.source]
            taken[r.source] += r.mix_copies * r.mix_size
            most[r.source] = max(most[r.source], r.mix_size)
        assert all(abs(taken[s] - want[s]) <= 1 + most[s] * 2 for s in sizes)
        assert sorted((str(r.doc_id), r.text or "", r.mix_copies) for r in mixing.mix(df).collect()) == sorted((str(r.doc_id), r.text or "", r.mix_copies) for r in got)
    mixed = mixing.emit(mixing.mix(docs))
    assert mixed.columns == docs.columns and mixing.mix(empty).count() == 0


# 6 -----------------------------------------------------------------------------------------------
PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><div class='cookie-notice'>we set cookies</div><nav><ul><li><a href=/a>menu</a><li><a>two</a></ul></nav><!-- ad --><div class=ad>buy</div><article><h1>Head &amp; line</h1><p>One <b>bold</b>\n text<br>goes&nbsp;on<p>Two <div class='share-bar'>share</div>{more}<aside>side</aside><form>f</form></article><section id='comments'><p>first!</p></section><footer>&copy; x</footer></body></html>"


def test_html(spark):
    plain = "<html><body><div class=header>top</div><ul><li><a>l1</a></li></ul><div><p>Only text here.</p></div><div class=footer>end</div></body></html>"
    rows = [(1, "https://h.example/x", PAGE.replace("{more}", "")), (2, "https://h.example/y", PAGE.replace("{more}", "<p>Three</p><p>Four < 5</p>")), (3, "https://o.example/", plain), (4, None, None), (5, "https://h.example/z", ""), (6, "x", "<p>cut off <b")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & line\nOne bold text goes on\nTwo" and got[2].text == got[1].text + "\nThree\nFour < 5"
    assert got[3].text == "Only text here." and (got[4].text, got[5].text, got[6].text) == ("", "", "cut off <b")
    assert all(r.n_chars == len(r.text) for r in got.values())
    wrapper = json.loads(html.wrappers(spark.createDataFrame(rows[:2], "page_id long, url string, html string")).first().wrapper)
    assert "*" in json.dumps(wrapper) or "?" in json.dumps(wrapper)


def test_wrapper_alignment():
    one, two = (html.expression(html.tree(p)) for p in ("<ul><li>a<li>b</ul>", "<ul><li>a</ul><p>x</p>"))
    both = html.joined(one, two)
    assert [(c[0], c[1]) for c in both[2]] == [("ul", ""), ("p", "?")] and both[2][0][2][0][:2] == ["li", "+"]
    assert html.folded([["dt", "", []], ["dd", "", []]] * 3) == [["()", "+", [["dt", "", []], ["dd", "", []]]]]


HTML = "page_id long, url string, html string"


def extracted(spark, pages, host="https://h{}.example/"):
    rows = [(k, host.format(k), p) for k, p in enumerate(pages)]
    return [r.text for r in sorted(html.extract(spark.createDataFrame(rows, HTML)).collect())]


def test_html_names_around_the_article_do_not_drop_it(spark):
    pages = {
        '<body class="has-sidebar"><article class="no-sidebar"><p>A</p></article>': "A", '<div class="comment-policy"><article><p>B</p></article></div>': "B",
        '<article class="post has-related"><p>C</p></article>': "C", '<main class="search-results-page"><p>D</p></main>': "D",
        "<article><p>Our <span class='ad'>buy <i>it</i> now</span> text</p></article>": "Our text", "<p>a &am<b>p;</b> b &amp;</p>": "a &amp; b &",
        "<article><p>x</p></article><section id=comments><article class=comment><p>first</p></article></section>": "x",
        "<div id=comments><article><p>c1</p></article></div><div class=body><p>main</p></div>": "main",
    }
    assert extracted(spark, pages) == list(pages.values())


def test_html_slots_of_the_host_decide(spark):
    """Without the host's other pages nothing tells template and menus from content: the wrapper changes the result."""
    pages = [f"<div class=q1><a href=/>Top {k}</a> of {'it ' * (k > 3)}</div><div class=q2><h2>Head {k}</h2><p>Body {k} is {k * k}</p></div><div class=q3>All rights reserved.</div>" for k in range(6)]
    alone, together = extracted(spark, pages), extracted(spark, pages, "https://one.example/{}")
    assert all("All rights" in t for t in alone)
    assert [t.split("\n")[-2:] for t in together] == [[f"Head {k}", f"Body {k} is {k * k}"] for k in range(6)]
    notices = [f"<article><h1>T</h1><div class=n7>Sign up today</div><p>Text {k}</p></article>" for k in range(9)]
    assert extracted(spark, notices, "https://two.example/{}") == [f"T\nText {k}" for k in range(9)]
    assert extracted(spark, [notices[0]] * 9, "https://copies.example/{}") == ["T\nSign up today\nText 0"] * 9


def plain_page(page):
    """An extractor of its own for pages of nested, closed elements: text by block under article, outside DROPPED ones."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.blocks, self.now = [], [], []

        def close_block(self):
            if text := " ".join("".join(self.now).split()):
                self.blocks.append(text)
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag in html.BLOCKS:
                self.close_block()
            self.stack.append(tag)

        def handle_endtag(self, tag):
            if tag in html.BLOCKS:
                self.close_block()
            while self.stack.pop() != tag:
                pass

        def handle_data(self, data):
            if "article" in self.stack and not {*self.stack} & (html.DROPPED | {"script", "style"}):
                self.now.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close_block()
    return "\n".join(reader.blocks)


def test_html_against_a_plain_reader(spark):
    rng = np.random.default_rng(3)

    def some(depth):
        out = []
        for _ in range(rng.integers(1, 6)):
            tag = str(rng.choice(["p", "div", "ul", "section", "nav", "aside", "h2", "b", "i", "table", "blockquote", "form"]))
            if tag in ("p", "h2", "b", "i") or depth > 3:
                tag = tag if tag in ("p", "h2", "b", "i") else "p"
                out.append(f"<{tag}>{rng.integers(1e6)} &lt;x&eacute; {rng.integers(1e6)}</{tag}>")
            else:
                out.append(f"<{tag}>{some(depth + 1)}</{tag}>")
        return "".join(out)

    pages = [f"<html><head><title>t</title></head><body><nav><ul><li>m</li></ul></nav><article><h1>h</h1>{some(0)}</article><footer>f</footer></body></html>" for _ in range(120)]
    rows = [(k, f"https://h{k % 3}.example/{k}", p) for k, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, HTML)).collect()}
    assert got == {k: plain_page(p) for k, p in enumerate(pages)}


def test_html_awkward_tables(spark, monkeypatch):
    rng = np.random.default_rng(4)
    wide = "<main>" + "".join(f"<{t}>{k}</{t}>" for k, t in enumerate(rng.choice(["p", "h2", "div", "ul", "section"], 20_000))) + "</main>"
    rows = [(1, "https://h.example/", "<div>" * 10_000 + "deep"), (2, "https://h.example/", wide), (3, None, "<p>x"), (3, None, "<p>x"), (None, "u", None), (5, "https://h.example/", "<<a <p '\" &#0; &bogus; <!-- open")]
    df = spark.createDataFrame([(*r, "clash", 1, "c") for r in rows], HTML + ", host string, place int, text string")
    for most in (2000, 0):
        monkeypatch.setattr(html, "SENT_HOSTS", most)
        got = html.extract(df).collect()
        assert len(got) == len(rows) and [r.text for r in got if r.page_id == 3] == ["x", "x"]
        assert [len(r.text.split()) for r in got if r.page_id == 2] == [20_000] and [r.text for r in got if r.page_id == 1] == ["deep"]
    assert html.extract(df.limit(0)).count() == 0


def test_html_keeps_what_only_another_slot_knows(spark):
    pages = {
        "<article><blockquote><p>A</p></blockquote><p>B</p><blockquote>C</blockquote></article>": "A\nB\nC",
        "<article><h1>H</h1><p>text</p><ul><li>x</ul><p><a>link only</a></p></article>": "H\ntext\nx\nlink only",
        "<main><div><p>1</p><p>2</p></div><h2>3</h2><div><ul><li>4</ul>5</div><h3>6</h3><div><h4>7</h4></div></main>": "1\n2\n3\n4\n5\n6\n7",
    }
    rows = [(k, f"https://h{k}.example/", p) for k, p in enumerate(pages)] + [(k + 10, "https://all.example/", p) for k, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k + at: t for k, t in enumerate(pages.values()) for at in (0, 10)}


# 7 -----------------------------------------------------------------------------------------------
def test_token_files(spark, docs, empty, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    monkeypatch.setattr(tokens, "FILE_TOKENS", 500)
    got = sorted(tokens.read_tokens(tokens.write_tokens(docs, path)).collect(), key=lambda r: r.start)
    ids = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    at = 0
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in docs.collect()], key=lambda i: (i is not None, i or 0))
    for r in got:
        want = np.array(ids[r.doc_id], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert tokens.read_tokens(tokens.write_tokens(empty, path)).count() == 0


def test_directly_addressable_codes():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 49408, 3000), rng.integers(0, 200, 700), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype(np.uint32)
    file = tokens.TokenFile(tokens.to_bytes([1, None, 3], [1000, 0, len(ids) - 1000], ids))
    assert file.doc_ids == [1, None, 3] and (file.document(2) == ids[1000:]).all() and len(file.document(1)) == 0
    for a, b in ((0, 5), (511, 514), (512, 513), (1023, 2050), (len(ids) - 4, len(ids)), (7, 7)):
        assert (file.tokens(a, b) == ids[a:b]).all()
    assert all(file.token(i) == ids[i] for i in (0, 1, 511, 512, 513, 2999, len(ids) - 1))
    with pytest.raises(IndexError):
        file.token(len(ids))


def test_encoder_pieces():
    texts = ["it's <|endoftext|> a'b 12ab, İx ΣΑΣ. don't!!", " lead  trail ", "한국어 ab́c 全角 \x1c a\x85b", "ﬁ ǅ, Ⅷ ①2 ½ ª º ʰ,", "", None]
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    flat, lens = tokens.Encoder(open(path).read()).encode(pa.array(texts))
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [list(x) for x in np.split(flat, np.cumsum(lens)[:-1])] == want
    assert "".join(tokens.pieces("ab cd " * 100, 50)) == "ab cd " * 100


# 8 -----------------------------------------------------------------------------------------------
def plain_set(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def plain_components(rows, percent):
    sets, parent = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    rng = np.random.default_rng(percent)
    vocabulary = [f"v{k}" for k in range(400)]
    texts = []
    for f in range(6):
        base = list(rng.choice(vocabulary, 120))
        for _ in range(14):
            w = list(base)
            for k in rng.integers(0, 120, rng.integers(0, 5)):
                w[k] = str(rng.choice(vocabulary))
            texts.append(" ".join(w))
    texts += TEXTS + [texts[3].upper(), texts[3]]
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    want = plain_components(rows, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_keep_one(docs, empty):
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()).most_common(1)[0][1] == 1
    assert {1, 2, 3, 5, 8, None} <= {r.doc_id for r in kept.collect()} and 10 not in {r.doc_id for r in kept.collect()}
    assert neardup.near_duplicates(empty).count() == 0


def chained(n):
    """Texts of one template, each with two tails of which either neighbour has one: none is like another enough."""
    base = " ".join(f"base{k}" for k in range(104))
    tail = lambda k: " ".join(f"t{k}x{i}" for i in range(17))
    return [(k, f"{base} {tail(k)} {tail(k + 1)}") for k in range(n)]


def test_a_template_makes_pairs_in_proportion(spark, monkeypatch):
    made = {}
    plain = neardup.compared
    for n in (60, 240):
        held = made[n] = []
        monkeypatch.setattr(neardup, "compared", lambda pairs, *a, held=held: held.append(pairs.count()) or plain(pairs, *a))
        got = neardup.near_duplicates(spark.createDataFrame(chained(n), "doc_id long, text string"), 85).collect()
        assert all(r.component_id == r.doc_id and r.kept for r in got) and len(got) == n
    assert sum(made[240]) < 6 * sum(made[60]) and made[240][-1] < 2 * 240


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (95, 100)]
    got = {r.u: r.v for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {95: 90, 100: 90}


def test_posterior_floor_keeps_true_links():
    floors = neardup.least_matches(85)
    assert list(floors) == [24, 48, 72, 96, 120] and all(0 < m < 0.85 * n for n, m in floors.items())
    a, b = set(range(1000)), set(range(80, 1000))
    x, y = (shingles.signatures([np.unique(shingles.mixed(np.array(sorted(s), np.uint64)))])[0] for s in (a, b))
    assert abs((x == y).mean() - 0.92) < 0.1


# 9 -----------------------------------------------------------------------------------------------
def test_lm(spark, docs, empty):
    plain = spark.createDataFrame([(k, "the cat sat on the mat and the dog sat on the rug " * 40) for k in range(60)], "doc_id long, text string")
    v = lm.vocabulary(plain)
    rows = lm.prepared(plain, v, 2, 2)
    start, trained = lm.first_parameters(v), lm.train(rows, v, 2, 2)
    before, after = (lm.scores(rows, v, p).first().mean_log_prob for p in (start, trained))
    assert after > before
    odd = lm.scores(lm.prepared(plain.limit(1).selectExpr("doc_id", "'mat the on dog cat zzz qqq' AS text"), v, 1, 1), v, trained).first()
    assert odd.mean_log_prob < after
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = lm.score_documents(docs).collect()
    assert len(got) == docs.count() and all(r.n_tokens == len(words(texts[r.doc_id])) for r in got)
    assert all((r.mean_log_prob is None) == (r.n_tokens == 0) for r in got) and lm.score_documents(empty).count() == 0


def test_lm_does_not_depend_on_the_files(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = ({r.doc_id: r.log_prob for r in lm.score_documents(df.repartition(n)).collect()} for n in (2, 13))
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-4) for k in one)


def test_lm_learns_from_every_token_and_gains(spark, monkeypatch):
    """Held-out gain over the unigram start, and each token a target once over all rounds and shards."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 100_000)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    v = lm.vocabulary(df)
    rows = lm.prepared(df, v, 1, lm.ROUNDS)
    assert rows.agg(F.sum("n_tokens")).first()[0] == v.tokens == sum(len(words(r.text)) for r in df.collect())
    assert {r.turn for r in rows.select("turn").distinct().collect()} <= set(range(lm.ROUNDS))
    seen, unseen = rows.filter("place % 5 <> 0"), rows.filter("place % 5 = 0")
    flat = lm.train(seen, v, 1, lm.ROUNDS)
    mean = lambda p: unseen.sparkSession and lm.scores(unseen, v, p).selectExpr("sum(log_prob) / sum(n_tokens)").first()[0]
    assert mean(flat) > mean(lm.first_parameters(v))


def test_lm_word_probabilities_of_slots(spark):
    """P(slot) P(word | slot) of the start is the word's share of all tokens, but for smoothing; the vocabulary grows."""
    df = spark.createDataFrame([(k, " ".join(f"w{k * j % 997}" for j in range(300))) for k in range(40)], "doc_id long, text string")
    v = lm.vocabulary(df)
    counts = Counter(w for r in df.collect() for w in r.text.split())
    slot, _, _ = lm.slots(pa.array([" ".join(v.words)]), v, pa.array(v.words))
    p = v.share[slot] * np.exp(v.listed)
    assert np.allclose(p, [counts[w] / v.tokens for w in v.words], rtol=0.6, atol=2e-4) and v.own < len(v.words)
    big = lm.vocabulary(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert big.classes * big.members > v.classes * v.members


def test_lm_gradient():
    v = lm.Vocabulary(16, 16, [], 160, 0, np.full(256, 1 / 256))
    rng = np.random.default_rng(0)
    flat = rng.normal(0, 0.3, lm.first_parameters(v).shape).astype(np.float32)
    stream = np.concatenate([[v.edge] * 2, rng.integers(0, 50, 400), [v.edge] * 2])
    at = np.arange(2, 402)
    first = lm.forward(v, v.unpack(flat), stream, at)[0].mean()
    for _ in range(60):
        lm.learn(v, flat, stream, at)
    assert lm.forward(v, v.unpack(flat), stream, at)[0].mean() > first + 0.5


# 10 ----------------------------------------------------------------------------------------------
def test_sharding(spark, docs, empty):
    rows = rows_of([("t" * (k * 31 % 400)) + str(k % 250) for k in range(1000)])
    big = spark.createDataFrame(rows + [r for r in rows_of(["copy of one text"] * 900)], SCHEMA)
    for df in (docs, big):
        got = sharding.shard_documents(df).collect()
        by, texts = defaultdict(list), {}
        assert len(got) == df.count()
        for r in got:
            by[r.shard].append(r)
            assert texts.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
        assert set(by) <= set(range(8)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
        assert sum(r["size"] for r in got) == sum(len((r.text or "").encode()) + 1 for r in df.collect())
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8
    assert sharding.shard_documents(empty).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(5)
    items = [(f"i{k}", int(s)) for k, s in enumerate(rng.integers(1, 100, 400))] + [("huge", 300)]
    placed = sharding.pack(items, 100)
    loads, bins = Counter(), []
    for n, s in sorted(items, key=lambda x: (-x[1], x[0])):
        loads[placed[n]] += s
        free = [(100 - v, k) for k, v in enumerate(bins) if 100 - v >= s]
        at = min(free)[1] if free and s <= 100 else len(bins)
        bins += [0] * (at == len(bins))
        bins[at] += s
        assert placed[n] == at
    assert max(v for k, v in loads.items() if k != placed["huge"]) <= 100
    assert set(sharding.pack_into([("a", 1000), ("b", 10), ("c", 10)], 2).values()) == {0, 1}
    assert sharding.pack_into([], 8) == {}


# Pipeline ----------------------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.saved(stage(spark, docs, d), "stage")
        assert docs.columns == before.columns
        if name == "near_duplicates":
            want = plain_components([(r.doc_id, r.text) for r in before.collect()], 80)
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in want.items() if i == c}
        if name == "decontamination":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect() if not plain_report(r.text, items)[4]}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect())
