"""HTML extraction, line dedup, chat formatting, the pipeline."""

import itertools
import os
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from recollect.llm import chat, html_text, linededup
from recollect.llm import queries as q

SF = "/root/testdata/sf0.001"


def test_minimum_cut_equals_all_labellings():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        n = int(rnd.integers(1, 8))
        cost = rnd.normal(size=n).round(2)
        edges = [(i, j, float(rnd.random())) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5]
        best = min(price(x, cost, edges) for x in itertools.product((False, True), repeat=n))
        assert abs(price(html_text.cut(cost, edges), cost, edges) - best) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="masthead">Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy now</div><article><h1>Head &amp; more</h1><p><b>First   text.<br><p>Second &lt;p&gt; text</p><form><input><button>Go</button></form><div class='comments'><p>I agree</p></div></article>
<aside>Related</aside><div id=cookie-notice>We use cookies</div><footer>&copy; x</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE, html_text.DEFAULT) == "Head & more\nFirst text.\nSecond <p> text"
    assert html_text.main_text(None, html_text.DEFAULT) == "" and html_text.main_text("", html_text.DEFAULT) == ""
    assert html_text.main_text("plain words of a page without tags, long enough to be text. Yes, it is.", html_text.DEFAULT).startswith("plain")


def price(lab, cost, edges):
    return sum(c for c, x in zip(cost, lab, strict=True) if c > 0 and not x) + sum(-c for c, x in zip(cost, lab, strict=True) if c < 0 and x) + sum(w for i, j, w in edges if lab[i] != lab[j])


LONG = "Words of a real sentence, long enough to be taken for text, follow here. And one more sentence, with a comma."


def test_whole_pages_get_the_cheapest_labelling():
    odd = f"<nav><a href=x>Go</a></nav><p>{LONG}</p><div>a <b>b</div><p class=promo>{LONG}</p><ul><li><a href=y>c</a><li>d</ul>{LONG}<footer>f</footer>"
    for html in (PAGE, odd, f"<p>{LONG}<p>x<p>{LONG}", f"<article><p>{LONG}</p><p>ok</p></article>"):
        bs = html_text.blocks(html)
        cost, edges = html_text.capacities(bs, html_text.DEFAULT)
        best = min(itertools.product((False, True), repeat=len(bs)), key=lambda lab: (price(lab, cost, edges), sum(lab)))
        assert html_text.label(bs, html_text.DEFAULT).tolist() == list(best)


def test_neighbours_decide_where_the_cut_goes():
    # (a) a block without a cue that looks like boilerplate stands between paragraphs
    bs = html_text.blocks(f"<p>{LONG}</p><p>Yes</p><p>{LONG}</p>")
    assert [b.cue for b in bs] == [0, 0, 0]
    assert html_text.capacities(bs, html_text.DEFAULT)[0][1] < 0 and html_text.label(bs, html_text.DEFAULT).all()
    # (b) a wrong cue on one paragraph of an article
    html = f"<article><p>{LONG}</p><p class='promo'>{LONG}</p><p>{LONG}</p></article>"
    bs = html_text.blocks(html)
    assert [b.cue for b in bs] == [1, -1, 1] and html_text.capacities(bs, html_text.DEFAULT)[0][1] < 0
    assert html_text.label(bs, html_text.DEFAULT).all()
    # an advert in a container of its own stays out, and so do comments
    out = html_text.main_text(f"<article><p>{LONG}</p><div class='ad'>{LONG}</div><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></article>", html_text.DEFAULT)
    assert out == f"{LONG}\n{LONG}"


def test_the_cut_changes_labels_of_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_text.learn(pages)
    changed = 0
    for r in pages.collect():
        bs = html_text.blocks(r.html)
        cost, _ = html_text.capacities(bs, model)
        changed += int((html_text.label(bs, model) != (cost > 0)).sum())
    assert changed > 0


def test_pages_whose_containers_say_nothing(spark):
    """Without names and container tags the classifier and the cut still find the articles."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model, right, found, there = html_text.learn(pages), 0, 0, 0
    for r in pages.collect():
        named = html_text.blocks(r.html)
        bare = html_text.blocks(re.sub(r"</?(?:article|nav|footer)[^>]*>|(?: class| id| role)=(?:\"[^\"]*\"|'[^']*'|\\S+?(?=[\\s>]))", "", r.html))
        want = Counter(b.text for b in named if b.cue > 0)
        got = Counter(b.text for b, keep in zip(bare, html_text.label(bare, model), strict=True) if keep)
        right, found, there = right + (want & got).total(), found + got.total(), there + want.total()
    assert right / there > 0.95 and right / found > 0.9


def test_names_that_only_look_like_boilerplate():
    tall = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    for html in (f"<article class='post category-legal'>{tall}</article>", f"<body class='right-sidebar'>{tall}</body>", f"<div class='overflow-hidden'>{tall}</div>", f"<div data-x='a hidden gem'>{tall}</div>",
                 f"<form action=x>{tall}</form>", f"<div class='page-promo'>{tall}</div>", f"<html class='comments footer'><body id=sidebar>{tall}</body></html>"):
        assert html_text.main_text(html, html_text.DEFAULT) == f"Title\n{LONG}\n{LONG}", html
    for around in ("<div hidden>{}</div>", "<div style='color:red; display : none'>{}</div>", "<div aria-hidden=true>{}</div>", "<div class='site-footer'>{}</div>", "<form><p>{}</p></form>", "<div class='x comments y'>{}</div>", "<article class=comment>{}</article>"):
        short = "Leave a reply"
        assert html_text.main_text(f"<article>{tall}</article>" + around.format(short), html_text.DEFAULT) == f"Title\n{LONG}\n{LONG}", around


def test_broken_markup_is_read_in_linear_time():
    for broken in ("<a ", '<a b="', "<!", "<a '\"", "<script ", "</", "<p class='", "<!-- <", "<svg>"):
        began = time.process_time()
        html_text.blocks(broken * (600_000 // len(broken)))
        assert time.process_time() - began < 2, broken
    assert [b.text for b in html_text.blocks(f"<p>{LONG}</p><div <p>After</p>")] == [LONG, "After"]


class Visible(HTMLParser):
    """What a reader sees of well-formed markup, by the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCK_TAGS and not any(self.stack):
            self.out.append("\n")
        if tag not in html_text.VOID_TAGS:
            a = dict(attrs)
            self.stack.append(tag in html_text.HIDDEN_TAGS or "hidden" in a or a.get("aria-hidden") == "true")
        elif tag == "br" and not any(self.stack):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.stack.pop()
        if tag in html_text.BLOCK_TAGS and not any(self.stack):
            self.out.append("\n")

    def handle_data(self, data):
        if not any(self.stack):
            self.out.append(data)


def test_blocks_equal_what_the_library_parser_sees():
    rnd = random.Random(3)
    attrs = ["", " class='a b'", ' id="x>y"', " hidden", " data-q='\"'", " aria-hidden=true", " title=\"it's &amp; so\"", " x=1"]

    def made(depth):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            kind = rnd.random()
            if kind < 0.35 or depth == 0:
                parts.append(rnd.choice(["words here ", "a &lt; b &eacute; ", " ", "x", "&#233;t&#xE9; ", "<!-- no > -->", "<br>", "tail"]))
            elif kind < 0.45:
                parts.append(f"<script{rnd.choice(attrs[:4])}>if (a < b) {{ '<p>' }}</script>")
            else:
                tag = rnd.choice(["div", "section", "b", "span", "h2", "ul", "button", "em", "blockquote"])
                parts.append(f"<{tag}{rnd.choice(attrs)}>{made(depth - 1)}</{tag}>")
        return "".join(parts)

    for _ in range(400):
        html = made(4)
        seen = Visible()
        seen.feed(html)
        seen.close()
        want = [t for line in "".join(seen.out).split("\n") if (t := " ".join(line.split()))]
        assert [b.text for b in html_text.blocks(html)] == want, html


def test_deep_and_long_pages():
    deep = "<div>a" * 20_000 + "<p>" + LONG
    assert len(html_text.blocks(deep)) == 20_001
    long = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert html_text.main_text(long, html_text.DEFAULT).count("\n") == 19_999


def test_extract_query(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "u", None, "x"), (2, "u", None, "x")], "page_id long, url string, html string, text string")
    r = html_text.extract(df).orderBy("page_id").collect()
    assert r[0].text.startswith("Head & more") and r[0].n_chars == len(r[0].text) and [x.n_chars for x in r[1:]] == [0, 0]
    assert html_text.extract(df.limit(0)).count() == 0


def words(k, n):
    return " ".join(f"w{k}x{i}" for i in range(n))


def brute_lines(docs, least):
    """Maximal equal runs of two places (document, line), of at least `least` words: the later one goes."""
    lines = [(d, [x.strip(" ") for x in t.split("\n") if x.strip(" ")]) for d, t in docs if t is not None]
    gone = set()
    for (i, (_, a)), (j, (_, b)) in itertools.product(enumerate(lines), repeat=2):
        if j > i:
            continue
        for shift in range(-len(b) + 1, len(a)):
            if i == j and shift <= 0:
                continue
            run = []
            for n in range(len(a) + 1):
                if n < len(a) and 0 <= n - shift < len(b) and a[n] == b[n - shift]:
                    run.append(n)
                else:
                    if sum(a[k].count(" ") + 1 for k in run) >= least:
                        gone |= {(i, k) for k in run}
                    run = []
    return {d: sum(1 for g in gone if g[0] == i) for i, (d, _) in enumerate(lines)}


def test_line_dedup_equals_brute_force(spark):
    p, q2, s = words("p", 60), words("q", 30) + "\n" + words("r", 12) + "\n" + words("s", 20), words("z", 10)
    docs = [(0, f"{words(1, 8)}\n{p}\n{words(2, 9)}"), (1, f"{words(3, 5)}\n{p}\n\n{q2}\n{words(4, 4)}"), (2, f"{q2}\n{s}"), (3, f"{s}\n{words(5, 40)}\n{s}"), (4, f"{p}\n{words(6, 3)}\n{p}"), (5, f"{words(1, 8)}\n{p}\n{words(2, 9)}"), (6, ""), (7, None)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_removed int")
    r = {x.doc_id: x for x in linededup.report(df).collect()}
    want = brute_lines(docs, linededup.NOISE + linededup.WINDOW - 1)
    assert {d: r[d].n_removed for d in want} == want and r[7].text is None and r[7].n_lines == 0
    assert r[1].text == f"{words(3, 5)}\n\n{words(4, 4)}" or r[1].text.split("\n")[0] == words(3, 5)
    assert r[0].text == docs[0][1] and r[3].text == docs[3][1]
    assert r[5].text == ""


def test_line_dedup_finds_runs_whose_parts_stand_earlier_alone(spark):
    a, b, tail = words("a", 30), words("b", 30), words("t", 3)
    docs = [(1, a), (2, b), (3, f"{a}\n{b}"), (4, f"{a}\n{b}"), (5, f"{a}\n{b}"), (6, f"{a}\n{b}\n{tail}"), (7, f"x\n{a}\n{b}\n{tail}\n{a}")]
    rnd = np.random.default_rng(9)
    short = [words(f"v{i}", n) for i, n in enumerate((1, 7, 24, 26, 30, 49, 50))]
    docs += [(8 + i, "\n".join(short[k] for k in rnd.integers(0, len(short), 6))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in linededup.report(df).collect()}
    want = brute_lines(docs, linededup.NOISE + linededup.WINDOW - 1)
    assert [want[d] for d in (3, 4, 5, 6, 7)] == [0, 2, 2, 2, 3] and got == want


def test_matches_extend_both_ways(spark):
    shared = [f"common {i} " + words("s", 9) for i in range(12)]  # 12 lines of 11 words
    docs = [(1, "\n".join(["own first", *shared, "own end"])), (2, "\n".join(["a", "b", *shared[2:], "c"])), (3, "\n".join([*shared[:9], "d", *shared])), (4, "\n".join(shared[:3]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found, lines = linededup.matches(df)
    key = {r.key: r.doc_id for r in lines.select("key", "doc_id").distinct().collect()}
    got = {(key[r.key], r.n, r["last"], key[r.of], r.at) for r in found.collect()}
    assert got == {(2, 3, 12, 1, 4), (3, 1, 9, 1, 2), (3, 11, 22, 1, 2)}


def test_line_dedup_leaves_only_what_it_returns(spark):
    df = spark.createDataFrame([(1, words("a", 60)), (2, words("a", 60))], "doc_id long, text string")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    assert linededup.report(df).count() == 2
    assert {n.split("-")[0] for n in set(os.listdir(folder)) - before} <= {"cut"}


def test_line_dedup_stage(spark):
    p = words("p", 60)
    df = spark.createDataFrame([(0, p, 1, 5), (0, p, 1, 5), (1, p, 2, 5), (2, p + "\nown words", 3, 5), (None, None, 4, 5), (None, "x", 4, 5)], "doc_id long, text string, __rc int, n_chars long")
    out = linededup.drop_repeated(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "", r.n_chars) for r in out.collect())
    assert got == [(-1, "", 5), (-1, "x", 5), (0, p, 5), (0, p, 5), (2, "own words", 9)]
    assert linededup.drop_repeated(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    texts = ["plain", "", None, "\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\s \\e \\h \\\\", "####", "a\nb"]
    rows = [(i % 2, i, r, t, "x") for i, (t, r) in enumerate(itertools.product(texts, ["user", "assistant", None, "a: b\\"]))] + [(None, None, "user", "q", "x"), (0, 1, "assistant", "tie", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    f = chat.format_conversations(df)
    got = f.select("conv_id", chat.parse(F.col("formatted")).alias("t"), "formatted", "loss_mask").collect()
    for r in got:
        mine = sorted(((t if t is not None else -1), ro or "", tx or "") for c, t, ro, tx, _ in rows if c == r.conv_id)
        assert [(x.role, x.text) for x in r.t] == [m[1:] for m in mine]
        at, lit = 0, ""
        for m in r.loss_mask:
            if m.loss:
                lit += r.formatted[at:at + m.length]
            at += m.length
        assert at == len(r.formatted)
        assert lit == "".join(x.body for x in r.t if x.role == "assistant")
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0
    plain = chat.format_turns(df.filter("text = 'plain' and role = 'user'")).first()
    assert not plain.escaped and plain.rendered == "### user: plain</turn>\n"


def test_chat_blocks(spark):
    df = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(300)], "conv_id long, turn long, role string, text string")
    r = chat.digest(chat.format_conversations(df)).first()
    assert r.n_turns == 300 and r.loss_chars == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = docs.count()
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.count() <= ids
            ids = out.count()
    assert set(r.doc_id for r in out.select("doc_id").distinct().collect()) <= set(r.doc_id for r in docs.select("doc_id").collect())
    assert out.count() >= ids


def test_registered_queries():
    assert [n.split("_")[0] for n in q.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(q.ORACLE_SQL) <= set(q.QUERIES)
