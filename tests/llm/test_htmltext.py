from __future__ import annotations

import random

from stripmill.llm.htmltext import Page, extracted

SCHEMA = "page_id long, url string, html string, text int, path string"
JUNK = [
    "<nav><ul><li><a href='/x'>Menu item</a></li></ul></nav>",
    "<div class='ad box'>Buy this now</div>",
    '<aside><p>Sidebar words that are long enough to be taken for text, were they not aside.</p></aside>',
    '<div id="cookie-notice">We use cookies</div>',
    "<form><p>Your mail</p><input value='>'></form>",
    "<script>var t='</p><p>not text';</script>",
    "<!-- <p>comment</p> -->",
    '<section class="comments"><h2>Comments</h2><p>A reader says a lot of things, and more, and more.</p></section>',
]


def page(rng, body, layout):
    junk = lambda: "".join(rng.sample(JUNK, rng.randrange(len(JUNK))))
    open_, close = {"a": ("<article>", "</article>"), "d": ('<div class="page"><div class="post post-17">', "</div></div>")}[layout]
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>{junk()}{open_}{body}{junk()}{close}{junk()}<footer>&copy; x</footer></body></html>"


def test_round_trip(spark):
    rng = random.Random(1)
    words = "alpha beta &amp; gamma délta &lt;tag&gt; x&#233;y &quot;q&quot;".split()
    plain = {"&amp;": "&", "&lt;tag&gt;": "<tag>", "x&#233;y": "xéy", "&quot;q&quot;": '"q"'}
    rows, want = [], {}
    for k in range(60):
        blocks = [rng.choices(words, k=rng.randrange(10, 60)) for _ in range(rng.randrange(1, 6))]
        body = "<h1>" + " ".join(blocks[0]) + "</h1>" + "".join(f"<p{rng.choice(['', ' class=x'])}>{rng.choice(['', '<b>'])}" + rng.choice([" ", "\n\t", " <br> "]).join(b) + rng.choice(["", "</p>"]) for b in blocks[1:])
        want[k] = "\n".join(" ".join(plain.get(w, w) for w in b) for b in blocks)
        rows.append((k, f"http://h{k % 2}.org/{k}", page(rng, body, "ad"[k % 2]), 1, "clash"))
    odd = [(100, None, None, 1, ""), (101, "x", "", 1, ""), (102, None, "no markup &amp", 1, ""), (103, "http://h0.org", "<p>cut <b>off <a href='", 1, ""), (104, "http://h1.org", "<nav><p>only menu</p></nav>", 1, ""), (105, "y", "<p>" + "long " * 50_000, 1, ""), (0, *rows[0][1:])]
    got = [tuple(r) for r in extracted(spark.createDataFrame(rows + odd, SCHEMA).repartition(3)).collect()]
    assert len(got) == len(rows) + len(odd)
    text = {d: t for d, _, t, _ in got}
    assert {d: text[d] for d in want} == want
    assert [text[d] for d in range(100, 105)] == ["", "", "no markup &", "cut off", ""]
    assert len(text[105]) == 5 * 50_000 - 1
    assert all(n == len(t) for _, _, t, n in got)
    assert extracted(spark.createDataFrame([], SCHEMA)).collect() == []


def test_host_path_beats_a_pages_own_best():
    html = "<body><div class='main'><p>short text</p></div><div class='other'><p>longer than the main text</p></div></body>"
    path = "/body/div.main"
    assert Page(html).text(None) == "longer than the main text"
    assert Page(html).text(path) == "short text"
    assert Page(html).text("/body/div.none") == "longer than the main text"


def test_markup_cases():
    body = "<table><tr><td>a<td>b</tr></table><ul><li>one<li>two</ul><pre>x\n y</pre><P>p1<P>p<i>2</i><div>d</div>tail"
    assert Page(f"<article>{body}</article>").within("/article") == ["a", "b", "one", "two", "x y", "p1", "p2", "d", "tail"]
    assert Page("<main><p>a &lt b &notanentity; &#x41;</p>").within("/main") == ["a < b ¬anentity; A"]


def test_all_parts_of_an_article_are_taken(spark):
    lead, long = "lead text of the page " * 8, "body text of the page " * 40
    parts = lambda k: f"<html><body><article><div class=lead><p>{lead}{k}</p></div><div class=body><p>{long}</p></div></article></body></html>"
    listed = lambda k: f"<html><body><article><p>{lead}{k}</p><ul><li>{long}</li></ul></article><div class=x><p>outside</p></div></body></html>"
    rows = [(k, f"http://a.org/{k}", parts(k), 1, "") for k in range(5)] + [(10 + k, f"http://b.org/{k}", listed(k), 1, "") for k in range(5)]
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {d: f"{lead}{d % 10}\n{long.strip()}" for d, *_ in rows}
    assert Page(parts(7)).text(None) == f"{lead}7\n{long.strip()}"


def test_named_containers_are_decided_by_the_vote(spark):
    text = "words of the article, one after another. " * 20
    names = ["content has-sidebar", "post with-comments", "main social-post", "hidden-xs article", "widgets-on article", "layout sidebar-left"]
    side = "<div class='sidebar'><p>beside it, much shorter</p></div>"
    rows = [(10 * k + n, f"http://h{k}.org/{n}", f"<html><body><div class='{name}'><p>{text}{n}</p><div class='comments'><p>a reader</p></div></div>{side}</body></html>", 1, "") for k, name in enumerate(names) for n in range(4)]
    only = (900, "http://h0.org/900", f"<html><body><div class='cookie-notice'><p>{text}</p></div></body></html>", 1, "")
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame([*rows, only], SCHEMA)).collect()}
    assert got == {d: f"{text}{d % 10}" for d, *_ in rows} | {900: ""}


def test_headlines_formulas_and_forms():
    body = "<article><header><h1>Headline</h1></header><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be given.</p><form><p>your mail</p></form></article>"
    assert Page(f"<body><header><h1>Site</h1></header>{body}</body>").text(None) == "Headline\nLet x=1 be given."
    assert Page("<body><form><div><p>a whole page inside a form</p></div></form></body>").text(None) == "a whole page inside a form"
    assert Page("<article><p>see <object><a>the file</a></object> <video>no film</video></p></article>").text(None) == "see the file no film"


def test_deep_nesting_takes_little_memory():
    import tracemalloc

    html = "<div class=level>" * 16_000 + "<p>deep inside</p>"
    tracemalloc.start()
    assert Page(html).text(None) == "deep inside"
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


def test_the_whole_article_is_taken():
    para = "words of one section, as long as those of any other. " * 6
    four = "".join(f"<div class='{n}'><section class='inner'><p>{n} {para}</p></section></div>" for n in ("intro", "method", "results", "end"))
    want = "\n".join(f"{n} {para.strip()}" for n in ("intro", "method", "results", "end"))
    for open_, close in (("<main>", "</main>"), ("<div class=page>", "</div>"), ("<div class=a><div class=b>", "</div></div>")):
        html = f"<body><nav><p>menu</p></nav>{open_}{four}{close}<div class='ad'><p>buy</p></div></body>"
        assert Page(html).text(None) == want
        # the host's vote, whichever of the four wins
        for _, path, _, _ in Page(html).best():
            assert Page(html).text(path) == want
    short = f"<body><div class=page><div class=lead><p>Short lead.</p></div><div class=body><p>{para * 9}</p></div><ul class=more><li><a href=x>a link</a></li></ul></div></body>"
    assert Page(short).text(None) == f"Short lead.\n{(para * 9).strip()}"


def test_names_that_only_contain_a_suspect_word_are_no_reason():
    para = "what a section says, and it is part of the article. " * 3
    for name in ("side-effects", "promotion-board", "related-work", "consent-law", "menu-planning"):
        html = f"<body><main><p>{para * 5}</p><div class='{name}'><p>{name}: {para}</p></div></main></body>"
        assert Page(html).text(None) == f"{(para * 5).strip()}\n{name}: {para.strip()}"
    for name in ("related-posts", "comment-list", "cookie-notice", "newsletter-signup", "share-buttons", "ad-box", "sidebar", "menu"):
        html = f"<body><main><p>{para * 5}</p><div class='{name}'><p>{name}: {para}</p></div></main></body>"
        assert Page(html).text(None) == (para * 5).strip()


def test_reading_is_linear():
    import time

    began = time.perf_counter()
    for html in ("<div>" * 64_000 + "</section>" * 64_000, "<section><table><tr><td>" + "<div>" * 64_000 + "</section>" * 64_000, "<ul>" + "<li><div>" * 64_000 + "</ol>" * 64_000, "<div><p>x" * 64_000):
        Page(html + "<p>text").text(None)
    assert time.perf_counter() - began < 40
