import html
import json
import random
import re

import pytest

from hindcast.llm import extraction, queries
from hindcast.llm.extraction import Wrapper, host_of, main_text, parse, regions


def text_of(page):
    tree = parse(page)
    return main_text(tree, regions(Wrapper.of(tree)))


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("plain &lt;b&gt; text\n\n more", "plain <b> text more"),
        ("<p>a<b>b</b>c<p>d", "abc d"),
        ("<article><h1>T</h1><p>x <i>y</i>\n z</p><div>w</div></article><p>outside</p>", "T x y z w"),
        ("<nav>menu</nav><main><p>body text</p><aside>side</aside></main><footer>f</footer>", "body text"),
        ("<body><div class='sidebar'>no</div><div id=content><p>yes yes yes yes</p><p>and more of it</p></div></body>", "yes yes yes yes and more of it"),
        ("<article><p>kept</p><div class='post-comments'>gone</div><form>gone</form><script>gone</script></article>", "kept"),
        ("<article><p>1 < 2 &amp; 3 &gt 2 &copy &#233;&nbsp;&unknown; a<!-- <p>no</p> -->b</p></article>", "1 < 2 & 3 > 2 © é &unknown; ab"),
        ("<script>var t='</p>';</script><style>p{}</style><article>in<br>two<br/>lines</article>", "in two lines"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>", "one two a b c"),
        ("<ARTICLE CLASS=\"Main\"><P TITLE='a>b'>up</P></ARTICLE>", "up"),
        ("<article><p>unclosed <b>bold<p>next", "unclosed bold next"),
        ("<article>x<script>never closed", "x"),
        ("</div></p><article>stray</b> ends</article>", "stray ends"),
        ("<article></article><main>m</main>", "m"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<div class='page with-sidebar'><article><p>whole article</p></article><div class=sidebar>s</div></div>", "whole article"),
        ("<div class='content no-sidebar'><article>text</article></div>", "text"),
        ("<div class='layout header-fixed has-footer'><h1>T</h1><p>a body of text</p></div>", "T a body of text"),
        ("<article><p>first</p><p class='share-price'>12.50</p><p class='share-buttons'>tweet</p></article>", "first 12.50"),
        ("<div class=widget><main><p>the page</p></main></div><div class=widget>w</div>", "the page"),
        ("<form id=aspnetForm><div><h1>Head</h1><p>much text of the page itself</p></div></form>", "Head much text of the page itself"),
        ("<div><p>short</p></div><div id=comments><article><h1>x</h1>a very long comment of a reader of this</article></div>", "short"),
        ("<div><p>own text</p></div><aside><article>much longer text of a teaser, longer than all</article></aside>", "own text"),
        ("<div class='site-header'>logo</div><div class='post'><p>body text of it</p></div><div class='newsletter-box'>join</div>", "body text of it"),
        ("<p>first</p><svg class=\"icon\"/><p>second</p>", "first second"),
        ("<p>first</p><svg><title>t</title><path/></svg><p>second</p>", "first second"),
        ("<p>a</p><script src=x /><p>in the script</p></script><p>b</p>", "a b"),
        ("<" * 5000, "<" * 5000),
        ("<a <b>x", "x"),
    ],
)
def test_single_pages(page, want):
    assert text_of(page) == want


def random_page(rng):
    def part(depth):
        kind = rng.choice(["p", "p", "ul", "div", "text", "b", "open"])
        if kind == "text" or depth > 3:
            return rng.choice(["word ", "é &amp; ", " "])
        if kind == "ul":
            return "<ul>" + "".join(f"<li class=i{rng.randint(0, 9)}>{part(depth + 1)}</li>" for _ in range(rng.randint(0, 4))) + "</ul>"
        if kind == "open":
            return f"<p>{part(depth + 1)}"
        tag = kind if kind != "div" else rng.choice(["div", "div class=x", "section", "div class=ad"])
        return f"<{tag}>" + "".join(part(depth + 1) for _ in range(rng.randint(0, 4))) + f"</{tag.split()[0]}>"

    return "<body>" + "".join(part(0) for _ in range(rng.randint(0, 6))) + "</body>"


@pytest.mark.parametrize("seed", range(40))
def test_wrappers_accept_every_page_they_come_from(seed):
    rng = random.Random(seed)
    pages = [parse(random_page(rng)) for _ in range(12)]
    parts = [Wrapper.of(p) for p in pages]
    for part, page in zip(parts, pages):
        assert part.accepts(page)
    left = parts[0]
    for part in parts[1:]:
        left = left.merged(part)
    halves = [parts[0], parts[6]]
    for i in range(1, 6):
        halves = [halves[0].merged(parts[i]), halves[1].merged(parts[6 + i])]
    for whole in (left, halves[0].merged(halves[1]), Wrapper.load(json.loads(json.dumps(left.dump())))):
        assert all(whole.accepts(p) for p in pages)
        names = [m[0] for members, _ in whole.items for m in members]
        assert len(names) == len(set(names))


def test_mismatches_become_optional_and_repeated():
    a, b = (Wrapper.of(parse(x)) for x in ("<h1>t</h1><p>x</p>", "<h1>t</h1><h2>u</h2><p>x</p><p>y</p>"))
    assert a.merged(b).items == [[[["h1", False, False]], False], [[["h2", True, False]], False], [[["p", False, True]], False]]
    c = Wrapper.of(parse("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>"))
    assert c.items == [[[["h2", True, False], ["p", True, False]], True]]
    assert not a.accepts(parse("<p>x</p>"))
    assert not a.accepts(parse("<p>x</p><h1>t</h1>"))


def test_hosts():
    assert host_of("HTTPS://User@Example.ORG:80/x") == "example.org"
    assert host_of(None) == host_of("") == host_of("http://[bad") == host_of("no url") == ""


def test_wide_pages_do_not_take_long():
    page = "".join(f"<x{i}>t</x{i}>" for i in range(3000))
    other = "".join(f"<y{i}>t</y{i}>" for i in range(3000))
    both = Wrapper.of(parse(page)).merged(Wrapper.of(parse(other)))
    assert both.accepts(parse(page)) and both.accepts(parse(other))


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div id=page><article>" + "<div>" * 200 + "deep" + "</div>" * 200 + "<p>tail</p></article></div><p>out</p>", "deep tail"),
        ("<article>" + "<div>" * 200 + "<p>a</p><p>b</p><div class=ad>no</div><nav>no</nav>c" + "</div>" * 200 + "d</article>", "a b c d"),
        ("<article>" + "<font>" * 200 + "<p>a<p>b<aside>no</aside></article><p>out</p>", "a b"),
        ("<article>" + "<b><p>x" * 30000 + "</article>", " ".join(["x"] * 30000)),
    ],
    ids=["tail", "unwanted", "unclosed", "very deep"],
)
def test_deep_elements_are_like_others(page, want):
    assert text_of(page) == want
    tree = parse(page)
    own = Wrapper.of(tree)
    whole = Wrapper.load(json.loads(json.dumps(own.merged(Wrapper.of(parse("<article><p>else</p></article>"))).dump())))
    assert whole.accepts(tree) and main_text(tree, regions(whole)) == want


@pytest.mark.parametrize("word", ["sidebar", "newsletter", "share", "widget"])
def test_unwanted_words_count_wherever_they_stand(word):
    classes = f"bg border flex gap hidden lg p rounded {word}"
    assert text_of(f"<article><p>kept</p><div class='{classes}'>gone</div></article>") == "kept"


def test_regions_are_told_by_any_word():
    assert text_of("<div class='a b c d e f g h main'><p>in</p></div><p>longer text outside of it</p>") == "in"
    assert text_of("<div itemprop=articleBody class='a aa ab ac ae af ag ah'><p>in</p></div><p>longer text outside of it</p>") == "in"


def test_wide_elements_are_aligned():
    page = "".join(f"<x{chr(97 + i % 26)}{i // 26}>t</x{chr(97 + i % 26)}{i // 26}>" for i in range(500))
    both = Wrapper.of(parse(page)).merged(Wrapper.of(parse(page + "<z>t</z>")))
    assert [m for members, repeated in both.items for m in members if repeated or m[1]] == [["z", True, False]]
    assert not both.accepts(parse("<z>t</z>"))


def extracted(spark, pages):
    rows = [(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)]
    found = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    return [r.text for r in sorted(found.collect())]


def test_texts_equal_on_all_pages_of_a_host_are_template(spark):
    def page(i):
        body = "".join(f"<p>story {i} <b>and</b> part {k}</p><p>and</p>" if k else f"<p>start {i}</p>" for k in range(i % 3 + 1))
        note = "<p>Read <b>more</b> like this:</p>" if i % 2 else "<div class=q>Get our  letter</div>"
        cells = f"<table><tr><td>0</td><td>x{i}</td>{'<td>0</td>' * (i % 2)}<td>Sum</td></tr></table>"
        return f"<body><p>Top line</p><article><h1>title {i}</h1>{note}{body}<p>Subscribe\nnow</p>{cells}</article></body>"

    def want(i):
        body = [f"story {i} and part {k} and" if k else f"start {i}" for k in range(i % 3 + 1)]
        note = ["Read more like this:"] * (i % 2)  # other pages have that place without it
        return " ".join([f"title {i}", *note, *body, "0", f"x{i}", *["0"] * (i % 2)])

    assert extracted(spark, [("a", page(i)) for i in range(12)]) == [want(i) for i in range(12)]


def test_a_few_or_equal_pages_tell_no_template(spark):
    page = "<article><p>one {}</p><p>same</p></article>"
    pages = [("two", page.format(0)), ("two", page.format(1)), *[("copies", f"<head><title>{i}</title></head>" + page.format(0)) for i in range(5)]]
    assert extracted(spark, pages) == ["one 0 same", "one 1 same", *["one 0 same"] * 5]
    whole = [("all", f"<p>date {i}</p><article><p>same text</p></article>") for i in range(4)]
    assert extracted(spark, whole) == ["same text"] * 4


def test_constants_do_not_depend_on_the_order_of_pages():
    rng = random.Random(4)
    parts = [extraction.Constants.of(parse(random_page(rng) + "<p>same</p>")) for _ in range(9)]

    def merged(items):
        out = items[0]
        for x in items[1:]:
            out = out.merged(x)
        return out

    want = merged(parts).dump()
    assert merged(parts).template()
    for _ in range(5):
        rng.shuffle(parts)
        assert merged([merged(parts[:4]), extraction.Constants.load(json.loads(json.dumps(merged(parts[4:]).dump())))]).dump() == want


def plain(page):
    """The main text of the test tables' pages, cut out by their known markup."""
    body = page.partition("<article>")[2].partition("</article>")[0]
    blocks = re.split(r"</?(?:p|h1|br)>", body)
    return " ".join(x for x in (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks) if x)


def test_whole_table_against_known_markup(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op5_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_awkward_rows(spark):
    rows = [
        (1, None, "<article>no url</article>"), (2, "http://a.example/x", None), (3, "http://a.example/y", ""), (4, "http://[bad", "bad"),
        (5, "http://a.example/z", "<article><p>ok</p></article>"), (5, "http://a.example/z", "<article><p>ok</p></article>"),
        (6, "http://a.example/w", "<div class=other><p>unlike the others</p></div>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS wrapper", "'z' AS text")
    got = sorted((r.page_id, r.text) for r in extraction.extract(pages).collect())
    assert got == [(1, "no url"), (2, ""), (3, ""), (4, "bad"), (5, "ok"), (5, "ok"), (6, "unlike the others")]
    assert extraction.extract(pages.limit(0)).collect() == []
