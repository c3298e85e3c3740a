import html
import random
import re
from collections import Counter, defaultdict

import pytest

from spanwise.llm import html_extract
from spanwise.llm.html_extract import Page

ROOT = "/root/testdata/sf0.01"
FULL = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{color:red}</style><script>var a="<p>no</p>";</script></head><body class="page-7">
<header class="site"><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="main" class="col-8"><article class="post-12"><header><h1>Head&shy;line</h1><p class="byline">By someone</p></header>
<p>First   &lt;para&gt;
with <b>bold<i> text</b> and &eacute;.<p>Second one<br>goes on<!-- hidden --> here<ul><li>item one<li>item two</ul>
<div class="ad-slot-3">Buy now</div><aside>Aside</aside><form><input value="x">Name</form><blockquote>Quoted</blockquote><table><tr><td>c1<td>c2</table><footer>Tags</footer></article>
<div class="comments"><p>A reader says a lot, far more than the article itself does, in very many words indeed, and on and on it goes</p></div></div>
<div class="sidebar">Side text</div><footer>Foot</footer></body></html>"""
TEXT = "Head\xadline\nFirst <para> with bold text and é.\nSecond one goes on here\nitem one\nitem two\nQuoted\nc1\nc2"


def text_of(page):
    p = Page(page)
    top = p.best()
    return p.text_of(element=top[0]) if top else ""


def test_a_full_page():
    assert text_of(FULL) == TEXT


@pytest.mark.parametrize(("page", "expected"), [
    (None, ""), ("", ""), ("  ", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\nb"), ("<p>un<closed", "un"), ("a < b and 3 <4", "a < b and 3 <4"),
    ("<script>x</script><p>y", "y"), ("<script>never ends", ""), ("<!-- c --><p>z<!-- open", "z"), ("</div></p><p>stray</span>", "stray"), ("<div hidden><p>a</p></div>", "a"),
    ("<P CLASS='Intro'>Upper</P>", "Upper"), ("<p>&#233;&#x41;&nbsp;&amp;amp;</p>", "éA &amp;"), ("<div class='with-sidebar'><p>body text</p></div>", "body text"), ("<nav>only menu</nav>", ""),
])
def test_odd_pages(page, expected):
    assert text_of(page) == expected


def test_junk_ends_behind_many_open_inline_elements():
    assert text_of("<article><p>Before <span class=ad>buy " + "<b>" * 40 + "now</span> and after</p></article>") == "Before and after"


@pytest.mark.parametrize("junk", [
    "<noscript><p>J</p></noscript>", "<template><div>J</div></template>", "<button><div>J</div></button>", "<label><p>J</p></label>", "<object><p>J</p></object>", "<select><option>J<option>J</select>",
    "<svg><text>J</text></svg>", '<span class="ad"><div>J</div></span>', '<a class="advert"><div>J</div></a>', '<span class="ad"><div>J</div>J<div>J</div></span>', '<p><button><div>J</div></button></p>',
])
def test_junk_around_blocks_goes(junk):
    assert text_of(f"<article><p>Main text.</p>{junk}<p>More of it.</p></article>") == "Main text.\nMore of it."


@pytest.mark.parametrize("page", [
    "<form><article><p>Main text.</p></article></form>", '<form id="aspnetForm"><div><input><label>L</label><p>Main text.</p></div></form>', '<div class="post category-social"><p>Main text.</p></div>',
    '<div class="notice"><article><p>Main text.</p></article></div>', '<article><p>Main text.</p><form>Search this site</form></article><div class="comments"><article><p>A reader has much more to say</p></article></div>',
])
def test_forms_and_class_words_do_not_empty_a_page(page):
    assert text_of(f"<body><nav>menu</nav>{page}</body>") == "Main text."


@pytest.mark.parametrize("name", ["search-engine-guide", "social-history", "banner-year", "copyright-law", "notice-board-story", "banner-image-note", "footerology", "notice"])
def test_a_class_word_does_not_delete_an_article(spark, name):
    rows = [(i, f"http://h.example/{i}", f"<nav>menu</nav><div class='{name}'><p>{'word ' * 40}one</p><p>{'text ' * 30}two</p></div><div class='foot'>Short {i}.</div>") for i in range(20)]
    got = {r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"word " * 40 + "one\n" + "text " * 30 + "two"}


@pytest.mark.parametrize("attr", ["class=social-history", "class=banner-year", "class=banner-image-note", "id=replies-of-kings", "class='cookie-recipe first'"])
def test_a_class_word_does_not_delete_a_paragraph(attr):
    assert text_of(f"<article><p>Start.</p><p {attr}>Middle.</p><div {attr}><p>More.</p></div></article>") == "Start.\nMiddle.\nMore."


@pytest.mark.parametrize("name", ["cookie-notice", "ad-slot-3", "site-footer", "post-comments", "related-posts-ads", "sidebarWidget", "social-share-bar", "comments", "adBox", "top-banner"])
def test_names_of_junk_words_alone_are_junk(name):
    gone = f"<article><p>Main text.</p><div class='{name}'><p>Junk.</p></div><p>End.</p></article>"
    assert text_of(gone) == ("Main text.\nJunk.\nEnd." if name == "related-posts-ads" else "Main text.\nEnd.")


def test_references_do_not_go_across_tags():
    assert text_of("<p>x &<b>lt;</b> y &amp<i>lt;</i> &lt;b&gt; &am<i>p;</i></p>") == "x &lt; y &lt; <b> &amp;"


def test_generated_pages_without_an_article(spark):
    """Menus, adverts, comments and footers around a container whose name says nothing, or says something of a junk word."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "&eacute;t&eacute;"]) for _ in range(n))
    rows, expected = [], {}
    for i in range(150):
        name = ["c-wrap", "search-engine-guide", "history", "node", "x9"][i % 5]
        blocks = [say(rng.randint(15, 40)) for _ in range(rng.randint(3, 6))]
        junk = ["<div class='ad-slot'><p>Buy</p></div>", "<form><p>Name</p></form>", "<aside>By the way</aside>", "<script>x()</script>", "<div class='share-bar'><a href='#'>Share</a></div>"]
        inner = "".join(f"<{t}>{b}</{t}>{rng.choice(junk)}" for b in blocks for t in [rng.choice(["p", "h2", "blockquote", "li"])])
        page = f"<body><header><h1>Site</h1></header><ul class='nav-menu'><li><a href='/'>Home</a><li><a href='/b'>B</a></ul><div class='{name}'>{inner}</div><div class='comments'><p>{say(30)}</p></div><footer>{say(8)}</footer></body>"
        rows.append((i, f"https://h{i % 5}.example/{i}", page))
        expected[i] = html.unescape("\n".join(blocks))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected


def test_junk_that_never_ends_is_closed_by_its_container():
    assert text_of("<article><div><p>a</p><span class=ad><p>J</div><p>b</p></article>") == "a\nb"
    assert text_of("<article><p>a <span class=ad>J<p>b</article>") == "a\nb"


def test_votes_against_brute_force(spark):
    """Pages without an article: six layouts a host, some pages with two of them; each page takes the most voted that it has."""
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = []
    for i in range(120):
        layouts = rng.sample(["zero", "one", "two", "three", "four", "five"], rng.choice([1, 1, 2]))
        rows.append((i, f"https://h{i % 3}.example/{i}", "".join(f"<div class='{c}'><p>{words(rng.randrange(3, 60))}</p></div>" for c in layouts) + "<p>tail</p>" * (i % 2)))
    pages = [(i, u.split("/")[2], Page(h)) for i, u, h in rows]
    votes, mass = defaultdict(Counter), defaultdict(Counter)
    for _, host, p in pages:
        e, score = p.best()
        votes[host][p.path[e]] += 1
        mass[host][p.path[e]] += score
    slow = {}
    for i, host, p in pages:
        order = sorted((x for x, n in votes[host].items() if n >= 0.01 * sum(votes[host].values())), key=lambda x: (-votes[host][x], -mass[host][x], x))
        slow[i] = next(t for x in order if (t := p.text_of(path=x)) is not None)
    assert max(map(len, votes.values())) > 4
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == slow


def test_heading_areas():
    """Headings of an article's own heading area stay; a site's do not. A byline elsewhere is text."""
    page = """<body class="single-post"><div class="site-header"><h1>Site</h1></div><div class="post"><div class="post-header"><h2>Title</h2><p>meta</p><nav><h2>m</h2></nav></div>
    <p class="byline">By B</p><div class="long-form"><p>Text one two three</p></div></div></body>"""
    assert text_of(page) == "Title\nBy B\nText one two three"


def test_deep_and_long_pages():
    assert text_of("<div>" * 5000 + "deep") == "deep"
    assert len(text_of("<article>" + "<p>word</p>" * 20_000 + "</article>")) == 20_000 * 5 - 1
    assert text_of("<p " + "a='1' " * 5000 + ">x") == "x"


def test_hosts_agree_on_a_container(spark):
    """A page whose own best container is wrong gets its host's."""
    good = [(i, f"http://h.example/{i}", f"<div class='body{i}'><p>{'main text here ' * 20}</p></div><div class='x{i}'><p>short</p></div>") for i in range(8)]
    odd = (9, "http://H.example:80/odd", f"<div class='body9'><p>brief</p></div><div class='x9'><p>{'a long thing that is not the text ' * 20}</p></div>")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame([*good, odd], "page_id long, url string, html string")).collect()}
    assert got[9] == "brief" and got[0] == ("main text here " * 20).strip()


def test_tables(spark):
    rows = [(1, None, FULL), (1, None, FULL), (2, "not a url", "<p>x"), (3, "http://a/b", None), (None, "http://a/c", ""), (4, "http://only.one/", "<article><p>alone</p></article>")]
    df = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.extract(df)
    by = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got.collect()), key=str)
    exp = [(1, None, TEXT, len(TEXT))] * 2 + [(2, "not a url", "x", 1), (3, "http://a/b", "", 0), (None, "http://a/c", "", 0), (4, "http://only.one/", "alone", 5)]
    assert by == sorted(exp, key=str) and got.columns == ["page_id", "url", "text", "n_chars"]
    assert html_extract.extract(df.limit(0)).count() == 0
    shuffled = html_extract.extract(df, broadcast_paths=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, got.collect()))


def test_all_pages_against_their_articles(spark):
    pages = spark.read.parquet(f"{ROOT}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"<(?!/?(?:p|h1)\b)[^>]*>", "", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", body))
        assert got[r["page_id"]] == "\n".join(x for x in blocks if x)
