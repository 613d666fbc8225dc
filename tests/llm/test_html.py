"""Page trees from tag soup, inferred wrappers, and main texts against pages whose articles are known."""

import html
import random
import re

import pytest

from vectide.llm import html_extract as E
from vectide.llm.html_tree import DEPTH, Text, parse


def texts(e):
    return [x for k in e.kids for x in ([k.text] if isinstance(k, Text) else texts(k))]


def shape(page):
    return E.expression(parse(page)).shape()


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a<b>b</b>\n c<br>d<p>e", ["ab c d", "e"]),
        ("<div>x<p>y</p>z</div>", ["x", "y", "z"]),
        ("a &lt;b&gt; &amp;amp; &#233;&nbsp;&copy x", ["a <b> &amp; é © x"]),
        ("1 < 2 <3 and a<b", ["1 < 2 <3 and a"]),
        ("<script>var t='</p><p>no';</script>yes<style>p{}</style>", ["yes"]),
        ("<SCRIPT>never closed <p>x", []),
        ("a<!-- <p>b -->c<!-- open <p>d", ["ac"]),
        ("<p title='x > y' class=\"a\">in</p>", ["in"]),
        ("<p title=don't>in</p>", ["in"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("</div></p>stray<div", ["stray"]),
        ("", []),
    ],
)
def test_parse(page, want):
    assert texts(parse(page)) == want


def test_nesting():
    assert shape("<ul><li>a<li>b<li>c</ul>") == "(ul(li(#())+))"
    assert shape("<p>a<p>b<div>c</div>") == "(p(#())+,div(#()))"
    assert shape("<p><b>a</b><br><p>b") == "(p(#())+)"


def test_deep_long_and_odd_pages():
    for page in ("<div>" * 100_000 + "deep", "<a \"" * 50_000, "<" * 200_000, "<p " + "x='" * 50_000, "&" * 200_000, "<p>word " * 50_000, "<!--" * 50_000):
        assert "".join(E.blocks_of(parse(page), None)) is not None
    assert texts(parse("<div>" * (3 * DEPTH) + "deep" + "</div>" * (3 * DEPTH) + "end")) in (["deep", "end"], ["deepend"])


def wrapper(*pages):
    return E.merged([E.bare(E.expression(parse(p))) for p in pages])


def test_wrappers_are_inferred():
    """Slots, optional and repeated groups, and squares of several elements."""
    w = wrapper("<div><h1>A</h1><p>x</p></div>", "<div><h1>B</h1><img><p>y</p><p>z</p></div>", "<div><h1>C</h1><p>x</p><h2>u</h2></div>")
    assert w.shape() == "(div(h1(#()),p(#())+,h2(#())?))"
    w = wrapper("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p></div>", "<div><h1>t</h1><h2>e</h2><p>f</p><h2>g</h2><p>h</p><p>i</p></div>")
    assert w.shape() == "(div(h1(#())?,()(h2(#()),p(#())+)+))"
    w = wrapper("<p>same</p><div>one</div>", "<p>same</p><div>two</div>")
    assert [k.kids[0].text is None for k in w.kids] == [False, True]


def test_wrappers_stay_small():
    rnd = random.Random(5)
    tags = ["p", "h2", "ul", "pre", "table", "blockquote", "dl", "section", "figure", "h3"]
    w = wrapper(*["<article>" + "".join(f"<{t}>x{rnd.random()}</{t}>" for t in rnd.choices(tags, k=60)) + "</article>" for _ in range(80)])
    assert len(E._store(w)) < 5000
    assert E._load(E._store(w)).shape() == w.shape()


WORDS = "river stone under light while paper green seven often market".split()


def made(rnd, kind, k):
    """A page of a kind of host and the blocks of its article."""
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    blocks = [f"Title {k} & more " + say(3)] + [say(rnd.randint(15, 60)) + rnd.choice([".", " <x>", " é", " \"q\""]) for _ in range(rnd.randint(1, 6))]
    soup = lambda b: html.escape(b).replace(" stone", " <b>stone</b>").replace(" seven", "\n\t<a href='/x'>seven</a>").replace(" paper", "<br> paper")
    close = rnd.choice(["</p>", ""])
    body = [f"<p>{soup(b)}{close}" for b in blocks[1:]]
    if rnd.random() < 0.4:
        blocks[2:2] = ["point one", "point two"]
        body[1:1] = ["<ul><li>point one<li>point two</ul>"]
    inner = f"<h1>{soup(blocks[0])}</h1>" + "".join(body)
    nav = "".join(f"<li><a href=/{w}>{w}</a>" for w in rnd.choices(WORDS, k=rnd.randint(3, 7)))
    notes = "".join(f"<div class='c'><b>user</b> {say(rnd.randint(20, 80))}</div>" for _ in range(rnd.randint(0, 5)))
    head = f"<!DOCTYPE html><html><head><title>{k}</title><script>if (1 < 2) x('</p>')</script></head>"
    return {
        "article": f"{head}<body><header><a>Site {k}</a></header><nav><ul>{nav}</ul></nav><div class=ad>{say(30)}</div><article>{inner}<aside>{say(9)}</aside><p>Share this page</p></article><footer>{say(5)}</footer>",
        "plain": f"{head}<body><div><div><ul>{nav}</ul></div><div>{inner}</div><div><p>&copy; {say(3)}</p></div></div></body></html>",
        "classes": f"{head}<body class='has-sidebar x{k}'><div id=cookie-notice>{say(60)}</div><div id='page-{k}'><div class='post-{k} entry'><div class='entry-header'><h1>{soup(blocks[0])}</h1><span>by me</span></div>{''.join(body)}<form><p>Mail us</p><textarea>x</textarea></form></div><div class='comments'>{notes}</div><div class=sidebar>{say(90)}</div></div></body>",
        "table": f"{head}<body><table><tr><td class=menu>{nav}</td><td>{inner}</td><td class='ads'>{say(50)}</td></tr></table>",
        "main": f"{head}<body><main>{inner}<section id=comments><article class=comment><p>{say(200)}</p></article></section></main><div class='footer'>{say(9)}</div></body>",
    }[kind], blocks


@pytest.fixture(scope="module")
def site():
    rnd = random.Random(9)
    rows, want = [], {}
    for k in range(150):
        kind = ["article", "plain", "classes", "table", "main"][k % 5]
        page, blocks = made(rnd, kind, k)
        rows.append((k, f"http://{kind}.example.org/{k}?x", page))
        want[k] = "\n\n".join(" ".join(b.split()) for b in blocks)
    return rows, want


def extracted(spark, rows, parts):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, text string").repartition(parts)
    return E.extract_main_text(df).collect()


@pytest.mark.parametrize("parts", [1, 5])
def test_known_articles(spark, site, parts):
    rows, want = site
    got = extracted(spark, rows, parts)
    assert sorted(r.page_id for r in got) == sorted(want)
    wrong = [r.page_id for r in got if r.text != want[r.page_id]]
    assert not wrong, (rows[wrong[0]][2], next(r.text for r in got if r.page_id == wrong[0]), want[wrong[0]])


def test_large_wrappers_are_joined(spark, site, monkeypatch):
    monkeypatch.setattr(E, "BROADCAST", -1)
    rows, want = site
    assert {r.page_id: r.text for r in extracted(spark, rows, 3)} == want


def test_edges(spark, site):
    page, text = site[0][0][2], site[1][0]
    rows = [(1, None, page), (1, None, page), (2, "http://a.org/", None), (3, "http://a.org/", ""), (4, "no url", "just text"), (5, "http://a.org/", "<p>" + "long " * 300_000), (None, "http://b.org", "<article><p>x</p></article>"), (6, "http://b.org", "<div>no article here</div>")]
    rows += [(k, "http://copies.org/", "<article><h1>One title</h1><p>One text</p><blockquote>short</blockquote></article>") for k in range(10, 40)]  # copies are no template
    got = extracted(spark, rows, 3)
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert [r.text for r in got if r.page_id == 1] == [text.replace("\n\nShare this page", "") + "\n\nShare this page"] * 2
    assert (by[2], by[3], by[4], by[None], by[6]) == ("", "", "just text", "x", "no article here") and by[5] == "long " * 299_999 + "long"
    assert {by[k] for k in range(10, 40)} == {"One title\n\nOne text\n\nshort"}
    assert extracted(spark, [], 2) == []


def test_given_pages_against_a_plain_reading(spark):
    """The given pages mark their articles; a regular expression reads those."""
    import os

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the driver's tables")
    pages = spark.read.parquet(path)
    got = {r.page_id: r.text for r in E.extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:h1|p)>", inner)]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)
