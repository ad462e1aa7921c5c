"""Main text of twenty page layouts, with what belongs to it written down by hand; blocks are compared exactly."""

from collections import Counter

import pytest

from trialgrid.llm import htmltext

WORDS = "the river runs past old mills where people once ground grain and now walk along its quiet banks on sunday afternoons with dogs and children".split()


def prose(n, at=0):
    return " ".join(WORDS[(at + 7 * i * i + i) % len(WORDS)] for i in range(n))


P = [prose(40, k) for k in range(8)]
ADVERT = prose(400, 3).replace("river", "buy").replace("quiet", "cheap")
NAV = "<nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in WORDS[:8]) + "</ul></nav>"
FOOT = "<footer>&copy; example &middot; imprint</footer>"
ITEMS = [prose(3, k) for k in range(30)]


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body>{body}</body></html>"


def paras(*texts):
    return "".join(f"<p>{x}</p>" for x in texts)


LAYOUTS = {
    "list in the article": (f"{NAV}<article><h1>real</h1><ul>{''.join(f'<li>{x}</li>' for x in ITEMS)}</ul></article>{FOOT}", ["real", *ITEMS]),
    "advert between two parts": (f"{NAV}<article><h1>head</h1>{paras(*P[:3])}<div class=\"ad\">{ADVERT}</div>{paras(*P[3:6])}</article>{FOOT}", ["head", *P[:6]]),
    "advert between two parts without an article": (f"{NAV}<div class=\"story\"><h1>head</h1>{paras(*P[:3])}</div><div class=\"ad-box\">{ADVERT}</div><div class=\"story\">{paras(*P[3:6])}</div>{FOOT}", ["head", *P[:6]]),
    "comments as articles": (f"<article><h1>head</h1>{paras(*P[:2])}</article><article class=\"comment\"><p>{P[6]}</p></article><article class=\"comment\"><p>{P[7]}</p></article>", ["head", *P[:2]]),
    "comments as articles without a class": (f"<article><h1>head</h1>{paras(*P[:3])}</article><article><p>{P[6]}</p></article><article><p>{P[7]}</p></article>", ["head", *P[:3]]),
    "articles inside the article": (f"<article><h1>head</h1>{paras(*P[:2])}<section><h2>views</h2><article><p>{P[5]}</p></article><article><p>{P[6]}</p></article></section></article>", ["head", *P[:2], "views"]),
    "comment service": (f"<article><h1>head</h1>{paras(*P[:2])}</article><div id=\"disqus_thread\">{paras(*P[4:7])}</div>", ["head", *P[:2]]),
    "responses": (f"<div class=\"entry\"><h1>head</h1>{paras(*P[:3])}</div><div class=\"responses\">{paras(*P[4:7])}</div>", ["head", *P[:3]]),
    "consent box": (f"<div class=\"gdpr-box\"><p>{P[7]}</p></div>{NAV}<div><h1>head</h1>{paras(*P[:3])}</div>{FOOT}", ["head", *P[:3]]),
    "table": (f"{NAV}<article><h1>head</h1><p>{P[0]}</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table><p>{P[1]}</p></article>", ["head", P[0], "a", "b", "1", "2", "3", "4", P[1]]),
    "main element": (f"{NAV}<main><h1>head</h1>{paras(*P[:3])}</main><div>{P[7]}</div>{FOOT}", ["head", *P[:3]]),
    "plain paragraphs": (f"{NAV}{paras(*P[:4])}{FOOT}", P[:4]),
    "old table layout": (f"<table><tr><td><a href=x>one two</a> <a href=y>three four</a></td><td><h2>head</h2>{paras(*P[:3])}</td></tr></table>", ["head", *P[:3]]),
    "link lists around": (f"<ul>{''.join(f'<li><a href=x>{x}</a></li>' for x in ITEMS[:9])}</ul><div><h1>head</h1>{paras(*P[:4])}</div><ul>{''.join(f'<li><a href=x>{x}</a></li>' for x in ITEMS[:9])}</ul>", ["head", *P[:4]]),
    "links in running text": (f"{NAV}<article><p>{prose(20)} <a href=x>{prose(4, 2)}</a> {prose(20, 5)}</p><ul><li><a href=y>{ITEMS[1]}</a></li></ul></article>", [f"{prose(20)} {prose(4, 2)} {prose(20, 5)}", ITEMS[1]]),
    "header in the article": (f"<header>site</header><article><header><h1>head</h1><p>by someone</p></header>{paras(*P[:2])}<footer>tags</footer></article>", ["head", "by someone", *P[:2]]),
    "figure and quote": (f"<article>{paras(P[0])}<figure><img src=x><figcaption>a caption</figcaption></figure><blockquote>{P[1]}</blockquote><pre>x  =\n 1</pre></article>", [P[0], "a caption", P[1], "x = 1"]),
    "forms and asides": (f"<article>{paras(P[0])}<aside>{P[5]}</aside><form><p>your mail</p><button>send</button></form>{paras(P[1])}</article>", P[:2]),
    "references and white space": ("<article><p>  a &lt; b &amp;\n\t c&nbsp;d <b>bold</b>ly<br>next </p><div>loose <i>text</i><p>inner</p>tail</div></article>", ["a < b & c d boldly next", "loose text", "inner", "tail"]),
    "class names that only look like marks": (f"<div class=\"comment-free\">{paras(P[0])}</div><div class=\"social-science\">{paras(P[1])}</div><div class=\"site-nav\">{paras(P[5])}</div>", P[:2]),
}


@pytest.fixture(scope="module")
def model(spark):
    return htmltext.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(model, name):
    body, want = LAYOUTS[name]
    for x in (model, None):
        assert htmltext.main_text(page(body), x).split("\n") == want


def test_recall_and_precision_of_words(model):
    hits = given = wanted = 0
    for body, want in LAYOUTS.values():
        a, b = Counter(htmltext.main_text(page(body), model).split()), Counter(" ".join(want).split())
        hits, given, wanted = hits + (a & b).total(), given + a.total(), wanted + b.total()
    assert hits >= 0.95 * given and hits >= 0.95 * wanted


def test_boxes_are_learned_by_their_classes(spark):
    """A class that stands outside the article on labelled pages is a box on others, whatever it is called."""
    labelled = [(i, "u", page(f"<div class=\"wrap\"><article>{paras(*P[:3])}</article><div class=\"zzplugh\">{paras(P[6])}</div></div>")) for i in range(30)]
    bare = [(99, "u", page(f"<div class=\"wrap\">{paras(*P[:3])}<div class=\"zzplugh\">{paras(P[6])}</div></div>"))]
    got = {r.page_id: r for r in htmltext.extract(spark.createDataFrame(labelled + bare, "page_id long, url string, html string")).collect()}
    assert {r.text for r in got.values()} == {"\n".join(P[:3])}
    assert got[99].n_chars == len(got[99].text)


def test_pages_without_the_mark_keep_their_text(spark):
    """The pages of the tables with their article elements turned into plain boxes give the same text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    with_mark = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    model = htmltext.train(pages)
    for r in pages.collect():
        assert htmltext.main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>"), model) == with_mark[r.page_id]


@pytest.mark.parametrize("piece", ["<div class='a b c'>x", "<article>x", "<article class=comment><main>x", "<main>x</main>", "<a>x"])
def test_deep_pages_are_read_once(piece):
    import time

    began = time.process_time()
    htmltext.main_text(piece * 60_000)
    assert time.process_time() - began < 8
