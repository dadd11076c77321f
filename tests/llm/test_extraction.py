"""Main texts: what is template goes, what varies stays; trees are aligned as well as can be."""

from __future__ import annotations

import random
import re
from functools import cache

import pytest

from driftline.llm import extraction
from driftline.llm.common import table
from driftline.llm.queries import op12_extraction

SCHEMA = "page_id long, url string, html string, label string, host string"


def texts(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = extraction.main_texts(df).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    return {r["page_id"]: r["text"] for r in got}


def test_marked_articles(spark):
    page = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body class="home"><header><h1>Site</h1></header>
    <nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><div id=ad1>Buy</div>
    <article><header><h1>Head&nbsp;line &amp; more</h1></header><p>One <b>two<br>three</b>
       four.<p>Five &#233; &eacute; &unknown; <script>var a="</p>";</script>six<ul><li>a<li>b</ul>
       <div class="ad">Advert</div><form><p>Name <input></form><!-- <p>hidden --><aside>side</aside>
       <table><tr><td>c<td>d</table><div class="comments"><p>First!</div></article>
    <section id="comments"><article class="comment"><p>reader</article></section><div class=sidebar>x</div><footer>&copy; foot</footer></body></html>"""
    assert texts(spark, [(1, "http://h/1", page)])[1] == "\n\n".join(["Head line & more", "One two three four.", "Five é é &unknown; six", "a", "b", "c", "d"])


def test_template_of_unmarked_pages(spark):
    r = random.Random(0)
    words = lambda n: " ".join(r.choices("alpha beta gamma delta epsilon zeta".split(), k=n))
    shared = "A passage that every text of this site holds, word for word."
    rows, want = [], {}
    for i in range(12):
        body = [f"Story {i} {words(3)}", *[f"{words(12)} {i}" for _ in range(r.randrange(3, 7))]]
        if i % 4:
            body.insert(2, shared)
        more = "<div>Extra hint of the week</div>" if i % 3 else ""
        html = f"<html><body><div><p>Welcome to our site</p><p>Contact us</p></div><div class=x9><div>{''.join(f'<p>{b}</p>' for b in body)}</div></div>{more}<div><ul>{''.join(f'<li><a href={j}>link {i} {j}</a>' for j in range(4))}</ul></div><div>All rights of ours</div></body></html>"
        rows.append((i, f"https://user@WWW.site.example:80/{i}", html))
        want[i] = "\n\n".join(body)
    assert texts(spark, rows) == want
    # copies are no evidence, nor is a host of its own
    copies = [(100 + i, "http://other/", rows[0][2]) for i in range(20)]
    assert all("Story 0" in t and want[0] in t for t in texts(spark, copies).values())
    assert texts(spark, rows + copies)[3] == want[3]


def test_articles_that_share_passages_keep_them(spark):
    rows = [(i, "http://h/", f"<body><nav>m</nav><article><h1>Same</h1><p>Same passage</p><p>own {i}</p></article></body>") for i in range(9)]
    assert texts(spark, rows) == {i: f"Same\n\nSame passage\n\nown {i}" for i in range(9)}


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [
        (1, None, None),
        (2, None, ""),
        (3, "not a url", "plain text &lt;b&gt;\t x"),
        (4, "http://h/4", deep),
        (5, "http://h/5", "<article><p>open <!-- never closed <p>x"),
        (6, "http://h/6", "<article>a<script>b</script"),
        (7, "http://h/7", "<p class='a>b</p><p>c"),
        (8, "http://h/8", "1 < 2 <3 </ > <> <a href=\"x>\">l</a> z"),
        (9, "http://h/9", "<article>" + "<p>word word</p>" * 20_000 + "</article>"),
        (None, "http://h/9", "<article><p>no id"),
        (10, "http://h/9", "<nav>only</nav>"),
    ]
    got = texts(spark, rows)
    assert got[1] == got[2] == got[10] == "" and got[3] == "plain text <b> x" and got[4] == "deep" and got[5] == "open" and got[6] == "a"
    assert "c" in got[7] and got[8].startswith("1 < 2 <3") and got[8].endswith("l z") and got[9].count("\n\n") == 19_999 and got[None] == "no id"
    assert texts(spark, []) == {}


def plain_match(a, b):
    """Nodes in a best matching of two trees as nested tuples (label, *children)."""

    @cache
    def w(x, y):
        if x[0] != y[0]:
            return 0
        m = [[0] * len(y) for _ in x]
        for i in range(1, len(x)):
            for j in range(1, len(y)):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + w(x[i], y[j]))
        return 1 + m[-1][-1]

    return w(a, b)


def test_matching_is_as_large_as_plain_simple_tree_matching():
    r = random.Random(3)

    def tree(depth):
        return (r.choice("pqd"), *[tree(depth - 1) for _ in range(r.randrange(0, 4) if depth else 0)])

    def flat(t):
        label, parent = [], []

        def walk(t, p):
            label.append(t[0])
            parent.append(p)
            i = len(label) - 1
            for c in t[1:]:
                walk(c, i)

        walk(t, -1)
        return extraction.Tree(label, parent), parent

    for _ in range(300):
        a, b = ("r", *tree(4)[1:]), ("r", *tree(4)[1:])
        (x, px), (y, py) = flat(a), flat(b)
        partner = extraction.match(x, y)
        found = [(i, j) for i, j in enumerate(partner) if j >= 0]
        assert len(found) == plain_match(a, b) == len({j for _, j in found})
        for i, j in found:
            assert x.label[i] == y.label[j] and (px[i] < 0 or partner[px[i]] == py[j])


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_given_pages_give_their_articles(spark, name):
    import html

    folder = f"/root/testdata/{name}"
    got = {r["page_id"]: r["text"] for r in op12_extraction(spark, folder).collect()}
    for r in table(spark, folder, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"] or "", re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner.group(1) if inner else "")]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)
