import random

import numpy as np
import pytest

from visitstat.llm.dom import FEATURES, WORDS, features, read
from visitstat.llm.extraction import decode, extract, extract_pages, landmark_labels, train
from visitstat.llm.layouts import Layouts

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><header><a href="/">Site</a><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav></header>
<!-- an <p>advert</p> --><div class="ad">Buy this now.</div>
<article><h1>A title &amp; more</h1><p><b>First   paragraph of the
article, with a <a href="/x">link</a> in it.<br><p>Second paragraph: 5 &lt; 6 and caf&eacute;.
<div class="newsletter">Subscribe to our letter.</div><p>Third paragraph, long enough to be one. It goes on and on.</p></article>
<aside><h3>Related</h3><ul><li><a href="/c">Other story</a></li></ul></aside>
<section id="comments"><h3>2 comments</h3><p>I liked this article a lot. Well written.</p></section>
<form action="/s"><input name=q><button>Search</button></form><footer>&copy; Site &middot; All rights.</footer>"""
TEXT = """A title & more
First paragraph of the article, with a link in it.
Second paragraph: 5 < 6 and café.
Third paragraph, long enough to be one. It goes on and on."""


@pytest.fixture(scope="module")
def trees(spark):
    return train(spark, layouts=300)


def best_by_force(nodes, p):
    """The most likely labels with nothing kept below a dropped node, over all labelings."""
    best, out = -np.inf, None
    weight = [1.0 + np.log2(1 + n.own) for n in nodes]
    for code in range(1 << (len(nodes) - 1)):
        kept = [True] + [bool(code >> i & 1) for i in range(len(nodes) - 1)]
        if any(kept[i] and not kept[nodes[i].parent] for i in range(1, len(nodes))):
            continue
        score = sum(weight[i] * np.log(p[i] if kept[i] else 1 - p[i]) for i in range(1, len(nodes)))
        if score > best:
            best, out = score, kept
    return out


def test_decoding_is_the_best_consistent_labeling():
    rng = random.Random(1)
    for seed in range(25):
        nodes = read(Layouts(seed).page())[0][:9]
        for n in nodes:
            n.children = [c for c in n.children if c < len(nodes)]
        p = np.array([rng.uniform(0.02, 0.98) for _ in nodes])
        assert decode(nodes, p).tolist() == best_by_force(nodes, p)


def test_known_page(spark, trees):
    pages = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p"), (4, "x", "plain words only"),
             (5, "y", "<article><p>" + "A long sentence, with words. " * 40_000 + "</article>")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id bigint, url string, html string, text string, n_chars int")
    got = extract(df, trees).collect()
    assert [(g.page_id, g.url) for g in got] == [p[:2] for p in pages]
    assert got[0].text == TEXT and got[1].text == TEXT
    assert [g.text for g in got[2:4]] == ["", ""]
    assert got[5].text == "plain words only"
    assert got[6].text == ("A long sentence, with words. " * 40_000).strip()
    assert all(g.n_chars == len(g.text) for g in got)


def test_unseen_layouts(trees):
    """Held-out layouts: nearly every node is labelled right."""
    wrong = total = 0
    for seed in range(50_000, 50_200):
        nodes, _ = read(Layouts(seed).page())
        kept = decode(nodes, trees.probability(features(nodes)))
        for n, k in zip(nodes[1:], kept[1:]):
            assert not k or kept[n.parent]
            total += 1
            wrong += k != (n.label == "1")
    assert wrong / total < 0.03


def test_reader_and_features():
    nodes, segments = read("<div>a<p>b<p>c</div>d<br>e<table><tr><td>f<td>g</table>")
    assert [(nodes[i].tag, t) for i, t in segments] == [("div", "a"), ("p", "b"), ("p", "c"), ("", "d e"), ("td", "f"), ("td", "g")]
    x = features(nodes)
    assert x.shape == (len(nodes), len(FEATURES)) and np.isfinite(x).all()
    assert read('<p class="never closed>text</p>')[1]


def test_text_straight_in_the_page_is_a_node_of_its_own(spark):
    nodes, segments = read('a <font>b</font><h1>c</h1><span data-y="1">d</span> <a href="/">e</a><br>f<div>g</div> <hr>h')
    assert [(nodes[i].tag, nodes[i].parent, nodes[i].label, t) for i, t in segments] == [
        ("", 0, "", "a b"), ("h1", 0, "", "c"), ("", 0, "1", "d e f"), ("div", 0, "", "g"), ("", 0, "", "h")]
    assert nodes[0].own == 0 and nodes[0].children == [1, 2, 3, 4, 5]
    one, two = "First paragraph, of some length. It goes on. ", "Second paragraph, which is longer, and ends here. "
    pages = [f"<body><h1>Title</h1>{one * 3}<br><br>{two * 4}</body>",
             f'<body><div class="menu"><a href="/">Home</a> <a href="/">News</a></div><h1>Title</h1><font size=2>{one * 4}</font>'
             f"<p>{two * 3}</p><x-y>{one * 2}</x-y><footer>&copy; Site</footer></body>"]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    got = [r.text for r in extract(df, train(spark)).collect()]
    one, two = one.strip(), two.strip()
    assert got == ["\n".join(["Title", " ".join([one] * 3 + [two] * 4)]),
                   "\n".join(["Title", " ".join([one] * 4), " ".join([two] * 3), " ".join([one] * 2)])]


def test_unseen_bare_text(trees):
    """Held-out layouts: runs of text straight in the page are labelled right nearly always."""
    wrong = total = 0
    for seed in range(60_003, 61_003, 4):
        nodes, _ = read(Layouts(seed).page())
        kept = decode(nodes, trees.probability(features(nodes)))
        bare = [(n.label == "1", k) for n, k in zip(nodes[1:], kept[1:]) if not n.tag]
        assert all(n.label for n in nodes[1:])
        total += len(bare)
        wrong += sum(y != k for y, k in bare)
    assert total > 200 and wrong / total < 0.05


def test_same_tag_is_counted_at_every_size():
    for n in (3, 70):
        nodes, _ = read("<article><h1>a</h1>" + "<p>b</p>" * n + "<div>c</div></article>")
        same = features(nodes)[:, FEATURES.index("same_tag")]
        assert np.allclose(np.expm1(same[2:]), [1, *[n] * n, 1])


def test_empty_table(spark, trees):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert extract(df, trees).collect() == []


@pytest.fixture(scope="module")
def full(spark):
    """The trees as the query trains them, without given pages."""
    return train(spark)


PARA = "A long enough sentence about something, with words and commas. It goes on for a while, and then it ends here."
BODY = "<h1>The title of it</h1>" + "".join(f"<p>{PARA} {i} {PARA}</p>" for i in range(6))
BODY_TEXT = "The title of it\n" + "\n".join(f"{PARA} {i} {PARA}" for i in range(6))
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
FOOT = "<footer>&copy; Site. All rights reserved.</footer>"


@pytest.mark.parametrize("around", [("", ""), (NAV, FOOT)])
@pytest.mark.parametrize("wrapper", [
    '<article class="post {}-enabled">{}</article>', '<article class="{}">{}</article>', '<div class="{}"><article>{}</article></div>',
    '<div class="{}"><div class="content">{}</div></div>', '<div id="{}"><div class="main-text">{}</div></div>'])
def test_no_word_of_an_attribute_costs_the_article(full, wrapper, around):
    words = [w for g, ws in WORDS.items() if g != "content" for w in ws.split()]
    assert len(words) == 105
    got = extract_pages([f"<html><body>{around[0]}{wrapper.format(w, BODY)}{around[1]}</body></html>" for w in words], full)
    assert [w for w, t in zip(words, got) if t != BODY_TEXT] == []


def test_pages_without_an_article_are_empty(full):
    pages = ['<body><a href="/">Home</a> | <a href="/n">News</a> | <a href="/c">Contact</a></body>', "Home | News | Contact",
             "<body>We use cookies. By going on you give consent.</body>", '<div class="cookie-notice">We use cookies on this site.</div>',
             f"<body>{NAV}{FOOT}</body>"]
    assert extract_pages(pages, full) == [""] * len(pages)


def test_other_parts_still_go(full):
    comments = (f'<section id="comments"><h3>2 comments</h3><div><b>Ann</b><p>I liked this a lot.</p></div><div><p>{PARA}</p></div></section>')
    side = '<div class="sidebar"><h3>Related</h3><ul><li><a href="/">Other story</a></li></ul></div>'
    pages = [f"{NAV}<article>{BODY}</article>{comments}{FOOT}", f'{NAV}<div class="has-sidebar"><div class="content">{BODY}</div>{side}</div>{FOOT}']
    assert extract_pages(pages, full) == [BODY_TEXT, BODY_TEXT]


def test_a_word_alone_gives_no_label():
    nodes, _ = read('<div class="comments"><p>a</p></div><article class="comment-enabled"><p>b</p><div class="ad"><p>c</p></div></article>'
                    '<nav>d</nav><article><footer>e</footer></article><footer>f</footer>')
    labels = {n.tag + str(i): y for i, (n, y) in enumerate(zip(nodes, landmark_labels(nodes)))}
    assert labels == {"0": None, "div1": None, "p2": None, "article3": 1, "p4": 1, "div5": None, "p6": None, "nav7": 0,
                      "article8": 1, "footer9": 1, "footer10": 0}
