"""Block extraction: templates, broken markup, and the minimum cut against all labellings."""

import itertools
import random
import re
import html as html_lib

from panelstats.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body class="has-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>never</p> --><div class="ad">Buy now</div>
<article><h1>Head &lt;1&gt;</h1><p>First <b>bold</b>,<i>it</i> line<br>next.<p>Second&nbsp;para &#x41;&eacute;
   with  space</p><aside>Side note</aside><ul><li>Item one<li>Item two</ul><form><input><label>Mail</label></form>Tail
<section id="comments"><article><p>I am a reader and this is my comment on it.</p></article></section></article>
<div id="sidebar"><p>Other stories</p></div><footer>&copy; all</footer></body></html>"""
MAIN = "Head <1>\n\nFirst bold,it line next.\n\nSecond para Aé with space\n\nItem one\n\nItem two\n\nTail"


def test_page():
    assert hx.main_text(PAGE, {}) == MAIN


def test_broken_markup_and_empty():
    assert hx.main_text("<article><p>a < b <p>open <b>text</article", {}) == "a < b\n\nopen text"
    assert hx.main_text("<article><p title='x>y'>ok</p><script>never", {}) == "ok"
    for t in (None, "", "   ", "<", "<!--", "<nav>x</nav>", "</p></div>", "<a" * 1000, "<p '" * 1000):
        assert hx.main_text(t, {}) == "" or "<" in t
    big = "<article>" + "<p>word word word.</p>" * 20_000 + "</article>"
    assert hx.main_text(big, {}).count("\n\n") == 19_999


def sentence(rng, lo=9, hi=30):
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(lo, hi))]
    return " ".join(words).capitalize() + ", " + words[0] + rng.choice(".!?")


def lying_page(rng, marked: bool):
    """A page, and its article's blocks.  Class names lie about one paragraph in eight; without
    ``marked`` nothing but shapes and places tells the article."""
    link = lambda: f"<a href='/x'>{sentence(rng, 1, 3)[:-1]}</a>"
    wrap = (lambda tag, inner: f"<{tag}>{inner}</{tag}>") if marked else (lambda tag, inner: f"<div>{inner}</div>")
    menu = "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(3, 9)))
    body, want = [], []
    for _ in range(rng.randrange(5, 14)):
        text = sentence(rng) + " " + sentence(rng)
        name = rng.choice([' class="promo"', ' class="widget-text"', ' id="banner"']) if rng.random() < 1 / 8 else ""
        body.append(f"<p{name}>{text}</p>")
        want.append(text)
        if rng.random() < 0.2:
            body.append(f'<div class="ad">{link()}</div>')
    foot = "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(2, 5)))
    return (f"<html><body>{wrap('nav', '<ul>' + menu + '</ul>')}{wrap('article', ''.join(body))}{wrap('footer', '<ul>' + foot + '</ul>')}</body></html>",
            want)


def test_names_that_lie_are_outvoted_by_the_cut(spark):
    """The labels of the cut beat the signs of the scores, with landmarks and without."""
    rng = random.Random(8)
    train = spark.createDataFrame([(i, "u", lying_page(rng, True)[0]) for i in range(60)], "page_id long, url string, html string")
    weights = hx.learn_shapes(train, id_col="page_id")
    assert hx.learn_shapes(train.repartition(7), id_col="page_id") == weights
    for marked in (True, False):
        blocks = right = by_sign = changed = 0
        for _ in range(150):
            page, want = lying_page(rng, marked)
            found, scores, labels = hx.labelled_blocks(page, weights)
            truth = [b.text in want for b in found]
            blocks += len(found)
            right += sum(x == y for x, y in zip(labels, truth))
            by_sign += sum((x > 0) == y for x, y in zip(scores, truth))
            changed += sum((x > 0) != y for x, y in zip(scores, labels))
        print(marked, blocks, right / blocks, by_sign / blocks, changed / blocks)
        assert right / blocks > 0.95 and right > by_sign + 0.01 * blocks and changed / blocks > 0.01


def test_comments_and_adverts_in_an_article_stay_out():
    prose = "<p>Long and winding sentences, with commas, end here. More of them, as ever, follow on.</p>"
    page = (f"<article>{prose * 3}<div class='ad'>Buy this now</div>{prose}<aside>{prose}</aside>{prose}"
            f"<section class='comments'>{prose}</section></article><footer>{prose}</footer>")
    assert hx.main_text(page, {}).count("Long and winding") == 5 and "Buy" not in hx.main_text(page, {})


def test_long_pages_are_cut_in_time():
    """Thousands of blocks that no score settles alone."""
    rng = random.Random(1)
    n = 6000
    scores = [rng.choice([-2.0, -1.0, 1.0, 2.0]) for _ in range(n)]
    edges = {(i, i + 1): 1.7 for i in range(n - 1)} | {(i, i + 2): 1.0 for i in range(0, n - 2, 3)}
    label = hx.min_cut(scores, edges)
    cost = lambda x: (sum(-s if s < 0 and y else s if s > 0 and not y else 0 for s, y in zip(scores, x))
                      + sum(w for (i, j), w in edges.items() if x[i] != x[j]))
    assert cost(label) <= min(cost([s > 0 for s in scores]), cost([True] * n), cost([False] * n))


def test_min_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 8)
        scores = [rng.randrange(-6, 7) / 2 for _ in range(n)]
        edges = {(i, j): rng.randrange(1, 6) / 2 for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4}
        cost = lambda label: (sum(-s if s < 0 and x else s if s > 0 and not x else 0 for s, x in zip(scores, label))
                              + sum(w for (i, j), w in edges.items() if label[i] != label[j]))
        assert cost(hx.min_cut(scores, edges)) == min(cost(x) for x in itertools.product([False, True], repeat=n))


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in hx.extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x"), (2, None, PAGE, None)], "page_id long, url string, html string, text string")
    assert sorted((r.n_chars, r.text) for r in hx.extract_pages(odd).collect()) == [(0, "")] * 3 + [(len(MAIN), MAIN)]
    assert hx.extract_pages(odd.limit(0)).count() == 0


def test_shapes_are_learned(spark):
    """Without landmarks, what other pages' landmarks have taught separates the blocks."""
    marked = "<nav><li><a>go</a></li><li><a>on</a></li></nav><article><p>Long and winding sentences, with commas, end here.</p></article>"
    pages = spark.createDataFrame([(i, "u", marked) for i in range(40)], "page_id long, url string, html string")
    weights = hx.learn_shapes(pages)
    plain = "<div><li><a>go</a></li><li><a>on</a></li></div><div><p>Long and winding sentences, with commas, end here.</p></div>"
    assert hx.main_text(plain, weights) == "Long and winding sentences, with commas, end here."
