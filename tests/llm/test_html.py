"""Extraction: known pages, induced templates, broken markup."""

import json
import random

import pytest

from larkspur.llm import html_extract
from larkspur.llm.html_extract import _chain, extract, extract_pages, induce, parse, Run, align


def page(k, extra=""):
    return f"""<!DOCTYPE html><html><head><title>t{k}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home {k}</a></li><li><a href="/b">News</a></li></ul></nav><div class="wrap"><div class="top">Daily paper of the town, since 1900</div>
<div class="story"><h2>Title {k} &amp; more</h2><p>First  paragraph of\n page {k} goes on for a while.<p>Second <b>bold</b> one, number {k}.<ul><li>item {k}<li>other {k}</ul></div>
<div class="sidebar"><p>Side text {k} that is long enough to matter here</p></div>{extra}<div class="legal">All rights are kept by the paper</div></div>
<div class="comments"><p>Reader {k} says no</p></div><footer>&copy; {k}</footer></body></html>"""


def want(k):
    return f"Title {k} & more\n\nFirst paragraph of page {k} goes on for a while.\n\nSecond bold one, number {k}.\n\nitem {k}\n\nother {k}"


def test_constant_nodes_are_template():
    wrapper = json.loads(induce([page(k) for k in range(5)]))
    for k in range(5, 9):
        assert extract(page(k), wrapper) == want(k)


def test_page_of_another_template_stands_for_itself():
    wrapper = json.loads(induce([page(k) for k in range(5)]))
    assert extract("<article><h1>A</h1><p>Words of its own</p></article>", wrapper) == "A\n\nWords of its own"


def test_simple_tree_matching():
    a = Run([parse("<div><p>x</p><ul><li>1</li></ul><p>y</p></div>")])
    b = Run([parse("<div><ul><li>2</li></ul><p>z</p></div>")])
    n, pairs = align(a.kids, b.kids)
    assert n == 4 and pairs == [(0, 0)]
    assert align(a.kids[0].kids, b.kids[0].kids)[1] == [(1, 0), (2, 1)]


def test_broken_and_odd_pages():
    for p, text in [
        (None, ""),
        ("", ""),
        ("<", "<"),
        ("plain &eacute;&#x41; text", "plain éA text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>one<br>two</div>", "one two"),
        ("<p title='a > b'>x</p>", "x"),
        ('<p title="open>x</p>', "x"),
        ("<script>never closed", ""),
        ("</div></p>text", "text"),
        ("<div>" * 3000 + "deep", "deep"),
    ]:
        assert extract(p, None) == text, p


def test_pages(spark):
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(12)] + [(50, None, None), (51, "http://h.example/1", ""), (52, "x", "<p>alone</p>"), (52, "x", "<p>alone</p>"), (60, "http://big.example/", "<article>" + "<p>part of it</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("none", "none").repartition(3)
    got = extract_pages(df.selectExpr("*", "url AS host", "html AS wrapper", "1 AS salt")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for k in range(12):
        assert by[k]["text"] == want(k) and by[k]["n_chars"] == len(want(k))
    assert by[50]["text"] == "" and by[51]["n_chars"] == 0 and by[52]["text"] == "alone"
    assert by[60]["text"].count("part of it") == 20_000
    assert extract_pages(df.limit(0)).count() == 0


def test_a_rare_section_is_template(spark):
    """A notice within the content of a few pages, more of them copies than not, is seen."""
    notice = '<div class="box">Written by our own desk, all claims were verified</div>'

    def story(k):
        return page(k).replace("<ul><li>item", f"{notice}<ul><li>item") if k % 20 == 0 else page(k)

    rows = [(k, f"http://h.example/{k}", story(k)) for k in range(100)] + [(1000 + k, f"http://h.example/copy/{k}", story(1)) for k in range(300)]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[k] == want(k) for k in range(100)) and all(got[1000 + k] == want(1) for k in range(300))


def test_long_articles_are_aligned_to_their_end():
    def long(k):
        body = "".join(f"<h2>Head {k} {i}</h2><p>Text {i} of page {k}</p>" for i in range(100 + k))
        return f'<div class="story">{body}<div class="box">Read more in our archive</div></div>'

    wrapper = json.loads(induce([long(k) for k in range(6)]))
    for k in range(4, 8):
        assert extract(long(k), wrapper) == "\n\n".join(f"Head {k} {i}\n\nText {i} of page {k}" for i in range(100 + k))


def test_chains_are_longest():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(12))] for _ in range(2))
        w = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                w[i + 1][j + 1] = w[i][j] + 1 if x == y else max(w[i][j + 1], w[i + 1][j])
        pairs = _chain(a, b)
        assert len(pairs) == w[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_alignment_against_plain_tree_matching():
    """Simple tree matching by its definition: the best order-preserving pairs over all choices."""
    rng = random.Random(9)

    def tree(depth):
        return "".join(f"<{t}>{'x' if rng.random() < 0.3 else ''}{tree(depth - 1) if depth else ''}</{t}>" for t in rng.choices(["div", "ul", "h2", "section"], k=rng.randrange(4)))

    def plain(a, b):
        if not a or not b:
            return 0
        best = max(plain(a[1:], b), plain(a, b[1:]))
        return max(best, 1 + plain(a[0].kids, b[0].kids) + plain(a[1:], b[1:])) if a[0].label == b[0].label else best

    for _ in range(60):
        a, b = Run([parse(tree(2))]), Run([parse(tree(2))])
        n, pairs = align(a.kids, b.kids)
        assert n == plain(a.kids, b.kids)
        assert n == sum(1 + align(a.kids[i].kids, b.kids[j].kids)[0] for i, j in pairs)


def test_weak_names_and_formulas():
    """A block of most of the text is the article even if its class says side; others of that class are not."""
    story = "The council met on Monday and agreed on the plan. " * 5
    one = f'<body><nav>Menu</nav><div class="side story"><p>{story}</p><p>Second part of it</p></div><div class="side"><p>Elsewhere</p></div></body>'
    assert extract(one, None) == f"{story.strip()}\n\nSecond part of it"
    assert extract(f'<article><p>{story}</p><div class="comments"><p>{story * 9}</p></div></article>', None) == story.strip()
    assert extract("<p>Sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is c</p>", None) == "Sum a+b is c"


def test_deep_elements_end_where_they_end():
    deep = "<div>" * 2500 + "<p>inner</p>" + "</div>" * 2500
    assert extract(f"<section>{deep}<p>after</p></section><p>last</p>", None).endswith("after\n\nlast")


def test_large_inputs_take_the_other_ways(spark, monkeypatch):
    """Parts handed on early and merged in a tree, copies and wrappers joined: the same texts."""
    notice = '<div class="box">Written by our own desk, all claims were verified</div>'
    rows = [(k, f"http://h{k % 3}.example/{k}", page(k).replace("<ul><li>item", f"{notice}<ul><li>item") if k % 20 < 3 else page(k)) for k in range(160)]
    rows += [(1000 + k, f"http://h1.example/copy/{k}", page(1)) for k in range(30)] + [(2000, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want_rows = sorted(tuple(r) for r in extract_pages(df).collect())
    for name, value in (("HELD", 40), ("FAN", 3), ("SMALL", 0), ("PAGES", 20), ("KEYS", 0)):
        monkeypatch.setattr(html_extract, name, value)
    assert sorted(tuple(r) for r in extract_pages(df).collect()) == want_rows
    assert {r[0]: r[2] for r in want_rows if r[0] < 160} == {k: want(k) for k in range(160)}


WORDS = ["river", "stone", "quiet", "garden", "letter", "window", "morning", "copper", "winter", "harbour", "paper", "engine"]


def _like_pages(wrap, heading=True):
    """Five like pages with an article inside of what wrap puts around it, and its paragraphs."""
    import random

    rng = random.Random(3)
    pages, wanted = [], []
    for k in range(5):
        paragraphs = [" ".join(rng.choice(WORDS) for _ in range(40)) + f" {k}{j}." for j in range(4)]
        head = f"<h1>Title {k}</h1>" if heading else ""
        article = head + "".join(f"<p>{p}</p>" for p in paragraphs)
        pages.append(wrap(article, k))
        wanted.append("\n\n".join(([f"Title {k}"] if heading else []) + paragraphs))
    return pages, wanted


@pytest.mark.parametrize("heading", [True, False])
@pytest.mark.parametrize("name", ["single has-sidebar", "content no-sidebar", "layout-sidebar-right", "sticky-footer", "menu-open", "cookie-bar", "article comments", "story"])
def test_a_name_on_an_outer_block_doesn_t_empty_the_page(name, heading):
    for outer in ("body", "div"):
        open_, close = (f'<body class="{name}">', "</body>") if outer == "body" else (f'<body><div class="{name}">', "</div></body>")
        pages, wanted = _like_pages(lambda a, k: f'<html>{open_}<nav><a href="/">Home</a></nav><div class="post">{a}</div><footer>Imprint</footer>{close}</html>', heading)  # noqa: B023
        wrapper = json.loads(induce(pages))
        assert [extract(p, wrapper) for p in pages] == wanted
        assert extract(pages[0], None) == wanted[0]


def test_longer_comments_stay_away():
    """Readers wrote three times as much as the author."""
    talk = lambda k: "".join(f"<p>{' '.join(reversed(WORDS * 4))} {k} {j}</p>" for j in range(12))
    pages, wanted = _like_pages(lambda a, k: f'<body class="has-sidebar"><div class="post">{a}</div><div class="comments">{talk(k)}</div><div class="left-sidebar">News {k}</div></body>')
    wrapper = json.loads(induce(pages))
    assert [extract(p, wrapper) for p in pages] == wanted
