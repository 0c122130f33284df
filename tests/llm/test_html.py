"""Main texts against a plain parser, and the elements within an article that neighbours decide on."""

import random
from html.parser import HTMLParser

import pytest

from brute import table
from kestrel.llm import html
from test_llm_operators import brute_pages

BESIDE = {
    '<div class="comments-list">{}</div>': html.DOUBTFUL,
    '<div id="disqus_thread">{}</div>': html.DOUBTFUL,
    '<div class="cookie-notice">{}</div>': html.DOUBTFUL,
    '<ul class="related-posts">{}</ul>': html.DOUBTFUL,
    '<section class="wide post-comments">{}</section>': html.DOUBTFUL,
    '<div class="comments">{}</div>': html.OTHER,
    '<div class="has-sidebar">{}</div>': html.ARTICLE,
    '<div class="no_comments">{}</div>': html.ARTICLE,
    '<div class="upload-area">{}</div>': html.ARTICLE,
    '<p class="cookie-notice">{}</p>': html.ARTICLE,
}


class _Plain(HTMLParser):
    """The text of <article>, a line for each block, without the named elements of the test tables."""

    SKIPPED = {"nav", "header", "footer", "aside", "form", "script", "style"}
    BLOCKS = {"article", "p", "div", "h1", "h2", "h3", "ul", "ol", "li", "blockquote", "pre", "section", "table", "tr"} | SKIPPED
    NAMES = {"ad", "comments", "cookie", "share", "related", "sidebar"}

    def __init__(self):
        super().__init__()
        self.lines, self.words, self.open, self.inside, self.skipped = [], [], [], 0, 0

    def cut(self):
        line = " ".join("".join(self.words).split())
        self.lines += [line] if line else []
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.cut()
            skip = tag in self.SKIPPED and not (tag == "header" and self.inside) or bool(self.NAMES & set((dict(attrs).get("class") or "").split()))
            self.open.append((tag, skip))
            self.skipped, self.inside = self.skipped + skip, self.inside + (tag == "article")
        elif tag == "br":
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.cut()
            while self.open and any(t == tag for t, _ in self.open):
                name, skip = self.open.pop()
                self.skipped, self.inside = self.skipped - skip, self.inside - (name == "article")
                if name == tag:
                    break

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.words.append(data)


def plain_text(page):
    parser = _Plain()
    parser.feed(page or "")
    parser.close()
    parser.cut()
    return "\n".join(parser.lines)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_texts_are_those_of_a_plain_parser(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    want = {r.page_id: plain_text(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html.main_texts(pages).collect()}
    assert got == want and sum(map(bool, want.values())) > len(want) * 0.9


def test_compound_names_are_doubtful_in_an_article():
    for element, kind in BESIDE.items():
        inner = "<li>x</li>" if element.startswith("<ul") else "x"
        lines = html.lines_of(f"<article><p>one</p>{element.format(inner)}<p>two</p></article>")
        assert lines == [(html.ARTICLE, "one"), (kind, "x"), (html.ARTICLE, "two")], element
    # Outside an article neighbours decide anyway; an article within stays doubtful.
    assert html.lines_of('<div class="comments-list">x</div>') == [(html.FREE, "x")]
    nested = '<article><p>one</p><div class="comments-list"><article>x</article></div>y</article>'
    assert [k for k, _ in html.lines_of(nested)] == [html.ARTICLE, html.DOUBTFUL, html.ARTICLE]


def test_neighbours_decide_on_doubtful_elements(spark):
    doubtful = [e for e, kind in BESIDE.items() if kind == html.DOUBTFUL]
    notices = "".join(e.format(f"<p>notice {k} that all pages share</p>") for k, e in enumerate(doubtful))
    own = '<div class="side-by-side"><p>a comparison of page {0} alone</p></div>'
    page = "<article><p>first text of page {0}, long enough to tell</p>" + notices + own + "<p>last text of page {0}, which ends it</p></article>"
    rows = [(k, f"http://a.com/{k}", page.format(k)) for k in range(3)] + [(9, "http://lone.com/9", page.format(9))]
    got = {r.page_id: r.text.split("\n") for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(3):
        assert got[k] == [f"first text of page {k}, long enough to tell", f"a comparison of page {k} alone", f"last text of page {k}, which ends it"]
    # Without a neighbour the article stays as it is marked up.
    assert len(got[9]) == 3 + len(doubtful)


def test_doubtful_elements_match_brute_force(spark):
    rng, rows = random.Random(11), []
    elements = [*BESIDE, "<p>{}</p>", "{}"]
    for k in range(150):
        parts = [f"<p>own text {k} {n} which is fairly long</p>" for n in range(rng.randrange(4))]
        parts += [rng.choice(elements).format(f"notice {rng.randrange(6)} of the site") for _ in range(rng.randrange(5))]
        rng.shuffle(parts)
        shell = rng.choice(["<article>{}</article>", "<main>{}</main>", "{}"])
        rows.append((k, f"https://h{rng.randrange(5)}.org/{k:03d}", shell.format("".join(parts))))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want = brute_pages(rows)
    assert table(html.main_texts(df).collect()) == table(want)
    assert any(k == html.DOUBTFUL and x not in text.split("\n") for (_, _, p), (_, _, text, _) in zip(rows, want) for k, x in html.lines_of(p))
