"""Ordinary page shapes whose article must not be lost."""

import re
from html.parser import HTMLParser

import pytest

from kgspark.llm import html_text

TREE = html_text.grow(html_text.LABELLED)
WORDS = "The mill stood by the river for two hundred years before the flood of that spring took its wheel and most of the lower floor away. "
WORDS = (WORDS * 2).strip()
ARTICLE = f"<p>{WORDS}</p><p>{WORDS}</p>"
TEXT = [WORDS, WORDS]


@pytest.mark.parametrize(
    "page",
    [
        f'<html><body><div class="content" style="overflow:hidden">{ARTICLE}</div></body></html>',
        f'<html><body><article data-note="hidden class=menu" title=\'role="navigation"\'>{ARTICLE}</article></body></html>',
        f"<html><head><title>x</title><meta charset=utf-8><body>{ARTICLE}</body></html>",
        f"<html><head><title>x</title><link rel=x href=y><article>{ARTICLE}</article></html>",
        f'<html><body><div id=page class="no-sidebar"><article>{ARTICLE}</article></div></body></html>',
        f'<html><body><div id=page class="no-sidebar">{ARTICLE}<div class="share">Share this page</div></div></body></html>',
    ],
)
def test_article_is_kept(page):
    assert html_text.main_blocks(page, TREE) == TEXT


@pytest.mark.parametrize("attributes", ["hidden", 'class="sidebar"', "id=comments", "role=navigation", "aria-hidden='true'", 'data-x="1" HIDDEN'])
def test_marked_parts_are_still_left_out(attributes):
    assert html_text.main_blocks(f"<body><article>{ARTICLE}</article><div {attributes}><p>{WORDS}</p></div></body>", TREE) == TEXT


def used(node):
    return set() if node.feature is None else {html_text.FEATURES[node.feature]} | used(node.below) | used(node.above)


def test_the_tree_reads_the_blocks():
    assert {"words", "link_density"} <= used(TREE) and used(TREE) & {"link_density_before", "link_density_after", "words_before", "words_after"}


def test_held_out_pages_without_a_main_element():
    right = n = 0
    for k, page in enumerate(html_text.PAGES):
        tree = html_text.grow(html_text._rows(html_text._variants([p for j, p in enumerate(html_text.PAGES) if j != k])))
        if not any(b[3] for b in page):
            rows = html_text.rows_of_page([b[:6] for b in page])
            right, n = right + sum(html_text.classify(tree, r) == bool(b[6]) for r, b in zip(rows, page, strict=True)), n + len(page)
    print("blocks of held-out pages judged right:", right, "of", n)
    assert right / n > 0.8


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<p data-x=don't>{WORDS}", [WORDS]),
        (f"<input value='unclosed><p>{WORDS}</p>", [WORDS]),
        (f'<p title="a > b" data-y=\'<i>\'>{WORDS}</p>', [WORDS]),
        (f"<article><p class='search'>{WORDS}</p></article>", [WORDS]),
        ("<a " + "x='1' " * 5000, []),
    ],
)
def test_odd_tags_do_not_leak(page, want):
    assert html_text.main_blocks(page, TREE) == want


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{WORDS}", "clash", 7)] * 2 + [(None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "u", WORDS, len(WORDS))] * 2 + [(None, None, "", 0)]


COMMENTS = "<p>I do not believe a word of this, and neither does anyone else in my street who saw the river that spring.</p>" * 5
SHORT = "<h1>Storm hits coast</h1>"
SAID = f"<p>{WORDS}</p><p>He said no.</p><p>Why?</p><p>{WORDS}</p>"


@pytest.mark.parametrize("name", ["id=comments", "class='comment-list'", "id='disqus_thread'", "class=advert", "class='ad sponsored'", "class='newsletter-signup'", "class='cookie-banner'"])
@pytest.mark.parametrize("inside", ["<main>{}</main>", "<div>{}</div>", "<article>{}</article>"])
def test_comments_and_adverts_go_however_long(name, inside):
    page = "<body>" + inside.format(f"{SHORT}<p>{WORDS}</p><div {name}><h3>4 replies</h3>{COMMENTS}</div>") + "</body>"
    assert html_text.main_blocks(page, TREE) == ["Storm hits coast", WORDS]


@pytest.mark.parametrize("wrapper", ["<article class='comment'>{}</article>", "<section id='comments'><article>{}</article></section>"])
def test_comments_in_articles_go(wrapper):
    page = f"<body><article>{SHORT}<p>{WORDS}</p></article><div>" + wrapper.format(COMMENTS).replace("<article>", "<article class=comment-body>") + "</div></body>"
    assert html_text.main_blocks(page, TREE) == ["Storm hits coast", WORDS]


@pytest.mark.parametrize("name", ["no-sidebar", "comments-open", "has-comments", "ad-free", "with-share", "main-sidebar", "header-wide"])
def test_layout_names_do_not_decide(name):
    for page in (f"<body><div class='{name}'><article>{SHORT}{ARTICLE}</article></div></body>", f"<body><div class='{name}'>{SHORT}{ARTICLE}</div></body>"):
        assert html_text.main_blocks(page, TREE) == ["Storm hits coast", *TEXT]


@pytest.mark.parametrize("inside", ["<main>{}</main>", "<div>{}</div>"])
def test_headlines_and_short_paragraphs_stay(inside):
    page = "<body><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul>" + inside.format(SHORT + SAID) + "<ul><li><a href=/a>About this site</a></ul></body>"
    assert html_text.main_blocks(page, TREE) == ["Storm hits coast", WORDS, "He said no.", "Why?", WORDS]


def test_links_in_an_article_stay():
    linked = "<p>See <a href=/x>the report of the river board on the flood</a> and what the town made of it.</p><ul><li><a href=/y>The full report</a></li></ul>"
    got = html_text.main_blocks(f"<body><article>{ARTICLE}{linked}</article></body>", TREE)
    assert got == [*TEXT, "See the report of the river board on the flood and what the town made of it.", "The full report"]


class Walker(HTMLParser):
    """Text of the article element by the standard library's parser, its blocks parted at the elements of BLOCKS."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth = self.skipped = 0
        self.blocks = [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skipped += tag in ("script", "style", "nav", "footer", "form", "aside")
        if tag in html_text.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.blocks.append("")
        self.depth -= tag == "article"
        self.skipped -= tag in ("script", "style", "nav", "footer", "form", "aside")

    def handle_data(self, data):
        if self.depth and not self.skipped:
            self.blocks[-1] += data


def test_pages_of_the_table_against_a_plain_walk(sf):
    """Whole texts, and nearly all of them again where no element is named article: then neighbours decide."""
    import pyarrow.parquet as pq

    pages = [r["html"] or "" for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()]
    same = 0
    for page in pages:
        walker = Walker()
        walker.feed(page)
        want = [x for x in (" ".join(b.split()) for b in walker.blocks) if x]
        assert html_text.main_blocks(page, TREE) == want
        same += html_text.main_blocks(re.sub(r"</?article>", "", page), TREE) == want
    print("pages alike without article elements:", same, "of", len(pages))
    assert same / len(pages) >= 0.95


def test_empty_table_and_a_long_page(spark):
    schema = "page_id long, url string, html string"
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []
    long = f"<body><nav><a href=/>Home</a></nav><article>{ARTICLE * 4000}</article></body>"
    (row,) = html_text.extract(spark.createDataFrame([(1, "u", long)], schema)).collect()
    assert row.text == "\n".join(TEXT * 4000)
