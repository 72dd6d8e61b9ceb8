"""Main text: weights from labelled pages, class words, nesting."""

import time

from spindrift.llm import op7_html

PAGE = (
    "<html><body><nav><ul><li>Home</li><li>About us</li></ul></nav><article><h1>Title here</h1><p>one two three four</p>"
    "<p>five six</p></article><footer>made by us</footer></body></html>"
)
ARTICLE = (
    '<article><p>first words of it</p><div class="search results"><p>body words kept here</p></div><div class="ad"><p>buy this</p></div>'
    "<p>last words of it</p></article>"
)
ARTICLE_TEXT = "first words of it\nbody words kept here\nlast words of it"


def test_weights_are_log_odds_of_the_inside():
    got = op7_html.fit_weights([(PAGE, "one two three four five six")])
    assert got.words["p"] == got.words["h1"] == 1.0
    assert got.tags["p"] == -0.05 and got.tags["nav"] < -0.5
    assert op7_html.main_text(PAGE, got) == "Title here\none two three four\nfive six"


def test_pages_that_teach_nothing():
    assert op7_html.fit_weights([]) == op7_html.Weights()
    assert op7_html.fit_weights([(PAGE, "not there"), (PAGE, None), (PAGE, ""), (None, "x")]) == op7_html.Weights()


def test_labelled_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.b/docs/7", PAGE), (2, "http://a.b/docs/8", None), (3, None, PAGE), (4, "http://a.b/x", PAGE), (5, "http://a.b/docs/9", PAGE)],
        "page_id long, url string, html string",
    )
    docs = spark.createDataFrame([(7, "seven", "x"), (8, "eight", "x"), (None, "none", "x")], "doc_id long, text string, html string")
    assert op7_html.labelled_pages(pages, docs) == [(PAGE, "seven")]


def test_class_words_of_an_articles_own_blocks(spark):
    rows = [(1, "u", ARTICLE, "old", 5, "k"), (2, "u", '<div class="search"><p>find things here</p></div>' + ARTICLE, "old", 5, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, id string")
    got = op7_html.extract(pages).collect()
    assert [(r["text"], r["n_chars"], r["id"]) for r in got] == [(ARTICLE_TEXT, len(ARTICLE_TEXT), "k")] * 2


def test_compound_classes():
    """A compound is left out only if all of it says so."""
    page = "<article><p>begin of it</p>%s<p>end of it</p></article>"
    part = lambda names: page % f'<div class="{names}"><p>what it holds</p></div>'
    for names in ("share-price", "social-housing", "footer-note", "modal-verbs", "navigation-history", "search results", "alert", "the share-price", "nav2go"):
        assert op7_html.main_text(part(names), op7_html.Weights()) == "begin of it\nwhat it holds\nend of it", names
    for names in ("ad", "ad-slot", "share-buttons", "comment-list", "wide ads", "social_links", "ad-2", "newsletter-signup", "sponsored"):
        assert op7_html.main_text(part(names), op7_html.Weights()) == "begin of it\nend of it", names
    quote = page % "<blockquote><p>said so</p><footer>who said it</footer></blockquote>"
    assert op7_html.main_text(quote, op7_html.Weights()) == "begin of it\nsaid so\nwho said it\nend of it"
    outside = '<div class="site-footer"><p>all rights</p></div><div class="cookie-banner"><p>we use them</p></div>' + page % ""
    assert op7_html.main_text(outside, op7_html.Weights()) == "begin of it\nend of it"


def test_deep_nesting_takes_linear_time():
    start = time.monotonic()
    assert op7_html.main_text("<b>" * 100_000 + "word" + "</i>" * 100_000, op7_html.Weights()) == "word"
    assert time.monotonic() - start < 20
