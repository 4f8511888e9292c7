import pytest

from sluice.llm import html_text as H
from sluice.llm.queries import op2_tag_ratio_text

ARTICLE = "<article><h1>A head</h1><p>First words, rather many of them,\n in a   row.</p><p>Two.</p><p>Third &amp; last &lt;one&gt;&nbsp;&eacute;</p></article>"
TEXT = "A head\nFirst words, rather many of them, in a row.\nTwo.\nThird & last <one> é"
AROUND = [
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us and a very long menu line that has many words in it</a></ul></nav>",
    "<header><h1>The site</h1></header>",
    "<footer><p>Copyright, a footer of many words that goes on and on</p></footer>",
    "<aside><p>A side bar with many words, more than the article has, to be sure of it</p></aside>",
    '<div class="cookie-notice"><p>We use cookies and say so in many words here</p></div>',
    '<div class="ad"><div>Buy this now, a very good thing for all, at a good price</div></div>',
    "<form><label>Name</label><select><option>One</option></select><button>Send it</button></form>",
    '<script>var t = "</p><p>not a text";</script><style>p { margin: 0 }</style><noscript>turn it on</noscript>',
    '<section id="comments"><article><p>I am a reader and this is my comment, which is long and goes on</p></article></section>',
    '<div role="navigation">more links</div><p hidden>hidden</p><!-- a note <p>no</p> -->',
]


@pytest.mark.parametrize("extra", AROUND)
def test_what_stands_around_goes(extra):
    for body in (extra + ARTICLE, ARTICLE + extra, ARTICLE.replace("<p>Two", f"{extra}<p>Two") if "<article" not in extra and "<header" not in extra else ARTICLE):
        assert H.main_text(f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>") == TEXT


def test_unclosed_and_cut_pages():
    assert H.main_text("<body><article><p><b>One two three<br><p>Four <i>five</article><footer>no") == "One two three\nFour five"
    assert H.main_text("<article><p>One<br>two</p><p>three &amp fo") == "One two\nthree & fo"


def test_without_an_article_the_heaviest_region_stays():
    links = "".join(f"<li><a href=/{k}>l{k}</a></li>" for k in range(12))
    body = "<p>A long paragraph of the main text that has many words in it, as texts do.</p>" * 3 + "<p>Short.</p>" + "<p>And again a long paragraph of the main text, with more words.</p>"
    got = H.main_text(f"<body><ul>{links}</ul><div>{body}</div><ul>{links}</ul></body>").split("\n")
    assert got == ["A long paragraph of the main text that has many words in it, as texts do."] * 3 + ["Short.", "And again a long paragraph of the main text, with more words."]


def test_nulls_long_pages_ties_and_clashing_names(spark):
    long = "<p>" + "word " * 100000 + "</p>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", ARTICLE), (3, "u", ARTICLE), (None, "u", long), (4, "u", "<p></p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((str(r.page_id), r.url, r.text) for r in H.extract(pages).collect()), key=str)
    assert got == sorted([("1", "u", ""), ("2", None, ""), ("3", "u", TEXT), ("3", "u", TEXT), ("None", "u", ("word " * 100000).strip()), ("4", "u", "")], key=str)
    assert H.extract(pages.limit(0)).count() == 0


def test_query_counts_code_points(spark, sf):
    rows = op2_tag_ratio_text(spark, sf).collect()
    assert len(rows) > 10 and all(r.n_chars == len(r.text) > 0 for r in rows)


def test_articles_within_what_is_left_out():
    """Comments of readers and adverts that are articles themselves stay out; one that starts in an unclosed menu is content."""
    body = "".join(f"<p>Sentence {k} of the story that goes on for a while.</p>" for k in range(6))
    want = "\n".join(f"Sentence {k} of the story that goes on for a while." for k in range(6))
    for extra in ('<section id="comments"><article><p>I do not agree with any of this.</p></article></section>', "<aside><article><p>Buy one, and get another one for free today.</p></article></aside>"):
        assert H.main_text(f"<body><article>{body}{extra}</article></body>") == want
        assert H.main_text(f"<body><article>{body}</article>{extra}</body>") == want
    assert H.main_text(f"<body><nav><a>Home</a><article>{body}</article></body>") == want

