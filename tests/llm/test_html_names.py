"""Names of classes lower scores, but take no prose out of the article; remarks and teasers stay out."""

import pytest

from tariffloom.llm.html import main_text

PROSE = "<p>" + "This is a plain sentence of the article, which says something. " * 4 + "</p>"
KEPT = [
    '<h2 class="section-header">KEEP</h2>', '<p class="side-note">KEEP of prose</p>', '<p class="foot-note">KEEP</p>', '<div class="card-header">KEEP</div>',
    '<p class="search-results-summary">KEEP</p>', '<pre class="menu">KEEP</pre>', '<p class="promotion-of-science">KEEP</p>', '<blockquote class="related">KEEP</blockquote>',
]
GONE = [
    '<div class="ad">GONE</div>', '<div class="comments"><p>GONE, says a reader</p></div>', '<p class="share"><a href="x">GONE share</a></p>', '<aside>GONE</aside>', '<form>GONE</form>', '<ul class="menu"><li>GONE</li></ul>',
    '<h3 class="related"><a href="x">GONE</a></h3>', '<section id="responses"><p>GONE, GONE</p></section>',
]


@pytest.mark.parametrize("part", KEPT)
def test_prose_stays_in_the_article(part):
    assert "KEEP" in main_text(f"<html><body><nav>menu</nav><article>{PROSE}{part}{PROSE}</article><footer>end</footer></body></html>")


@pytest.mark.parametrize("part", GONE)
def test_other_parts_go(part):
    text = main_text(f"<html><body><nav>menu</nav><article>{PROSE}{part}{PROSE}</article></body></html>")
    assert "GONE" not in text and text.count("plain sentence") == 8


def test_teaser_beside_the_article():
    teaser = '<article class="teaser"><p>Another tale that is told, short, nice, and elsewhere.</p></article>'
    assert "Another tale" not in main_text(f'<body><div><article class="post">{PROSE * 4}</article>{teaser}</div></body>')
    assert main_text(f'<body><div><article class="post">{PROSE}</article><article class="post">{PROSE}</article></div></body>').count("plain sentence") == 8


@pytest.mark.parametrize("tag", ["article", "div"])
def test_many_commas_of_remarks(tag):
    remarks = f'<div id="responses"><p>{"well, no, yes, ok, " * 60}</p><p>{"a, b, c, d, " * 50}</p></div>'
    text = main_text(f"<body><{tag}><p>The short article has two sentences. This is the second.</p><p>And a third one here to read.</p></{tag}>{remarks}</body>")
    assert text == "The short article has two sentences. This is the second. And a third one here to read."
