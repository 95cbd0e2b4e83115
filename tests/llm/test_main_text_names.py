"""Names of elements lower what they hold; they don't decide alone."""

from __future__ import annotations

import pytest

from varsparq.llm import maintext

LONG = "A paragraph, with commas, of some length, that is the article of this page. " * 4
NAMES = [
    "content no-sidebar", "layout has-sidebar", "content with-header", "page-with-comments", "post related-2", "share-enabled", "search-page", "social-science",
    "notice-board", "cookie-recipe", "article-header", "main-content ad-free", "recipe-search", "hasSidebar", "promotion-day post",
]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_names_with_other_words_keep_the_page(name, attribute):
    page = f'<body><div class="menu"><a href="/">Home</a></div><div {attribute}="{name}"><p>{LONG}</p><p>{LONG}</p></div><div class="footer">Imprint</div></body>'
    assert maintext.main_text(page) == " ".join(f"{LONG} {LONG}".split())


@pytest.mark.parametrize("name", ["ad", "sidebar", "comments", "comment-list", "comments-area", "cookie-banner", "share-buttons", "related-posts", "newsletter-box", "content-ad", "commentList", "nav-2"])
def test_named_blocks_go(name):
    block = f'<div class="{name}"><p>Unwanted words, a few of them.</p></div>'
    for page in (f"<body>{block}<div><p>{LONG}</p><p>{LONG}</p>{block}</div>{block}</body>", f"<body>{block}<article><p>{LONG}</p>{block}</article></body>"):
        assert "Unwanted" not in maintext.main_text(page) and "the article of this page" in maintext.main_text(page)


def test_long_comments_go():
    comments = "".join(f"<div class='comment'><p>Reader {k} says, at length, what readers say. {LONG}</p></div>" for k in range(6))
    page = f"<body><div class='text'><p>{LONG}</p><p>{LONG}</p></div><div id='comments'>{comments}</div></body>"
    assert maintext.main_text(page) == " ".join(f"{LONG} {LONG}".split())
    assert "Reader" not in maintext.main_text(f"<body><article><p>Short.</p></article><div id='comments'>{comments * 3}</div></body>")


def test_a_page_in_a_form():
    assert maintext.main_text(f"<body><form id='aspnetForm'><div><p>{LONG}</p></div></form></body>") == LONG.strip()
    assert maintext.main_text(f"<body><div><p>{LONG}</p></div><form><p>Your name, please</p></form></body>") == LONG.strip()


def test_ends_of_comments():
    assert maintext.main_text(f"<body><!-- a --!><p>{LONG}</p><!--><p>x</p><!---><p>y</p><!-- open") == f"{LONG.strip()} x y"
