"""Main text where names mislead, hosts' pages differ, or markup is broken or endless."""

import time

import pytest

from plumbline.llm.html_extract import best_path, extract_text

LONG = "Long text of the story that goes on and on. " * 20


@pytest.mark.parametrize(
    ("inside", "kept"),
    [
        ('<section id="notices"><p>Notices were posted in 1848.</p></section>', "Notices were posted in 1848."),
        ('<section id="navigation"><p>Ships used stars.</p></section>', "Ships used stars."),
        ('<div id="banner"><p>The banner flew.</p></div>', "The banner flew."),
        ('<div id="navigation"><a href=/a>Home page</a> <a href=/b>All stories</a></div>', ""),
        ('<div id="comments"><p>Nice one!</p></div>', ""),
        ('<div class="comments"><p>Nice one!</p></div>', ""),
        ('<div id="cookie-notice"><p>We use them.</p></div>', ""),
    ],
)
def test_ids_in_an_article(inside, kept):
    got = extract_text(f"<article><p>Start of it.</p>{inside}<p>End of it.</p></article>", None)
    assert got == "\n".join(x for x in ("Start of it.", kept, "End of it.") if x)


def test_ids_outside_an_article_count():
    assert extract_text(f'<body><div id="banner"><p>Buy it.</p></div><div class="body"><p>{LONG}</p></div></body>', None) == LONG.strip()


def test_a_page_unlike_its_host():
    page = f'<body><div class="body">Loading.</div><div class="story"><p>{LONG}</p></div></body>'
    assert extract_text(page, "body>div.body") == LONG.strip()
    assert extract_text(f'<body><div class="body">{LONG}</div><div class="story"><p>{LONG} more</p></div></body>', "body>div.body") == LONG.strip()


def test_a_card_is_no_article():
    page = f'<article class="card">short</article><div class="main-text"><p>{LONG}</p></div>'
    assert best_path(page) == "div.main-text" and extract_text(page, None) == LONG.strip()


@pytest.mark.parametrize("piece", ['<a b="', "<div>x", "<p a='", "<!--", "<", "<a b=", "</div", '<div class="x', "<p>x<div>"])
def test_a_megabyte_of_broken_markup(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    extract_text(page, best_path(page))
    assert time.process_time() - began < 20


def test_deep_elements_keep_their_text():
    depth = 500
    page = "<div>" * depth + "inner" + "</div>" * depth + "<p>after</p>"
    assert extract_text("<main>" + page + "</main>", None) == "inner\nafter"
