"""HTML text of pages that leave out end tags."""

import pytest

from lodestream.llm.html_text import main_text

TEXT = "An article of some length, with words enough to be the content of a page."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=utf-8><body><p>{TEXT}</body></html>",
        f"<html><head><title>T</title><div><p>{TEXT}</p></div>",
        f"<body><div><p class='ad'>buy<p>{TEXT}</div>",
        f"<body><ul><li class='share'>mail<li>{TEXT}</ul>",
        f"<body><div><nav>menu</div><div><p>{TEXT}</p></div>",
        f"<body><svg><path d='x'><p>{TEXT}</p>",
        f"<body><svg><g><path d='x'/></g></svg><div><p>{TEXT}</p></div>",
        f"<body><div class='layout no-sidebar'><p>{TEXT}</p></div>",
        f"<body><div class='with-comments'><p>{TEXT}</p></div>",
        f"<body><div><p>{TEXT}</p></div><div class='site-footer'>end</div><div id='ad_slot'>buy</div><div class='x comments'>hi</div>",
    ],
)
def test_text_is_kept(page):
    assert main_text(page) == TEXT
