"""Pages made from known articles in many layouts: the text must be the article, whatever stands around it."""

import html
import random

import pytest

from lodestream.llm import html_text

WORDS = "river stone harbour lantern meadow winter signal garden copper thunder village morning letter bridge falcon amber".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + rng.choice([".", " & more.", " <3.", "."])


def article(rng):
    """Blocks of an article: tag and text."""
    blocks = [("h1", sentence(rng, 5))]
    for _ in range(rng.randrange(3, 7)):
        blocks.append(("p", " ".join(sentence(rng, rng.randrange(9, 20)) for _ in range(rng.randrange(2, 5)))))
        if rng.random() < 0.3:
            blocks.append(("h2", sentence(rng, 4)))
            blocks.append(("p", " ".join(sentence(rng, 14) for _ in range(3))))
    return blocks


def body(rng, blocks, unclosed):
    parts = []
    for tag, text in blocks:
        inner = html.escape(text)
        if tag == "p" and rng.random() < 0.4:
            inner = inner.replace(" ", " <a href='x'>", 1).replace(" ", "</a> ", 1) if rng.random() < 0.2 else inner.replace(" ", "\n  <b>", 1) + "</b>"
        parts.append(f"<{tag}>{inner}" + ("" if tag == "p" and unclosed else f"</{tag}>"))
    return "\n".join(parts)


LINKS = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in WORDS)
LAYOUTS = {
    "article": "<html><head><title>T</title></head><body><header><a href='/'>Site</a></header><nav><ul>{links}</ul></nav><article>{body}</article><aside><ul>{links}</ul></aside><footer>About us</footer></body></html>",
    "div": "<html><body><div id='header'><a href='/'>Site</a></div><div class='nav'><ul>{links}</ul></div><div class='content'>{body}</div><div class='sidebar'><ul>{links}</ul></div><div class='footer'>Imprint</div></body></html>",
    "nested divs": "<body><div><div><div class='layout no-sidebar'><div class='post comments-open'>{body}</div></div></div><div class='comments'><p>Great post, thank you for it all, I read every word</p></div></div></body>",
    "related": "<body><main><section id='related work'>{body}</section></main><div class='related-posts'><ul>{links}</ul></div></body>",
    "open head": "<html><head><title>T</title><meta charset=utf-8><body><nav><ul>{links}</ul></nav><main>{body}</main>",
    "open notice": "<body><p class='notice'>We use cookies<div class='main-text'>{body}</div><ul class='pager'><li class=social>Share<li class=social><a href=x>Mail</a></ul>",
    "form and script": "<body><form><label>Search</label><input><button>Go</button></form><div>{body}<script>var x = '<p>no</p>';</script><style>p {{}}</style></div><noscript>Enable it</noscript></body>",
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
@pytest.mark.parametrize("unclosed", [False, True])
def test_the_text_is_the_article(name, unclosed):
    rng = random.Random(f"{name}{unclosed}")
    for _ in range(20):
        blocks = article(rng)
        page = LAYOUTS[name].format(links=LINKS, body=body(rng, blocks, unclosed))
        assert html_text.main_text(page) == "\n\n".join(text for _, text in blocks)


def test_very_long_pages_and_rows_without_ids(spark):
    blocks = [("p", f"paragraph {i} of a very long page, with some words more") for i in range(60_000)]
    page = "<body><div class='content'>" + "".join(f"<p>{t}" for _, t in blocks) + "</div></body>"
    assert len(page) > 3_000_000
    rows = [(1, "u", page, "x"), (None, None, "<p>alone</p>", "y"), (2, "u", None, "z"), (2, "u", None, "z"), (3, "u", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")  # a name that the result has
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and html_text.extract(pages.limit(0)).count() == 0
    found = {(r["page_id"], r["text"], r["n_chars"]) for r in got.collect()}
    whole = "\n\n".join(t for _, t in blocks)
    assert found == {(1, whole, len(whole)), (None, "alone", 5), (2, "", 0), (3, "", 0)}
