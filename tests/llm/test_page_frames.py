"""Pages whose frame, names or nesting stand in the way of the article."""

import time

from lodestream.llm.html_text import extract, main_text

ARTICLE = "".join(f"<p>Sentence {i} of the article tells something, and goes on for a while to have some length.</p>" for i in range(6))
TEXT = "\n\n".join(f"Sentence {i} of the article tells something, and goes on for a while to have some length." for i in range(6))
LINKS = "".join(f'<li><a href="/{i}">Teaser number {i} of another page</a></li>' for i in range(5))


def test_a_form_that_is_the_page():
    controls = '<input name="a"><select><option>One</option></select><button>Send</button>'
    assert main_text(f'<body><form action="x"><header>Site</header><article>{ARTICLE}</article><footer>End</footer>{controls}</form></body>') == TEXT
    assert main_text(f'<body><form id="aspnetForm"><div><div>{ARTICLE}</div></div>{controls}</form></body>') == TEXT
    assert main_text(f'<body><div>{ARTICLE}</div><form><p>Write to us whatever you like about this page and others.</p><label>Name</label>{controls}</form></body>') == TEXT


def test_a_long_sidebar_beside_a_short_article():
    aside = "<p>" + "words of the sidebar that go on and on " * 200 + "</p>"
    assert main_text(f'<body><article><p>A short article of a single sentence here.</p></article><div class="sidebar">{aside}</div></body>') == "A short article of a single sentence here."
    assert main_text(f'<body><div class="sidebar">{aside}</div><main><p>A short article of a single sentence here.</p></main></body>') == "A short article of a single sentence here."


def test_reader_comments_by_their_usual_names():
    said = "<p>I think that this is a very good article and want to say so at length here.</p>" * 3
    assert main_text(f'<body><article>{ARTICLE}</article><ol class="commentlist"><li>{said}</li></ol><div id="respond">{said}</div></body>') == TEXT


def test_teasers_beside_the_article_of_a_main_part():
    assert main_text(f"<body><main><ul>{LINKS}</ul><article>{ARTICLE}</article><ul>{LINKS}</ul></main></body>") == TEXT


def test_a_label_in_the_article_is_text():
    assert "Label text" in main_text(f"<body><article>{ARTICLE}<p><label>Label text</label> and what follows it in the sentence.</p></article></body>")


def test_deep_nesting_takes_time_by_the_page():
    for page in ("<i>" * 100_000 + "</b>" * 100_000, "<p><button>" + "<i>" * 60_000 + "<hr>" * 60_000, "<div>" * 60_000 + "<header>x</header>" * 20_000, "<b><i>" * 50_000 + "</p>" * 50_000):
        began = time.perf_counter()
        main_text(f"<body>{page}{ARTICLE}</body>")
        assert time.perf_counter() - began < 8


def test_tables_of_pages(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x"), (1, "u", f"<article>{ARTICLE}</article>", "x"), (None, None, None, "x"), (2, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert extract(pages.limit(0)).count() == 0
