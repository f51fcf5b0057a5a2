import random
import time

import pytest

from assayer.llm.htmltext import extract, main_text, stretches

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>x";</script></head><body class="has-sidebar">
<header><a href=/>Logo</a><p>Site slogan that is fairly long and repeated on every page</p></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to improve your experience on this site. Accept all or choose.</p></div>
<article><header><h1>The title &amp; more</h1></header><p><b>First   paragraph,\nwith <a href=x>a link</a> inside.<br><p>Second&nbsp;one &lt;here&gt;.</p>
<div class="ad"><p>Buy this very nice product right now</p></div><aside>Related stories of interest</aside><ul><li>item a<li>item b</ul><p>Ok.</p><!-- <p>gone</p> -->
<form><label>Mail</label><input name=q><button>Send</button></form></article>
<section id="comments"><h2>Comments</h2><p>I disagree with all of this article, it is plainly wrong</p></section><div class="sidebar">Popular posts and other things</div>
<footer>&copy; Somebody, all rights reserved, and a lot of other legal words</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == "The title & more\nFirst paragraph, with a link inside.\nSecond one <here>.\nitem a\nitem b\nOk."


def test_without_article_element():
    page = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>").replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")
    assert main_text(page) == main_text(PAGE)


def test_link_lists_are_no_text_and_names_may_be_wrong():
    menu = "".join(f"<div><a href={i}>Menu entry {i}</a></div>" for i in range(9))
    assert main_text(f"<body>{menu}<p>{'word ' * 40}</p>{menu}</body>") == ("word " * 40).strip()
    assert main_text('<div class="page-with-sidebar"><p>All of the text is in here.</p></div>') == "All of the text is in here."


def test_headers_of_site_and_article():
    body = f"<p>{'word ' * 30}</p>"
    site = '<div id="header">My site, all about words and other things</div>'
    assert main_text(f"<body>{site}<div class=post-header><h1>Title</h1></div>{body}</body>") == "Title\n" + ("word " * 30).strip()
    assert main_text(f'<body>{site}<main><div class="header"><h1>Title</h1></div>{body}</main></body>') == "Title\n" + ("word " * 30).strip()


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "a < b", "<!-- x", "<script>x", "</p></div>", "<p>" * 5000, "&#xD800;&#0;&bogus;", "<a href='>x", '<p class="a>b">t</p>'])
def test_broken_markup(page):
    assert isinstance(main_text(page), str)


def test_any_soup():
    r = random.Random(1)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<li>", "<ul>", "<article>", "</article>", "text ", "&amp;", "<br>", "<b>", "'", '"', "<", ">", "<!--", "-->", "<td>", "<table>"]
    for _ in range(300):
        main_text("".join(r.choice(bits) for _ in range(80)))


def test_stretches():
    assert stretches([0, 5, 90, 0, 3, 0, 0, 0, 100, 0], 80) == [(1, 5), (8, 9)]


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (3, "w", PAGE, 1), (3, "w", PAGE, 1), (4, "x", "<p>" + "long " * 200000, 1)], "page_id long, url string, html string, text int")
    out = sorted((r.page_id, r.url, len(r.text)) for r in extract(df).collect() if r.page_id != 2)
    n = len(main_text(PAGE))
    assert out == [(1, "u", 0), (3, "w", n), (3, "w", n), (4, "x", 999999)]
    assert extract(df.limit(0)).count() == 0


def test_every_article_is_kept():
    long, short = "A long sentence of the story's first part. " * 25, "The second part is short but belongs to it. " * 9
    text = main_text(f"<body><nav>Home</nav><article><p>{long}</p></article><article><p>{short}</p></article><footer>Imprint</footer></body>")
    assert text.split("\n") == [long.strip(), short.strip()]


def test_teaser_cards_are_not_the_article():
    body = "A sentence of the body, which no element marks. " * 20
    text = main_text(f"<body><div><p>{body}</p></div><div><article><h3>Read this too</h3></article><article><h3>And this one</h3></article></div></body>")
    assert body.strip() in text.split("\n")


@pytest.mark.parametrize("mark", ["id='discussion'", "id='related-work'", "id='search-algorithms'", "id='social-impact'", "class='commentary'"])
def test_sections_named_like_boilerplate_are_kept(mark):
    prose = "A long sentence of the section that the name could mislead about. " * 5
    page = f"<article><p>{prose}</p><section {mark}><h2>Heading</h2><p>{prose}</p></section><div class='related'><a href='/x'>Another story</a></div></article>"
    assert main_text(page).split("\n") == [prose.strip(), "Heading", prose.strip()]


def test_a_form_around_the_page_is_the_page():
    prose = "A long sentence of a page that is one form. " * 5
    page = f"<body><form action='/'><nav>Home</nav><div><p>{prose}</p></div></form></body>"
    assert main_text(page) == prose.strip()
    assert main_text(f"<body><div><p>{prose}</p></div><form>Your name and your address, please</form></body>") == prose.strip()


@pytest.mark.parametrize("name", ["follow-up", "related", "search", "social", "privacy", "notice", "login", "response"])
def test_a_body_named_like_boilerplate_is_kept(name):
    prose = "A long sentence of the body of a page. " * 12
    page = f"<main><div class='{name}'><p>{prose}</p><div class='ad'>Buy it now</div></div><p>The end.</p></main>"
    assert main_text(page).split("\n") == [prose.strip(), "The end."]


def test_notices_in_an_article_are_dropped():
    prose = "A long sentence of the body of a page. " * 12
    page = f"<article><div class='privacy-notice'><p>{'We value what you do here and ask you to agree. ' * 2}</p></div><p>{prose}</p></article>"
    assert main_text(page) == prose.strip()


def test_the_window_decides_where_no_element_marks_the_article(monkeypatch):
    prose = "A long sentence of the body of a page. " * 6
    far = "".join(f"<div><a href='{i}'>entry {i}</a></div>" for i in range(6))
    page = f"<body><div>Est. 1987</div>{far}<div><p>{prose}</p><p>Short.</p><p>{prose}</p></div>{far}<div>Printed here</div></body>"
    want = [prose.strip(), "Short.", prose.strip()]
    assert main_text(page).split("\n") == want
    monkeypatch.setattr("assayer.llm.htmltext.SURGE", 1)
    assert main_text(page).split("\n") == ["Est. 1987", *want, "Printed here"]


@pytest.mark.parametrize("page", ["<div data-x=" + '"x' * 100_000, "<div data-x=" + '"x' * 99_999 + "<p>t</p>", "<a " * 100_000, '<a x=">" ' * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<b>" * 50_000 + "<p>" * 50_000, "<" * 200_000, "<!--" * 100_000, "<script>" * 50_000])
def test_long_broken_pages_end_soon(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 2


def test_quotes_and_ends_of_tags():
    assert main_text('<p title="a > b">one</p><p title=\'c > d\'>two</p><p title=">three</p><p>four</p>') == "one\ntwo\nthree\nfour"
