import html as entities
import re
import time

from docloom.llm.html_content import content, main_text

FILL = "word " * 60


def test_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in main_text(rows, keep=("page_id", "html")).collect():
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<b>", "").replace("</b>", "").replace("<br>", " "))
        assert r.text == "\n".join(x for b in blocks if (x := " ".join(entities.unescape(b).split())))


def test_aside():
    page = (
        "<body><header><h1>Site</h1><nav><a href=x>menu</a></nav></header><div id='cookie-notice'>" + FILL + "</div>"
        "<div class='post'><h2>Title &amp; more</h2><p>" + FILL + "</p><p>short.</p><div class='ad-box ads'>" + FILL + "</div><ul><li>item</li></ul></div>"
        "<section class='comments'><p>" + FILL + "</p></section><aside>" + FILL + "</aside><form><p>" + FILL + "</p></form><footer>" + FILL + "</footer>"
    )
    assert content(page).split("\n") == ["Title & more", FILL.strip(), "short.", "item"]


PROSE = "Plain words of an article that go on, with commas and some more of them. " * 4
ARTICLE = f"<h1>Title</h1><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p><ul><li>first item</li><li>second item</li></ul><p>{PROSE}</p>"
TEXT = "\n".join(["Title", PROSE.strip(), "Short one.", PROSE.strip(), "first item", "second item", PROSE.strip()])
LINKS = "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(12))


def test_wrappers():
    """Words that mark what is no article say nothing on an element that holds the article."""
    side = f"<div class=sidebar><p>{PROSE}</p></div>"
    for page in (
        f"<body><div class='layout has-sidebar'><div>{ARTICLE}</div>{side}</div>",
        f"<body><div class='site no-sidebar'><article>{ARTICLE}</article>{side}</div>",
        f"<body><div class='job-search-guide'>{ARTICLE}</div>{side}",
        f"<body><form id=aspnetForm><div>{ARTICLE}</div>{side}</form>",
        f"<body><div class='search-results promo'><div>{ARTICLE}</div></div>{side}",
        f"<body><main class='related page'>{ARTICLE}</main>{side}",
    ):
        assert content(page) == TEXT, page[:60]


def test_comments_and_menus():
    said = "".join(f"<article class='comment depth-{k}'><p>{PROSE}</p></article>" for k in range(9))
    assert content(f"<body><main><article>{ARTICLE}</article><div>{said}</div></main>") == TEXT
    assert content(f"<body><article>{ARTICLE}</article><section class=comments>{said}</section>") == TEXT
    assert content(f"<body><div>{ARTICLE}<section id=comments><ol><li>{PROSE}</li><li>{PROSE}</li></ol></section></div>") == TEXT
    assert content(f"<body><ul>{LINKS}</ul>{ARTICLE}<ul>{LINKS}</ul>") == TEXT


def test_no_labels():
    """Nothing but ratios tells the article from what stands around it."""
    page = f"<body><div><div><b>Brand</b></div><ul>{LINKS}</ul></div><div><div class=x1>{ARTICLE}</div><div class=x2><ul>{LINKS}</ul></div></div><div><p><a href=/a>About</a> <a href=/b>Contact</a></p><p>2024</p></div>"
    assert content(page) == TEXT
    # intro before a long list, and two regions of unequal size: nothing that was selected goes
    items = "".join(f"<li>{PROSE}</li>" for _ in range(20))
    assert content(f"<body><ul>{LINKS}</ul><div><h1>Title</h1><p>{PROSE}</p><ul>{items}</ul></div>").count(PROSE.strip()) == 21
    assert content(f"<body><div><div>{ARTICLE * 8}</div><div><p>{PROSE}</p></div></div>").count(PROSE.strip()) == 25


def test_linear():
    for page in ("<div>x" * 16_000, "<b>x" * 16_000, "<p><a href=x>y" * 16_000, "<ul><li>z" * 8_000, "</b></div>" * 16_000):
        began = time.perf_counter()
        content(page)
        assert time.perf_counter() - began < 1


def test_broken():
    assert content("") == "" and content("<p") in ("", "<p") and content("plain text") == "plain text"
    assert content("<p>a &lt;b&gt;  \n c &#228;") == "a <b> c ä"
    assert content("<nav>only a menu</nav>") == ""
    assert content("<article>" + "<div>" * 3000 + "deep text here</article>") == "deep text here"


def test_streaming():
    page = "<article><h1>T</h1>" + "".join(f"<p>para {k} &amp; {FILL}</p>" for k in range(50)) + "</article>"
    assert content(page, chunk=7) == content(page)


def test_odd(spark):
    df = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<article><p>" + "x " * 300_000), (1, "u", "")], "page_id long, url string, html string")
    rows = main_text(df).collect()
    assert sorted(len(r.text) for r in rows) == [0, 0, 0, 599_999] and main_text(df.limit(0)).count() == 0
