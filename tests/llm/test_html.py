import html
import random

from carelens.llm.htmltext import extract_text, main_text

LONG = "a paragraph with enough words in it to make the distribution of line lengths surge at this point"


def test_marked_article_is_kept_whole_and_nothing_else():
    page = f"""<!DOCTYPE html><title>no</title><style>p{{}}</style><body><nav><ul><li><a href="/x">menu</a></ul></nav>
    <!-- <p>comment</p> --><div class="ad">buy {LONG}</div><article><h1>Fish &amp; chips &copy &quo</h1><p><b>First.<br>
    <p>x &lt; y <i>in</i>line\n\tspace&nbsp;here</p><p>Tiny.</p><script>var t="</p><p>no";</script>
    <aside>{LONG}</aside><p>Last.</article><section class="comments"><p>{LONG}</p></section><footer>&copy; f</footer>"""
    assert main_text(page) == "Fish & chips © &quo\nFirst.\nx < y inline space here\nTiny.\nLast."


def test_unmarked_pages_keep_the_surge():
    page = f"""<body><div id="main-menu"><a href=x>Home</a></div><p><a href=1>One</a> | <a href=2>Two</a></p>
    <div class="content"><h1>Title</h1><div><p>{LONG}<p>Short.<p>{LONG}</div><div class="ad-box">{LONG}</div><p>After.</p></div>
    <div class="cookie-notice">{LONG}</div><form><p>{LONG}</p></form><div id=sidebar><p>{LONG}</div><footer>bye</footer>"""
    assert main_text(page) == f"Title\n{LONG}\nShort.\n{LONG}\nAfter."


def test_marked_article_keeps_its_lists_of_links():
    items = "".join(f"<li><a href=/{i}>Paper {i}</a></li>" for i in range(4))
    listed = "\n".join(f"Paper {i}" for i in range(4))
    page = f"<main><h1>Title</h1><p>Short.</p><div><p>{LONG}</p></div><h2>Sources</h2><ul>{items}</ul><ul class='related'>{items}</ul></main>"
    assert main_text(page) == f"Title\nShort.\n{LONG}\nSources\n{listed}"
    assert main_text(f"<article><ul>{items}</ul></article>") == listed


def test_named_paragraph_stays_and_named_container_goes():
    page = "<article><p class='related work'>Earlier work.</p><div class='related'><p>More to read</p></div><p>End. <span class=ad>buy</span></p></article>"
    assert main_text(page) == "Earlier work.\nEnd."


def test_short_unmarked_page_keeps_its_largest_stretch():
    page = "<body><nav><a href=/>Home</a></nav><div><h1>Note</h1><p>A few words only.</p></div><footer>f</footer></body>"
    assert main_text(page) == "Note\nA few words only."


def test_broken_markup_loses_no_article_text():
    assert main_text(f"<nav><ul><li>menu<article><p>{LONG}<p>two<!-- open <p>no") == f"{LONG}\ntwo"
    assert main_text("<article><p>a < b and c<d> e</p><p title='x>y'>f</p>") == "a < b and c e\nf"
    assert main_text("<article>" + "<p>w</p>" * 20_000) == "\n".join(["w"] * 20_000)
    for page in (None, "", "<", "<p", "</", "<!--", "<script>", "<a href='", "&#0; &#x110000;", "</p></div>"):
        assert isinstance(main_text(page), str)


def test_random_articles_read_back():
    rnd = random.Random(6)
    for _ in range(300):
        blocks = [" ".join(rnd.choice(["x", "&", "<b>", "é", "long" * 9, '"', "&amp;"]) for _ in range(rnd.randint(1, 9)))
                  for _ in range(rnd.randint(1, 8))]
        inner = "".join(f"<p>{html.escape(b)}</p>" for b in blocks)
        assert main_text(f"<nav>n</nav><article>{inner}</article><footer>f</footer>") == "\n".join(blocks)


def test_rows_of_awkward_and_empty_tables(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article>x"), (3, "u", "<article>y"), (3, "u", "<article>y")]
    pages = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id bigint, url string, html string, n_chars int, text string")
    got = sorted(map(tuple, extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "x", 1), (3, "u", "y", 1), (3, "u", "y", 1)], key=str)
    assert extract_text(pages.limit(0)).count() == 0
