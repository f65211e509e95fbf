import random
import time

import pytest

from claimspark.llm import html_text

LONG = "The cat sat on the mat and it was there for a while, as they all said to us in the house by the sea. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>Only this.</p>", "Only this."),
        (f"<nav><a href=x>Home</a></nav><article><h1>T&eacute;st &amp; more</h1><p>{LONG}<p>Short.</article><footer>&copy; us</footer>", f"Tést & more\n{LONG.strip()}\nShort."),
        (f"<div class='ad-box'>Buy the thing now, it is the best of all.</div><h1>Title</h1><p>{LONG}</p><div id=comments><p>{LONG}</p></div>", f"Title\n{LONG.strip()}"),
        (f"<ul><li><a href=a>one</a><li><a href=b>two</a></ul><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}</form>", LONG.strip()),
        (f"<main><p>a&nbsp;\n b<br>c<!-- {LONG} --><script>x('</p>')</script><b>d</b>e</p></main>", "a b cde"),
        ("<article><section class='comment'><p>Nice one.</p></section></article>", ""),
        (f"<nav>menu never closed<ul><li>x<article><p>{LONG}</p></article>", LONG.strip()),
        ("<article>plain &#x41;&#66; text", "plain AB text"),
        (f"<article><p>{LONG}</p><div class='cookie-notice'>We use cookies for the best.</div><p>End.</p></article>", f"{LONG.strip()}\nEnd."),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_short_blocks_inherit_from_neighbours():
    page = f"<div><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p></div><div><a href=x>{LONG}</a></div><p>Fine.</p>"
    assert html_text.main_text(page) == f"{LONG.strip()}\nTiny.\n{LONG.strip()}"


def test_rows_stay(spark):
    rows = [(1, "u", "<p>A"), (1, "u", "<p>A"), (None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract_text(df).collect()), key=repr)
    assert got == [(1, "u", "A", 1), (1, "u", "A", 1), (None, None, "", 0)]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_long_broken_markup_ends():
    assert html_text.main_text("<" * 5000 + "<a href='" * 2000) is not None
    assert len(html_text.main_text("<p>word " * 20000)) > 50000


MAIN = "It was a long day for the people of the town, and all of them had to wait in the rain for the bus that was late."
POLISH = "Wczoraj wieczorem mieszkańcy miasteczka zebrali się na rynku, żeby wspólnie obejrzeć pokaz sztucznych ogni nad rzeką."
NAV = "<nav><a href='/'>Home</a></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<head><title>x</title><meta charset=utf-8><style>p {{}}</style><body><article><p>{MAIN}</p></article>",
        f"<body><article><svg viewBox='0 0 1 1'/><p>{MAIN}</p></article>",
        f"<body><article><select><p>{MAIN}</p></article>",
    ],
)
def test_elements_without_end_tag_lose_nothing(page):
    assert html_text.main_text(page) == MAIN


def test_open_script_is_skipped_to_the_end():
    assert html_text.main_text(f"<p>{MAIN}</p><script>var a = '<p>{MAIN}</p>'") == MAIN


@pytest.mark.parametrize("teaser", ["", "<article><h3>More news</h3></article>"])
def test_other_languages_without_article(teaser):
    assert html_text.main_text(f"<body>{NAV}<div><p>{POLISH}</p></div>{teaser}<footer>Stopka</footer>").startswith(POLISH)


def test_teaser_article_does_not_replace_the_main_text():
    assert MAIN in html_text.main_text(f"<body>{NAV}<div><p>{MAIN}</p></div><article><h3>More news</h3></article>")


@pytest.mark.parametrize("cls", ["entry-header", "post-header", "article-header", "header", "social-science", "legal-news", "search-results-study"])
def test_names_inside_an_article_keep_its_title(cls):
    page = f"<body>{NAV}<article><header class='entry-header'><div class='{cls}'><h1>My title</h1></div></header><p>{MAIN}</p></article>"
    assert html_text.main_text(page) == f"My title\n{MAIN}"


def test_header_of_a_post_without_article():
    page = f"<body>{NAV}<div class='post'><div class='post-header'><h1>My title</h1></div><p>{MAIN}</p></div><div class='site-header'>Site name</div>"
    assert html_text.main_text(page) == f"My title\n{MAIN}"


@pytest.mark.parametrize("cls", ["share-buttons", "social-links", "related-posts", "comments", "ad-box", "newsletter", "site-header", "search-form", "cookie-notice", "alert"])
def test_names_of_the_frame_are_refused_inside_an_article(cls):
    assert html_text.main_text(f"<article><p>{MAIN}</p><div class='{cls}'>{MAIN} Again.</div></article>") == MAIN


@pytest.mark.parametrize(
    "page",
    ["<a " * 1_600_000, "<a " * 1_600_000 + ">", "<" * 4_000_000, "<div>" * 300_000 + "</p>" * 300_000, "<a href='" * 500_000, ("<a '" + 'x"') * 400_000 + ">" * 10, "<!--" * 1_000_000, "<svg>" * 500_000],
)
def test_megabytes_of_broken_markup_take_seconds(page):
    import time

    start = time.monotonic()
    html_text.main_text(page)
    assert time.monotonic() - start < 30


def test_second_pass_equals_a_naive_search():
    import random

    rng = random.Random(2)
    for _ in range(300):
        blocks = [html_text.Block(rng.choice([0, 0, 1, 2]), rng.random() < 0.2, False, text="x", good=rng.choice([True, False, None, None, None])) for _ in range(rng.randint(1, 25))]
        for b in blocks:
            b.good = False if b.refused else b.good

        def naive(at, step):
            mine = blocks[at].article
            for distance in range(1, len(blocks)):
                i = at + step * distance
                if not 0 <= i < len(blocks):
                    return None
                b = blocks[i]
                if b.good is not None and (not mine or b.article == mine and not b.refused):
                    return b.good, distance
            return None

        assert html_text._nearest(blocks) == [naive(i, -1) for i in range(len(blocks))]
        assert html_text._nearest(blocks[::-1])[::-1] == [naive(i, 1) for i in range(len(blocks))]


def test_labels_are_inherited_by_distance():
    short = "".join(f"<p>s{i}</p>" for i in range(10))
    links = "<div>" + "<a href=x>one two three four five six seven eight nine ten eleven twelve</a> " * 2 + "</div>"
    got = html_text.main_text(f"<div><p>{LONG}</p>{short}{links}</div>").split("\n")
    assert got == [LONG.strip(), *(f"s{i}" for i in range(5))]
    assert html_text.inherited((True, 2), (False, 2), False)
    assert not html_text.inherited((True, 1), (False, 1), True)
    assert html_text.inherited(None, None, False)


STORY = [f"This is paragraph {i} of the article, and it has been written so that the words of it are those of a story." for i in range(6)]
ARTICLE = "".join(f"<p>{x}</p>" for x in STORY)
SIDE = "<p>Another story that is told in short, for those who have the time to read it as well as this one.</p>"


@pytest.mark.parametrize(
    ("start", "end"),
    [
        ('<div class="content-sidebar-wrap">', "</div>"),
        ('<div id="page" class="site has-sidebar">', "</div>"),
        ('<div class="wrapper no-related">', "</div>"),
        ('<article class="post comments-open">', "</article>"),
        ('<div id="ad-free-reading">', "</div>"),
        ('<section id="login-problems">', "</section>"),
        ('<form id="aspnetForm" method="post">', "</form>"),
        ('<form role="form"><div class="nav-page menu-layout"><main>', "</main></div></form>"),
    ],
)
def test_wrappers_keep_their_article(start, end):
    around = f'<nav><a href="/">Home</a></nav>{{}}<footer><p>All rights are reserved by the owners of this site and of what is on it.</p></footer>'
    inner = f'{ARTICLE}<div class="sidebar">{SIDE}</div><div class="comments"><p>{STORY[0].replace("This", "My")}</p></div>'
    for page in (f"{start}{ARTICLE}{end}", around.format(start + inner + end), f"<html><body>{around.format(start + inner + end)}</body></html>"):
        assert html_text.main_text(page).split("\n") == STORY


def test_small_parts_stay_refused():
    for part in ("<form><p>{}</p><input></form>", '<div class="sidebar"><p>{}</p></div>', '<div class="related-posts"><article><p>{}</p></article></div>', '<div id="login"><p>{}</p></div>'):
        text = "Please give us the name that you have and the word for it, and we will let you in as soon as it is read."
        assert html_text.main_text(f"<body><div>{ARTICLE}</div>{part.format(text)}</body>").split("\n") == STORY
    comments = "".join(f'<li><article class="comment"><p>{x} So say I.</p></article></li>' for x in STORY * 5)
    assert html_text.main_text(f'<div>{ARTICLE}</div><ol class="comment-list">{comments}</ol>').split("\n") == STORY
    assert html_text.main_text(f'<ol class="comment-list">{comments}</ol>') == ""


@pytest.mark.parametrize("quote", ['"', "'"])
def test_long_attributes_and_broken_quotes(quote):
    value = "x > y " * 200_000
    start = time.perf_counter()
    assert html_text.main_text(f"<div data-state={quote}{value}{quote}>{ARTICLE}</div>").split("\n") == STORY
    assert time.perf_counter() - start < 2
    assert html_text.main_text(f"<div title={quote}never closed>{ARTICLE}</div>").split("\n") == STORY
    for broken in (f"<a {quote}>{quote} " * 100_000, f'<a ">" ' * 100_000, f"<a x={quote}b " * 100_000, "<a '\">" * 100_000):
        start = time.perf_counter()
        html_text.main_text(broken)
        assert time.perf_counter() - start < 5


def test_pages_made_of_known_parts():
    """Random pages whose main text is known by the way they are made."""
    rng = random.Random(4)
    junk = [
        "<nav><ul><li><a href='/a'>First</a></li><li><a href='/b'>Second</a></li></ul></nav>", "<script>var a = '<p>not text</p>';</script>", f'<aside>{SIDE}</aside>',
        "<form><label>Name</label><input><button>Send it</button></form>", '<div class="cookie-notice"><p>We use them so that the site is as it is for you, and you may say no to that.</p></div>',
        '<div class="share"><a href="#">Share</a></div>', "<style>p { color: red }</style>", "<!-- <p>a note</p> -->", f'<div class="ads">{SIDE}</div>',
    ]
    for _ in range(200):
        texts = [f"{x} It is the number {rng.randrange(99)} &amp; the last of them." for x in rng.sample(STORY, rng.randint(3, 6))]
        body = [f"<p>{t}</p>" if rng.random() < 0.8 else f"<div> {t}\n </div>" for t in texts]
        before, after = ("".join(rng.sample(junk, rng.randint(0, 4))) for _ in "ab")
        shell = rng.choice(["{}", "<article>{}</article>", "<div class='content'>{}</div>", "<div class='main-sidebar-layout'>{}</div>", "<form>{}</form>"])
        page = before + shell.format("".join(body)) + after
        assert html_text.main_text(page).split("\n") == [t.replace("&amp;", "&") for t in texts]


def test_rows_of_any_kind_and_an_empty_table(spark):
    page = f"<div>{ARTICLE}</div>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", ""), (3, "w", "plain " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars").repartition(2)
    got = sorted(((r.page_id or 0, r.n_chars) for r in html_text.extract_text(df).collect()))
    assert got == [(0, 0), (1, len("\n".join(STORY))), (1, len("\n".join(STORY))), (2, 0), (3, 6 * 200_000 - 1)]
    assert html_text.extract_text(df.limit(0)).count() == 0
