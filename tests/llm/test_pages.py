import html
import random
import re

import pytest

from tidewatch.llm.common import table
from tidewatch.llm.pages import extract, main_text, main_texts

ARTICLE = "One, two, three and more, words enough to count as a paragraph of its own, with commas."


def article_of(page):
    """What the article element of a given page holds, read by plain substitution."""
    inner = page[page.index("<article>") + 9:page.index("</article>")]
    inner = re.sub(r"</?b>", "", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())


def test_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    expected = {r.page_id: article_of(r.html) for r in pages.collect()}
    out = main_texts(pages).collect()
    assert {r.page_id: r.text for r in out} == expected
    assert all(r.n_chars == len(r.text) for r in out)


@pytest.mark.parametrize("noise", [
    "<nav><ul><li><a href=x>Home</a></li></ul></nav>",
    "<header><h1>Site name, and more</h1></header>",
    "<footer>&copy; us, all rights</footer>",
    "<aside><p>Side text, that goes on, and on.</p></aside>",
    '<div class="cookie-notice"><p>We use cookies, and more, to follow you, everywhere.</p></div>',
    '<div id="ads"><p>Buy this, that, and more, and more, now.</p></div>',
    "<form><p>Sign up, now, please.</p><input name=q><button>Go</button></form>",
    "<script>var t = '</p><p>never</p>';</script><style>p{margin:0}</style><!-- <p>never, ever</p> -->",
    '<section id="comments"><p>Reader says, this, that, and a lot, more, than that, at length.</p></section>',
    '<div class="sidebar"><ul><li>One, thing</li></ul></div>',
    '<div role="navigation"><p>Up, down, left, right.</p></div>',
    "<div hidden><p>Hidden, text, here.</p></div>",
])
def test_what_is_left_out(noise):
    body = f"<p>{ARTICLE}</p><p>{ARTICLE} Again.</p>"
    for page in (f"<html><body>{noise}<article>{body}</article></body></html>",
                 f"<body><div class=content>{body}</div>{noise}", f"<article>{body}{noise}</article>"):
        assert main_text(page) == f"{ARTICLE} {ARTICLE} Again."


def test_blocks_references_and_white_space():
    page = "<article><h1>A &amp; B</h1><p>one<b>two</b>  three\n four&nbsp;five<br>six<p>&lt;x&gt; &#233;</article>"
    assert main_text(page) == "A & B onetwo three four five six <x> é"
    assert main_text("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>") == "a b c d"


def test_siblings_are_kept_and_link_lists_are_not():
    links = "".join(f"<li><a href={i}>Some other page, number {i}</a></li>" for i in range(20))
    page = (f"<body><div><div class=part><p>{ARTICLE}</p><p>{ARTICLE}</p></div><p>{ARTICLE} Sibling.</p>"
            f"<ul>{links}</ul></div></body>")
    assert main_text(page) == f"{ARTICLE} {ARTICLE} {ARTICLE} Sibling."


def test_broken_and_long_pages():
    assert main_text("") == ""
    assert main_text("plain &lt;text&gt;") == "plain <text>"
    assert main_text("<p>a<p>b<script>x</script><div") == "a b"
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert main_text("<a href='x" * 3) == ""
    many = main_text("<article>" + f"<p>{ARTICLE}" * 20_000)
    assert len(many) == 20_000 * (len(ARTICLE) + 1) - 1


def test_nulls_repeats_extra_columns_and_empty(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "y"), (3, "u", "<p>Hi</p>", "z"), (3, "u", "<p>Hi</p>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted((r.page_id, r.text, r.n_chars) for r in main_texts(pages).collect())
    assert out == [(1, "", 0), (2, "", 0), (3, "Hi", 2), (3, "Hi", 2)]
    assert extract(pages).columns == pages.columns
    assert main_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("wrapper", [
    'class="post has-comments"', 'id="content" class="no-ads"', 'class="page subscribe-enabled"', 'class="login-wall" id=signup'])
def test_words_on_a_wrapper_do_not_drop_the_article(wrapper):
    body = f"<p>{ARTICLE}</p><p>{ARTICLE} Again.</p>"
    comments = '<div class="comments"><p>Reader says, this, that, and more.</p></div>'
    aside = "<div><p>Short, text.</p></div>"
    for inner in (body, f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>{comments}",
                  f"<article>{body}</article>{comments}"):
        for page in (f"<body><div {wrapper}>{inner}</div></body>", f"<body>{aside * ('<article' in inner)}<div {wrapper}>{inner}</div>"):
            assert main_text(page) == f"{ARTICLE} {ARTICLE} Again."


def test_comments_go_though_they_are_articles_or_longer():
    body, reply = f"<p>{ARTICLE}</p>", f"<p>Reader: {ARTICLE}</p>"
    for page in (f"<body><article>{body}</article><section class=comments>{reply * 6}</section>",
                 f"<body><article>{body}</article><ol class=commentlist><li><article class=comment>{reply * 6}</article></ol>",
                 f"<body><div>{body}{body}</div><section id=comments>{reply * 3}</section>",
                 f"<body><article>{body}</article><div class=sponsored><article>{reply}</article></div>"):
        assert main_text(page) in (ARTICLE, f"{ARTICLE} {ARTICLE}")


def test_comments_beside_the_article_never_replace_it():
    body, reply = f"<p>{ARTICLE}</p>", f"<p>Reader: {ARTICLE}</p>"
    thread = f"<article class=comment>{reply * 6}</article>"
    for page in (f"<body><article>{body}</article><section id=responses>{thread}</section>",
                 f"<main><article>{body}</article>{thread}</main>",
                 f"<main><article>{body}{thread}</article></main>",
                 f"<main>{body}<div class=comments>{reply * 3}</div></main>",
                 f"<body><article class='post comments-open'>{body}</article>{thread}",
                 f"<main><article class='newsletter post'>{body}</article></main>",
                 f"<main><div class='newsletter'>{body}</div></main>",
                 f"<body><div id=comments><article>{body}</article>{thread}</div>"):
        assert main_text(page) == ARTICLE


WORDS = "One, two three four, five six seven eight nine ten eleven twelve, thirteen fourteen fifteen sixteen"


def made_page(pick):
    """A page without article elements, and its article: blocks of any length in any wrapper, noise in between."""
    blocks, page = [], []

    def block(text):
        blocks.append(text)
        kind = pick.randrange(5)
        if kind == 0 and len(text) < 60:
            return f"<ul><li>{text}</li></ul>"
        return [f"<p>{text}</p>", f"<div><p>{text}</p></div>", f"<div>{text}</div>", f"<section><div><p>{text}</p></div></section>",
                f"<blockquote>{text}</blockquote>"][kind]

    noise = ['<div class="ad"><p>Buy, now, this, and that, at once.</p></div>', "<nav><a href=x>Menu</a> <a href=y>More</a></nav>",
             "<form>Your name, please <input></form>", '<div class=sidebar><p>Side, text.</p></div>',
             "<ul>" + "<li><a href=z>Some other page, at length</a></li>" * 4 + "</ul>", "<script>x('<p>no</p>')</script>",
             '<div class="comments"><p>A reader says, this.</p></div>', "<footer>All rights</footer>", "<!-- <p>no</p> -->"]
    for i in range(pick.randint(3, 9)):
        page.append(block(f"{i}. " + " ".join([WORDS] * pick.randint(1, 6)) + "."))
        if pick.random() < 0.5:
            page.append(block(pick.choice(["The end.", "Short", "A list item, short.", "See: below"])))
        if pick.random() < 0.6:
            page.append(pick.choice(noise))
    inner = "".join(page)
    wrap = pick.choice(["{}", "<div>{}</div>", "<div class='page has-comments'><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>"])
    return f"<html><body>{''.join(pick.sample(noise, 2))}{wrap.format(inner)}{pick.choice(noise)}</body></html>", " ".join(blocks)


def test_pages_without_article_elements():
    pick = random.Random(11)
    for _ in range(400):
        page, article = made_page(pick)
        assert main_text(page) == article, page
