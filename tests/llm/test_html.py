"""Page shapes with and without an article, and pages made to be slow."""

import time

import pytest

from tideline.llm import html

ONE = "The harbour was quiet in the morning, and the boats that had come in at night lay along the wall where the water was deep enough for them."
TWO = "Most of the crews were still asleep, but on the last of the boats a man was mending a net that had been torn on the rocks in the storm."
SHORT = "It was cold."
LINKS = " ".join(f'<a href="/{i}">Story number {i}</a>' for i in range(12))
NOISE = f"""<header><h1>Daily site</h1>{LINKS}</header><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav>
<div class="sidebar"><p>{TWO}</p></div><div class="cookie-notice"><p>We use cookies so that the site of the day works for all of you and for us.</p></div>"""
TAIL = f'<div id="comments"><p>I think the story of the boats is the best that was on the site in a year.</p></div><ul>{LINKS}</ul><footer><p>All rights of the site are with the owner of the site.</p></footer>'
WANT = f"The boats\n{ONE}\n{SHORT}\n{TWO}"


def body(inner, wrapper="div"):
    return f"<html><body>{NOISE}<{wrapper}><h2>The boats</h2><p>{ONE}</p><p>{SHORT}</p>{inner}<p>{TWO}</p></{wrapper.split()[0]}>{TAIL}</body></html>"


@pytest.mark.parametrize("wrapper", ["div", "article", "main", 'div class="layout has-sidebar"', 'div class="no-sidebar with-nav"', 'section id="search-page"', 'div class="side-by-side"'])
def test_main_text_of_pages_with_and_without_an_article(wrapper):
    assert html.main_text(body("", wrapper)) == WANT


@pytest.mark.parametrize("wrapper", ["div", "article"])
@pytest.mark.parametrize(
    "junk",
    [f'<p class="ad">{ONE}</p>', f'<p class="notice">{TWO}</p>', f'<div class="comment-list"><p>{ONE}</p></div>', f"<aside><p>{ONE}</p></aside>", f"<form>{ONE}<input></form>",
     f"<ul>{LINKS}</ul>", f"<p>{LINKS}</p>", f"<script>var x = '<p>{ONE}</p>'</script>", f"<div hidden>{ONE}</div>", f"<!-- <p>{ONE}</p> -->", f'<article class="comment"><p>{ONE}</p></article>'],
)
def test_junk_inside_the_text_is_left_out(wrapper, junk):
    assert html.main_text(body(junk, wrapper)) == WANT


def test_parts_of_an_article_whose_names_mention_a_header_or_tags_stay():
    page = f"<article><div class='article-header'><h1>The boats</h1><p>{SHORT}</p></div><p>{ONE}</p><p>{TWO}</p><p>See <a>the next part</a></p></article>"
    assert html.main_text(page) == f"The boats\n{SHORT}\n{ONE}\n{TWO}\nSee the next part"


def test_a_teaser_in_an_article_does_not_hide_longer_text():
    page = f"<article><p>{SHORT}</p></article><div><p>{ONE}</p><p>{TWO}</p></div>"
    assert ONE in html.main_text(page) and TWO in html.main_text(page)


def test_attributes_and_broken_tags():
    assert html.main_text(f'<article><p title="a > b" data-x=\'<p>\'>{ONE}</p><p>{TWO}<br>x < y and 3 <4</p>') == f"{ONE}\n{TWO}\nx < y and 3 <4"
    assert html.main_text(f'<article><p>{ONE}</p><p title="never closed>{TWO}</p></article>') == f"{ONE}\n{TWO}"
    assert html.main_text(f"<article><p>{ONE}</p><div") == f"{ONE}\n<div"


@pytest.mark.parametrize(
    "page",
    ["x < y <a b " * 100_000, '<a "' * 200_000, "<div>" * 100_000 + "</b>" * 100_000, "<textarea>" * 100_000, '<a x="' * 150_000 + '">"', "<p class=ad>x" * 80_000, "<!-" * 300_000, "<b class=x>" * 100_000 + "</i>" * 100_000, "<div>" * 100_000 + "</div>" * 100_000],
)
def test_pages_of_a_megabyte_take_seconds(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 6
