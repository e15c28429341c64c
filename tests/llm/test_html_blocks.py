"""Pages with odd markup lose no text, and deep ones take time in proportion."""

import time

import pytest

from spokenspark.llm.html_text import blocks

ODD = {
    "<article><p>A</p><svg/><p>B</p></article>": ["A", "B"],
    "<article><p>A</p><svg width=3 /><p>B</p></article>": ["A", "B"],
    "<article><p>A</p><svg><text>no</text></svg><p>B</p></article>": ["A", "B"],
    '<article><p>A</p><iframe src="a"/><p>B</p></article>': ["A", "B"],
    "<p>A</p><noscript><p>B": ["A", "B"],
    "<p>A</p><script>var x = '<p>no</p>'": ["A"],
    "<p>A</p><style/>no</style><p>B</p>": ["A", "B"],
    '<article><p>see <a class="tags">the link</a> here</p></article>': ["see the link here"],
    '<div>before <span class="share">Share this</span> after</div>': ["before", "Share this", "after"],
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": ["a", "b", "c", "d"],
    "<p>a<div>b</div>c</p>": ["a", "b", "c"],
    "a &amp; b<br>c": ["a & b", "c"],
}


@pytest.mark.parametrize("page", ODD)
def test_odd_markup(page):
    assert [b.text for b in blocks(page)] == ODD[page]


def test_names_inside_a_sentence_part_nothing():
    (one,) = blocks('<article><p>see <a class="tags">the link</a> here</p></article>')
    assert one.path == (("article", frozenset()), ("p", frozenset())) and one.links == len("the link") / len("see the link here")
    (inner,) = blocks('<div class="a"><div class="b"><div class="a"><div>x</div></div></div></div>')
    assert inner.path == (("div", frozenset("b")), ("div", frozenset("a")), ("div", frozenset()))  # each step once, where it was last opened


@pytest.mark.parametrize("tag", ["div", "span", "ul", "a"])
def test_deep_pages_take_time_in_proportion(tag):
    began = time.time()
    found = blocks(f"<{tag}>x" * 100_000 + f"</{tag}>" * 100_000 + "<p>end</p>")
    assert found[-1].text == "end" and found[-1].path == (("p", frozenset()),) and time.time() - began < 20
