"""Elements whose content is no text, closed and not closed."""

import time

import pytest

from nearfield.llm import html_text

TEXT = "This is the first paragraph of a long article about rivers, and it has quite a few words in it."
MORE = "This is the second paragraph of the same article, which follows whatever element stood before it."


@pytest.mark.parametrize("tag", sorted(html_text.HIDDEN_TAGS))
def test_not_closed(tag):
    page = f"<body><article><p>{TEXT}</p><{tag}><p>{MORE}</p></article></body>"
    assert html_text.main_text(page) == f"{TEXT} {MORE}"


@pytest.mark.parametrize("tag", sorted(html_text.HIDDEN_TAGS))
def test_closed_and_nested(tag):
    inner = f"<{tag}>gone <{tag}>gone</{tag}> gone</{tag}>"
    assert html_text.main_text(f"<body><article><p>{TEXT}</p>{inner}<p>{MORE}</p></article></body>") == f"{TEXT} {MORE}"
    assert html_text.main_text(f"<body><article><p>{TEXT}</p><{tag}>kept {inner}<p>{MORE}</p></article></body>").endswith(MORE)


def test_formulas_stay():
    page = f"<body><article><p>{TEXT} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> {MORE}</p></article></body>"
    assert html_text.main_text(page) == f"{TEXT} x=1 {MORE}"


def test_html_itself_reads_to_the_end():
    assert html_text.main_text(f"<body><article><p>{TEXT}</p><script>{MORE}</article></body>") == TEXT


def test_many_that_are_not_closed():
    began = time.perf_counter()
    assert html_text.main_text("<article>" + f"<p>{TEXT}</p><button>" * 5000).count(TEXT) == 5000
    assert time.perf_counter() - began < 20
