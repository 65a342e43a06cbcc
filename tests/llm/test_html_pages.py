"""Hand-made pages with the text that a reader would call the article, written out beside each."""

import time

import pytest

from nearfield.llm import html_text

A = "The river rises in the northern hills and runs for ninety miles through farmland before it meets the sea near the old harbour town."
B = "For most of the year its water is low, but in spring the snow melts and the banks are flooded for weeks, which the farmers have learned to use."
C = "A bridge was built here in the last century, and since then the villages on both sides have grown into one another."
LONG = " ".join([C] * 4)
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 River Times. All rights reserved.</p></footer>"


def page(body, attrs=""):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body{attrs}>{body}</body></html>"


PAGES = {
    "plain article": (page(f"{NAV}<article><h1>The river</h1><p>{A}</p><p>{B}</p></article>{FOOT}"), f"The river {A} {B}"),
    "header of the entry": (page(f'{NAV}<article><header class="entry-header"><h1>The long river of the north</h1></header><p>{A}</p><p>{B}</p></article>{FOOT}'), f"The long river of the north {A} {B}"),
    "layout class on a wrapper": (page(f'<div class="page has-sidebar">{NAV}<article><h1>The river</h1><p>{A}</p><p>{B}</p></article><div class="sidebar"><p>Popular this week</p><p>{C}</p></div></div>'), f"The river {A} {B}"),
    "layout class on the body": (page(f"<p>{A}</p><p>{B}</p>", ' class="single-post sidebar-right nav"'), f"{A} {B}"),
    "button not closed": (page(f"<article><p>{A}</p><button>Share<p>{B}</p></article>{FOOT}"), f"{A} Share {B}"),
    "paragraph that is a link": (page(f'<article><p>{A}</p><p>{B}</p><p><a href="x">Read the full survey</a></p></article>{FOOT}'), f"{A} {B} Read the full survey"),
    "link between paragraphs": (page(f'<article><p>{A}</p><p><a href="x">A map of the river</a></p><p>{B}</p></article>{FOOT}'), f"{A} A map of the river {B}"),
    "short last paragraph": (page(f"<article><p>{A}</p><p>{B}</p><p>More soon.</p></article>{FOOT}"), f"{A} {B} More soon."),
    "one word": (page(f"<article><p>{A}</p><p>Why?</p><p>{B}</p></article>"), f"{A} Why? {B}"),
    "comments inside": (page(f'<article><p>{A}</p><p>{B}</p><div class="comments"><h3>Two comments</h3><p>{C}</p><p>{A}</p></div></article>'), f"{A} {B}"),
    "comments behind": (page(f'<article><p>{A}</p></article><section id="comments"><ol><li>{C}</li><li>{B}</li></ol></section>'), A),
    "comments of two-part names": (page(f'<article><p>{A}</p><p>{B}</p></article><div class="comment-list"><p>{C}</p></div><div id="user-comments"><p>{C}</p></div>'), f"{A} {B}"),
    "cookie notice": (page(f'<div class="cookie-notice"><p>{C} We use cookies and by reading on you accept all of them.</p></div>{NAV}<article><p>{A}</p><p>{B}</p></article>'), f"{A} {B}"),
    "advert between paragraphs": (page(f'<article><p>{A}</p><div class="ad"><p>{C}</p></div><p>{B}</p></article>'), f"{A} {B}"),
    "aside in the article": (page(f"<article><p>{A}</p><aside><p>{C}</p></aside><p>{B}</p></article>"), f"{A} {B}"),
    "form inside": (page(f"<article><p>{A}</p><form><label>Your mail</label><input><p>Stay informed</p></form><p>{B}</p></article>").replace("<form>", '<form class="newsletter-form">'), f"{A} {B}"),
    "form around the page": (page(f'<form id="main-form">{NAV}<div class="content"><h1>The river</h1><p>{A}</p><p>{B}</p></div></form>{FOOT}'), f"The river {A} {B}"),
    "no hints at all": (page(f'<div><a href="/">Home</a> <a href="/n">News</a></div><div><p>{A}</p><p>{B}</p><p>{C}</p></div><div><a href="/i">Imprint</a></div>'), f"{A} {B} {C}"),
    "list in the article": (page(f"<article><p>{A}</p><ul><li>one bridge</li><li>two mills and a weir</li></ul><p>{B}</p></article>"), f"{A} one bridge two mills and a weir {B}"),
    "related links": (page(f'<article><p>{A}</p><p>{B}</p></article><div class="related-posts"><h3>See also</h3><ul><li><a href="1">The lake</a></li><li><a href="2">The harbour</a></li></ul></div>'), f"{A} {B}"),
    "share and tags": (page(f'<article><p>{A}</p><p>{B}</p><div class="share-buttons"><a href="f">Facebook</a> <a href="t">Twitter</a></div></article>{FOOT}'), f"{A} {B}"),
    "scripts and styles": (page(f"<article><p>{A}</p><script>var x = '<p>no</p>';</script><style>p {{ color: red }}</style><p>{B}</p><noscript><p>Turn scripts on</p></noscript></article>"), f"{A} {B}"),
    "references and blanks": (page(f"<article><p>Fish &amp; chips&nbsp;at\n\n the&#32;harbour,&#x20;{A}</p></article>"), f"Fish & chips at the harbour, {A}"),
    "nothing closed": (f"<html><body><nav><a href=x>Home</a></nav><article><h1>The river<p>{A}<p>{B}", f"The river {A} {B}"),
    "hidden text": (page(f'<article><p>{A}</p><p style="display: none">{C}</p><p hidden>{C}</p><p>{B}</p></article>'), f"{A} {B}"),
    "article in a table": (page(f'<table><tr><td><a href="/">Home</a><td><p>{A}</p><p>{B}</p></table>'), f"{A} {B}"),
    "sidebar of articles": (page(f'<div class="sidebar"><article><p>{C}</p></article></div><article><p>{A}</p><p>{B}</p></article>'), f"{A} {B}"),
    "long comments before a short one": (page(f'{NAV}<article><h1>The river</h1><p>{A}</p><p>{B}</p></article><section class="comments"><p>{LONG}</p><p>Nice!</p><p>{LONG}</p></section>{FOOT}'), f"The river {A} {B}"),
    "long footer": (page(f"<article><p>{A}</p></article><footer><p>{LONG}</p><p>Imprint</p></footer>"), A),
    "long aside": (page(f"<article><p>{A}</p><aside><p>{LONG}</p></aside><p>{B}</p></article>"), f"{A} {B}"),
    "long cookie notice": (page(f'<div class="cookie-notice"><p>{LONG}</p></div><article><p>{A}</p></article>'), A),
    "labels of a form": (page(f"<article><p>{A}</p><form><label>Mail</label><input><button>Go</button></form><p>{B}</p></article>"), f"{A} {B}"),
    "call to sign up": (page(f'<article><p>{A}</p><div class="signup">Sign up for our daily letter now</div><p>{B}</p></article>'), f"{A} {B}"),
    "search box": (page(f'<article><div class="search"><label>Search this site</label><input></div><p>{A}</p><p>{B}</p></article>'), f"{A} {B}"),
    "title and last line": (page(f"<div><h1>The river of the north</h1><p>{A}</p><p>{B}</p><p>It ends here.</p></div>"), f"The river of the north {A} {B} It ends here."),
    "headings without an article": (page(f"<div>{NAV}<h1>Rivers</h1><p>{A}</p><h2>The bridge</h2><p>{C}</p><p>It ends here.</p></div>{FOOT}"), f"Rivers {A} The bridge {C} It ends here."),
    "article of the class notice": (page(f'{NAV}<article class="notice"><h1>The river</h1><p>{A}</p><p>So it is.</p></article>{FOOT}'), f"The river {A} So it is."),
    "page in a sidebar": (page(f'<div class="sidebar">{NAV}<h1>The river</h1><p>{A}</p><p>So it is.</p></div>'), f"The river {A} So it is."),
    "article in a sidebar": (page(f'<div class="sidebar">{NAV}<article><h1>The river</h1><p>{A}</p><p>So it is.</p></article></div>'), f"The river {A} So it is."),
    "only a notice": (page(f'<div class="cookie-notice"><p>{LONG}</p></div>'), ""),
    "names without meaning": (page(f'<article><h1>The river</h1><p>{A}</p><p>{B}</p></article><div class="zz-feedback"><p>{LONG}</p><p>{A}</p></div><div class="xq"><p>{C}</p></div>'), f"The river {A} {B}"),
    "no full stops": (page(f"<div><p>{A[:-1]}</p><p>{B[:-1]}</p></div>"), f"{A[:-1]} {B[:-1]}"),
    "header of the page": (page(f"<header><h1>River Times</h1><p>{C}</p></header><article><h1>The river</h1><p>{A}</p></article>"), f"The river {A}"),
    "form around an article": (page(f"<form action=x>{NAV}<article><h1>The river</h1><p>{A}</p></article></form>"), f"The river {A}"),
    "only a menu": (page(NAV + FOOT), ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    text, expected = PAGES[name]
    assert html_text.main_text(text) == expected


def test_nesting_costs_no_square():
    for inner in ("<div>", "<div><button>", "<p><li>", "<div class=x>"):
        began = time.perf_counter()
        html_text.main_text(inner * 40_000 + A + "</p></section></div>" * 40_000)
        assert time.perf_counter() - began < 5


def test_tree():
    """Every leaf has rows enough, and names alone keep nothing: a hint is one feature of twelve."""
    rows = html_text.labelled()

    def leaves(node, part):
        if not isinstance(node, tuple):
            return [len(part)]
        feature, cut, low, high = node
        return leaves(low, part[part[:, feature] <= cut]) + leaves(high, part[part[:, feature] > cut])

    sizes = leaves(html_text.tree(), rows)
    assert min(sizes) >= html_text.LEAST == 5 and sum(sizes) == len(rows) and len(html_text.FEATURES) == rows.shape[1] - 1
    assert sum(html_text.is_main(r[:-1]) == bool(r[-1]) for r in rows) > 0.95 * len(rows)
    hints = {r[6] for r in rows if r[-1]}, {r[6] for r in rows if not r[-1]}
    assert hints == ({1, 0, -1}, {1, 0, -1, -2})


def test_the_table():
    """Pages of the table, whose article is marked by its element: all its text, and none besides."""
    import html
    import re

    import duckdb

    for (text,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        inside = re.search("<article>(.*?)</article>", text, re.S)[1]
        assert html_text.main_text(text) == " ".join(html.unescape(re.sub("<[^>]*>", " ", inside)).split())
