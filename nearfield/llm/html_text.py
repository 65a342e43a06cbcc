"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a row of text blocks. Menus, footers, asides, dialogs, forms and the page's own header are left out by
what their elements mean; their blocks still count as neighbours. A block knows its number of words, its
link density (words inside links / words), both of them for the blocks before
and behind it, whether it is a heading, an item of a list or table or a paragraph, whether it ends like a sentence, whether it stands
outside the articles of a page that has some, and a hint of the names around it: 1 inside an article, -1 inside what may
hold an article or not (widgets, tags, ...), -2 inside an advert, sidebar, notice or comment, 0 elsewhere. Hints come from
whole names of classes, ids and roles; parts of names give none, and an article is one whatever its class. The tree is grown from PAGES, short
notes of pages that a person labelled.

A page of which nothing would be left is looked at again: without names where an article or a first heading stands inside an
away-name (a layout that calls its whole page so), and then with forms as if they were not there (a form around the page).

The content of scripts, styles, buttons, drawings, frames and the like (and what stands in for them where they are not
shown) is no text of the article; one that is not closed hides nothing, unless HTML itself reads it to the end of the page.

Edge cases: null and empty pages have an empty text; unclosed, nested wrongly or
broken tags never fail; pages of any length are read whole, in time proportional to it; repeated rows give
equal results; an empty table gives no rows; extra columns are carried along, but for those with the names of the two new
ones, which are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearfield.runtime import prepare

# Elements that end a text block.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Elements whose content is no markup and goes on to the end of the page where they are not closed, other
# elements whose content is no text of the page, and elements that are never closed.
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
HIDDEN_TAGS = frozenset("template svg select button object canvas audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ITEM_TAGS = frozenset("li dt dd td th".split())
# Elements that hint at what they hold.
AWAY_TAGS = frozenset("nav aside footer menu dialog search".split())
MAIN_TAGS = frozenset("article main".split())
# Names of classes, ids and roles that hint at it: alone, with a word for a place before, or with a word for a holder behind.
AWAY_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr notice newsletter subscribe subscription comment comments disqus replies share sharing social related recommended recommendations trending pagination pager toolbar contentinfo complementary".split())
HEADER_NAMES = frozenset("banner header masthead topbar".split())
WEAK_NAMES = frozenset("aside bottom widget widgets notices alert notification popup modal overlay signup login search form more tags discussion reviews response responses skip".split())
MAIN_NAMES = frozenset("article content post entry story main maincontent articlebody main-content page-content article-body article-content post-body post-content entry-content story-body".split())
PLACES = tuple("site page main left right top bottom post entry article global primary secondary user reader".split())
HOLDERS = tuple("area bar block box buttons container content form holder inner items left links list menu module notice nav panel posts right section stories widget wrap wrapper unit banner slot footer header".split())
AWAY = AWAY_NAMES | {f"{p}{d}{n}" for n in AWAY_NAMES for p in PLACES for d in "-_"} | {f"{n}{d}{h}" for n in AWAY_NAMES for h in HOLDERS for d in "-_"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
HIDDEN_OPEN = re.compile(rf"<(?:{'|'.join(sorted(HIDDEN_TAGS))})\b", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    hint: int  # GONE where an element leaves it out
    heading: bool
    item: bool
    paragraph: bool

    @property
    def density(self) -> float:
        return self.link_words / self.words if self.words else 0.0

    @property
    def stop(self) -> bool:
        return self.text.rstrip("\"'\u201d\u2019\u00bb)]")[-1:] in (".", "!", "?", "\u2026", ":", "\u3002")


GONE = -3


@dataclass
class Reading:
    """How a page is read, and what was seen: names and forms count or not."""

    names: bool = True
    forms: bool = True
    articles: int = 0
    held: bool = False  # an article or a first heading inside an away-name


def _hint(tag: str, attrs: str, inside: int, how: Reading) -> int:
    """The hint inside an element; inside: that around it."""
    if tag in MAIN_TAGS and inside > -2:
        how.articles += 1
    if inside == -2 and tag in (*MAIN_TAGS, "h1"):
        how.held = True
    if inside <= -2 and not (inside == -2 and (tag in AWAY_TAGS or tag == "form" and how.forms)):
        return inside
    found = 1 if tag in MAIN_TAGS else GONE if tag in AWAY_TAGS or tag == "form" and how.forms or tag == "header" and inside < 1 else inside
    if attrs and tag not in ("html", "body"):
        for name, *values in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDING.search(value):
                return GONE
            if name in ("class", "id", "role") and how.names and tag not in MAIN_TAGS and found > GONE:
                words = set(value.split())
                if words & AWAY:
                    found = -2
                elif words & MAIN_NAMES:
                    found = 1 if found > -2 else found
                elif words & WEAK_NAMES or words & HEADER_NAMES and inside < 1:
                    found = min(found, -1)
    return found


def _raw_end(page: str, tag: str, at: int) -> int:
    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
    return end.end() if end else len(page)


def hidden_ends(page: str) -> dict[int, int]:
    """Where the content of each hidden element starts -> where its own closing tag ends. An element
    that is not closed before the one around it is closed is not there, so it hides nothing."""
    out: dict[int, int] = {}
    if not HIDDEN_OPEN.search(page):
        return out
    stack: list[tuple[str, int]] = []
    inside: dict[str, int] = {}  # how often a tag is on the stack
    at = 0
    while found := TOKEN.search(page, at):
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        attrs = found["attrs"] or found["attrs2"] or ""
        if found["close"] or found["close2"]:
            if inside.get(tag):
                while True:
                    name, start = stack.pop()
                    inside[name] -= 1
                    if name == tag:
                        break
                if tag in HIDDEN_TAGS:
                    out[start] = at
        elif tag in RAW_TAGS:
            at = at if attrs.rstrip().endswith("/") else _raw_end(page, tag, at)
        elif tag in HIDDEN_TAGS and not attrs.rstrip().endswith("/") or tag in BLOCK_TAGS and tag not in VOID_TAGS:
            stack.append((tag, at))
            inside[tag] = inside.get(tag, 0) + 1
    return out


def blocks(page: str, how: Reading) -> list[Block]:
    hidden = hidden_ends(page)
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # open elements, and the hint inside each
    inside: dict[str, int] = {}  # how often a tag is on the stack
    parts: list[str] = []
    linked: list[str] = []
    links, heading, item, paragraph = 0, False, False, False

    def close(tag: str) -> None:
        while inside.get(tag):
            name, _ = stack.pop()
            inside[name] -= 1
            if name == tag:
                return

    def flush() -> None:
        nonlocal parts, linked
        words = html.unescape("".join(parts)).split()
        if words:
            hint = stack[-1][1] if stack else 0
            out.append(Block(" ".join(words), len(words), min(len(words), len(html.unescape("".join(linked)).split())), hint, heading, item, paragraph))
        parts, linked = [], []

    def add(text: str) -> None:
        parts.append(text)
        linked.append(text if links else " ")

    at = 0
    while found := TOKEN.search(page, at):
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        if found["cdata"] is not None:
            add(html.escape(found["cdata"]))
            continue
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        attrs = found["attrs"] or found["attrs2"] or ""
        if found["close"] or found["close2"]:
            if tag in BLOCK_TAGS:
                flush()
                close(tag)
                links = 0 if tag != "li" else links
                heading = item = paragraph = False
            elif tag == "a":
                links = max(0, links - 1)
            elif tag == "head":
                flush()
            continue
        if tag in RAW_TAGS or tag in HIDDEN_TAGS:
            if tag in HIDDEN_TAGS:
                at = hidden.get(at, at)
            elif not attrs.rstrip().endswith("/"):
                at = _raw_end(page, tag, at)
            parts.append(" ")
            linked.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if stack and stack[-1][0] == tag and tag in ("p", "li", "dt", "dd", "td", "th", "tr"):
                close(tag)  # it ends where the next one starts
            around = stack[-1][1] if stack else 0
            heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            item, paragraph = tag in ITEM_TAGS, tag in ("p", "pre", "blockquote")
            if tag not in VOID_TAGS:
                stack.append((tag, _hint(tag, attrs, around, how)))
                inside[tag] = inside.get(tag, 0) + 1
        elif tag == "a":
            links += 1
        elif tag in VOID_TAGS:
            parts.append(" ")
            linked.append(" ")
    add(page[at:])
    flush()
    return out


# Notes of pages, labelled by hand. A note is a row of blocks: kind (h heading, p paragraph, i item, d other), words, l and the
# percent of them inside links, `.` where it ends like a sentence, a letter for where it stands (a article, o outside the page's
# articles, w weak name, x away-name, g left out by its element, none elsewhere), and + for main text or - for none.
PAGES = """
i1l100g- i1l100g- i1l100g- h6a+ p40.a+ p35.a+ p60.a+ d9g-
i1l100g- i2l100g- d8.x- h9a+ p55.a+ p3.a+ p80.a+ p20.a+ d7g-
i1l100g- i1l100g- d14.x- h7a+ p30.a+ p25.a+ d9.g-
d6x- h4a+ p90.a+ p2.a+ p70.a+ h3a+ p45.a+ i4a+ i6a+ i9.a+ p30.a+ d8l20g-
h8a+ p12.a+ d6w- p40.a+ p5a+ p50.a+ p8.a+
h5a+ p120.a+ h2a+ p60.a+ p1.a+ p30.a+ h3x- p25.x- p60.x- p90.x- p8.x-
h7a+ p200.a+ p150.a+ p4.a+ p50.x- p45.x- p70.x- d3l100g-
h6a+ p80.a+ p60.x- p6.a+ p90.a+ p65.x-
h6a+ p35.a+ p4l100a+ p50.a+ p6l100a+ p5l100a+ h2o- i5l100o- i6l100o- i4l100o-
h10a+ d12a+ p45.a+ p25l10.a+ d2l100w- d1l100w- d2l100w- p40.a+
i4l100a- i6l100a- i5l100a- h8a+ p60.a+ p45.a+ i7l100a- i8l100a- i6l100a- i5l100a-
h7a+ p75.a+ i3l100a- i4l100a- i3l100a- i5l100a- p66.a+ i2l100a- i3l100a- i2l100a-
i5a+ i7.a+ i4a+ p20.a+ i12.a+ i3a+ i8.a+ p3.a+ d5a+ d6a+ d20.a+ d4a+
h6o- p45.o- p30.o- h7a+ p50.a+ p70.a+ h3o- p60.o- p20.o- p12.o- d9o-
p25.o- d3o- d4l50o- h9a+ p33.a+ p8.a+ p60.o- p48.o- p5.o- p90.o-
d2o- d5l100o- p55.o- p70.o- h5a+ p44.a+ p5.a+ d30.o- d8o- d7.o- p11.o-
p60.o- h8a+ p90.a+ p100.a+ p80.o- h2o- p40.o- p35.o- p3.o- p100.o-
d3w- d7w- d8w- d2w- p45.w+ p60.w+ d5w- d4w- p30.w+ d6w- h4w- d9w-
h6w+ p50.w+ p80.w+ p3.w+ d4l100w- d3l100w- d7w- d6w- d1w- p35.w+ d2w-
h3w- d4w- d5w- d8w- d3l100w- i2l100w- i3l100w- i2l100w- i1l100w-
h3x- d20x- p30.x- p45.x- p60.x- p100.x- p200.x- p8.x- p3.x- d5x- i40.x- i60.x- i25.x- h5x-
d12.x- d18.x- d25.x- d40.x- p70.x- h4x- i6l100x- i5l100x- i7l100x- i30.x- p55.x- p90.x- p12.x-
d1l100- d2l100- h6+ p40.+ p60.+ p3.+ d2l100- d1l100-
d2l100- d1l100- h9+ p30.+ p25.+ p80.+ p4.+
i1l100- i1l100- i2l100- i1l100- p90.+ p60.+ p70.+ d5-
i2l100- i1l100- i1l100- h5+ p50.+ p45.+ p2.+ d6l20-
d3l100- d2- h7+ d60.+ d80.+ d45.+ d4l50- d3l100- d5-
d4- h6+ p120.+ p9.+ p60.+ h2+ p70.+ p3.+
h8+ p100.+ h3+ p80.+ i5+ i7.+ i4+ p60.+ p6.+ d5- d3l100-
h4+ p35.+ p12.+ p40l10.+ p5.+ p50.+
p200.+ p6.+ d4- d2l100-
p16.+
d300.+
d500.+ d3l100- d2l100-
p14.+ p20.+ p9.+
h6+ p20.+ p15.+ p4.+ d7-
d3- d4- i2l100- i3l100- i2l100- i4l100- d30l80- d25l90- d12l50- d9l40-
h2- i4l100- i5l100- i3l100- h3- i5l100- i6l100- i4l100- d6- d4l50-
d2l100- d1l100- d5- h7+ d70.+ d55.+ i8.+ i6+ i9.+ d40.+ d6l30- d4-
d3- d2l100- h5+ p60.+ p5l100+ p40.+ p3.+ d4- d1l100- d2l100-
h9+ p25.+ d5l80- d6l90- p50.+ p30.+ i3l100- i2l100- i4l100- d5-
d6- d5- d4- d8- d3- h6+ p45.+ p70.+ d7- d6- d3-
h6a+ p40.a+ p5l100a+ p50.a+ p4l100a+ p60.a+ p5l100a+ d9g-
p30.a+ p6l100a+ p45.a+ p3l100a+ p25.a+ p35.a+ p7l100a+
h6+ p80+ p100.+ p60+ d200+ p45+ p3.+ d120+ d5-
d3l100- d90+ d150+ p70+ p40+ d4- d2l100-
h4+ d60+ d110.+ d80+ d300+ i60+ i45+ d6-
p90w+ d120w+ p60w+ d8.w- d6.w- d7.w- p70w+ d5.w- h3w- d9.w-
d6.- h7+ p50.+ p40.+ p3.+ d6.- d4.-
d5.- d3l100- p60.+ p35.+ d7.- d4l50-
d8.- d4- h5+ p45.+ p90.+ p8.+ d5.- d9.- d3-
d60.+ d7.+ d45.+ d5.+ d80.+ d9.+ d30.+ d12.+
d50o- p70o- d100o- p60o- h8a+ p60a+ p80a+ d9a+ p7a+ p40o- d90o-
"""

NOTE = re.compile(r"([hpid])(\d+)(?:l(\d+))?(\.?)([aowxg]?)([+-])")


def noted(line: str) -> list[tuple[Block, bool, bool]]:
    """(block, whether it stands outside the page's articles, whether it is main text) of one note."""
    out = []
    for kind, words, link, stop, where, label in NOTE.findall(line):
        hint = {"a": 1, "w": -1, "x": -2, "g": GONE}.get(where, 0)
        block = Block("." if stop else "x", int(words), int(words) * int(link or 0) // 100, hint, kind == "h", kind == "i", kind == "p")
        out.append((block, where == "o", label == "+"))
    return out


def labelled() -> np.ndarray:
    """A row for each noted block that no element leaves out: its features, and 1 for main text."""
    rows = []
    for line in PAGES.split("\n"):
        page = noted(line)
        found = [b for b, _, _ in page]
        rows += [(*features(found, i, outside), main) for i, (b, outside, main) in enumerate(page) if b.hint > GONE]
    return np.array(rows, float)


LEAST, DEPTH = 5, 8  # rows at a leaf, splits above it


def grow(rows: np.ndarray, depth: int = DEPTH) -> tuple | float:
    """A decision tree by Gini impurity: (feature, threshold, low, high), or the share of main text at a leaf.
    Of equal splits the first feature's wins."""
    labels = rows[:, -1]
    share = labels.mean()
    best = None
    for feature in range(rows.shape[1] - 1) if depth and 0 < share < 1 else ():
        values = np.unique(rows[:, feature])
        for cut in (values[:-1] + values[1:]) / 2:
            low = rows[:, feature] <= cut
            a, b = labels[low], labels[~low]
            if min(len(a), len(b)) < LEAST:
                continue
            gini = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or gini < best[0] - 1e-12:
                best = (gini, feature, float(cut))
    if best is None:
        return float(share)
    _, feature, cut = best
    low = rows[:, feature] <= cut
    return feature, cut, grow(rows[low], depth - 1), grow(rows[~low], depth - 1)


_tree: tuple | float | None = None


def tree() -> tuple | float:
    global _tree
    if _tree is None:
        _tree = grow(labelled())
    return _tree


FEATURES = ("words", "density", "words before", "density before", "words behind", "density behind", "hint", "outside", "heading", "item", "paragraph", "stop")


def features(found: list[Block], i: int, outside: bool) -> tuple:
    own = found[i]
    before = found[i - 1] if i else None
    behind = found[i + 1] if i + 1 < len(found) else None
    near = [x for b in (before, behind) for x in ((b.words, b.density) if b else (0, 0.0))]
    return own.words, own.density, *near, own.hint, outside, own.heading, own.item, own.paragraph, own.stop


def is_main(values: tuple) -> bool:
    node = tree()
    while isinstance(node, tuple):
        feature, cut, low, high = node
        node = low if values[feature] <= cut else high
    return node > 0.5


def _read(page: str, how: Reading) -> str:
    found = blocks(page, how)
    return " ".join(b.text for i, b in enumerate(found) if b.hint > GONE and is_main(features(found, i, how.articles > 0 and b.hint < 1)))


def main_text(page: str | None) -> str:
    how = Reading()
    text = _read(page or "", how)
    if not text and how.held:
        text = _read(page, Reading(names=False))
    if not text and page:
        text = _read(page, Reading(names=not how.held, forms=False))
    return text


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of every page, and n_chars, its code points."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(page))
            for i in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(i, 256)
                texts = [main_text(p.as_py()) for p in column.slice(i, 256)]
                keep = [(n, c) for n, c in zip(part.schema.names, part.columns) if n not in (out, "n_chars")]
                yield pa.RecordBatch.from_arrays([c for _, c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [n for n, _ in keep] + [out, "n_chars"])

    fields = [f for f in df.schema.fields if f.name not in (out, "n_chars")]
    return df.mapInArrow(run, T.StructType(fields + [T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())]))
