"""Main text of HTML pages by tree scoring (operator 7).

A small forgiving reader turns the page into a tree (implied ends of p, li,
table cells and options; raw script and style contents; comments dropped).
Subtrees that are never part of an article are cut first: menus, headers,
footers, sidebars, notices, adverts, forms, reader comments, hidden parts, by
element, role, and the words of class and id.  A word that articles use too
("related", "form") counts only where the whole name is that of a box; the id
of a heading names its subject and does not count.  A form around more than
half of the page's runs of LONG characters is the page, no form to fill in, and
stays; so does a part of that size whose name has other words too
("hidden-figures"), unless they are of comments.  A header inside an article or
a main element is the article's and stays.

Each remaining block of text gives points for its length and commas, less its
share of link text, to its parent, half to the grandparent and less to higher
ancestors; a container's points are discounted by its link density.  The best
container is kept (or the article or main element around it), together with
siblings that score a fifth of it or are paragraphs, headings, sections or
articles of running text with few links; of a main element every article with
few links is kept.  Lists
and boxes made of links go outside of what is kept, and on a page of which no
part but the body stands out; a list of sources in an article stays.

The text is every kept block in page order: character references decoded,
runs of white space turned into one space, trimmed, empty blocks left out,
joined by two line feeds.  Nothing else is dropped or cut.

Defined results: null, empty and text-free pages give the empty text; markup
that never ends is read as far as it goes; a head without its end tag ends
before text or an element that cannot stand in it.  An end tag without its
start is passed over.  Equal pages give equal texts; other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tickwise.llm.common import appended, text_slices, with_columns

# HTML element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section
    summary table tbody td tfoot th thead tr ul caption hr""".split()
)
CUT = frozenset(
    """head nav header footer aside form script style noscript iframe template svg math canvas object embed button select
    textarea input dialog menu audio video map applet title search""".split()
)
CUT_ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
# Words in class or id that mark a part as no article text.
CUT_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side rail
    comment comments reply replies respond discussion disqus menu nav navbar navigation topnav breadcrumb breadcrumbs
    footer foot header masthead topbar notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe
    subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager
    search form alert copyright hidden skip trending teaser""".split()
)
#: words of CUT_WORDS that name subjects as well: they count only in names of nothing but CUT_WORDS and BOX_WORDS
WEAK_WORDS = frozenset("side rail related social form discussion share notice notices search alert foot trending comment reply".split())
BOX_WORDS = frozenset(
    """area articles bar block bottom box boxes button buttons col column container content entries group icons inner items left
    links list media module news outer pages panel posts right section site stories top topics wrap wrapper""".split()
)
#: words whose boxes go at any size
COMMENT_WORDS = frozenset("comment comments reply replies respond discussion disqus".split())
#: start tags that do not end an open head
HEAD_TAGS = frozenset("base basefont bgsound link meta title style script noscript template head".split())
KEEP_TAGS = frozenset("html body article main".split())
#: characters of a run of text that is no label
LONG = 25
#: characters outside links that make a sibling running text
RUNNING = 100
#: ancestors that a block gives points to
LEVELS = 8
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIBLINGS = HEADINGS | {"p", "blockquote", "pre"}
NOT_P, NOT_HEADING = BLOCK - {"p"}, BLOCK - HEADINGS
#: an element of the key ends open elements of the value, up to the nearest element of STOPS
IMPLIED = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "tbody": {"thead", "tbody", "tr", "td", "th", "p"}, "tfoot": {"thead", "tbody", "tr", "td", "th", "p"},
}
STOPS = {
    "li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"},
    "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"},
}
MARKUP = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
COMMAS = re.compile("[,،、，]")


class Tree:
    """Elements as parallel lists in page order; element 0 is the page."""

    def __init__(self) -> None:
        self.parent, self.tag, self.cut = [-1], [""], [0]
        #: (element, text, inside a link) in page order; text None marks the edge of a block
        self.parts: list[tuple[int, str | None, bool]] = []

    def add(self, parent: int, tag: str, cut: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.cut.append(cut)
        return len(self.tag) - 1


def unwanted(tag: str, raw: str, in_article: bool) -> int:
    """1 for no article text, 2 for none unless it is most of the page, else 0."""
    if tag in CUT and tag != "form" and not (tag == "header" and in_article):
        return 1
    named = 2 if tag == "form" else 0
    if not raw.strip(" \t\r\n\f/") or tag in ("html", "body"):
        return named
    for name, a, b, c in ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return 1
        if name == "role" and value.lower() in CUT_ROLES:
            return 1
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 1
        if name == "class" and tag not in KEEP_TAGS or name == "id" and tag not in KEEP_TAGS | HEADINGS:
            found = {names_box(n) for n in unescape(value).split()}
            if 1 in found:
                return 1
            named = 2 if 2 in found else named
    return named


def names_box(name: str) -> int:
    """1 for a class or id that marks a part as no article text, 2 for one with other words too, else 0."""
    words = {w.lower() for w in WORD.findall(name)}
    if not words & CUT_WORDS:
        return 0
    if words <= CUT_WORDS | BOX_WORDS:
        return 1
    return 0 if words & CUT_WORDS <= WEAK_WORDS else 1 if words & COMMENT_WORDS else 2


def read(page: str) -> Tree:
    tree = Tree()
    stack, links, at = [0], 0, 0  # links: how many open a elements
    opened: Counter[str] = Counter()  # open elements by name: an end tag that fits none is passed over at once

    def pop(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            e = stack.pop()
            opened[tree.tag[e]] -= 1
            if tree.tag[e] in BLOCK:
                tree.parts.append((e, None, False))
            links -= tree.tag[e] == "a"

    def close(tags, stops) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if tree.tag[stack[i]] in stops:
                return
            if tree.tag[stack[i]] in tags:
                pop(i)
                close(tags, stops)
                return

    while at < len(page):
        m = MARKUP.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            if tree.tag[stack[-1]] == "head" and not page[at:end].isspace():
                pop(len(stack) - 1)
            tree.parts.append((stack[-1], unescape(page[at:end]), links > 0))
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                tree.parts.append((stack[-1], m[0][9:].removesuffix("]]>"), links > 0))
            continue
        tag, ends, raw = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ends:
            if not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[i]] == tag:
                    pop(i)
                    break
            continue
        if tag in IMPLIED:
            close(IMPLIED[tag], STOPS[tag])
        elif tag in BLOCK:
            close({"p"}, NOT_P)
            if tag in HEADINGS:
                close(HEADINGS, NOT_HEADING)
        if tag in ("body", "html", "head") and opened[tag]:
            if tag == "body" and tree.tag[stack[-1]] == "head":
                pop(len(stack) - 1)
            continue
        if tree.tag[stack[-1]] == "head" and tag not in HEAD_TAGS:
            pop(len(stack) - 1)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in VOID:
            tree.parts.append((stack[-1], None if tag == "hr" else " " if tag == "br" else "", links > 0))
            continue
        if tag in BLOCK:
            tree.parts.append((stack[-1], None, False))
        e = tree.add(stack[-1], tag, unwanted(tag, raw, opened["article"] + opened["main"] > 0))
        if not (raw.rstrip().endswith("/") and tag not in BLOCK and tag != "a"):
            stack.append(e)
            opened[tag] += 1
            links += tag == "a"
    return tree


def small_boxes(tree: Tree) -> set[int]:
    """Elements marked 2 with at most half of the long runs of text outside those marked 1."""
    boxes = {e for e, cut in enumerate(tree.cut) if cut == 2}
    if not boxes:
        return boxes
    n = len(tree.tag)
    gone, held = [False] * n, [0] * n
    for e in range(1, n):
        gone[e] = gone[tree.parent[e]] or tree.cut[e] == 1
    for e, text, _ in tree.parts:
        if text and not gone[e] and len(text.strip()) >= LONG:
            held[e] += len(text.strip())
    for e in range(n - 1, 0, -1):
        held[tree.parent[e]] += held[e]
    return {e for e in boxes if 2 * held[e] <= held[0]}


def blocks_of(tree: Tree) -> list[tuple[int, str, int]]:
    """(innermost block element, text, characters in links) of every block of text outside cut subtrees."""
    n = len(tree.tag)
    gone, home, boxes = [False] * n, [0] * n, small_boxes(tree)
    for e in range(1, n):
        up = tree.parent[e]
        gone[e] = gone[up] or tree.cut[e] == 1 or e in boxes
        home[e] = e if tree.tag[e] in BLOCK else home[up]
    out: list[tuple[int, str, int]] = []
    parts: list[str] = []
    linked, owner = 0, 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((owner, text, min(linked, len(text))))
        parts, linked = [], 0

    for e, text, in_link in tree.parts:
        if text is None:
            flush()
        elif not gone[e]:
            if home[e] != owner:
                flush()
                owner = home[e]
            parts.append(text)
            if in_link:
                linked += len(" ".join(text.split()))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by two line feeds."""
    if not page:
        return ""
    tree = read(page)
    blocks = blocks_of(tree)
    n = len(tree.tag)
    size, linked, points, count = [0] * n, [0] * n, [0.0] * n, [0] * n
    for e, text, k in blocks:
        size[e] += len(text)
        linked[e] += k
        count[e] += k > 0
        worth = (1 + len(COMMAS.findall(text)) + min(len(text) / 100, 30)) * (1 - k / len(text)) if len(text) >= LONG or tree.tag[e] == "p" else 0.0
        up, level = (tree.parent[e] if tree.tag[e] not in ("article", "main", "div", "section", "body", "td") else e), 1
        while up >= 0 and level <= LEVELS:
            points[up] += worth / (1 if level == 1 else 2 if level == 2 else 3 * level)
            up, level = tree.parent[up], level + 1
    for e in range(n - 1, 0, -1):
        up = tree.parent[e]
        size[up] += size[e]
        linked[up] += linked[e]
        count[up] += count[e]
    # lists and boxes made of links are menus even where nothing names them so
    menu = [False] * n
    for e in range(1, n):
        own = tree.tag[e] in ("ul", "ol", "div", "section", "table", "dl") and count[e] >= 3 and linked[e] >= 0.8 * size[e]
        menu[e] = menu[tree.parent[e]] or own
    scored = [(p * (1 - linked[e] / size[e]) if size[e] else 0.0) for e, p in enumerate(points)]
    best = max(range(n), key=lambda e: (scored[e] * (1.25 if tree.tag[e] in ("article", "main") else 1.0), -e))
    if scored[best] <= 0:
        named = [e for e in range(n) if tree.tag[e] in ("article", "main") and size[e]]
        best = named[0] if named else 0
    around, e = -1, best
    while e > 0:
        if tree.tag[e] == "article" or (tree.tag[e] == "main" and around < 0):
            around = e
        e = tree.parent[e]
    top = around if around >= 0 else best
    kept = {top}
    if top > 0:
        main, e = -1, tree.parent[top]
        while e > 0:
            main = e if tree.tag[e] == "main" else main
            e = tree.parent[e]
        within = [False] * n
        for e in range(1, n):
            within[e] = e == main or within[tree.parent[e]]
            if not size[e] or e == top:
                continue
            few = linked[e] < 0.25 * size[e]
            running = few and size[e] - linked[e] >= RUNNING
            if tree.tag[e] == "article" and within[e] and few:
                kept.add(e)
            elif tree.parent[e] == tree.parent[top]:
                if tree.tag[e] in SIBLINGS and few or tree.tag[e] in ("section", "article") and running:
                    kept.add(e)
                elif around < 0 and scored[e] >= max(3.0, 0.2 * scored[best]):
                    kept.add(e)
    inside = [False] * n
    for e in range(n):
        inside[e] = e in kept or (e > 0 and inside[tree.parent[e]])
    chosen = not kept & {e for e in range(n) if tree.tag[e] in ("", "html", "body")}
    return "\n\n".join(text for e, text, _ in blocks if inside[e] and (chosen or not menu[e]))


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All columns of ``df`` and the main text as ``out``."""
    kept, schema = appended(df, [(out, pa.string(), "string")])

    def run(batches):
        for batch in text_slices(batches, html):
            texts = [main_text(p) for p in batch.column(html).to_pylist()]
            yield with_columns(batch, kept, [(out, pa.array(texts, pa.string()))])

    return df.mapInArrow(run, schema)
