"""A tolerant HTML reader: text to a flat list of nodes, and kept nodes to blocks of text.

Nodes are the elements that are no inline markup, in page order, each with the index of its parent (always smaller).
The reader is one pass of a scanner without recursion or backtracking, linear in the page: a tag ends at the first ``>``
outside the quoted values that follow a ``=``. Once such a tag runs to the end of the page, quotes are no longer
believed and every later tag ends at its first ``>``; a tag without any is dropped with the rest, as browsers do.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content is skipped unread up to the end tag.
RAW = frozenset("script style noscript template title textarea iframe noembed noframes xmp".split())
SKIPPED = frozenset("head svg math canvas audio video object applet map datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Start tags that end an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: Elements that a start tag ends where they are open, and those that shield them.
ENDS = {
    "p": (("p",), ("button", "table", "td", "th", "caption", "object")), "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}
#: The row of ``ENDS`` for each start tag, and the rows in which an element ends or shields.
ROW = dict.fromkeys(CLOSES_P, "p") | {"li": "li", "dt": "dt", "dd": "dt", "option": "option", "tr": "tr", "td": "td", "th": "td", "tbody": "tbody", "thead": "tbody", "tfoot": "tbody"}
ROWS_OF: dict[str, tuple[str, ...]] = {}
for _row, _both in ENDS.items():
    for _name in (*_both[0], *_both[1]):
        ROWS_OF[_name] = (*ROWS_OF.get(_name, ()), _row)

#: Up to the ``>`` of a tag, quoted values passed over; nothing is tried twice.
TAG_END = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+>""")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WHITE = re.compile(r"\s+")
#: Zeros before a decimal character reference, and references beyond all characters.
ZEROS, TOO_LARGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")

#: Groups of attribute words, one bit each.
GROUPS = {
    "menu": "nav navbar navigation menu menubar topnav topbar subnav breadcrumb breadcrumbs crumbs pagination pager toc tabs skip",
    "header": "header masthead head top branding logo site-title hero",
    "footer": "footer foot bottom colophon copyright legal imprint",
    "side": "sidebar side aside rail widget widgets complementary related recommended recommendations popular trending more similar teaser teasers",
    "advert": "ad ads advert adverts advertisement advertising adsense adsbygoogle adslot adbox sponsor sponsored sponsors promo promotion promoted banner taboola outbrain affiliate dfp",
    "notice": "cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog toast banner warning disclaimer paywall message",
    "form": "form search searchbox newsletter subscribe subscription signup signin login register contact poll survey feedback",
    "comment": "comment comments commentlist discussion disqus reply replies respond reviews guestbook responses",
    "share": "share sharing social socials follow twitter facebook tags meta byline author bio print tools toolbar actions",
    "content": "article content post entry body story main text maincontent page hentry blog single prose markdown readable",
}
GROUP_NAMES = tuple(GROUPS)
_BITS: dict[str, int] = {}
for _k, _names in enumerate(GROUPS.values()):
    for _name in _names.split():
        _BITS[_name] = _BITS.get(_name, 0) | 1 << _k
HIDDEN_BIT = 1 << len(GROUPS)
_masks: dict[str, int] = {}


def attribute_mask(attributes: str) -> int:
    """Groups of the words in class, id and role; a bit more for elements that are not shown."""
    if not attributes or attributes.isspace():
        return 0
    mask = _masks.get(attributes)
    if mask is None:
        mask = 0
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "style" and NOT_SHOWN.search(value):
                mask |= HIDDEN_BIT
            if name not in ("class", "id", "role"):
                continue
            for w in PART.findall(value):
                mask |= _BITS.get(w.lower(), 0)
            for w in value.lower().split():
                mask |= _BITS.get(w, 0)
        if len(_masks) > 20_000:
            _masks.clear()
        if len(attributes) < 500:
            _masks[attributes] = mask
    return mask


@dataclass
class Page:
    """Nodes of one page and its text runs."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    masks: list[int] = field(default_factory=list)
    #: (node, block number, text, inside a link)
    runs: list[tuple[int, int, str, bool]] = field(default_factory=list)


def read(source: str | None) -> Page:
    """Parse a whole page."""
    page = Page(["html"], [-1], [0], [0])
    if not source:
        return page
    open_names, open_nodes = ["html"], [0]
    counts: dict[str, int] = {}
    #: For each row of ``ENDS`` the places of the open elements that end or shield in it.
    marks: dict[str, list[int]] = {row: [] for row in ENDS}
    links = block = 0
    at, n, skip, quotes = 0, len(source), "", True
    tags, parents, depths, masks, runs = page.tags, page.parents, page.depths, page.masks, page.runs

    def pop_to(k: int) -> None:
        nonlocal links
        for name in open_names[k:]:
            counts[name] -= 1
            links -= name == "a"
            for row in ROWS_OF.get(name, ()):
                marks[row].pop()
        del open_names[k:], open_nodes[k:]

    def ended(row: str) -> int:
        """The place of the outermost open element that a start tag of the row ends; 0 if none."""
        found, ends = 0, ENDS[row][0]
        for k in reversed(marks[row]):
            if open_names[k] not in ends:
                break
            found = k
        return found

    def text(start: int, stop: int) -> None:
        if stop > start and not skip:
            runs.append((open_nodes[-1], block, source[start:stop], links > 0))

    start = 0
    while True:
        i = source.find("<", at)
        if i < 0:
            text(start, n)
            break
        after = source[i + 1 : i + 2]
        if after in ("!", "?"):
            text(start, i)
            stop = source.find("-->", i + 4) if source.startswith("<!--", i) else source.find(">", i)
            if stop < 0:
                break
            start = at = stop + (3 if source.startswith("<!--", i) else 1)
            continue
        closing = after == "/"
        m = TAG_NAME.match(source, i + 1 + closing)
        if m is None:  # a sign in the text
            at = i + 1
            continue
        text(start, i)
        name = m[0].lower()
        end = TAG_END.match(source, m.end()) if quotes else None
        stop = end.end() if end else source.find(">", m.end()) + 1
        if end is None:
            quotes = False
            if not stop:
                break
        attributes = source[m.end() : stop - 1]
        start = at = stop
        if skip:
            if closing and name == skip:
                skip = ""
            elif skip == "head" and not closing and (name == "body" or name in CLOSES_P):
                skip = ""
            if skip or closing:
                if not closing and name in RAW:
                    start = at = _raw_end(source, at, name)
                continue
        if closing:
            if counts.get(name):
                k = len(open_names) - 1
                while open_names[k] != name:
                    k -= 1
                if name not in INLINE:
                    block += 1
                pop_to(k)
            elif name == "p":
                block += 1
            continue
        if name in RAW:
            start = at = _raw_end(source, at, name)
            continue
        if name in SKIPPED:
            if not attributes.endswith("/"):
                skip = name
            continue
        if name in ("html", "body"):
            masks[0] |= attribute_mask(attributes) & ~HIDDEN_BIT
            continue
        if name in VOID:
            if name == "br":
                runs.append((open_nodes[-1], block, " ", links > 0))
            elif name == "hr":
                block += 1
            continue
        if name in ROW and (found := ended(ROW[name])):
            pop_to(found)
        mask = attribute_mask(attributes)
        counts[name] = counts.get(name, 0) + 1
        for row in ROWS_OF.get(name, ()):
            marks[row].append(len(open_names))
        open_names.append(name)
        if name in INLINE:
            links += name == "a"
            if not mask & HIDDEN_BIT:
                open_nodes.append(open_nodes[-1])
                continue
        else:
            block += 1
        parent = open_nodes[-1]
        tags.append(name)
        parents.append(parent)
        depths.append(depths[parent] + 1)
        masks.append(mask)
        open_nodes.append(len(tags) - 1)
    return page


def _raw_end(source: str, at: int, name: str) -> int:
    m = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(source, at)
    stop = source.find(">", m.end()) if m else -1
    return stop + 1 or len(source)


def decoded(text: str) -> str:
    """Character references as their characters; numbers of any length are read."""
    if "&#" in text:
        text = TOO_LARGE.sub("\ufffd", ZEROS.sub("&#", text))
    return html.unescape(text)


def blocks(page: Page, kept: list[bool]) -> str:
    """The text of the kept nodes: one line per block, white space collapsed, references decoded."""
    out: list[str] = []
    own: list[str] = []
    last = None
    for node, block, text, _ in page.runs:
        if not kept[node]:
            continue
        if block != last:
            if own:
                out.append("".join(own))
            own, last = [], block
        own.append(text)
    if own:
        out.append("".join(own))
    lines = (WHITE.sub(" ", decoded(x)).strip() for x in out)
    return "\n".join(x for x in lines if x)
