"""Leaf blocks of an HTML page, with what a sequence model wants to know of each."""

from __future__ import annotations

import html
import re

# One alternative for each kind of markup; none can fail after it has begun, so a scan is linear. An unclosed tag ends with the page.
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>])*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_LETTERS = re.compile(r"[a-zA-Z]+")
_DECIMAL = re.compile(r"&#0*+([0-9]*+)(?<=[0-9]);?")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page: it is left out, to the end of the page where one isn't closed.
RAW = frozenset("script style noscript template textarea iframe title".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: What words of class, id and role say of an element.
HINTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc",
    "head": "header masthead topbar banner logo branding",
    "foot": "footer bottom copyright legal contentinfo",
    "side": "sidebar aside widget related recommended trending complementary rail",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall",
    "comment": "comment comments reply replies respond disqus discussion reviews",
    "form": "form login search searchbox signin register",
    "share": "share sharing social tags follow",
    "main": "article content main post entry story body text prose",
}
_HINT_OF = {word: hint for hint, words in HINTS.items() for word in words.split()}
_TAGS = ("nav", "header", "footer", "aside", "form", "main", "article", "section", "figure", "table", "li", "a", "button", "select", "h", "p", "blockquote", "pre", "head", "label", "dialog", "details")
FEATURES = (
    ["any", "hidden"] + [f"in {t}" for t in _TAGS] + [f"hint {h}" for h in HINTS] + [f"leaf {t}" for t in ("p", "h", "li", "cell", "pre", "other")]
    + [f"words {k}" for k in range(5)] + ["some links", "mostly links", "ends a sentence", "rights", "no letters", "outside article", "no article", "first", "last"]
)
_NUMBER = {name: k for k, name in enumerate(FEATURES)}
_LEAF = {"p": "p", "h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "li": "li", "td": "cell", "th": "cell", "dd": "li", "dt": "li", "pre": "pre"}
_RIGHTS = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)


def _decoded(text: str) -> str:
    """Character references decoded, however many digits they have; one beyond the last code point is U+FFFD."""
    if "&#" in text:
        text = _DECIMAL.sub(lambda m: f"&#{m[1] or 0};" if len(m[1]) < 8 else "\ufffd", text)
    return html.unescape(text)


def _element(tag: str, attributes: str) -> tuple[int, ...]:
    """Features that an element gives to all below it."""
    name = "h" if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else tag
    found = {_NUMBER[f"in {name}"]} if name in _TAGS else set()
    if attributes and not attributes.isspace():
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key in ("class", "id", "role", "aria-label"):
                found |= {_NUMBER[f"hint {_HINT_OF[w]}"] for w in _LETTERS.findall(value) if w in _HINT_OF}
            if key == "style" and "display:none" in value.replace(" ", "") or key == "aria-hidden" and value == "true":
                found.add(_NUMBER["hidden"])
        if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
            found.add(_NUMBER["hidden"])
    return tuple(found)


class _Open:
    """The open elements, with what a block asks of them at hand: nothing here looks through the whole stack."""

    def __init__(self) -> None:
        self.elements: list[tuple[str, tuple[int, ...]]] = []
        self.places: dict[str, list[int]] = {}  # of each tag, ascending
        self.blocks: list[str] = []
        self.leaves: list[str] = []
        self.counts = [0] * len(FEATURES)
        self.given: set[int] = set()

    def push(self, tag: str, given: tuple[int, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.elements))
        self.elements.append((tag, given))
        if tag in BLOCKS:
            self.blocks.append(tag)
        if tag in _LEAF:
            self.leaves.append(_LEAF[tag])
        for f in given:
            self.counts[f] += 1
            if self.counts[f] == 1:
                self.given.add(f)

    def last(self, tags: set[str] | tuple[str, ...]) -> int:
        """Place of the innermost element of these tags; -1: none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def cut(self, place: int) -> None:
        """Closes the element at this place and all within it."""
        while len(self.elements) > place:
            tag, given = self.elements.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            if tag in _LEAF:
                self.leaves.pop()
            for f in given:
                self.counts[f] -= 1
                if not self.counts[f]:
                    self.given.discard(f)


def blocks(page: str) -> tuple[list[str], list[list[int]]]:
    """Texts of the leaf blocks in page order (character references decoded, white space as one space, trimmed, never
    empty) and the features of each. The content of script, style, template, textarea, title, iframe and noscript is left
    out; math, svg, object and canvas are inline elements like any other. Time is linear in the page, however deep it is."""
    texts: list[str] = []
    features: list[list[int]] = []
    opened = _Open()
    parts: list[str] = []
    linked = 0
    known: dict[tuple[str, str], tuple[int, ...]] = {}
    in_article = _NUMBER["in article"]

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_decoded("".join(parts)).split())
            if text:
                own = {0} | opened.given
                own.add(_NUMBER["leaf " + (opened.leaves[-1] if opened.leaves else "other")])
                n = text.count(" ") + 1
                own.add(_NUMBER[f"words {(n > 2) + (n > 6) + (n > 15) + (n > 40)}"])
                if linked:
                    own.add(_NUMBER["mostly links" if 2 * linked >= len(text) else "some links"])
                if text[-1] in ".!?…\"”»:":
                    own.add(_NUMBER["ends a sentence"])
                if _RIGHTS.search(text):
                    own.add(_NUMBER["rights"])
                if not any(c.isalpha() for c in text):
                    own.add(_NUMBER["no letters"])
                texts.append(text)
                features.append(list(own))
            parts.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece:
            parts.append(piece)
            if opened.places.get("a"):
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                close()
            if opened.places.get(tag):
                opened.cut(opened.places[tag][-1])
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                stop = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                at = stop.start() if stop else end
            continue
        if tag in BLOCKS:
            close()
            if opened.blocks and opened.blocks[-1] == "p":
                opened.cut(opened.places["p"][-1])
            if tag in _ENDS:
                ended = opened.last(_ENDS[tag])
                if ended > opened.last(_HOLDS[tag]):
                    opened.cut(ended)
        elif tag == "br":
            parts.append(" ")
        if tag not in VOID and not m[3].endswith("/"):
            key = (tag, m[3])
            if key not in known:
                known[key] = _element(tag, m[3])
            opened.push(tag, known[key])
    close()
    has_article = any(in_article in f for f in features)
    for k, own in enumerate(features):
        if not has_article:
            own.append(_NUMBER["no article"])
        elif in_article not in own:
            own.append(_NUMBER["outside article"])
        if k == 0:
            own.append(_NUMBER["first"])
        if k == len(features) - 1:
            own.append(_NUMBER["last"])
    return texts, features
