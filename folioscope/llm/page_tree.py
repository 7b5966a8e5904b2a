"""Pages as trees of blocks: what the wrappers of a site are aligned on."""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterator

# Names as HTML has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Elements whose content a page doesn't show as its text.
INSETS = frozenset("noscript template iframe object svg canvas select".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section summary"
    " table tbody tfoot thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that never hold an article's text.
FURNITURE = frozenset("nav footer aside form dialog menu search button fieldset".split()) | RAW | INSETS
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class or id that say the same, if all its words do or say where it stands
#: (``main-menu``, but not ``menu-of-the-day``); ``header`` is judged by where it stands.
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead footer sidebar sidebars aside widget widgets ad ads"
    " adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr"
    " notice notices notification notifications alert alerts announcement announcements popup modal overlay newsletter subscribe subscription signup login share sharing social"
    " related recommended recommendations comment comments commentlist comentarios disqus respond reply replies pagination"
    " pager toolbar search form hidden".split()
)
PLACE_WORDS = frozenset(
    "site page global main top bottom left right first second third primary secondary inner outer sticky fixed floating mobile desktop"
    " container wrapper wrap holder box block bar area zone section panel row column col list item items link links button buttons"
    " icon icons label title heading unit slot group set js wp id post posts article articles entry entries stories".split()
)

#: Paths go down to here; elements below have the path of the one at this depth.
DEEPEST = 100
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S,
)
_TAG = re.compile(r"<[a-zA-Z/!]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-zA-Z][a-z]*|[A-Z]+(?![a-z])")
_CLOSED_BY = {  # start tag -> open elements that it ends, and where to stop looking
    **{t: (("p",), ()) for t in BLOCKS if t not in ("html", "head", "body", "option", "optgroup", "caption", "tbody", "thead", "tfoot", "tr")},
    "li": (("li", "p"), ("ul", "ol", "menu")),
    "dt": (("dt", "dd", "p"), ("dl",)),
    "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "p"), ("table",)),
    "tbody": (("tbody", "thead", "tr", "p"), ("table",)),
    "tfoot": (("tbody", "thead", "tr", "p"), ("table",)),
    "option": (("option",), ()),
    "body": (("head",), ()),
}
_BARRIERS = frozenset("html body div article section main aside nav header footer td th table ul ol dl blockquote form figure".split())


class Node:
    """An element: its ``key`` (tag, classes, id), and text or elements within, in order.

    ``furniture``: 0 none, 1 certain, 2 a header, of which only headings may
    belong to an article. Text is (string, whether it is linked).
    """

    __slots__ = ("tag", "key", "furniture", "main", "block", "children")

    def __init__(self, tag: str, key: str = "", furniture: int = 0, main: bool = False, block: bool = True) -> None:
        self.tag, self.key, self.furniture, self.main, self.block = tag, key or tag, furniture, main, block
        self.children: list[Node | tuple[str, bool]] = []


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}


def _element(tag: str, rest: str) -> Node:
    if not rest or rest.isspace():
        furniture = 1 if tag in FURNITURE else 2 if tag == "header" else 0
        return Node(tag, tag, furniture, tag in ("article", "main"), tag in BLOCKS)
    given = _attributes(rest)
    classes, ids = ([re.sub(r"\d+", "", w) for w in given.get(a, "").split()] for a in ("class", "id"))
    marks = classes + ids
    role = given.get("role", "").lower()
    body = "articlebody" in given.get("itemprop", "").lower().split()
    main = tag in ("article", "main") or role in ("main", "article") or body
    furniture = 1 if tag in FURNITURE or role in ROLES else 2 if tag == "header" else 0
    if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")):
        furniture = 1
    if tag not in ("html", "body", "main") and furniture != 1:
        for mark in classes if tag in HEADINGS else marks:  # a heading's id is its text
            words = [w.lower() for w in _WORD.findall(mark)]
            if words and words[0] not in ("no", "has", "with", "without"):
                own = FURNITURE_WORDS.intersection(words) and all(w in FURNITURE_WORDS or w in PLACE_WORDS for w in words)
                if own and not (tag == "article" and words[0] in ("article", "post", "entry")):
                    furniture = 1
                elif "header" in words:
                    furniture = furniture or 2
    key = ".".join([tag, *sorted(set(marks))]) + (f"@{role}" if role else "")
    return Node(tag, key, furniture, main, tag in BLOCKS)


def parse(page: str) -> Node:
    """The page's blocks as a tree; tag soup gives one too, and no text is lost.

    Inline elements are part of their block's text, unless they are furniture.
    Elements that never close end with what they are in; a script or style that
    never closes is the rest of the page, as in browsers, and a title or
    textarea is the text up to the next tag.
    """
    root = Node("#page")
    stack, at, linked, end_of = [root], 0, False, len(page)
    unclosed: set[str] = set()  # raw elements that have no end tag from here on
    places: dict[str, list[int]] = {}  # where each tag is open, outermost first, so that no tag walks the stack
    walls: list[int] = []  # where barriers are open
    hidden = plain = 0  # inline furniture that is open; where the stack has no more forms to clear above

    def text(start: int, end: int) -> None:
        if end > start:
            stack[-1].children.append((html.unescape(page[start:end]), linked))

    def close(k: int) -> None:
        nonlocal hidden, plain
        for n in stack[k:]:
            places[n.tag].pop()
            hidden -= bool(n.furniture and not n.block)
        while walls and walls[-1] >= k:
            walls.pop()
        del stack[k:]
        plain = min(plain, k)

    while at < end_of:
        m = _TOKEN.search(page, at)
        if not m:
            text(at, end_of)
            break
        text(at, m.start())
        at = m.end()
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["end"]:
            if tag == "a":
                linked = False
            elif places.get(tag):
                k = places[tag][-1]
                if tag not in ("p", "li", "dd", "dt") or k > (walls[-1] if walls else 0):
                    close(k)
                    linked = linked and not tag in BLOCKS
            continue
        if tag in RAW:
            if not m["rest"].rstrip().endswith("/"):
                found = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if not found:
                    unclosed.add(tag)
                    found = _TAG.search(page, at) if tag in ("textarea", "title") else None
                    at = found.start() if found else end_of
                else:
                    at = found.end()
            continue
        if tag == "a":
            linked = True
            continue
        if tag == "br" or tag in ("td", "th"):
            stack[-1].children.append((" ", linked))
            if tag == "br":
                continue
        if tag in VOID:
            continue
        node = _element(tag, m["rest"])
        if tag in BLOCKS:
            linked = False
            ends, stops = _CLOSED_BY.get(tag, ((), ()))
            floor = max([walls[-1] if walls else 0, *[places[t][-1] for t in (*stops, *INSETS) if places.get(t)]])
            outer = [places[t][bisect(places[t], floor)] for t in ends if places.get(t) and places[t][-1] > floor]
            if outer:
                close(min(outer))
        elif not node.furniture and not hidden:
            continue  # inline: part of the text
        if m["rest"].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if node.main and not node.furniture:  # a form around the article is no form
            for n in stack[plain:]:
                n.furniture = 0 if n.tag == "form" else n.furniture
            plain = len(stack)
        if tag in _BARRIERS:
            walls.append(len(stack))
        hidden += bool(node.furniture and not node.block)
        places.setdefault(tag, []).append(len(stack))
        stack[-1].children.append(node)
        stack.append(node)
    _free_forms(root)
    return root


def _free_forms(root: Node) -> None:
    """A form that holds most of a page's unlinked text, and is in no article, is the page's frame."""
    order, forms, waiting = [], [], [(root, False)]
    while waiting:
        node, within = waiting.pop()
        order.append(node)
        if node.tag == "form" and node.furniture == 1 and not within:
            forms.append(node)
        waiting += [(c, within or node.main) for c in node.children if isinstance(c, Node)]
    if not forms:
        return
    size: dict[int, int] = {}
    for node in reversed(order):  # children before parents
        own = sum(len(" ".join(c[0].split())) for c in node.children if isinstance(c, tuple) and not c[1])
        inner = [c for c in node.children if isinstance(c, Node)]
        size[id(node)] = own + sum(size[id(c)] for c in inner if c.furniture != 1 or c.tag == "form")
    for form in forms:
        form.furniture = 0 if size[id(form)] * 2 > size[id(root)] else 1


def blocks(node: Node, skip=lambda path, text: False, path: str = "") -> Iterator[tuple[str, str, int]]:
    """(path, text, linked characters) of each block below ``node`` that isn't furniture, in page order."""
    parts: list[str] = []
    links = 0

    def flush(path: str) -> Iterator[tuple[str, str, int]]:
        nonlocal links
        joined = " ".join("".join(parts).split())
        parts.clear()
        if joined and not skip(path, joined):
            yield path, joined, min(links, len(joined))
        links = 0

    path = path or node.key
    waiting = [(iter(node.children), path, False, True)]  # no recursion: pages are as deep as they like
    top = path.count("/")
    while waiting:
        children, path, in_header, block = waiting[-1]
        child = next(children, None)
        if child is None:
            waiting.pop()
            if block:
                yield from flush(path)
        elif isinstance(child, tuple):
            if not in_header:
                parts.append(child[0])
                links += len(child[0]) if child[1] else 0
        elif child.furniture == 1:
            if child.block:
                yield from flush(path)
        elif child.block:
            yield from flush(path)
            inner = f"{path}/{child.key}" if top + len(waiting) < DEEPEST else path
            header = (in_header or child.furniture == 2) and child.tag not in HEADINGS
            waiting.append((iter(child.children), inner, header, True))
        else:
            waiting.append((iter(child.children), path, in_header, False))
