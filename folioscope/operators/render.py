"""Cleaned page markup to Markdown, as an Arrow batch job.

Nested lists, tables and code blocks need a tree, which Column expressions
cannot build; everything around this step stays in Spark expressions. A page is
one row, so the job is narrow.

Rendered: headings, paragraphs, line breaks, bold, italics, strike-out, code,
code blocks with language, links, lists, quotes, tables, rules. Other elements
contribute their content.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect
from collections.abc import Generator, Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.html import BLOCK_TAGS, sanitize_markdown

# Workers get these helpers with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BLOCKS = frozenset(BLOCK_TAGS) - {"br"} | {"article", "body", "html"}
_VOID = frozenset({"br", "hr", "img", "input", "meta", "link", "col", "wbr"})
_UNSEEN = frozenset({"head", "script", "style", "title", "template"})
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~"}
# A block ends an open paragraph; these end elements of their own kind as well.
_PARAGRAPH = frozenset({"p"})
_CLOSED_BY = {
    "li": {"p", "li"},
    "tr": {"p", "tr", "td", "th"},
    "td": {"p", "td", "th"},
    "th": {"p", "td", "th"},
    "dt": {"p", "dd", "dt"},
    "dd": {"p", "dd", "dt"},
    "a": {"a"},
}
# Blocks that are more than their content.
_OWN = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "hr", "pre", "blockquote", "ul", "ol", "table"})
_SCOPES = frozenset({"ul", "ol", "table", "blockquote", "div"})
_BREAK = "  \n"

_TOKEN = re.compile(
    r"""([^<]+|<(?![a-zA-Z/!?]))|<!--.*?(?:-->|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*>?""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_MARK = re.compile(r"([\\`*\[\]<>])")
_EDGE_UNDERSCORE = re.compile(r"(?<!\w)_|_(?!\w)")
_BLOCK_START = re.compile(r"^(?:#{1,6}(?=\s|$)|[-+](?= )|\d+(?=[.)] ))")
_SPACES = re.compile(r"(?<=[^\n]) {2,}(?!\n)")
_AROUND_BREAK = re.compile(r" *\n *")
_BLANK = re.compile(r"[ \t\r\n\f]+")


class _Node:
    """``blocks``: whether an element within starts a block, not counting what marks enclose."""

    __slots__ = ("tag", "attributes", "children", "blocks")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.blocks = tag, attributes, [], False

    def get(self, name: str) -> str:
        for key, *values in _ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return unescape("".join(values))
        return ""


class _Tree:
    """Element tree of tag soup: a block ends an open paragraph together with
    the inline elements left open in it, and a link ends the one before."""

    def __init__(self, markup: str):
        self.root = _Node("root")
        self.open = [self.root]
        # Where each tag is open, outermost first, so that no end tag walks the stack.
        self.depths: dict[str, list[int]] = {}
        for match in _TOKEN.finditer(markup):
            text, end, name, attributes = match.groups()
            if text:
                self.open[-1].children.append(unescape(text) if "&" in text else text)
            elif name and end:
                self._end(name.lower())
            elif name:
                self._start(name.lower(), attributes)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCKS or tag == "a":
            self._end_within(_CLOSED_BY.get(tag, _PARAGRAPH))
        node = _Node(tag, attributes)
        parent = self.open[-1]
        parent.children.append(node)
        if tag in _BLOCKS:
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth].blocks:
                    break
                self.open[depth].blocks = True
                if self.open[depth].tag in _MARKS or self.open[depth].tag in _BLOCKS:
                    break
        if tag not in _VOID and not attributes.endswith("/"):
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def _close(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.depths[node.tag].pop()
        del self.open[depth:]

    def _end(self, tag: str) -> None:
        """Close the innermost open element of this tag."""
        if self.depths.get(tag):
            self._close(self.depths[tag][-1])

    def _end_within(self, tags: frozenset[str] | set[str]) -> None:
        """Close up to the outermost open element of ``tags`` within scope."""
        scope = max((self.depths[tag][-1] for tag in _SCOPES if tag not in tags and self.depths.get(tag)), default=0)
        found = []
        for tag in tags:
            depths = self.depths.get(tag, [])
            at = bisect(depths, scope)
            found += depths[at : at + 1]
        if found:
            self._close(min(found))


def to_markdown(markup: str) -> str:
    return "\n\n".join(_run(_blocks(_Tree(markup).root.children)))


def _run(step: Generator) -> list[str]:
    """Run generators that yield generators and get their results: calls whose
    depth the page decides, without Python's stack."""
    waiting, result = [step], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(result))
            result = None
        except StopIteration as done:
            waiting.pop()
            result = done.value
    return result


def _escape(text: str) -> str:
    text = _MARK.sub(r"\\\1", _BLANK.sub(" ", text))
    return _EDGE_UNDERSCORE.sub(r"\\_", text) if "_" in text else text


def _inline(nodes: Iterable[_Node | str]) -> str:
    """Text of inline elements; a mark within a mark of its kind adds nothing."""
    out: list[str] = []
    active: set[str] = set()
    stack: list[tuple[Iterator, _Node | None, str, int]] = [(iter(nodes), None, "", 0)]
    while stack:
        children, node, mark, start = stack[-1]
        for child in children:
            if isinstance(child, str):
                out.append(_escape(child))
            elif child.tag == "br":
                out.append(_BREAK)
            elif child.tag == "code":
                out.append(_code(_verbatim(child)))
            elif child.tag not in _UNSEEN:
                new = _MARKS.get(child.tag, "")
                new = "" if new in active else new
                active.add(new)
                stack.append((iter(child.children), child, new, len(out)))
                break
        else:
            stack.pop()
            if mark:
                active.discard(mark)
                _enclose(out, start, mark)
            elif node and node.tag == "a" and node.get("href"):
                inner = "".join(out[start:])
                target = node.get("href").replace(" ", "%20")
                out[start:] = [f"<{target}>" if inner == _escape(target) and ":" in target else f"[{inner}]({target})"]
    return "".join(out)


def _enclose(out: list[str], start: int, mark: str) -> None:
    """Put the mark around the pieces from ``start``, inside their outer white space."""
    first = next((k for k in range(start, len(out)) if out[k].strip(" \n")), None)
    if first is None:
        return
    last = next(k for k in range(len(out) - 1, -1, -1) if out[k].strip(" \n"))
    core = out[first].lstrip(" \n")
    out[first] = out[first][: len(out[first]) - len(core)] + mark + core
    core = out[last].rstrip(" \n")
    out[last] = core + mark + out[last][len(core) :]


def _longest_run(text: str) -> int:
    return max(map(len, re.findall("`+", text)), default=0)


def _code(text: str) -> str:
    """Inline code, in a longer run of backticks than it holds."""
    fence = "`" * (_longest_run(text) + 1)
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{fence}{pad}{text}{pad}{fence}"


def _verbatim(node: _Node) -> str:
    parts, stack = [], [iter([node])]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append("\n")
        else:
            stack.append(iter(child.children))
    return "".join(parts)


def _paragraph(run: list[_Node | str]) -> list[str]:
    """One paragraph of inline elements; marks that would start a block are escaped."""
    text = _inline(run) if run else ""
    if "  " in text:
        text = _SPACES.sub(" ", text)
    if "\n" in text:
        text = _AROUND_BREAK.sub(_BREAK, text)
    text = text.strip()
    return [_BLOCK_START.sub(_escape_start, text)] if text else []


def _escape_start(match: re.Match) -> str:
    mark = match.group()
    return mark + "\\" if mark.isdigit() else "\\" + mark


def _blocks(nodes: Iterable[_Node | str]) -> Generator:
    """Blocks of a sequence of nodes; containers are part of the sequence around them."""
    done: list[str] = []
    run: list[_Node | str] = []
    stack = [iter(nodes)]
    while stack:
        for child in stack[-1]:
            if isinstance(child, str) or not (child.tag in _BLOCKS or child.blocks):
                run.append(child)
                continue
            done += _paragraph(run)
            run = []
            if child.tag in _OWN:
                done += yield _block(child)
            elif child.tag not in _UNSEEN:
                stack.append(iter(child.children))
                break
        else:
            stack.pop()
            done += _paragraph(run)
            run = []
    return done


def _block(node: _Node) -> Generator:
    if re.fullmatch("h[1-6]", node.tag):
        text = " ".join(_inline(node.children).split())
        return [f"{'#' * int(node.tag[1])} {text}"] if text else []
    if node.tag == "hr":
        return ["---"]
    if node.tag == "pre":
        code = _verbatim(node).strip("\n")
        classes = " ".join(n.get("class") for n in [node, *node.children] if isinstance(n, _Node))
        language = re.search(r"(?:^|\s)lang(?:uage)?-(\S+)", classes)
        fence = "`" * max(3, _longest_run(code) + 1)
        return [f"{fence}{' ' + language.group(1) if language else ''}\n{code}\n{fence}"]
    if node.tag == "blockquote":
        quoted = "\n\n".join((yield _blocks(node.children)))
        return ["\n".join(("> " + line).rstrip() for line in quoted.split("\n"))] if quoted else []
    if node.tag in ("ul", "ol"):
        return (yield _list(node))
    return (yield _table(node))


def _list(node: _Node) -> Generator:
    items = []
    start = node.get("start")
    number = int(start) if re.fullmatch("[0-9]{1,9}", start) else 1
    loose = False
    for child in node.children:
        if not isinstance(child, _Node):
            continue
        mark = f"{number + len(items)}. " if node.tag == "ol" else "- "
        blocks = yield (_block(child) if child.tag in _OWN else _blocks(child.children))
        loose = loose or any(isinstance(c, _Node) and c.tag == "p" for c in child.children)
        body = ("\n\n" if loose else "\n").join(blocks)
        items.append(mark + re.sub(r"\n(?=[^\n])", "\n" + " " * len(mark), body))
    return [("\n\n" if loose else "\n").join(items)] if items else []


def _rows(node: _Node) -> Iterator[_Node]:
    for child in node.children:
        if isinstance(child, _Node) and child.tag == "tr":
            yield child
        elif isinstance(child, _Node) and child.tag in ("thead", "tbody", "tfoot"):
            yield from (c for c in child.children if isinstance(c, _Node) and c.tag == "tr")


def _table(node: _Node) -> Generator:
    rows = []
    for row in _rows(node):
        cells = []
        for cell in row.children:
            if isinstance(cell, _Node) and cell.tag in ("td", "th"):
                blocks = yield _blocks(cell.children)
                cells.append(" ".join(" ".join(blocks).split()).replace("|", "\\|"))
        rows.append(cells)
    width = max(map(len, rows), default=0)
    if not width:
        return []
    lines = ["| " + " | ".join(row + [""] * (width - len(row))) + " |" for row in rows]
    return ["\n".join([lines[0], "|" + "---|" * width, *lines[1:]])]


def _one(page: str | None) -> tuple[str | None, str | None]:
    try:
        return to_markdown(page or ""), None
    except Exception as error:  # the page is kept, with the reason
        return None, f"{type(error).__name__}: {error}"


def render(pages: DataFrame, markup: str = "cleaned_html") -> DataFrame:
    """Add ``markdown`` (sanitized) and ``render_error``.

    Other columns pass through as Arrow buffers. A page that cannot be rendered
    keeps its row, with the reason. A batch holds as many pages as
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` says: lower it for large
    pages.
    """
    added = [T.StructField("markdown", T.StringType()), T.StructField("render_error", T.StringType())]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            page = batch.schema.get_field_index(markup)
            drawn = [_one(text) for text in batch.column(page).to_pylist()]
            texts, errors = zip(*drawn) if drawn else ((), ())
            kind = batch.schema.field(page).type
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, kind), pa.array(errors, kind)],
                [*batch.schema.names, "markdown", "render_error"],
            )

    drawn = pages.mapInArrow(batches, T.StructType([*pages.schema.fields, *added]))
    return drawn.withColumn("markdown", sanitize_markdown(F.col("markdown")))
