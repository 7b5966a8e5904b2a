"""Main text of pages by wrappers of their sites.

A wrapper is a regular expression without unions over a site's pages: a sequence
of elements in which some are optional and some repeat, and of text that is
fixed or a slot. Pages of one host are aligned one after another; what doesn't
match becomes a repetition, an option or a slot. The wrapper then says where a
site keeps its articles, and which text there is its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import matched, stored
from folioscope.llm.page_tree import DEEPEST, Node, blocks, parse
from folioscope.llm.site_lines import host

# A wrapper node is a dict: k key, f furniture, m main, n pages that have it,
# o optional, r repeated, t characters of text, l of them linked,
# x the text, or its digest, if it is the same on all pages, c children.

#: Sites that one task aligns at once; more are passed on in parts.
_SITES = 2_000
#: Partial wrappers of a site meet in so many tasks before they meet in one.
_SALTS = 16


def _same(text: str) -> str:
    """What a text is compared by: a long one's digest, so that wrappers stay small."""
    return text if len(text) <= 200 else "\0" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _text_below(node: Node) -> list[tuple[str, bool]]:
    """All text below an element that isn't furniture, without recursion."""
    out: list[tuple[str, bool]] = []
    waiting = [iter(node.children)]
    while waiting:
        child = next(waiting[-1], None)
        if child is None:
            waiting.pop()
            out.append((" ", False))
        elif isinstance(child, tuple):
            out.append(child)
        elif child.furniture != 1:
            waiting.append(iter(child.children))
            out.append((" ", False))
    return out


def of_page(node: Node, depth: int = 0) -> dict:
    """The wrapper of a single page: its tree with runs of like elements folded.

    What lies below the deepest element of a path is text of that element.
    """
    within = node.children if depth < DEEPEST else _text_below(node)
    words = "".join(c[0] for c in within if isinstance(c, tuple))
    shown = " ".join(words.split())
    linked = sum(len(c[0]) for c in within if isinstance(c, tuple) and c[1])
    if linked and not any(x.isalnum() for c in within if isinstance(c, tuple) and not c[1] for x in c[0]):
        linked = len(shown)  # links and what stands between them
    inner = [of_page(c, depth + 1) for c in within if isinstance(c, Node)]
    return {
        "k": node.key, "f": node.furniture, "m": int(node.main), "n": 1, "o": 0, "r": 0,
        "t": len(shown), "l": min(linked, len(shown)), "x": _same(shown), "c": _fold(inner),
    }


def _fold(children: list[dict]) -> list[dict]:
    """Turn repetitions of one, two or three elements into repeated ones."""
    for period in (1, 2, 3):
        out: list[dict] = []
        at = 0
        while at < len(children):
            unit = children[at : at + period]
            keys = [c["k"] for c in unit]
            stop = at + period
            while len(unit) == period and [c["k"] for c in children[stop : stop + period]] == keys:
                unit = [_merge(a, b, same_page=True) for a, b in zip(unit, children[stop : stop + period])]
                stop += period
            if stop > at + period and len(unit) == period:
                for c in unit:
                    c["r"] = 1
                out += unit
                at = stop
            else:
                out.append(children[at])
                at += 1
        children = out
    return children


def _merge(a: dict, b: dict, same_page: bool = False) -> dict:
    return {
        "k": a["k"], "f": min(a["f"], b["f"]), "m": a["m"], "n": a["n"] if same_page else a["n"] + b["n"],
        "o": a["o"] | b["o"], "r": a["r"] | b["r"], "t": a["t"] + b["t"], "l": a["l"] + b["l"],
        "x": a["x"] if a["x"] == b["x"] else None, "c": _align(a["c"], b["c"], same_page),
    }


def _align(a: list[dict], b: list[dict], same_page: bool) -> list[dict]:
    """Align two sequences; what only one has is optional, what comes again repeats."""
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c["k"], []).append(j)
    left = {}
    for i, c in enumerate(a):
        left.setdefault(c["k"], []).append(i)

    def ahead(where: dict[str, list[int]], key: str, at: int) -> int | None:
        return next((p for p in where.get(key, ()) if p >= at), None)

    out: list[dict] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i]["k"] == b[j]["k"]:
            out.append(_merge(a[i], b[j], same_page))
            i, j = i + 1, j + 1
            continue
        last = out[-1]["k"] if out else None
        if j < len(b) and b[j]["k"] == last:  # the element before, once more
            out[-1] = _merge(out[-1], b[j], same_page=True) | {"r": 1}
            j += 1
            continue
        if i < len(a) and a[i]["k"] == last:
            out[-1] = _merge(out[-1], a[i], same_page=True) | {"r": 1}
            i += 1
            continue
        in_b = ahead(places, a[i]["k"], j) if i < len(a) else None
        in_a = ahead(left, b[j]["k"], i) if j < len(b) else None
        if j < len(b) and (i >= len(a) or in_b is not None and (in_a is None or in_b - j <= in_a - i)):
            out.append(b[j] | {"o": 1})
            j += 1
        else:
            out.append(a[i] | {"o": 1})
            i += 1
    return out


def expression(w: dict) -> str:
    """The wrapper as text: ``( )?`` may be missing, ``( )+`` may repeat, ``#text`` is a slot, ``#same`` long fixed text."""
    text = "" if not w["t"] else "#text" if w["x"] is None else "#same" if w["x"].startswith("\0") else w["x"]
    inner = f"<{w['k']}>{text}{''.join(map(expression, w['c']))}</>"
    mark = {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[w["o"], w["r"]]
    return f"({inner}){mark}" if mark else inner


def _own(w: dict) -> tuple[int, int]:
    """Characters and linked characters below, furniture left out."""
    if w["f"] == 1:
        return 0, 0
    t, l = (w["t"], w["l"]) if w["f"] != 2 else (0, 0)
    for c in w["c"]:
        a, b = _own(c)
        t, l = t + a, l + b
    return t, l


def _loose(w: dict, least_pages: int) -> int:
    """Characters below that are no furniture, no links and not the same on the pages that have them."""
    if w["f"] == 1:
        return 0
    fixed = w["f"] == 2 or w["x"] is not None and w["n"] >= least_pages
    return (0 if fixed else w["t"] - w["l"]) + sum(_loose(c, least_pages) for c in w["c"])


def region(w: dict, least_pages: int = 3) -> str:
    """The path of the element in which a site keeps its article.

    The article or main element with most text of its own, or one within it that
    leaves out only links, furniture and what the site repeats; else the innermost
    element that holds all of the text that isn't links or the same on the pages
    that have it, ``least_pages`` or more. An element that is furniture doesn't
    count, unless there is nothing else.
    """
    found: list[tuple[bool, int, str, int]] = []

    def look(c: dict, path: str, within: bool) -> None:
        if c["m"]:
            t, l = _own(c | {"f": 0})
            found.append((not within and c["f"] != 1, t - l, path, _loose(c | {"f": 0}, least_pages)))
        for x in c["c"]:
            look(x, f"{path}/{x['k']}", within or c["f"] == 1)

    look(w, w["k"], False)
    found = [x for x in found if x[1] > 0]
    clear = [x for x in found if x[0]]
    if clear or _own(w)[0] == 0 and found:  # comments are articles too
        found = clear or found
        best = max(found, key=lambda x: (x[0], x[1], -len(x[2])))
        # an article with all of the largest one's text is meant, not what encloses both
        inner = [x for x in found if x[0] == best[0] and x[2].startswith(best[2] + "/") and x[3] == best[3]]
        return max(inner, key=lambda x: (x[1], len(x[2])))[2] if inner else best[2]
    path = w["k"]
    least = least_pages if _loose(w, least_pages) else w["n"] + 1  # copies of one page: nothing is the site's own
    total = _loose(w, least)
    while True:
        best = max(((_loose(c, least), c) for c in w["c"]), key=lambda x: x[0], default=(0, None))
        if best[1] is None or best[0] < total or best[1]["r"] or not best[1]["c"]:
            return path
        w = best[1]
        path = f"{path}/{w['k']}"


def template(w: dict, least_pages: int = 3) -> list[list[str]]:
    """(path, text or its digest) of the text that all of a site's pages have, outside articles."""
    out: list[list[str]] = []

    def look(c: dict, path: str, pages: int) -> None:
        if c["m"] or c["f"] == 1:
            return
        if c["x"] and c["n"] >= max(least_pages, pages) and not c["r"]:
            out.append([path, c["x"]])
        for x in c["c"]:
            look(x, f"{path}/{x['k']}", pages)

    look(w, w["k"], w["n"])
    return out


def _find(node: Node, path: str) -> list[tuple[Node, str]]:
    """The elements at a path, outermost first."""
    at = [(node, node.key)]
    if path == node.key:
        return at
    if not path.startswith(node.key + "/"):
        return []
    for _ in range(path.count("/")):
        at = [(c, f"{p}/{c.key}") for n, p in at for c in n.children if isinstance(c, Node) and path.startswith(f"{p}/{c.key}")]
        done = [x for x in at if x[1] == path]
        if done:
            return done
    return []


def main_text(page: str | None, where: str | None = None, fixed: list[list[str]] | None = None) -> str:
    """The article of a page, a line per block.

    ``where`` and ``fixed`` are the site's region and template; a page that
    lacks the region is its own site.
    """
    if not page:
        return ""
    tree = parse(page)
    found = _find(tree, where) if where else []
    if not found:
        where, fixed = region(of_page(tree)), None
        found = _find(tree, where)
    known = {tuple(x) for x in fixed or ()}
    for skip in ((lambda path, text: (path, _same(text)) in known), lambda path, text: False):
        lines = [text for node, path in found for _, text, _ in blocks(node, skip, path)]
        if lines or not known:
            break
    return "\n".join(lines)


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align the pages of this task, site by site."""
    salt, sites = TaskContext.get().partitionId(), {}

    def passed_on() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict({
            "site": pa.array(list(sites), pa.string()),
            "part": pa.array([salt] * len(sites), pa.int32()),
            "wrapper": pa.array([json.dumps(w) for w in sites.values()], pa.string()),
        })
        sites.clear()
        return batch

    for batch in batches:
        for site, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = page.as_py()
            if text:
                own = of_page(parse(text))
                sites[site] = _merge(sites[site], own) if site in sites else own
        if len(sites) > _SITES:
            yield passed_on()
    if sites:
        yield passed_on()


def _meet(last: bool):
    """Align partial wrappers, which come sorted by site."""

    def out(site: str | None, w: dict) -> dict:
        row = {"site": site, "wrapper": json.dumps(w)}
        if last:
            row |= {"pages": w["n"], "expression": expression(w), "region": region(w), "template": json.dumps(template(w))}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # site and wrapper so far
        for batch in batches:
            rows = []
            for site, text in zip(batch.column("site").to_pylist(), batch.column("wrapper").to_pylist()):
                w = json.loads(text)
                if held and held[0] == site:
                    held[1] = _merge(held[1], w)
                else:
                    if held:
                        rows.append(out(*held))
                    held = [site, w]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=types)
        if held:
            yield pa.RecordBatch.from_pylist([out(*held)], schema=types)

    names = [("site", pa.string()), ("wrapper", pa.string())]
    if last:
        names += [("pages", pa.int64()), ("expression", pa.string()), ("region", pa.string()), ("template", pa.string())]
    types = pa.schema(names)
    return run


def infer(pages: DataFrame, *, site: Column, html: str = "html") -> DataFrame:
    """``site``, ``pages``, ``expression``, ``region``, ``template``: the wrapper of each site.

    Every page is aligned. Each task folds its pages into one wrapper per site;
    those meet in a few tasks and then in one, so of a site that has most pages
    only wrappers meet, not pages. Pages of no site (null) form one.
    """
    rows = pages.select(site.alias("site"), F.col(html).alias("html"))
    parts = rows.mapInArrow(_infer, "site string, part int, wrapper string")
    salted = parts.withColumn("salt", F.pmod("part", F.lit(_SALTS)))
    some = salted.repartition("site", "salt").sortWithinPartitions("site", "salt", "part", "wrapper")
    # runs of a site may hold several salts of one partition; they meet there
    some = some.mapInArrow(_meet(False), "site string, wrapper string")
    whole = some.repartition("site").sortWithinPartitions("site", "wrapper")
    return whole.mapInArrow(_meet(True), "site string, wrapper string, pages long, expression string, region string, template string").drop("wrapper")


def _apply(usual: tuple[str | None, str | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pages, regions, templates = batch.columns
            texts = []
            for page, where, fixed in zip(pages, regions.to_pylist(), templates.to_pylist()):
                where, fixed = (where, fixed) if where is not None else usual
                texts.append(main_text(page.as_py(), where, json.loads(fixed) if fixed else None))
            yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string())], names=["row", "text"])

    return run


def extract(pages: DataFrame, *, site: Column | None = None, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all columns but the page) with ``text``, a row per page.

    Of each page, the blocks in its site's region, without furniture and
    without the site's template; white space is one space, character references
    are read, blocks are joined by line ends. A null or empty page, and one
    without an article's text, gives an empty text. Pages are never moved: a
    site whose region and template are those of most sites needs no entry in
    the table they meet, and the table is sent to all tasks if its files are
    small. Repeated rows give the same; a column ``text`` is replaced.
    """
    site = host(F.col("url")) if site is None else site
    known = stored(infer(pages, site=site, html=html), "wrappers")
    usual = known.groupBy("region", "template").count().orderBy(F.desc("count"), "region", "template").first()
    usual = (usual.region, usual.template) if usual else (None, None)
    unusual = known.where(~((F.col("region") == usual[0]) & (F.col("template") == usual[1]))) if usual[0] else known
    unusual = stored(unusual.select("site", F.col("region").alias("at"), F.col("template").alias("fixed")), "unusual")
    kept = [c for c in keep or pages.columns if c.lower() not in (html.lower(), "text")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(html).alias("text"), site.alias("site"))
    rows = matched(rows, unusual, ["site"], "left").select("row", "text", "at", "fixed")
    return rows.mapInArrow(_apply(usual), rows.select("row", "text").schema).select("row.*", "text")


def op4_main_text(spark, root) -> DataFrame:
    pages = spark.read.parquet(f"{root}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))


# What the rules come to on pages whose article is an <article> of headings and paragraphs.
_BLOCKS = r"(?i)</?(?:p|h1)>"
_INLINE = r"(?i)</?b>"
SQL = rf"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS t FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '{_BLOCKS}', chr(10), 'g'), '(?i)<br>', ' ', 'g'), '{_INLINE}', '', 'g') AS s FROM a),
d AS (
  SELECT *, list_transform(string_split(s, chr(10)), lambda x: trim(regexp_replace(replace(replace(replace(replace(
    regexp_replace(x, '&amp;?', chr(1), 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), chr(1), '&'), '\s+', ' ', 'g'))) AS l FROM b)
SELECT page_id, url, array_to_string(list_filter(l, lambda x: x <> ''), chr(10)) AS text,
  length(array_to_string(list_filter(l, lambda x: x <> ''), chr(10))) AS n_chars FROM d
"""
