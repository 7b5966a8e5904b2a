"""HTML page rules as Column expressions.

Pages are tag soup, so no XML function applies. Elements are delimited by
balancing start and end tags of the same name, which is unaffected by other
unclosed tags around or inside them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.bind import let
from folioscope.functions.text import LINE_BREAK, SPACES, trim
from folioscope.functions.urls import Site, rewritten_link

# Alternatives share their first character, so the search skips text quickly.
_RAW_TEXT = (
    r"(?s)<(?:!--.*?(?:-->|\z)|((?i:script|style|noscript))(?=[\s/>])[^>]*>.*?(?:</(?i:\1)\s*>|\z))"
)
_TAG_END = r"""/?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|/?[a-zA-Z][^>]*>"""
_TAG = rf"<(?:{_TAG_END})"
_PIECE = rf"(?s)<(?:!--.*?(?:-->|\z)|{_TAG_END}|[!?][^>]*>|)|[^<]+"
_NAME = r"^</?([a-zA-Z][a-zA-Z0-9-]*)"
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr")


def _class_token(name: str) -> str:
    """An attribute holding ``name`` as one of its classes."""
    return (
        rf"""(?i:\sclass)\s*=\s*(?:"(?:[^"]*\s)?{name}(?:\s[^"]*)?"|'(?:[^']*\s)?{name}(?:\s[^']*)?'"""
        rf"|{name}(?=[\s/>]))"
    )


def _class_part(part: str) -> str:
    """An attribute whose class text contains ``part`` anywhere."""
    return rf"""(?i:\sclass)\s*=\s*(?:"[^"]*{part}[^"]*"|'[^']*{part}[^']*'|[^\s"'>]*{part}[^\s>]*)"""


def _attribute(name: str, value: str) -> str:
    return rf"""(?i:\s{name})\s*=\s*(?:"{value}"|'{value}'|{value}(?=[\s/>]))"""


def _start_tag(name: str, attribute: str = "") -> str:
    inner = rf"[^>]*?{attribute}" if attribute else ""
    return rf"<(?i:{name})(?=[\s/>]){inner}[^>]*>"


_ANY = "[a-z][a-z0-9-]*"

# Elements removed as noise, by name and by class.
NOISE_TAGS = ("header", "nav", "footer", "aside", "script", "style", "noscript")
NOISE_CLASSES = (
    "theme-doc-toc-desktop",
    "table-of-contents",
    "theme-doc-sidebar-container",
    "breadcrumbs",
)

# Decoration and media.
MEDIA_TAGS = ("img", "picture", "figure", "svg")
_DECOR_MARKS = ("hash-link", "aria-hidden", "copyButton")
_DECOR_TAG = "|".join(
    [
        _start_tag("a|span", _class_part("hash-link")),
        _start_tag("a", _attribute("aria-hidden", "true")),
        _start_tag(_ANY, _class_part("copyButton")),
    ]
)


# ------------------------------------------------------------ main content


def _from(markup: Column, start: str) -> Column:
    """The markup from the first start tag that matches, else an empty string."""
    return F.regexp_extract(markup, rf"(?s)({start}.*)", 1)


def _whole_element(opened: Column) -> Column:
    """The element that opens the markup; all of it if the element never closes."""

    def close(parts: Column, name: Column) -> Column:
        counted = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("depth"), F.lit(0).alias("used"), F.lit(False).alias("done")),
            lambda s, part: F.when(s.done, s).otherwise(
                let(
                    s.depth + F.when(part.startswith("</"), -1).otherwise(1),
                    lambda depth: F.struct(
                        depth.alias("depth"), (s.used + 1).alias("used"), (depth == 0).alias("done")
                    ),
                )
            ),
        )
        return let(
            counted,
            lambda s: F.when(
                s.done,
                F.concat(F.array_join(F.slice(parts, F.lit(1), s.used - 1), ""), F.lit("</"), name, F.lit(">")),
            ).otherwise(F.array_join(parts, "")),
        )

    def element(tail: Column) -> Column:
        return let(
            F.regexp_extract(tail, _NAME, 1),
            lambda name: let(
                F.split(tail, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"[\s/>])"))),
                lambda parts: close(parts, name),
            ),
        )

    return let(opened, element)


def _from_within(markup: Column, outer: str, start: str) -> Column:
    """Like ``_from``, for the first match that has an ``outer`` ancestor."""
    opens = rf"\A<(?i:{outer})(?=[\s/>])"

    def locate(parts: Column) -> Column:
        found = F.aggregate(
            parts,
            F.struct(
                F.lit(0).alias("depth"),
                F.lit(0).alias("at"),
                F.lit(0).alias("found"),
                F.lit(False).alias("nested"),
            ),
            lambda s, part: let(
                F.when(part.rlike(opens), s.depth + 1)
                .when(part.startswith("</"), F.greatest(s.depth - 1, F.lit(0)))
                .otherwise(s.depth),
                lambda depth: let(
                    (s.found == 0)
                    & (depth > 0)
                    & F.when(s.depth > 0, part).otherwise(F.regexp_replace(part, r"\A<[^>]*>", "")).rlike(start),
                    lambda hit: F.struct(
                        depth.alias("depth"),
                        (s.at + 1).alias("at"),
                        F.when(hit, s.at + 1).otherwise(s.found).alias("found"),
                        F.when(hit, s.depth > 0).otherwise(s.nested).alias("nested"),
                    ),
                ),
            ),
        )
        return let(
            found,
            lambda s: F.when(
                s.found > 0,
                let(
                    F.array_join(F.slice(parts, F.greatest(s.found, F.lit(1)), F.size(parts)), ""),
                    lambda rest: _from(
                        F.when(s.nested, rest).otherwise(F.regexp_replace(rest, r"\A<[^>]*>", "")), start
                    ),
                ),
            ).otherwise(F.lit("")),
        )

    return let(F.split(markup, rf"(?=</?(?i:{outer})[\s/>])"), locate)


def main_content(page: Column) -> Column:
    """First hit of seven selectors, tried in order; the whole page if none.

    Comments, scripts and styles hold no elements and go first. The cheap ``contains`` guards keep pages without such a class out of the
    expensive searches.
    """
    return let(strip_raw_text(page), lambda markup: F.coalesce(_whole_element(_main_tail(markup)), markup))


def _main_tail(markup: Column) -> Column:
    themed, marked = _class_token("theme-doc-markdown"), _class_token("markdown")
    root = _start_tag(_ANY, _attribute("id", "__docusaurus"))
    has_theme, has_mark = markup.contains("theme-doc-markdown"), markup.contains("markdown")
    in_root = _from(
        F.regexp_replace(_whole_element(_from(markup, root)), r"\A<[^>]*>", ""), _start_tag(_ANY, marked)
    )
    tails = [
        F.when(has_theme, _from(markup, _start_tag("article", themed))),
        F.when(has_mark, _from_within(markup, "article", _start_tag(_ANY, marked))),
        F.when(has_theme, _from_within(markup, "main", _start_tag(_ANY, themed))),
        F.when(has_mark, _from_within(markup, "main", _start_tag(_ANY, marked))),
        F.when(has_mark & markup.contains("__docusaurus"), in_root),
        F.when(
            markup.contains("articleBody"),
            _from(markup, _start_tag(_ANY, _attribute("itemprop", "articleBody"))),
        ),
        _from(markup, _start_tag("article")),
    ]
    return F.coalesce(*[let(tail, lambda found: F.when(found != "", found)) for tail in tails])


# ---------------------------------------------------------------- removal


def strip_raw_text(markup: Column) -> Column:
    """Drop comments and the elements whose content is not markup."""
    return F.regexp_replace(markup, _RAW_TEXT, "")


def _drop_elements(page: Column, names: Sequence[str], marks: Sequence[str], marked: str) -> Column:
    """Remove every element with one of ``names``, or whose start tag matches
    the pattern ``marked``, keeping what follows it. Only tags that hold one of
    ``marks`` are tried against the pattern.

    One linear pass over the tags finds the piece ranges to cut; an element
    inside a removed one goes with it. Pages without a match are returned as
    they are.
    """

    def relevant(tags: Column) -> Column:
        """Tags that can open, nest in or close a removed element."""
        same_name = F.transform(F.filter(tags, lambda tag: tag.marked), lambda tag: tag["name"])
        return let(
            F.array_distinct(same_name),
            lambda marked_names: F.filter(
                tags, lambda tag: tag["name"].isin(*names) | F.array_contains(marked_names, tag["name"])
            ),
        )

    def cuts(pieces: Column) -> Column:
        tags = F.filter(
            F.transform(
                pieces,
                lambda piece, i: F.struct(
                    F.lower(F.regexp_extract(piece, _NAME, 1)).alias("name"),
                    piece.startswith("</").alias("ends"),
                    (_has_any(piece, marks) & piece.rlike(rf"\A(?:{marked})")).alias("marked"),
                    (i + 1).alias("at"),
                ),
            ),
            lambda tag: tag["name"] != "",
        )

        def step(s: Column, tag: Column) -> Column:
            inside = s["name"] != ""
            hit = ~inside & ~tag.ends & (tag.marked | tag["name"].isin(*names))
            opening = hit & ~tag["name"].isin(*_VOID)
            lone = hit & tag["name"].isin(*_VOID)
            same = inside & (tag["name"] == s["name"])
            closing = same & tag.ends & (s.depth == 1)
            return F.struct(
                F.when(closing, F.lit("")).when(opening, tag["name"]).otherwise(s["name"]).alias("name"),
                F.when(opening, 1)
                .when(same & tag.ends, s.depth - 1)
                .when(same, s.depth + 1)
                .otherwise(s.depth)
                .alias("depth"),
                F.when(opening, tag["at"]).otherwise(s["from"]).alias("from"),
                F.when(closing, F.concat(s.cut, F.array(_range(s["from"], tag["at"]))))
                .when(lone, F.concat(s.cut, F.array(_range(tag["at"], tag["at"]))))
                .otherwise(s.cut)
                .alias("cut"),
            )

        start_state = F.struct(
            F.lit("").alias("name"),
            F.lit(0).alias("depth"),
            F.lit(0).alias("from"),
            F.array().cast("array<struct<first:int,last:int>>").alias("cut"),
        )
        return F.aggregate(
            let(tags, relevant),
            start_state,
            step,
            lambda s: F.concat(
                s.cut,
                # An element that never closes runs to the end.
                F.when(s["name"] != "", F.array(_range(s["from"], F.size(pieces)))).otherwise(
                    F.array().cast("array<struct<first:int,last:int>>")
                ),
                F.array(_range(F.size(pieces) + 1, F.size(pieces) + 1)),
            ),
        )

    def rebuild(pieces: Column) -> Column:
        return let(
            cuts(pieces),
            lambda cut: F.array_join(
                F.transform(
                    cut,
                    lambda c, k: let(
                        F.coalesce(F.get(cut, k - 1)["last"], F.lit(0)),
                        lambda done: F.array_join(F.slice(pieces, done + 1, c["first"] - done - 1), ""),
                    ),
                ),
                "",
            ),
        )

    return let(
        page,
        lambda markup: F.when(
            _has_any(markup, marks) | markup.rlike(rf"<(?i:{'|'.join(names)})(?=[\s/>])"),
            let(
                F.when(_has_any(markup, marks), F.regexp_extract_all(markup, F.lit(_PIECE), F.lit(0))).otherwise(
                    F.regexp_extract_all(markup, F.lit(_pieces_between(names)), F.lit(0))
                ),
                rebuild,
            ),
        ).otherwise(markup),
    )


def _pieces_between(names: Sequence[str]) -> str:
    """Tags with one of ``names``, and whole stretches of anything else."""
    other = rf"(?!/?(?i:{'|'.join(names)})[\s/>])(?:!--.*?(?:-->|\z)|{_TAG_END}|[!?][^>]*>|)"
    return rf"(?s)(?:[^<]++|<{other})++|<(?:{_TAG_END}|)"


def _has_any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.contains(part) for part in parts])


def _range(first: Column, last: Column) -> Column:
    return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))


def denoise(markup: Column) -> Column:
    """Without headers, navigation, footers, asides, scripts, styles and TOCs."""
    marked = "|".join(_start_tag(_ANY, _class_token(name)) for name in NOISE_CLASSES)
    return _drop_elements(strip_raw_text(markup), NOISE_TAGS, NOISE_CLASSES, marked)


def undecorate(markup: Column) -> Column:
    """Without hash links, copy buttons and media."""
    return _drop_elements(markup, MEDIA_TAGS, _DECOR_MARKS, _DECOR_TAG)


# ------------------------------------------------------------------- text

_LEGACY = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n)))


def _literal_map(keys: Iterable[str], values: Iterable[str]) -> Column:
    """A constant map, built from two literals rather than one per entry."""
    return F.map_from_arrays(F.split(F.lit(" ".join(keys)), " "), F.split(F.lit("\x00".join(values)), "\x00"))


def decode_entities(text: Column) -> Column:
    """Character references to characters, in one left-to-right pass."""
    names = _literal_map(name2codepoint, [chr(code) for code in name2codepoint.values()])
    rare = {name[:-1]: text for name, text in html5.items() if name.endswith(";") and name[:-1] not in name2codepoint}
    others = _literal_map(rare, rare.values())
    # Numbers in this range mean characters of the Windows code page.
    cp1252 = _literal_map(
        map(str, range(0x80, 0xA0)),
        [bytes([code]).decode("cp1252", errors="ignore") or chr(code) for code in range(0x80, 0xA0)],
    )

    def character(code: Column) -> Column:
        known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        as_text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (
            F.when(code.between(0x80, 0x9F), F.try_element_at(cp1252, code.cast("string")))
            .when(known, as_text)
            .otherwise(F.lit("\ufffd"))
        )

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        named = F.coalesce(F.try_element_at(names, name), F.try_element_at(others, name))
        legacy = F.regexp_extract(piece, rf"^({_LEGACY})", 1)
        decimal = F.regexp_extract(piece, r"^#0*([0-9]{1,7})(?![0-9]);?", 1)
        hexadecimal = F.regexp_extract(piece, r"^#[xX]0*([0-9a-fA-F]{1,6})(?![0-9a-fA-F]);?", 1)
        rest = lambda pattern: F.regexp_replace(piece, pattern, "")
        return (
            F.when(named.isNotNull(), F.concat(named, rest(r"^[A-Za-z0-9]+;")))
            .when(decimal != "", F.concat(character(decimal.cast("int")), rest(r"^#[0-9]+;?")))
            .when(
                hexadecimal != "",
                F.concat(character(F.conv(hexadecimal, 16, 10).cast("int")), rest(r"^#[xX][0-9a-fA-F]+;?")),
            )
            .when(legacy != "", F.concat(F.try_element_at(names, legacy), rest(rf"^(?:{_LEGACY});?")))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    def join(pieces: Column) -> Column:
        return F.array_join(
            F.transform(
                pieces,
                lambda piece, i: F.when(i == 0, piece)
                .when(piece.startswith("amp;"), F.concat(F.lit("&"), F.substring(piece, F.lit(5), F.length(piece))))
                .otherwise(decoded(piece)),
            ),
            "",
        )

    return let(
        text, lambda raw: F.when(raw.contains("&"), let(F.split(raw, "&"), join)).otherwise(raw)
    )


def _text_pieces(markup: Column) -> Column:
    """Trimmed, non-empty text between tags."""
    pieces = F.transform(F.split(markup, _TAG), lambda piece: trim(decode_entities(piece)))
    return F.filter(pieces, lambda piece: piece != "")


def inner_text(markup: Column) -> Column:
    return F.array_join(_text_pieces(markup), " ")


def page_title(markup: Column, fallback: Column) -> Column:
    """Text of the first level-one heading, else ``fallback``."""
    heading = F.regexp_extract(markup, r"(?is)<h1(?=[\s/>])[^>]*>(.*?)(?:</h1\s*>|\z)", 1)
    return let(inner_text(heading), lambda text: F.when(text == "", fallback).otherwise(text))


# Elements that start a new line in plain text.
BLOCK_TAGS = (
    "address article blockquote br caption dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()


def plain_text(markup: Column) -> Column:
    """Visible text, one block per line, without blank lines."""
    broken = F.regexp_replace(strip_raw_text(markup), rf"</?(?i:{'|'.join(BLOCK_TAGS)})(?=[\s/>])[^>]*>", "\n")
    bare = decode_entities(F.regexp_replace(broken, rf"<(?:{_TAG_END}|[!?][^>]*>)", ""))
    kept = F.filter(F.transform(F.split(bare, LINE_BREAK), trim), lambda line: line != "")
    return F.array_join(kept, "\n")


# -------------------------------------------------------------- Markdown

# Containers whose tags are dropped from Markdown.
CONTAINER_TAGS = ("span", "div", "section", "article", "header", "footer", "main", "figure", "figcaption")


def sanitize_markdown(markdown: Column) -> Column:
    """Five passes, in this order: image tags, inline anchors, container tags,
    runs of blank lines, line ends."""
    # The patterns of the passes.
    text = F.regexp_replace(markdown, r"(?iu)<img[^>]*>", "")
    text = F.regexp_replace(text, r"(?isu)<a[^>]*>(.*?)</a>", "$1")
    text = F.regexp_replace(text, rf"(?iu)</?(?:{'|'.join(CONTAINER_TAGS)})[^>]*>", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    ends = F.transform(F.split(text, LINE_BREAK), lambda line: F.rtrim(line, F.lit(SPACES)))
    text = F.array_join(ends, "\n")
    return F.concat(trim(text), F.lit("\n"))


def has_residual_html(markdown: Column) -> Column:
    return markdown.rlike("<[A-Za-z/!]")


def is_challenge(markup: Column) -> Column:
    """A bot-check page answered instead of the document."""
    return markup.contains("Just a moment") & markup.contains("challenge-platform")


# ----------------------------------------------------------------- links

_HREF = r"""(?is)\A(<a\s(?:[^>]*?\s)?href\s*=\s*)("[^"]*"|'[^']*'|[^\s"'>]+)(.*)\z"""


def _anchor_parts(markup: Column) -> Column:
    """Markup cut before each anchor start tag; a new anchor ends the one before."""
    return F.split(markup, r"(?i)(?=<a\s)")


def _href(part: Column) -> Column:
    quoted = F.regexp_extract(part, _HREF, 2)
    return decode_entities(F.regexp_replace(quoted, r"""\A["']|["']\z""", ""))


def anchors(markup: Column) -> Column:
    """Links in page order as array<struct<href, text>>; empty targets left out.
    What stands in comments, scripts and styles is no link."""
    found = F.transform(
        _anchor_parts(strip_raw_text(markup)),
        lambda part: F.struct(
            _href(part).alias("href"),
            inner_text(F.regexp_extract(part, r"(?is)\A<a\s[^>]*>(.*?)(?:</a\s*>|\z)", 1)).alias("text"),
        ),
    )
    return F.filter(found, lambda link: link["href"] != "")


def rewrite_links(markup: Column, page_url: Column, site: Site) -> Column:
    """The markup with every link target replaced by ``rewritten_link``."""
    return _relinked(markup, lambda href, i: rewritten_link(href, page_url, site))


def link_targets(markup: Column) -> Column:
    """The target of each anchor start tag in order, empty where it has none."""
    return F.transform(_anchor_parts(markup), _href)


def replace_links(markup: Column, targets: Column) -> Column:
    """The markup with the targets of its links, as ``link_targets`` counts
    them, replaced by those of an array; a null one leaves the link."""
    return let(
        F.struct(markup.alias("page"), targets.alias("targets")),
        lambda both: _relinked(both["page"], lambda href, i: F.coalesce(F.get(both["targets"], i), href)),
    )


def _relinked(markup: Column, target: Callable[[Column, Column], Column]) -> Column:
    def relink(part: Column, i: Column) -> Column:
        return let(
            _href(part),
            lambda href: F.when(href == "", part).otherwise(
                F.concat(
                    F.regexp_extract(part, _HREF, 1),
                    F.lit('"'),
                    _escape_attribute(target(href, i)),
                    F.lit('"'),
                    F.regexp_extract(part, _HREF, 3),
                )
            ),
        )

    return let(
        markup,
        lambda page: F.when(
            page.rlike(r"(?i)<a\s"), F.array_join(F.transform(_anchor_parts(page), relink), "")
        ).otherwise(page),
    )


def _escape_attribute(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
