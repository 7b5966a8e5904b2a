"""Text rules as Column expressions: lines, titles, descriptions, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.bind import let

# The characters ``str.strip`` removes and the line boundaries of
# ``str.splitlines``. The class form is for patterns that start with (?U).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\s\x1c\x1d\x1e\x1f"
EOL = r"\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
LINE_BREAK = r"\R|[\x1c-\x1e]"

# Description width and its mark for cut text.
WIDTH = 180
ELLIPSIS = "…"

TOKEN = "[a-z0-9]+"

# First line that is neither blank nor a heading. Blank lines are swallowed by
# the possessive run, so no group repeats and long heads cannot overflow.
_BODY = rf"(?U)(?:^|[{EOL}])[{SPACE}]*+([^#{SPACE}][^{EOL}]*)"

# Longest prefix that leaves room for the mark and ends where a wrapped line
# may break: before whitespace, after a word hyphen, around a dash run.
_LETTER = r"[^\d\W]"
_PUNCT = r"""[\w!"'&.,?]"""
_BREAK = (
    rf"(?:(?=\s)"
    rf"|(?<={_LETTER}{_LETTER}-|{_LETTER}-{_PUNCT}-)(?={_LETTER}-?{_LETTER})"
    rf"|(?<={_PUNCT})(?=-{{2,}}\w)"
    rf"|(?<={_PUNCT}-{{2,9}})(?=\w))"
)
_BREAKABLE = rf"(?U)^(.{{0,{WIDTH - 1}}}){_BREAK}"
_FITS = rf"(?U)^.{{1,{WIDTH}}}(?:{_BREAK}|$)"


def trim(text: Column) -> Column:
    """Strip every kind of leading and trailing whitespace, not only spaces."""
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Trim, then turn each whitespace run into one space."""
    return F.regexp_replace(trim(text), rf"(?U)[{SPACE}]+", " ")


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def shorten(text: Column) -> Column:
    """One line of at most 180 characters, cut at a word boundary; within a
    word that is longer than a line, behind its last hyphen that fits."""

    def cut(flat: Column) -> Column:
        return let(F.regexp_extract(flat, _BREAKABLE, 1), lambda head: F.concat(_with_part(flat, head), F.lit(ELLIPSIS)))

    return let(squeeze(text), lambda flat: F.when(F.char_length(flat) <= WIDTH, flat).otherwise(cut(flat)))


def _with_part(flat: Column, head: Column) -> Column:
    """``head``, with the part of the word behind it that may stand on its line."""
    at = F.char_length(head)
    rest = F.substring(flat, at + 1, F.char_length(flat))

    def long_word(word: Column) -> Column:
        start = F.char_length(flat) - F.char_length(word)
        part = F.regexp_extract(F.substring(word, F.lit(1), WIDTH - start), r"^(.*-)", 1)
        taken = part.rlike("[^-]") & (start + F.char_length(part) < WIDTH) & ~word.rlike(_FITS)
        return F.when(taken, F.concat(F.substring(flat, F.lit(1), start), part)).otherwise(trim(head))

    return let(F.ltrim(rest), long_word)


def title(text: Column, fallback: Column) -> Column:
    """The last non-empty heading above the first body line, else ``fallback``."""
    # The match is the first of its kind, so nothing above it repeats it and
    # the text up to its first occurrence is the block of headings and blanks.
    match = F.regexp_extract(text, _BODY, 0)
    lead = let(match, lambda m: F.when(m == "", text).otherwise(F.call_function("substring_index", text, m, F.lit(1))))
    heads = F.transform(lines(lead), lambda line: trim(F.ltrim(trim(line), F.lit("# "))))
    named = F.filter(heads, lambda head: head != "")
    return F.coalesce(F.try_element_at(named, F.lit(-1)), fallback)


def description(text: Column, title_col: Column) -> Column:
    """The first body line, else the title, shortened."""
    body = F.regexp_extract(text, _BODY, 1)
    return shorten(F.when(body == "", title_col).otherwise(body))


def search_text(title_col: Column, description_col: Column, text: Column) -> Column:
    """Title, description and text together: this is what weighs title words."""
    return F.concat_ws("\n", title_col, description_col, text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def term_counts(text: Column) -> Column:
    """Distinct tokens of a text with their counts, as array<struct<term, tf>>.

    A document lies in one row, so its terms are counted there: sort the
    tokens, find where each run starts, take run lengths. Nothing is shuffled
    and no token row is ever produced; only distinct terms leave the row.
    """

    def runs(tok: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(tok) - 1),
            lambda i: ~F.get(tok, i).eqNullSafe(F.get(tok, i - 1)),
        )
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda start, k: F.struct(
                    F.get(tok, start).alias("term"),
                    (F.coalesce(F.get(at, k + 1), F.size(tok)) - start).cast("bigint").alias("tf"),
                ),
            ),
        )

    def counted(tok: Column) -> Column:
        empty = F.array().cast("array<struct<term:string,tf:bigint>>")
        return F.when(F.size(tok) == 0, empty).otherwise(runs(tok))

    return let(F.sort_array(tokens(text)), counted)


def vector_norm(counts: Column) -> Column:
    """Euclidean length of a count vector; 1.0 for an empty one."""
    squares = F.aggregate(
        counts, F.lit(0).cast("bigint"), lambda total, pair: total + pair.tf * pair.tf
    )
    return let(squares, lambda sq: F.when(sq == 0, F.lit(1.0)).otherwise(F.sqrt(sq.cast("double"))))


def with_term_counts(df: DataFrame, text: Column) -> DataFrame:
    """Add ``terms`` and ``norm``."""
    return df.withColumn("terms", term_counts(text)).withColumn("norm", vector_norm(F.col("terms")))


def term_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row per (document, term). The outer form keeps Spark from deriving a
    size predicate, which would evaluate the counting a second time."""
    return df.select(*keep, F.inline_outer("terms")).filter(F.col("term").isNotNull())
