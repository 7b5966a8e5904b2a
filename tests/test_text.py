import math
import random
import re
import textwrap
from collections import Counter

from pyspark.sql import functions as F

from folioscope.functions import text as T

ALPHABET = ["a", "b", "Z", "9", "é", "文", " ", "  ", "\t", "\n", "\r\n", "\u2028", "\xa0", "\u3000", "#", "# ", "-", "--", ".", "!", "_", "😀"]


def rule_title_description(text, fallback):
    """Plain restatement of the rule on the standard library."""
    name = fallback
    for line in (part.strip() for part in text.splitlines()):
        if line and not line.startswith("#"):
            return name, textwrap.shorten(line, width=180, placeholder="…")
        name = line.lstrip("# ").strip() or name
    return name, textwrap.shorten(name, width=180, placeholder="…")


def random_texts(n, length):
    rng = random.Random(11)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(length))) for _ in range(n)]


HEADS = [
    ("# A\n## B\n\nbody", "B", "body"),
    ("", "stem", "stem"),
    ("# \n##\nx", "stem", "x"),
    ("#tag\nb", "tag", "b"),
    ("\ufeff# T\nbody", "stem", "\ufeff# T"),
    ("# only", "only", "only"),
    ("#  # x #\ny", "x #", "y"),
    ("---\nfm: 1\n---\n# T", "stem", "---"),
    ("# T\u2028body", "T", "body"),
]


def test_title_and_description_examples(column):
    rows = [text for text, _, _ in HEADS]
    assert column(lambda v: T.title(v, F.lit("stem")), rows) == [t for _, t, _ in HEADS]
    assert column(lambda v: T.description(v, T.title(v, F.lit("stem"))), rows) == [d for _, _, d in HEADS]


def test_title_and_description_random(column):
    rows = random_texts(600, 30)
    want = [rule_title_description(r, "stem") for r in rows]
    assert column(lambda v: T.title(v, F.lit("stem")), rows) == [t for t, _ in want]
    assert column(lambda v: T.description(v, T.title(v, F.lit("stem"))), rows) == [d for _, d in want]


def test_many_headings_do_not_overflow(column):
    text = "# h\n\n" * 20000 + "# last\nbody"
    assert column(lambda v: T.title(v, F.lit("stem")), [text]) == ["last"]
    assert column(lambda v: T.description(v, F.lit("t")), [text]) == ["body"]


SHORT = [
    ("x" * 200, "…"),
    ("ab " + "x" * 200, "ab…"),
    ("x" * 168 + " well-known-thing", "x" * 168 + " well-…"),
    ("x" * 170 + " a-bb well-known-thing", "x" * 170 + " a-bb…"),
    ("a \t b" + "c" * 170, "a b" + "c" * 170),
]


def test_shorten_examples(column):
    assert column(T.shorten, [s for s, _ in SHORT]) == [w for _, w in SHORT]


def test_shorten_random(column):
    rng = random.Random(5)
    parts = ["a", "bc", "word", "well-known", "-", "--", "---", "x1", "9", "é", "😀", ",", ".", "it's", "\t", "e-mail"]
    rows = []
    for _ in range(1500):
        line = ""
        while len(line) < 260:
            line += rng.choice(parts) + rng.choice(["", " ", " ", "  "])
        rows.append(line)
    want = [textwrap.shorten(r, width=180, placeholder="…") for r in rows]
    assert column(T.shorten, rows) == want


def test_shorten_breaks_overlong_words_at_hyphens(column):
    rng = random.Random(12)
    rows = ["123456-" * 40, "ab " + "123456-" * 40, "x" * 400, "-" * 400, "a" * 178 + " " + "1-" * 200, "1" * 179 + "-" + "1" * 30]
    for _ in range(1500):
        words = ["".join(rng.choice(["12", "3", "4-"]) for _ in range(rng.choice([3, 20, 100, 119, 135, 180, 250]))) for _ in range(6)]
        rows.append(" ".join(words))
    assert column(T.shorten, rows) == [textwrap.shorten(r, width=180, placeholder="…") for r in rows]


def test_trim_matches_strip(column):
    rows = random_texts(300, 12) + [" " * 5000 + "a" + " " * 5000 + "b"]
    assert column(T.trim, rows) == [r.strip() for r in rows]


def test_tokens(column):
    rows = random_texts(200, 40) + ["É a1 B-c", "文档", "K\u212a"]
    assert column(T.tokens, rows) == [re.findall("[a-z0-9]+", r.lower()) for r in rows]


def test_term_counts_and_norm(spark):
    rows = [(i, t) for i, t in enumerate(random_texts(200, 60) + ["", "c c c", "a a b"])]
    df = T.with_term_counts(spark.createDataFrame(rows, "id int, text string"), F.col("text"))
    got = {r.id: ({p.term: p.tf for p in r.terms}, r.norm) for r in df.collect()}
    for i, text in rows:
        want = Counter(re.findall("[a-z0-9]+", text.lower()))
        assert got[i][0] == want
        assert got[i][1] == (math.sqrt(sum(v * v for v in want.values())) or 1.0)
    unnested = T.term_rows(df, "id").groupBy("id").agg(F.sum("tf").alias("n")).collect()
    assert {r.id: r.n for r in unnested} == {
        i: len(re.findall("[a-z0-9]+", t.lower())) for i, t in rows if re.search("[a-z0-9]", t.lower())
    }
