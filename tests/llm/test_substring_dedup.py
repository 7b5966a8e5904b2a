import random
import re

import pytest

from folioscope.llm import substring_dedup as S


def brute(rows, separator="\n", least=5, sentences=False):
    """Walk the documents in order and drop what was there before."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        at, spans, kept = 0, [], []
        for line in text.split(separator):
            found = []
            for sentence in re.split(r"(?<=[.!?])(?=[ \t])", line) if sentences else [line]:
                # white space belongs to what is before it
                space = len(sentence) - len(sentence.lstrip(" \t")) if found else 0
                if found:
                    found[-1] += sentence[:space]
                found.append(sentence[space:])
            units, held = [], ""
            for sentence in found:
                held += sentence
                if len(sentence.split()) >= least:
                    units.append(held)
                    held = ""
            units += [held] if held or not units else []
            left, cut, last = "", False, False
            for unit in units:
                words = unit.lower().split()
                last = len(words) >= least and tuple(words) in seen
                if last:
                    spans.append((at, at + len(unit)))
                    cut = True
                else:
                    left += unit
                if len(words) >= least:
                    seen.add(tuple(words))
                at += len(unit)
            if not cut or left:
                kept.append(left.rstrip() if last else left)
            at += len(separator)
        out[doc] = (separator.join(kept), spans)
    return out


@pytest.mark.parametrize("sentences", [False, True])
@pytest.mark.parametrize("separator", ["\n", "\n\n"])
def test_equals_a_walk_in_order(spark, table, separator, sentences):
    rng = random.Random(9)
    lines = [" ".join(rng.choice(["a", "É", "word", "𝒳", "other", "x.", "y!?", "3.5"]) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    dress = lambda s: rng.choice([s, s.upper(), "  " + s.replace(" ", "\t ", 1)])
    mixed = lambda: rng.choice(["\n", "\n\n", separator, " ", ". "]).join(dress(rng.choice(lines)) for _ in range(rng.randint(0, 15)))
    rows = [(i, mixed()) for i in range(300)]
    want = brute(rows, separator, sentences=sentences)
    got = S.without_repeats(table(rows).repartition(6), separator=separator, sentences=sentences).collect()
    for r in got:
        spans = [(s.start, s.end) for s in r.removed or []]
        assert (r.text, spans) == want[r.doc_id]
        original = dict(rows)[r.doc_id]
        assert all(len(original[a:b].split()) >= 5 for a, b in spans)
    assert len(got) == len(rows) and sum(bool(w[1]) for w in want.values()) > 50


def test_a_passage_within_lines(spark, table):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("etaoinshrdlu") + str(rng.randint(0, 999)) for _ in range(n)).capitalize() + "."
    passage = " ".join(say(n) for n in (9, 3, 12, 2, 8, 11, 10))
    rows = []
    for i in range(60):
        own = [say(rng.randint(3, 14)) for _ in range(12)]
        words = " ".join(own).split(" ")
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage.split(" ")
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.text for r in S.without_repeats(table(rows)).collect()}
    inner = [s for s in passage.split(". ")[2:] if len(s.split()) >= 5]
    for i, text in rows:
        if i % 3 == 0 and i:
            assert not any(s in got[i] for s in inner)
            assert len(text.split()) - len(got[i].split()) >= 41
        else:
            assert got[i] == text


def test_a_line_everyone_has(spark, table):
    rows = [(i, f"this line is in every document\nbut this line is only in number {i}") for i in range(2000)]
    got = S.without_repeats(table(rows)).collect()
    assert {r.doc_id for r in got if not r.removed} == {0}
    assert all(r.text == f"but this line is only in number {r.doc_id}" for r in got if r.doc_id)


def test_awkward(spark, table, awkward):
    docs = table(awkward, ("key", "row", "start", "end", "high", "low", "first", "id", "removed"))
    out = S.without_repeats(docs, min_words=3)
    assert set(out.columns) == set(docs.columns)
    rows = out.collect()
    assert len(rows) == len(awkward) and rows[0].high == "<high>"
    one = sorted((r.text for r in rows if r.doc_id == 1), key=len)
    # rows alike in id and text come out alike; a null id comes last
    first, second = awkward[0][1].split("\n")
    assert one in ([second + " differently", *[awkward[0][1]] * 2], [second, second, awkward[2][1]])
    by = {(r.doc_id, r.text) for r in rows}
    assert {(None, ""), (None, None), (2, None), (3, ""), (4, " \n\t\n "), (7, "a"), (5, awkward[9][1])} <= by
    assert S.without_repeats(table([])).collect() == []
