import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate as D


def words(text):
    return re.sub(r"[!-/:-@\[-`{-~\x09-\x0D ]+", " ", (text or "").lower()).split(" ")


def brute(docs, items, width=5, least=0.8):
    out = set()
    for item, text in items:
        own = [w for w in words(text) if w]
        if not own:
            continue
        n = min(width, len(own))
        mine = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for doc, long in docs:
            w = [x for x in words(long) if x]
            have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            share = len(mine & have) / len(mine)
            if share >= least:
                out.add((doc, item, share))
    return out


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.choice([1, 2, 4, 5, 6, 9, 20, 40, 90, 400])) for _ in range(80)]
    docs = []
    for k in range(150):
        doc = say(rng.choice([0, 3, 50, 500, 5000]))
        for item in rng.sample(items, rng.choice([0, 1, 2])):
            item = list(item)
            for _ in range(rng.choice([0, 0, 1, 2])):
                item[rng.randrange(len(item))] = "changed"
            if rng.random() < 0.3:  # in two places
                half = len(item) // 2
                at = rng.randrange(len(doc) + 1)
                doc[at:at] = item[half:]
                item = item[: half + 4]
            at = rng.randrange(len(doc) + 1)
            doc[at:at] = item
        text = " ".join(doc)
        docs.append((k, text.upper().replace(" W1", ", W1") if k % 3 == 0 else text))
    return docs, [(i, " ".join(x)) for i, x in enumerate(items)]


@pytest.mark.parametrize("small", [False, True])
def test_finds_what_is_there(spark, table, monkeypatch, small):
    if small:  # several passes, vector operations of a few words
        monkeypatch.setattr(D, "PASS_WORDS", 300)
        monkeypatch.setattr(D, "_BYTES_AT_ONCE", 500)
        monkeypatch.setattr(D, "_WORDS_AT_ONCE", 64)
        monkeypatch.setattr(D, "_powers", D._powers.__wrapped__)
    docs, items = corpus(random.Random(11))
    known = spark.createDataFrame(items, "item_id int, text string")
    got = {tuple(r) for r in D.leaks(table(docs), known).collect()}
    want = brute(docs, items)
    assert len(want) > 60 and got == want
    kept = {r.doc_id for r in D.clean(table(docs), known).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _, _ in want}


def test_hashes_in_pieces(monkeypatch):
    text = D.plain(" ".join(f"word{i * 37 % 501}" for i in range(4000)))
    whole = D._word_hashes([text, b"", text[:100]])
    monkeypatch.setattr(D, "_BYTES_AT_ONCE", 200)
    cut = D._word_hashes([text, b"", text[:100]])
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert len(set(whole[0].tolist())) == len(set(text.split()) | set(text[:100].split()))


def test_awkward(spark, table, awkward):
    extra = ("item_id", "containment", "_text", "kept")
    docs = table(awkward, extra)
    items = spark.createDataFrame(
        [(1, awkward[0][1]), (1, awkward[0][1]), (2, None), (3, ""), (None, "another line OF words, that goes"), (4, "w1x0 w2x0 w3x0 w4x0 w5x0 w6x0"), (5, "ärger")],
        "item_id long, text string",
    )
    got = sorted(((r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, 1, 1, None) for i in (1, None)] + [(5, 4), (6, 5)], key=str)
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x in (None, None, 2, 3, 4, 7))
    assert D.leaks(table([]), items).collect() == [] and D.clean(table([]), items).collect() == []
    none = items.where(F.lit(False))
    assert D.leaks(docs, none).collect() == [] and D.clean(docs, none).count() == len(awkward)


@pytest.mark.parametrize("least", [0.2, 0.5])
def test_low_containment_and_single_shingles(spark, table, least):
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [say(rng.choice([1, 3, 5, 6, 30, 100])) for _ in range(150)]
    docs = []
    for k in range(120):
        doc = say(400)
        for item in rng.sample(items, 3):
            n = max(min(len(item), 5), round(len(item) * rng.choice([0.25, 0.6, 1])))
            at = rng.randrange(len(doc))
            doc[at:at] = item[:n]
        docs.append((k, " ".join(doc)))
    texts = [(i, " ".join(x)) for i, x in enumerate(items)]
    wanted = spark.createDataFrame(texts, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.containment) for r in D.leaks(table(docs), wanted, least=least).collect()}
    want = brute(docs, texts, least=least)
    assert got == want and len(want) > 150
