import random
import re

import pytest

from folioscope.llm.wordpiece import HEAD, Automaton, token_counts, vocabulary


def greedy(word, pieces):
    """Cut off the longest piece again and again."""
    rest, n, first = HEAD + word, 0, True
    while rest:
        size = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces and (first or rest[0] != HEAD)), 0)
        if not size:
            return None
        rest, n, first = rest[size:], n + 1, False
    return n


def test_automaton_equals_greedy():
    rng = random.Random(1)
    for _ in range(1500):
        pieces = {"".join(rng.choice("ab" + HEAD) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = Automaton(pieces)
        for _ in range(15):
            word = "".join(rng.choice("abc" + HEAD if rng.random() < 0.2 else "ab") for _ in range(rng.randint(1, 12)))
            assert automaton.count(word) == greedy(word, pieces), (word, pieces)


def test_equals_a_word_piece_tokenizer():
    models = pytest.importorskip("tokenizers.models")
    rng = random.Random(2)
    starts = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(60)}
    inner = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(60)}
    names = ["[UNK]", *sorted(starts), *(f"##{p}" for p in sorted(inner))]
    model = models.WordPiece({p: i for i, p in enumerate(names)}, unk_token="[UNK]", max_input_chars_per_word=1000)
    automaton = Automaton([*(HEAD + p for p in starts), *inner])
    for _ in range(2000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 20)))
        tokens = [t.value for t in model.tokenize(word)]
        assert automaton.count(word) == (None if tokens == ["[UNK]"] else len(tokens))


def test_linear_in_the_word():
    """Every character is taken once, however far matches reach back."""
    automaton = Automaton([HEAD + "a", "a", "a" * 50 + "b"])
    assert automaton.count("a" * 200_000) == 200_000


def test_table(spark, table, awkward):
    pieces = [HEAD + "w", HEAD + "a", "a", "w", "x", *"0123456789", HEAD + "line", HEAD + "line" + "s"]
    docs = table(awkward, ("n_words", "n_tokens", "n_unknown", "key"))
    out = token_counts(docs, pieces)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "key", "n_words", "n_tokens", "n_unknown"]
    got = out.collect()
    assert len(got) == len(awkward)
    want = []
    for doc, text, *_ in awkward:
        counts = [greedy(w, set(pieces)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        want.append((doc, len(counts), sum(1 if c is None else c for c in counts), counts.count(None)))
    assert sorted(((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in got), key=str) == sorted(want, key=str)
    assert token_counts(table([]), pieces).collect() == []


def test_public_vocabulary(spark):
    public = pytest.importorskip("public_tokenizers")
    from folioscope.llm.wordpiece import op10_token_counts

    pieces = vocabulary(public.path("piece_bpe_32k.model"))
    assert 30_000 < len(pieces) < 32_000 and "<s>" not in pieces
    root, known = "/root/testdata/sf0.001", set(pieces)
    got = {r.doc_id: r for r in op10_token_counts(spark, root).collect()}
    for r in spark.read.parquet(f"{root}/documents.parquet").where("doc_id % 5 = 0").select("doc_id", "text").collect():
        counts = [greedy(w, known) for w in r.text.split()]
        assert (got[r.doc_id].n_words, got[r.doc_id].n_tokens) == (len(counts), sum(c or 1 for c in counts))
