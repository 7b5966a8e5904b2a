import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def made(spark, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(f"<{c}>") for c in extra}) if extra else df


def shown(df, **settings):
    settings = {"budget": 60, "history_turns": 2, "history_tokens": 20} | settings
    out = chat.windows(df, **settings)
    return out.withColumn("turns", chat.read_turns(F.col("text"))).withColumn("target", chat.read_loss(F.col("text"), F.col("loss"))).collect()


TEXTS = ["", "plain", "\\", "\\\\<s>", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nno", "<<s>", "a\\<\\/s>", "<<SYS>> x <</SYS>>", "ü𝒳\n\r\t", "[INST", "%0A\n%"]


@pytest.mark.parametrize("text", TEXTS)
def test_escape_is_reversible_and_hides_marks(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert row.u == text
    assert not any(c in row.e for c in chat.CONTROL)


def test_windows(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(60):
        if conv % 3 == 0:
            rows.append((conv, 0, "system", "be " * rng.randint(1, 8)))
        for turn in range(1, rng.randint(2, 30)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "odd\nrole%"]), rng.choice(TEXTS) + " w" * rng.choice([1, 5, 20, 90])))
    rng.shuffle(rows)
    out = shown(made(spark, rows))
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.conv_id, r.window)):
        by[r.conv_id].append(r)
    cost = lambda role, text: len(text.split()) + chat.MARKS
    for conv, windows in by.items():
        turns = [(r[2], r[3]) for r in sorted(x for x in rows if x[0] == conv)]
        system = next((t for t in turns if t[0] == "system"), None)
        done = 0
        for w in windows:
            got = [(t.role, t.text) for t in w.turns]
            n = len(got) - w.n_repeated
            assert n > 0 and got[w.n_repeated :] == turns[done : done + n]
            assert w.target == "".join(t for role, t in turns[done : done + n] if role == "assistant")
            head = got[: w.n_repeated]
            if system and done:
                assert head[0] == system
                head = head[1:]
            past = [t for t in turns[:done] if t != system]
            assert len(head) <= 2 and sum(cost(*t) for t in head) <= 20
            assert head == past[len(past) - len(head) :]
            if len(head) < 2 and len(head) < len(past) and past[-len(head) - 1] == turns[done - len(head) - 1]:
                assert sum(cost(*t) for t in past[-len(head) - 1 :]) > 20
            assert w.n_tokens == sum(cost(*t) for t in got)
            assert w.over_budget == (w.n_tokens > 60)
            if w.over_budget:  # one turn that is too long in itself
                assert n == 1
            done += n
        assert done == len(turns)


def test_one_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(3000)] + [(2, 0, "user", "x")]
    out = shown(made(spark, rows), budget=200)
    text = "".join(r.target for r in sorted(out, key=lambda r: r.window) if r.conv_id == 1)
    assert text == "".join(f"text {t}" for t in range(1, 3000, 2))
    assert not any(r.over_budget for r in out)
    assert sum(r.n_tokens for r in out) / len(out) > 100


def test_awkward(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, "assistant", "n"),
            (None, None, None, None), (2, 5, "assistant", " ".join(["long"] * 50_000)), (1, -7, "user", "minus")]
    out = shown(made(spark, rows, ("conv", "block", "room", "q", "window", "tokens", "n", "ordinal")), budget=1000)
    got = {r.conv_id: r for r in out}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "first"), ("user", "minus"), ("", ""), ("assistant", "a"), ("assistant", "a")]
    assert got[1].target == "aa" and got[None].target == "n" and len(got[2].target) == 5 * 50_000 - 1
    assert got[2].over_budget and not got[1].over_budget
    assert shown(made(spark, [])) == []


def test_query(spark, tmp_path):
    rows = [(3, 1, "assistant", "b<s>"), (3, 0, "user", None), (4, 0, "user", "only")]
    made(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op6_chat_windows(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    mark = "</s>[INST] ok [/INST]"
    assert (got[3].n_turns, got[3].turns_sha256) == (2, sha("user\n\nassistant\nb<s>\n"))
    assert (got[3].loss_chars, got[3].loss_sha256) == (4, sha("b<s>"))
    assert (got[4].loss_chars, got[4].loss_sha256) == (0, sha(""))
    assert (got[-1].turns_sha256, got[-1].loss_sha256) == (sha(f"user\n{mark}\nassistant\n{mark}\n"), sha(mark))
