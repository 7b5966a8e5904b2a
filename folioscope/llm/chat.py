"""Chat training windows: turn-aligned spans within a token budget, with a loss mask."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import matched, n_words, stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: Strings that chat templates use as marks. None occurs in an escaped text.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

#: Tokens of a turn's marks.
MARKS = 4
#: Turns of a conversation are numbered in blocks of so many turn numbers.
_BLOCK = 256


def escape(text: Column) -> Column:
    """Double each backslash, then put one behind the first character of each control string."""
    starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), starts, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``ordinal`` and, for ``tokens`` and ``room``, the sums over the turns before.

    Sums within blocks of turn numbers, and sums of whole blocks before: a
    conversation that holds most of the table is spread over tasks.
    """
    rows = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / _BLOCK).cast("long"))
    order = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    within = (
        rows.withColumn("ordinal", F.row_number().over(order))
        .withColumn("tokens_before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .withColumn("room_before", F.coalesce(F.sum("room").over(before), F.lit(0)))
    )
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum("room").alias("r"))
    blocks = blocks.select("conv", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("n", "t", "r")])
    return (
        matched(within, blocks, ["conv", "block"])
        .select("conv", "role", "text", "tokens", "long", "q", "is_system",
                (F.col("ordinal") + F.col("n")).alias("ordinal"),
                (F.col("tokens_before") + F.col("t")).alias("tokens_before"),
                (F.col("room_before") + F.col("r")).alias("room_before"))
    )


def windows(
    turns: DataFrame,
    *,
    budget: int,
    history_turns: int,
    history_tokens: int,
    tokens: Column | None = None,
) -> DataFrame:
    """Training windows of the conversations in ``turns`` (conv_id, turn, role, text).

    A row per window: ``conv_id``, ``window`` (ascending within the
    conversation), ``text``, ``loss`` (spans in code points, array of
    (start, end)), ``n_repeated`` (turns at its head that were in earlier
    windows), ``n_tokens``, ``over_budget``.

    Each turn is new in exactly one window. With s the budget less the system
    turn and the room for history, turns fall into windows by the prefix sum of
    tokens before them, in steps of 3/4 s; a turn above s/4 has a window of its
    own, so that the others overhang a step by s/4 at most and the budget
    holds. Only a turn (with its system turn) that is too long in itself goes
    beyond it: its window is marked, and nothing is cut. A window opens with the
    conversation's first system turn, if an earlier window had it, then up to
    ``history_turns`` turns before it (copies of the system turn left out), of up to ``history_tokens`` tokens in
    all; those are outside the loss. The loss covers each new assistant turn's
    text, escaped as it stands.

    Turns go by number (null first), then role, then text; repeated rows are
    turns of their own. Null roles and texts count as empty; a null id is a
    conversation. Other columns are not read. No turns give no windows.
    """
    rows = turns.select(
        F.col("conv_id").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("tokens", (n_words(F.col("text")) if tokens is None else tokens) + MARKS)
    # each turn learns what the system turn costs and whether it is that turn, not what it says
    first = F.min(F.struct("turn", "text", "tokens")).alias("first")
    system = rows.where("role = 'system'").groupBy("conv").agg(first).select(
        "conv", F.struct("first.turn", F.xxhash64("first.text").alias("digest"), "first.tokens").alias("system"))
    rows = matched(rows, system, ["conv"], "left")
    is_system = (F.col("role") == "system") & F.struct("turn", F.xxhash64("text")).eqNullSafe(F.struct("system.turn", "system.digest"))
    rows = rows.withColumn("is_system", is_system)
    # the room for new turns, and the step
    room = F.greatest(F.lit(4), F.lit(budget - history_tokens) - F.coalesce("system.tokens", F.lit(0)))
    rows = rows.withColumn("q", F.floor(room * 3 / 4)).withColumn("long", F.col("tokens") * 4 > room)
    rows = rows.withColumn("room", F.when(F.col("long"), F.col("q") * 2).otherwise(F.col("tokens")))
    window = F.floor(F.col("room_before") / F.col("q")) * 2 + F.col("long").cast("int")
    placed = stored(_numbered(rows).withColumn("window", window).drop("q", "long", "room_before"), "turns")

    firsts = placed.groupBy("conv", "window").agg(F.min(F.struct("ordinal", "tokens_before")).alias("first"))
    starts = stored(firsts.select("conv", "window", "first.*"), "windows")
    said = placed.where("is_system").groupBy("conv").agg(F.min(F.struct("ordinal", "role", "text", "tokens")).alias("head"))
    heads = matched(starts, said, ["conv"]).where(F.col("ordinal") > F.col("head.ordinal")).select(
        "conv", "window", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ordinal"), "head.role", "head.text", "head.tokens")
    wanted = starts.select(F.col("conv"), F.col("window").alias("into"), F.col("tokens_before").alias("until"),
                           F.explode(F.sequence(F.lit(1), F.lit(max(1, history_turns)))).alias("back"), F.col("ordinal").alias("at"))
    wanted = wanted.where(F.col("back") <= history_turns).select("conv", "into", "until", (F.col("at") - F.col("back")).alias("ordinal"))
    past = matched(placed.drop("window"), wanted, ["conv", "ordinal"]).where(
        (F.col("until") - F.col("tokens_before") <= history_tokens) & ~F.col("is_system"))
    past = past.select("conv", F.col("into").alias("window"), F.lit(1).alias("kind"), "ordinal", "role", "text", "tokens")
    new = placed.select("conv", "window", F.lit(2).alias("kind"), "ordinal", "role", "text", "tokens")

    turn = F.struct("kind", "ordinal", "role", "text", "tokens")
    grouped = heads.unionByName(past).unionByName(new).groupBy("conv", "window").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    shown = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), _role_out(t.role), F.lit("\n")).alias("head"),
        escape(t.text).alias("body"),
        ((t.kind == 2) & (t.role == "assistant")).alias("target"),
        (t.kind < 2).cast("int").alias("repeated"),
        t.tokens.alias("tokens")))
    tail = CLOSE + "\n"
    none = F.array().cast("array<struct<start:int,end:int>>")

    def place(state: Column, t: Column) -> Column:
        start = state.at + F.length(t.head)
        end = start + F.length(t.body)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(tail)).alias("at"), F.when(t.target, F.concat(state.spans, span)).otherwise(state.spans).alias("spans"))

    out = grouped.select("conv", "window", shown.alias("turns"))
    n_tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t.tokens)
    return out.select(
        F.col("conv").alias("conv_id"),
        "window",
        F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(tail))), "").alias("text"),
        F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("spans")), place, lambda s: s.spans).alias("loss"),
        F.aggregate("turns", F.lit(0), lambda n, t: n + t.repeated).alias("n_repeated"),
        n_tokens.alias("n_tokens"),
        (n_tokens > budget).alias("over_budget"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a window's text, as an array of (role, text)."""
    inner = re.escape(OPEN) + "(.*?)" + re.escape(CLOSE) + "\\n"
    parts = F.regexp_extract_all(text, F.lit(f"(?s){inner}"), 1)
    return F.transform(parts, lambda p: F.struct(
        _role_in(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text")))


def read_loss(text: Column, loss: Column) -> Column:
    """What a window's loss mask covers, unescaped."""
    spans = F.transform(loss, lambda s: unescape(F.substring(text, s.start + 1, s.end - s.start)))
    return F.array_join(spans, "")


BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 256
_MARKED = "</s>[INST] ok [/INST]"


def op6_chat_windows(spark, root) -> DataFrame:
    """Digests of the windows, each conversation's put together again.

    The digest of a whole conversation needs its turns in one place, whatever
    its length; ``windows`` itself does not.
    """
    turns = spark.read.parquet(f"{root}/conversations.parquet").select("conv_id", F.col("turn").cast("long"), "role", "text")
    extra = spark.sql(f"VALUES (-1L, 0L, 'user', '{_MARKED}'), (-1L, 1L, 'assistant', '{_MARKED}') AS t(conv_id, turn, role, text)")
    shown = windows(turns.unionByName(extra), budget=BUDGET, history_turns=HISTORY_TURNS, history_tokens=HISTORY_TOKENS)
    turns_of = F.expr("slice(turns, n_repeated + 1, size(turns))")
    back = shown.withColumn("turns", read_turns(F.col("text"))).select(
        "conv_id", "window",
        F.array_join(F.transform(turns_of, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("said"),
        (F.size("turns") - F.col("n_repeated")).cast("long").alias("n"),
        read_loss(F.col("text"), F.col("loss")).alias("target"),
        F.length("text").cast("long").alias("chars"),
    )
    per = back.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "said", "target"))).alias("parts"))
    target = F.array_join("parts.target", "")
    return per.select(
        "conv_id", "n_turns",
        F.sha2(F.array_join("parts.said", ""), 256).alias("turns_sha256"),
        F.length(target).cast("long").alias("loss_chars"),
        F.sha2(target, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql() -> str:
    escaped = "replace({}, '\\', '\\\\')"
    for c in CONTROL:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    text, role = escaped.format("text"), escaped.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")
    return rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_MARKED}'), (-1, 1, 'assistant', '{_MARKED}')),
r AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {MARKS} AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ordinal,
    length({text}) + length({role}) + {len(OPEN) + len(CLOSE) + 2} AS chars FROM rows_),
sys AS (SELECT conv_id, min(ordinal) AS pos FROM r WHERE role = 'system' GROUP BY conv_id),
st AS (SELECT sys.conv_id, pos, tokens AS t, chars AS c FROM sys JOIN r ON r.conv_id IS NOT DISTINCT FROM sys.conv_id AND ordinal = pos),
s AS (
  SELECT r.*, pos, t, c, greatest(4, {BUDGET - HISTORY_TOKENS} - coalesce(t, 0)) AS room
  FROM r LEFT JOIN st ON r.conv_id IS NOT DISTINCT FROM st.conv_id),
u AS (SELECT *, floor(room * 3 / 4)::BIGINT AS q, tokens * 4 > room AS long FROM s),
p AS (
  SELECT *, coalesce(sum(CASE WHEN long THEN 2 * q ELSE tokens END) OVER w, 0) AS before,
    coalesce(sum(tokens) OVER w, 0) AS tokens_before FROM u
  WINDOW w AS (PARTITION BY conv_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
placed AS (SELECT *, floor(before / q) * 2 + long::INT AS win FROM p),
f AS (
  SELECT conv_id, win, min(ordinal) AS first, min(tokens_before) AS until, any_value(pos) AS pos, any_value(c) AS c
  FROM placed GROUP BY ALL),
parts AS (
  SELECT conv_id, chars FROM placed
  UNION ALL SELECT conv_id, c FROM f WHERE pos < first
  UNION ALL SELECT f.conv_id, x.chars FROM f JOIN placed x ON x.conv_id IS NOT DISTINCT FROM f.conv_id
    AND x.ordinal BETWEEN f.first - {HISTORY_TURNS} AND f.first - 1 AND f.until - x.tokens_before <= {HISTORY_TOKENS}
    AND x.ordinal IS DISTINCT FROM f.pos),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY ordinal) AS said,
    coalesce(string_agg(text, '' ORDER BY ordinal) FILTER (role = 'assistant'), '') AS target FROM r GROUP BY conv_id)
SELECT w.conv_id, n_turns, sha256(said) AS turns_sha256, length(target) AS loss_chars, sha256(target) AS loss_sha256,
  formatted_chars
FROM whole w JOIN (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM parts GROUP BY conv_id) x
  ON w.conv_id IS NOT DISTINCT FROM x.conv_id
"""


SQL = _sql()
