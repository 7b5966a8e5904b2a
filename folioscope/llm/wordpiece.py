"""Token counts by greedy longest match, in time linear in the text.

The pieces of a vocabulary form a trie. Every node has a failure link: where
matching goes on once the longest pieces of the node's string are cut off, and
how many those are. So each character is read once, and no piece is built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Opens a word in the vocabulary.
HEAD = "▁"
#: Pieces that a vocabulary may have, as each task holds it whole.
MAX_PIECES = 1_000_000
_UNKNOWN = 1 << 40


class Automaton:
    """Trie with failure links and the number of pieces that each pops.

    Pieces that open a word start with ``head``; the others go on within one.
    Node 0 is the root for the latter; ``start`` is where words begin. ``head``
    itself may be a piece.
    """

    def __init__(self, pieces: Iterable[str], head: str = HEAD) -> None:
        self.goto: list[dict[str, int]] = [{}]
        ends = [False]

        def add(node: int, text: str) -> int:
            for c in text:
                if c not in self.goto[node]:
                    self.goto[node][c] = len(self.goto)
                    self.goto.append({})
                    ends.append(False)
                node = self.goto[node][c]
            return node

        self.start = add(0, head)
        for piece in pieces:
            if piece:
                ends[add(0, piece)] = True
        nothing = -1
        self.fail, self.pops = [nothing] * len(self.goto), [0] * len(self.goto)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, child in self.goto[node].items():
                queue.append(child)
                if ends[child]:
                    self.fail[child], self.pops[child] = 0, 1
                    continue
                at, popped = self.fail[node], self.pops[node]
                while at != nothing and (c not in self.goto[at] or at == 0 and c == head):
                    popped += self.pops[at]
                    at = self.fail[at]
                if at != nothing:
                    self.fail[child], self.pops[child] = self.goto[at][c], popped
        del self.goto[0][head]  # within a word it opens nothing

    def count(self, word: str) -> int | None:
        """How many pieces the word has; None if it can't be cut into pieces."""
        goto, fail, pops = self.goto, self.fail, self.pops
        node, n = self.start, 0
        for c in word:
            while c not in goto[node]:
                if fail[node] < 0:
                    return None
                n += pops[node]
                node = fail[node]
            node = goto[node][c]
        while node:
            if fail[node] < 0:
                return None
            n += pops[node]
            node = fail[node]
        return n


class _Counts(dict):
    """Counts of words seen, forgotten when there are too many; unknown words count as one."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode())
        n = _UNKNOWN + 1 if n is None else n
        if len(word) <= 64:
            if len(self) > 500_000:
                self.clear()
            self[word] = n
        return n


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]


def token_counts(docs: DataFrame, pieces: list[str], *, text: str = "text", head: str = HEAD) -> DataFrame:
    """``docs`` without its text, with ``n_words``, ``n_tokens``, ``n_unknown``.

    Words are runs of anything but ASCII white space. Each is cut into the
    longest pieces from its front; one that has no such cut is one unknown
    token. Words are taken whole, however long. A null or empty text has
    counts 0; rows are counted one by one. The added columns replace columns of
    the same name. The automaton is sent to all tasks: vocabularies beyond
    MAX_PIECES are refused.
    """
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"{len(pieces)} pieces; at most {MAX_PIECES} can be sent to every task")
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(pieces, head))
    added = ["n_words", "n_tokens", "n_unknown"]
    kept = [c for c in docs.columns if c != text and c.lower() not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("binary").alias("n_tokens"))
    out = rows.drop("n_tokens").schema
    for name in added:
        out = out.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(sent.value)
        for batch in batches:
            found = []
            for value in batch.column(len(kept)):
                words = (value.as_py() or b"").split()
                unknown, tokens = divmod(sum(map(counts.__getitem__, words)), _UNKNOWN)
                found.append((len(words), tokens, unknown))
            numbers = [pa.array(x, pa.int64()) for x in zip(*found)] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *numbers], names=out.names)

    return rows.mapInArrow(run, out)


def op10_token_counts(spark, root, model: str | None = None) -> DataFrame:
    """``model``: a SentencePiece model file; by default the public one that is installed."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, vocabulary(model))
