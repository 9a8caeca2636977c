"""Token counts by count-only Viterbi for unigram vocabularies.

An Aho-Corasick automaton lists every piece of the vocabulary that ends at each character of a word; dynamic
programming carries the best score and, along it, the number of pieces. The rules are those of the tokenizers
library: among pieces that end at one place the one that starts first wins ties, a character that no piece covers alone
costs the least score less ten, runs of such characters are one unknown piece, which byte pieces spell if the
vocabulary has all of its bytes. Words, each with its mark, are counted once and remembered.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame

from tidewright.llm.common import rows_of, text_column
from tidewright.llm.tokens import Memory

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a public sentencepiece file with unigram scores in the order of its ids.

    The public file has ranks, no probabilities; a piece's score is the Zipf estimate -ln(rank + 2), which keeps the
    file's order, and pieces without a rank of their own (control and byte pieces) get the last one's.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [(model.id_to_piece(i), -math.log((n if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) else i) + 2)) for i in range(n)]


class Counter:
    """count(text): (pieces, pieces that spell what no piece covers, score) by words."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, remember: int = 250_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        pieces = {piece for piece, _ in vocabulary}
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in pieces} if byte_fallback else set()
        self.known = Memory(self.viterbi, remember)

    def viterbi(self, word: str) -> tuple[int, int, float]:
        n = len(word)
        ends: list[list] = [[] for _ in range(n + 1)]
        for last, (size, score) in self.automaton.iter(word):
            ends[last + 1].append((size, score))
        best = [0.0] + [-math.inf] * n
        step = [0] * (n + 1)  # the last piece's length; 0: unknown
        alone = [False] * (n + 1)
        for end in range(1, n + 1):
            for size, score in sorted(ends[end], reverse=True):  # those that start first come first
                alone[end] |= size == 1
                if best[end - size] + score > best[end]:
                    best[end], step[end] = best[end - size] + score, size
            if not alone[end] and best[end - 1] + self.unknown > best[end]:
                best[end], step[end] = best[end - 1] + self.unknown, 0
        count = odd = 0
        at = n
        while at:
            if step[at]:
                at, count = at - step[at], count + 1
            else:
                to = at
                while at and not step[at]:
                    at -= 1
                run = word[at:to].encode("utf-8", "surrogatepass")
                pieces = len(run) if all(b in self.bytes for b in run) else 1
                count, odd = count + pieces, odd + pieces
        return count, odd, best[n]

    def count(self, text: str) -> tuple[int, int, float]:
        """Words start at spaces, each with a mark in the space's place; a text's first word is given one if it has none."""
        if not text:
            return 0, 0, 0.0
        words = text.replace(MARK, " ").split(" ")
        found = list(map(self.known.__getitem__, [MARK + w for w in (words if words[0] else words[1:])]))
        return sum(f[0] for f in found), sum(f[1] for f in found), math.fsum(f[2] for f in found)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(unigram_vocabulary(path))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_unknown (pieces that spell uncovered text), score.

    Null texts count as empty: 0 tokens. Whole texts, however long; ids and rows may repeat. No shuffle.
    """
    import pyarrow as pa

    names, types = ["doc_id", "n_tokens", "n_unknown", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches):
        count, out = counter(path).count, []
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            out.append((doc_id, *count(text)))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_unknown long, score double")
