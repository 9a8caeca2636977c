"""What two or three words have been followed by in the whole corpus: statistics that grow with it, met in a shuffle.

Lots of tokens ask for what they hold: their distinct (context, word) and how often training documents say them. The
questions are dealt by the hash of the two words before, so that all of a context meet in one task, which counts them
and answers each with how reliable the context's favourite word is and whether it is the word at hand. An occurrence
of a training document is answered from all others: its own count is taken off. Nothing is capped; a frequent context
costs its distinct words in each lot, not its occurrences.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import squeeze, stretch_out

#: About how many tokens' questions meet in a task.
TOKENS_A_CHUNK = 1 << 19
#: From which number of occurrences, and from which share of the favourite, a context is in the next class.
SEEN, SHARES = (2, 3, 5, 10), (0.34, 0.67, 0.9, 1.0)
STATES = 1 + (len(SEEN) + 1) * (len(SHARES) + 1)
CODE_BITS = 27
MOST = np.uint64((1 << 28) - 1)
START = np.uint64(0x51ED270B9F4C3A11)
K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * K[3]
    return x ^ (x >> np.uint64(29))


def before(keys: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The key k tokens before, START where the text has none; place: of each token in its text."""
    out = np.empty_like(keys)
    out[k:] = keys[:-k]
    out[place < k] = START
    return out


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def in_order(keys: np.ndarray, codes: np.ndarray, place: np.ndarray, training: np.ndarray, use: np.ndarray, chunks: int):
    """(distinct questions by their numbers, how often each is asked, order of the tokens with `use` by them, each question's
    chunk, order of questions by chunks).

    keys hash tokens, codes tell them apart in CODE_BITS. Questions are short: 28 bits of the two words before, in a
    chunk and in order, the third word before as 8 bits, the code of the word, and whether it is of a training document.
    """
    one, two, three = (before(keys, place, k) for k in (1, 2, 3))
    two_words = mix(two[use] * K[0] + one[use])
    third = mix(three[use] * K[1]) >> np.uint64(56)
    whole = (two_words & np.uint64((1 << 28) - 1)) << np.uint64(36) | third << np.uint64(28) | codes[use].astype(np.uint64) << np.uint64(1) | training[use].astype(np.uint64)
    order = np.argsort(whole)
    whole = whole[order]
    starts = runs(whole)
    high, n = (two_words[order[starts]] >> np.uint64(40)).astype(np.uint32), np.diff(starts, append=len(order))
    chunk = high - high // np.uint32(chunks) * np.uint32(chunks)
    return whole[starts], n, order, chunk, np.argsort(chunk.astype(np.uint16) if chunks < 1 << 16 else chunk, kind="stable")


def questions(*of):
    """(chunk of each distinct question of in_order, its columns: two words, third, word, how often training documents ask it)."""
    distinct, n, _, chunk, by_chunk = in_order(*of)
    distinct, n = distinct[by_chunk], n[by_chunk]
    columns = ((distinct >> np.uint64(36)).astype("<u4"), (distinct >> np.uint64(28)).astype("u1"), ((distinct >> np.uint64(1)) & np.uint64((1 << CODE_BITS) - 1)).astype("<u4"), np.where(distinct & np.uint64(1), n, 0).astype("<u4"))
    return chunk[by_chunk].astype(np.int64), columns


def asked_by(*of) -> tuple[int, np.ndarray]:
    """(how many questions there are, which of them each token with `use` asks)."""
    _, n, order, _, by_chunk = in_order(*of)
    rank, which = np.empty(len(n), np.int64), np.empty(len(order), np.int64)
    rank[by_chunk] = np.arange(len(n))
    which[order] = np.repeat(rank, n)
    return len(n), which


def favourite(context: np.ndarray, word: np.ndarray, n: np.ndarray):
    """(state, favourite word, whether it is the word) of each question, its own occurrence taken off where n > 0.

    context: up to 36 bits; word: CODE_BITS. The favourite has the most occurrences, and of equals the smaller code.
    """
    key = context << np.uint64(28) | word
    order = np.argsort(key)
    new, n = changes(context[order]), n[order]
    open_, out = unsettled(new, n), (np.zeros(len(n), np.int64), np.zeros(len(n), np.uint64), np.zeros(len(n), bool))
    for x, y in zip(out, favourite_in_order(new[open_], word[order[open_]], n[open_]), strict=True):
        x[order[open_]] = y
    return out


def changes(x: np.ndarray) -> np.ndarray:
    """Whether each value is another than the one before."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def unsettled(new: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of all questions, in order, but those that are alone in their contexts and don't come again: nothing is known for them."""
    alone = n < 2
    alone &= new
    alone[:-1] &= new[1:]
    return np.flatnonzero(~alone)


def favourite_in_order(new: np.ndarray, word: np.ndarray, n: np.ndarray):
    """As favourite, of questions in order of their contexts and words; new: where contexts start."""
    new_pair = new | changes(word)
    pairs = np.flatnonzero(new_pair)
    starts, of_pair = np.flatnonzero(new[pairs]), MOST - word[pairs]
    sums = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    count = np.diff(sums[np.append(pairs, len(n))])
    total = np.diff(sums[np.append(pairs[starts], len(n))])
    value = (count << 28 | of_pair.astype(np.int64)) * (count > 0)
    first = np.maximum.reduceat(value, starts) if len(starts) else value
    value[value == first.take(np.cumsum(new[pairs]) - 1)] = 0
    second = np.maximum.reduceat(value, starts) if len(starts) else value
    group, own = np.cumsum(new) - 1, n > 0
    seen, top, next_ = total.take(group) - own, first.take(group), second.take(group)
    is_top = (top > 0) & (int(MOST) - (top & int(MOST)) == word)
    own &= is_top
    less = top - (own.astype(np.int64) << 28)
    falls = own & ((less < 1 << 28) | (less < next_))
    pick = np.where(falls, next_, less)
    share = (pick >> 28) / np.maximum(seen, 1)
    state = np.ones(len(n), np.int64)
    for x in SEEN:
        state += seen >= x
    state += (len(SHARES)) * (state - 1)
    for x in SHARES:
        state += share >= x
    some = (seen > 0) & (pick > 0)
    return state * some, ((int(MOST) - (pick & int(MOST))) * some).astype(np.uint64), is_top & ~falls & some


def answers(two_words: np.ndarray, third: np.ndarray, word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What a token is told, 13 bits: states of the three and two words before, whether each is right, whether both say the same.

    Questions are put in order once. That by the third word as well comes from their places in it, each of them behind
    the number of its two words and the third one, so that one sort of numbers without others beside them does.
    """
    out, order = np.zeros(len(word), "<u2"), np.argsort(two_words.astype(np.uint64) << np.uint64(28) | word)
    new = changes(two_words[order])
    open_ = unsettled(new, n[order])
    order, new = order[open_], new[open_]
    word, n = word[order].astype(np.int64), n[order]
    s2, w2, h2 = favourite_in_order(new, word, n)
    told = s2 << 6 | h2.astype(int) << 11
    bits = max(1, len(order) - 1).bit_length()
    if 2 * bits + 8 > 63:
        raise ValueError("too many questions in a chunk")
    key = np.sort((np.cumsum(new) - 1 << 8 | third[order]) << bits | np.arange(len(order)))
    at, new = key & ((1 << bits) - 1), changes(key >> bits)
    open_ = unsettled(new, n[at])
    at, new = at[open_], new[open_]
    s3, w3, h3 = favourite_in_order(new, word[at], n[at])
    told[at] |= s3 | h3.astype(int) << 5 | ((w2[at] == w3) & (s2[at] > 0) & (s3 > 0)).astype(int) << 12
    out[order] = told
    return out


def chunks_for(tokens: int) -> int:
    return max(1, -(-tokens // TOKENS_A_CHUNK))


def pack(columns) -> bytes:
    return squeeze(np.diff(columns[0], prepend=np.uint32(0)), *columns[1:])


def unpack(data: bytes) -> list[np.ndarray]:
    two_words, *others = stretch_out(data, "<u4", "u1", "<u4", "<u4")
    return [np.cumsum(two_words, dtype=np.uint32), *others]


def told(asked: DataFrame) -> DataFrame:
    """asked (lot, chunk, data) -> (lot, told: array of (chunk, what each of its questions is told)).

    A lot's array is as long as its questions, which its number of tokens bounds.
    """
    import pandas as pd

    def solve(pdf):
        pdf = pdf.sort_values("lot")
        parts = [unpack(data) for data in pdf["data"]]
        out = answers(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        stops = np.cumsum([len(p[0]) for p in parts])
        return pd.DataFrame({"lot": pdf["lot"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "told": [squeeze(out[b - len(p[0]) : b]) for b, p in zip(stops, parts, strict=True)]})

    each = asked.groupBy("chunk").applyInPandas(solve, "lot long, chunk long, told binary")
    return each.groupBy("lot").agg(F.sort_array(F.collect_list(F.struct("chunk", "told"))).alias("told"))
