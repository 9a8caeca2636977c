"""LM scoring by online logistic context mixing.

A text is its lower-cased words and one end, spelt as binary decisions. First: is the next word the favourite of the
three words before it, in the corpus (corpus_contexts)? Then that of the two words before? Then the word that came
last behind the same word in this text? If none of them, the decisions on the word's path in the Huffman tree of the
training counts, each predicted from hashed contexts (the word before, the last very frequent word) as counts of both
outcomes, and from the tree's own counts. A word outside the tree is an escape; whether it is one that training
documents hold is another decision, and its share of those words' counts comes from a join.

Predictions are mixed in the logistic domain by weights that gates choose (how deep a decision is, how often its
contexts have been seen, how long favourites have been right) and refined by adaptive maps from what the mix says to
what has come. The mix of paths is learnt online: all training documents are dealt into BUCKETS by hash, whose decisions
are counted by what the inputs say, and each bucket in turn is foretold and then learnt from by a Newton step. Counts are
whole numbers, so the mix depends on the rows alone and not on how they are dealt out. That of favourites comes from
exact counts as well.
Counts cover all training documents. A training document is scored from the others: the occurrence at hand is taken
off every count it is in, so that scores mean the same for documents that are held out and those that are not.

The score is over training words and one class for all others, as the base is. bits_per_byte adds the spelling of
those other words, by the same mixing over their bytes, and so is a whole code length.

Contexts of two and three words grow with the corpus without bound, in a shuffle. Only what is short is broadcast: the
tree, of at most VOCABULARY words and VOCABULARY_BYTES, and the tables of the single word before, of MOST_SLOTS.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import corpus_contexts as cc
from tidewright.llm.common import drop, lean, squeeze, stretch_out, text_column, written

FOLDS, HELD_OUT = 7, 2
VOCABULARY, VOCABULARY_BYTES, LONG_WORD = 1 << 18, 1 << 24, 1 << 12
LEAST_SLOTS, MOST_SLOTS, TOKENS_A_SLOT = 1 << 20, 1 << 22, 64
CHUNK = 1 << 14
FAN_IN = 64
#: Longer texts are cut into pieces here; a lot is a row of several pieces; decisions are spelt out for a batch of words.
PIECE, LOT_TOKENS, BATCH_TOKENS, BATCH_DECISIONS = 1 << 17, 1 << 18, 8_000, 1 << 16
#: How many decisions' symbols a task holds before it counts them, alike ones at once.
HELD = 1 << 20
#: How many letters' logarithms a worker remembers.
SPELT = 1 << 18
#: Texts are split into words until so many bytes are at hand, and counted when so many words are.
SPLIT_BYTES, COUNT_WORDS = 1 << 22, 1 << 21
FREQUENT = 64
INPUTS, GATES, BINS, BUCKETS = 3, 128, 33, 16
RUNS = 4
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END_OF_WORD = 256
GRID, TOP = 64, 640
LOG_SQUASH = -np.logaddexp(0, -(np.arange(2 * TOP + 1) - TOP) / GRID) / np.log(10)
#: By the outcome: of zeros, then of ones.
LOGS = np.concatenate([LOG_SQUASH[::-1], LOG_SQUASH])
C = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2C1B3C6D], np.uint32)
#: Of every pair of counts up to 255: the stretched share of ones, and how often seen in four classes.
_n = np.arange(1 << 16)
STRETCHED = np.log((_n % 256 + 0.4) / (_n // 256 + 0.4)).astype(np.float32)
SEEN = np.searchsorted([1, 4, 16], _n % 256 + _n // 256, side="right").astype(np.uint8)
#: The pair of counts without the own occurrence of a decision's outcome, first for zeros, then for ones.
LEFT = np.concatenate([_n - 0x100 * (_n > 0xFF), _n - (_n % 256 > 0)])
#: For counting what inputs say: kinds of pairs of counts, by the class above and the stretched share in halves, and of priors.
_kinds, KIND = np.unique(SEEN * 64 + np.rint(2 * STRETCHED).astype(np.int64) + 32, return_inverse=True)
KINDS, KIND_SEEN, KIND_SAYS = len(_kinds), _kinds // 64, (_kinds % 64 - 32) / 2
PRIORS = np.arange(-3.5, 4)
#: Each for all counts as they are, and without the own occurrence: by the outcome and the pair.
STRETCHED, SEEN, SEEN_FIRST, KIND = ((t, t[LEFT]) for t in (STRETCHED, SEEN, SEEN * np.uint8(4), KIND.astype(np.uint8)))
VIEWS = 4 * len(PRIORS) * KINDS * KINDS
#: What a token is told, and that no favourite is right for it.
PLAIN = np.uint16(1 << 15)
#: Numbers of what a token is told beside its runs of hits.
SITUATIONS = int(PLAIN) * RUNS * RUNS
#: Decisions on favourites: of three words, of two, in this text; each has CELLS cells that tell its situation.
LEVELS, CELLS = 3, cc.STATES * cc.STATES * 2 * RUNS


def fold_of(doc_id) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@dataclass
class Tree:
    """A Huffman tree: for each symbol, where its path starts and how long it is; for each step its node and bit.

    Paths of one length lie together, each from its leaf to the root.
    """

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    prior: np.ndarray
    depth: np.ndarray

    @staticmethod
    def of(weights: np.ndarray) -> Tree:
        n = len(weights)
        order = np.argsort(weights, kind="stable")
        total = np.concatenate([weights[order].astype(np.float64), np.zeros(n - 1)])
        up, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
        a, b, leaf, inner = total.tolist(), 0, 0, n
        for new in range(n, 2 * n - 1):  # leaves in order of weight, and sums, which come out in order
            for which in (0, 1):
                take_leaf = leaf < n and (inner >= new or a[leaf] <= a[inner])
                at = leaf if take_leaf else inner
                leaf, inner = leaf + take_leaf, inner + (not take_leaf)
                up[at], side[at] = new, which
                a[new] += a[at]
        total = np.array(a)
        cur, steps = np.arange(n), []
        while (cur < 2 * n - 2).any():
            going = cur < 2 * n - 2
            steps.append((np.where(going, up[cur], -1).astype(np.int32), np.where(going, side[cur], 0).astype(np.int8)))
            cur = np.where(going, up[cur], cur)
        nodes = np.array([s[0] for s in steps]).reshape(len(steps), n).T
        bits = np.array([s[1] for s in steps]).reshape(len(steps), n).T
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        nodes, bits = nodes[rank], bits[rank]
        used = nodes >= 0
        length = used.sum(1)
        ones = np.zeros(2 * n - 1)
        right = side == 1
        ones[up[right][: n - 1]] = total[right][: n - 1]
        inner_total = total[n:]
        p = (ones[n:] + 0.4) / (inner_total + 0.8)
        depth = np.zeros(2 * n - 1, np.int64)
        for at in range(2 * n - 3, -1, -1):
            depth[at] = depth[up[at]] + 1
        by = np.argsort(length, kind="stable")
        start = np.empty(n, np.int64)
        start[by] = np.cumsum(length[by]) - length[by]
        nodes, bits, used = nodes[by], bits[by], used[by]
        return Tree(start, length, (nodes[used] - n).astype(np.uint32), bits[used].astype(np.uint8), np.log(p / (1 - p)).astype(np.float32), np.minimum(depth[n:] // 3, 3).astype(np.uint8))

    @functools.cached_property
    def blocks(self) -> dict:
        """By length: (where its paths start, nodes and bits, priors, priors' kinds), a row for each path."""
        steps, prior = self.node << np.uint32(1) | self.bit, self.prior.take(self.node)
        kind = np.clip(np.rint(prior + 3.5), 0, len(PRIORS) - 1).astype(np.uint8)
        out, lo = {}, 0
        for length, n in enumerate(np.bincount(self.length).tolist()):
            if n:
                out[length] = (lo, *(x[lo : lo + n * length].reshape(n, length) for x in (steps, prior, kind)))
                lo += n * length
        return out


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Lot:
    """Pieces of texts as one row. A piece that goes on a text starts with up to three of its words before, which aren't scored."""

    row: np.ndarray
    doc_id: list
    fold: list
    key: np.ndarray
    piece: np.ndarray
    skip: np.ndarray
    size: np.ndarray
    n_bytes: np.ndarray
    ids: np.ndarray
    cold: list[bytes]
    told: np.ndarray | None = None

    SCHEMA = "lot long, row array<long>, doc_id array<long>, fold array<long>, key array<long>, piece array<long>, skip array<long>, size array<long>, n_bytes array<long>, ids binary, cold binary"
    COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]

    @staticmethod
    def of(r: dict) -> Lot:
        cold = stretch_out(r["cold"], "u1")[0].tobytes()
        numbers = {c: np.array(r[c], np.int64) for c in ("row", "key", "piece", "skip", "size", "n_bytes")}
        told = stretch_out(r["states"], "<u2")[0] if r.get("states") else None
        return Lot(doc_id=r["doc_id"], fold=r["fold"], ids=stretch_out(r["ids"], "<u4")[0].astype(np.int64), cold=cold.split(b" ") if cold else [], told=told, **numbers)

    def __post_init__(self):
        self.owner = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.ids)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.use = self.place >= self.skip[self.owner]
        self.training = np.array([f is not None and f != HELD_OUT for f in self.fold], bool)

    def keys(self, model: Model) -> np.ndarray:
        """A hash of each token, the same for a word inside the vocabulary and outside."""
        import xxhash

        out = model.keys.take(self.ids)
        out[self.ids == model.escape] = np.fromiter(map(xxhash.xxh64_intdigest, self.cold), np.uint64, len(self.cold))
        return out

    def codes(self, keys: np.ndarray, model: Model) -> np.ndarray:
        """A number of 27 bits for each token: its place in the vocabulary, or a hash behind all places."""
        top = cc.CODE_BITS - 1
        return np.where(self.ids == model.escape, (keys >> np.uint64(64 - top)) | np.uint64(1 << top), self.ids.astype(np.uint64)).astype("<u4")

    def asking(self, model: Model, chunks: int):
        """What corpus_contexts wants to know of the tokens for their questions."""
        keys = self.keys(model)
        return keys, self.codes(keys, model), self.place, self.training[self.owner], self.use, chunks


def lots_of(batches) -> object:
    for b in batches:
        for r in b.to_pylist():
            yield r["lot"], Lot.of(r)


@dataclass
class Decisions:
    """Binary decisions of symbols with paths of one length, a row for each: bit, slots, prior, prior's kind; each column's gate without counts."""

    bit: np.ndarray
    slots: list[np.ndarray]
    prior: np.ndarray
    kind: np.ndarray
    gate: np.ndarray


@dataclass
class Model:
    words: list[bytes]
    counts: np.ndarray
    tree: Tree
    letters: Tree
    slots: int
    tokens: int
    distinct: int
    documents: int
    cold_tokens: int  # of training words outside the tree, and of those the words that occur once
    cold_once: int
    cells: np.ndarray | None = None  # INPUTS - 1 x slots: counts of zeros and ones, 8 bits each
    weights: np.ndarray | None = None
    refined: np.ndarray | None = None  # GATES x BINS
    favourites: np.ndarray | None = None  # LEVELS x CELLS: log10 of a favourite's being wrong, and right

    def __post_init__(self):
        self.logs, self.keys, self.spelt, self.chain_logs, self.kinds, self.mixed = [None] * 6
        self.weights = Model.start() if self.weights is None else self.weights

    def ready(self) -> Model:
        if self.logs is None:
            import xxhash

            floor = np.log10(self.tokens + self.distinct + 1.0)
            # an escape adds nothing here: the words behind it meet their counts in a join
            self.logs = np.concatenate([np.log10(self.counts + 1.0) - floor, [np.log10(self.documents + 1.0) - floor, 0.0]])
            self.keys = np.concatenate([np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words)), np.array([1, 0], np.uint64)])
        return self

    @staticmethod
    def start() -> np.ndarray:
        """Weights before anything has been learnt."""
        return np.full((GATES, INPUTS + 1), 0.4, np.float32) * np.array([1, 1, 1, 0], np.float32)

    @property
    def end(self) -> int:
        return len(self.words)

    @property
    def escape(self) -> int:
        return len(self.words) + 1

    @property
    def known_share(self) -> float:
        """Of escaped words, the share that other training documents hold (Good-Turing)."""
        return float(np.clip(1 - self.cold_once / self.cold_tokens, 0.01, 0.99)) if self.cold_tokens else 0.0

    def contexts(self, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the token before, the last very frequent token before), the end where there is none."""
        first = place == 0
        one = np.concatenate([[self.end], ids[:-1]])
        one[first] = self.end
        at = np.where((one < FREQUENT) | first, np.arange(len(ids)), 0)
        return one, one[np.maximum.accumulate(at)] if len(ids) else one

    def paths(self, symbols: np.ndarray, one: np.ndarray, recent: np.ndarray):
        """The decisions of words in the tree, as of `decisions`."""
        return self.decisions(self.tree, symbols, (self.hashed(0, one), self.hashed(1, recent)), 0)

    @staticmethod
    def hashed(context: int, tokens: np.ndarray) -> np.ndarray:
        """What the tokens of a context of words, of the two, add to a node's slot."""
        return tokens.astype(np.uint32) * C[5 * context] + C[1 + context]

    @staticmethod
    def letters_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(each byte or end of the words and the three before it as one number, where each word starts)."""
        size = np.array([len(w) + 1 for w in words])
        letters = np.full(size.sum(), END_OF_WORD, np.int64)
        stops = np.cumsum(size)
        keep = np.ones(len(letters), bool)
        keep[stops - 1] = False
        letters[keep] = np.frombuffer(b"".join(words), np.uint8)
        at = np.arange(len(letters)) - np.repeat(stops - size, size)
        out = np.zeros(len(letters), np.int64)
        for k in (3, 2, 1, 0):
            out = out * (END_OF_WORD + 1) + np.where(at >= k, np.concatenate([np.full(k, END_OF_WORD), letters])[: len(letters)], END_OF_WORD)
        return out, stops - size

    def spelling(self, letters: np.ndarray):
        """The decisions of bytes and ends from letters_of."""
        three, two, one, symbol = (letters // (END_OF_WORD + 1) ** k % (END_OF_WORD + 1) for k in (3, 2, 1, 0))
        pair = (two.astype(np.uint32) * C[0] + one.astype(np.uint32)) * C[5]
        return self.decisions(self.letters, symbol, (pair + C[1], (pair ^ three.astype(np.uint32)) * C[2] + C[1]), 64)

    def decisions(self, tree: Tree, symbols: np.ndarray, contexts: tuple, gate: int):
        """(which symbols, their decisions), about BATCH_DECISIONS at a time. Alike symbols come together, as they read the same places."""
        start, shift = tree.start.take(symbols), np.uint32(33 - int(self.slots).bit_length())
        order = np.sort(start << 32 | np.arange(len(start))) & ((1 << 32) - 1)  # numbers sort faster than their places
        length = tree.length.take(symbols.take(order))
        cuts = [*np.flatnonzero(np.diff(length, prepend=0)).tolist(), len(order)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = int(length[a])
            lo, steps, prior, kind = tree.blocks[n]
            depth = (np.minimum(np.arange(n - 1, -1, -1) // 3, 3) * 16 + gate).astype(np.uint8)
            for at in range(a, b, max(1, BATCH_DECISIONS // n)):
                which = order[at : min(b, at + max(1, BATCH_DECISIONS // n))]
                row = (start.take(which) - lo) // n
                step = steps.take(row, axis=0)
                spread, slots = (step >> np.uint32(1)) * C[4], []
                for c in contexts:
                    slot = c.take(which)[:, None] ^ spread
                    slot *= C[0]
                    slot >>= shift
                    slots.append(slot.astype(np.intp))
                yield which, Decisions(step & np.uint32(1), slots, prior.take(row, axis=0), kind.take(row, axis=0), depth)

    def views(self, e: Decisions) -> np.ndarray:
        """What each decision of a path of a training document is told, as one number below VIEWS."""
        if self.kinds is None:  # of each cell, first for decisions that are zeros, then for ones
            self.kinds = [np.concatenate([kind.take(c) for kind in np.split(KIND[1], 2)]) for c in self.cells]
        view = (e.gate // 16).astype(np.intp) * len(PRIORS) + e.kind
        ones = e.bit.astype(np.intp) * self.slots
        for kinds, slots in zip(self.kinds, e.slots, strict=True):
            view *= KINDS
            view += kinds.take(ones | slots)
        return view

    def mixers(self) -> tuple[list[np.ndarray], np.ndarray]:
        """(each input's weights by gate and bin, refined), in units of half a GRID; powers of two change no digit."""
        if self.mixed is None:
            w = self.weights.T * np.float32(GRID // 2)
            w[INPUTS] *= np.float32(0.3)
            self.mixed = [np.repeat(x, BINS) for x in w], None if self.refined is None else self.refined.ravel() * np.float32(GRID // 2)
        return self.mixed

    def logs_of(self, e: Decisions, own: bool) -> np.ndarray:
        """log10 of each symbol's probability. Logits are rounded to 1 / GRID, for both outcomes alike, so that they still add up."""
        w, refined = self.mixers()
        high = e.bit << np.uint32(16) if own else np.uint32(0)
        first, second = ((c.take(x) | high).astype(np.intp) for c, x in zip(self.cells, e.slots, strict=True))
        gate = SEEN_FIRST[own].take(first)
        gate += SEEN[own].take(second)
        gate += e.gate
        gate = gate.astype(np.intp) * BINS
        s = e.prior * w[0].take(gate)
        s += STRETCHED[own].take(first) * w[1].take(gate)
        s += STRETCHED[own].take(second) * w[2].take(gate)
        s += w[INPUTS].take(gate)
        np.clip(s, -4 * GRID, 4 * GRID, out=s)
        if refined is None:
            s += s
        else:
            gate += ((s + 4 * GRID) * ((BINS - 1) / (8 * GRID)) + 0.5).astype(np.intp)
            s += refined.take(gate)
        s += TOP + 0.5
        k = s.astype(np.intp)
        k += e.bit * np.uint32(2 * TOP + 1)
        return LOGS.take(k).sum(axis=1)

    def logs_of_letters(self, letters: np.ndarray, own: bool) -> np.ndarray:
        """log10 of the probability of each of letters_of. Those of late are remembered, each at a place by its hash."""
        if self.spelt is None:
            self.spelt = [(np.full(SPELT, -1), np.zeros(SPELT)) for _ in range(2)]
        (known, logs), place = self.spelt[own], (cc.mix(letters.astype(np.uint64)) % np.uint64(SPELT)).astype(np.intp)
        out, new = logs.take(place), np.flatnonzero(known.take(place) != letters)
        if len(new):
            some, back = np.unique(letters[new], return_inverse=True)
            found = np.empty(len(some))
            for which, e in self.spelling(some):
                found[which] = self.logs_of(e, own)
            out[new] = found.take(back)
            known[place[new]], logs[place[new]] = letters[new], out[new]
        return out

    def chain(self, lot: Lot) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """([(tokens, cells, hits) of the decisions on each level's favourites], tokens that no favourite was right for)."""
        return chain_of(self.situations(lot))

    def situations(self, lot: Lot) -> np.ndarray:
        """All that the decisions on a token's favourites depend on, as a number below SITUATIONS: what it is told, and both runs."""
        s, owner = lot.told & (PLAIN - np.uint16(1)), lot.owner[lot.use]
        first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(s) else np.zeros(0, bool)
        out = s.astype(np.int32) << 4
        out |= self.run((s & np.uint16(1 << 5 | 1 << 11)) > 0, first) << 2
        out |= self.run((s & np.uint16(1 << 14)) > 0, first)
        return out

    def own_favourites(self, lot: Lot) -> tuple[np.ndarray, np.ndarray]:
        """(whether the token before has come before in its piece, whether what followed it then is the token)."""
        # words by numbers, those outside the vocabulary behind the others, so that piece, word and place fit one number
        keys, use, word = lot.keys(self), lot.use, lot.ids.copy()
        outside = word == self.escape
        word[outside] = self.escape + np.unique(keys[outside], return_inverse=True)[1]
        one = np.where(lot.place > 0, np.concatenate([[0], word])[: len(word)] + 1, 0)[use]
        word, n = word[use], len(one)
        bits = [int(x).bit_length() for x in (n, one.max(initial=0), len(lot.size))]
        if sum(bits) > 63:
            raise ValueError("a lot is too long")
        where = np.sort((lot.owner[use] << bits[1] | one) << bits[0] | np.arange(n))
        order = where & ((1 << bits[0]) - 1)
        where >>= bits[0]
        again = np.concatenate([[False], where[1:] == where[:-1]]) if n else np.zeros(0, bool)
        there, hit = np.zeros(n, bool), np.zeros(n, bool)
        there[order] = again
        hit[order[1:]] = again[1:] & (word[order][1:] == word[order][:-1])
        return there, hit

    @staticmethod
    def run(hit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many tokens just before were hits, up to RUNS - 1."""
        out, before = np.zeros(len(hit), np.int8), np.ones(len(hit), bool)
        for _ in range(RUNS - 1):  # whether the token before was one, and as many before it as so far
            before[1:] = hit[:-1] & before[:-1] & ~first[1:]
            before[:1] = False
            out += before
        return out

    def score(self, lot: Lot) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of each scored token's probability, whether no favourite was right for it)."""
        use, plain = lot.use, lot.told & PLAIN > 0
        logs, left = self.chained().take(self.situations(lot)), np.flatnonzero(plain)
        one, recent = self.contexts(lot.ids, lot.place)
        symbols, one, recent, own = lot.ids[use], one[use], recent[use], lot.training[lot.owner[use]]
        for yes in (False, True):
            i = left[own[left] == yes]
            for which, e in self.paths(symbols[i], one[i], recent[i]):
                logs[i[which]] += self.logs_of(e, yes)
        return logs, plain

    def chained(self) -> np.ndarray:
        """log10 of the probability of what comes of the favourites in each situation."""
        if self.chain_logs is None:
            self.chain_logs = np.zeros(SITUATIONS)
            for (some, cells, hit), table in zip(chain_of(np.arange(SITUATIONS))[0], self.favourites, strict=True):
                self.chain_logs[some] += table[hit.astype(np.intp), cells]
        return self.chain_logs


def chain_of(situations: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """As Model.chain, of situations. What can't be told, such as states beyond the last, gets some cell or other."""
    s = situations >> 4
    s3, h3, s2, h2, same = np.minimum(s & 31, cc.STATES - 1), (s >> 5) & 1, np.minimum((s >> 6) & 31, cc.STATES - 1), (s >> 11) & 1, (s >> 12) & 1
    own_word, own_hit, run, own_run = ((s >> 13) & 1) > 0, ((s >> 14) & 1) > 0, (situations >> 2) & 3, situations & 3
    out, left = [], np.arange(len(s))
    asked = (s3 > 0, (s2 > 0) & ~((same > 0) & (s3 > 0)), own_word)
    cells = (((s3 * cc.STATES + s2) * 2 + same) * RUNS + run, ((s2 * cc.STATES + s3) * 2) * RUNS + run, (own_run * 8 + (s3 > 0) * 4 + (s2 > 0) * 2 + (run > 0)))
    for level, hit in enumerate((h3 > 0, h2 > 0, own_hit)):
        some = left[asked[level][left]]
        out.append((some, cells[level][some], hit[some]))
        left = left[~(asked[level][left] & hit[left])]
    return out, left


@functools.cache
def plain_for() -> np.ndarray:
    """PLAIN for what a token is told where no favourite is right for it, which runs don't change; else 0."""
    out = np.zeros(int(PLAIN), np.uint16)
    out[chain_of(np.arange(int(PLAIN)) << 4)[1]] = PLAIN
    return out


def words_of(text: str) -> list[bytes]:
    """Lower-cased in A-Z only and split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def split_texts(batches, *columns: str):
    """(the words of some rows' texts as one Arrow array, where each row's end, the rows' values of columns)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        texts = batch.column("text")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // SPLIT_BYTES
        cuts = [*np.flatnonzero(np.diff(size, prepend=-1)).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.slice(a, b - a)))
            full, n = pc.binary_length(trimmed).to_numpy(zero_copy_only=False) > 0, np.zeros(b - a, np.int64)
            lists = pc.ascii_split_whitespace(trimmed if full.all() else trimmed.filter(pa.array(full)))
            words, n[full] = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            yield words.cast(pa.binary()), np.cumsum(n), list(zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in columns), strict=True))


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c) over all rows; partial counts leave the tasks."""
    import pyarrow as pa

    def run(batches):
        held, n = [], 0

        def counted():
            both = pa.chunked_array(held, pa.binary()).value_counts()
            return pa.RecordBatch.from_arrays([both.field("values"), both.field("counts")], ["word", "c"])

        for words, _, _ in split_texts(batches):
            held.append(words)
            n += len(words)
            if n >= COUNT_WORDS:
                yield counted()
                held, n = [], 0
        yield counted()

    return rows.select("text").mapInArrow(lean(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def make_lots(rows: DataFrame, shared) -> DataFrame:
    """rows (doc_id, fold, key, text) -> lots (Lot.SCHEMA)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        from pyspark import TaskContext

        model, base = shared.value.ready(), TaskContext.get().partitionId() << 33
        inside, row, lot, held, cold, tokens = pa.array(model.words, pa.binary()), base, base, [], [], 0

        def out():
            columns = list(zip(*(h[:-1] for h in held), strict=True))
            ids = np.concatenate([h[-1] for h in held]).astype("<u4")
            values = [[lot], *([list(c)] for c in columns), [squeeze(ids)], [squeeze(np.frombuffer(b" ".join(cold), np.uint8))]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=Lot.COLUMNS)

        types = [pa.int64()] + [pa.list_(pa.int64())] * 8 + [pa.binary()] * 2
        for words, ends, values in split_texts(batches, "doc_id", "fold", "key"):
            found = pc.index_in(words, value_set=inside).fill_null(model.escape).to_numpy().astype(np.uint32)
            cold_at = np.flatnonzero(found == model.escape)
            outside = words.take(pa.array(cold_at)).to_numpy(zero_copy_only=False).tolist()
            n_bytes = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)])
            first = 0
            for end, (doc_id, fold, key) in zip(ends.tolist(), values, strict=True):
                for piece, at in enumerate(range(first, end + 1, PIECE)):
                    skip = min(3, at - first)
                    a, b = at - skip, min(at + PIECE, end)
                    n = b - a + (at + PIECE > end)
                    ids = np.full(n, model.end, np.uint32)
                    ids[: b - a] = found[a:b]
                    cold += outside[slice(*np.searchsorted(cold_at, (a, b)).tolist())]
                    held.append((row, doc_id, fold, key, piece, skip, n, int(n_bytes[b] - n_bytes[a + skip]) + n - skip, ids))
                    tokens += n
                    if tokens >= LOT_TOKENS:
                        yield out()
                        lot, held, cold, tokens = lot + 1, [], [], 0
                row, first = row + 1, end
        if held:
            yield out()

    return rows.mapInArrow(lean(run), Lot.SCHEMA)


def with_told(lots: DataFrame, shared, chunks: int) -> DataFrame:
    """lots with `states`: what each scored token is told by the corpus's contexts, and by its own text; and with
    `favourites`: how often each decision on a favourite has come, of training documents."""
    import pyarrow as pa

    def ask(batches):
        model = shared.value.ready()
        for lot, x in lots_of(batches):
            chunk, columns = cc.questions(*x.asking(model, chunks))
            cuts = [*np.flatnonzero(np.diff(chunk, prepend=-1)).tolist(), len(chunk)]
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_pydict(
                {
                    "lot": pa.array([lot] * len(spans), pa.int64()),
                    "chunk": pa.array([int(chunk[a]) for a, _ in spans], pa.int64()),
                    "data": pa.array([cc.pack([c[a:b] for c in columns]) for a, b in spans], pa.binary()),
                }
            )

    def tell(batches):
        model = shared.value.ready()
        for b in batches:
            for r in b.to_pylist():
                x = Lot.of(r)
                n, which = cc.asked_by(*x.asking(model, chunks))
                got = np.concatenate([np.zeros(0, "<u2"), *(stretch_out(t["told"], "<u2")[0] for t in r["told"] or ())])
                if len(got) != n:
                    raise ValueError(f"{n} questions of a lot, {len(got)} answers")
                there, hit = model.own_favourites(x)
                x.told = got.take(which) | (there.astype("<u2") << 13) | (hit.astype("<u2") << 14)
                data = [squeeze(x.told | plain_for().take(x.told)), favourites_of(x, model.situations(x))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c]], t) for c, t in zip(Lot.COLUMNS, types, strict=True)] + [pa.array([d], pa.binary()) for d in data], names=[*Lot.COLUMNS, "states", "favourites"])

    types = [pa.int64()] + [pa.list_(pa.int64())] * 8 + [pa.binary()] * 2
    told = cc.told(lots.mapInArrow(ask, "lot long, chunk long, data binary"))
    return lots.join(told, "lot", "left").mapInArrow(tell, f"{Lot.SCHEMA}, states binary, favourites binary")


def packed(counts: np.ndarray) -> bytes:
    return squeeze(counts.astype("<u4"), level=1)


def unpacked(data: bytes) -> np.ndarray:
    return stretch_out(data, "<u4")[0]


def to_cells(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Both counts in 8 bits each, scaled where one is larger; neither becomes 0 unless it was."""
    scale = np.maximum(1, np.maximum(zeros, ones) / 255)
    z, o = (np.where(c > 0, np.maximum(1, np.rint(c / scale)), 0).astype(np.int64) for c in (zeros, ones))
    return (z << 8 | o).astype("<u2")


def gather_counts(lots: DataFrame, words: DataFrame, shared, slots: int) -> np.ndarray:
    """Every slot's cell: tasks count both outcomes of the decisions of training documents where no favourite is right,
    chunks of slots are added up in a tree.

    Beside the texts' own escapes, each word of the vocabulary teaches spelling once, as new words look like known ones.
    """
    import pandas as pd
    import pyarrow as pa

    schema = "part long, context int, chunk int, counts binary"

    def run(batches):
        from pyspark import TaskContext

        model = shared.value.ready()
        counts = np.zeros((INPUTS - 1, 2 * slots), np.uint32)

        held: list[list] = [[] for _ in range(INPUTS)]  # of each context (symbol, token) as one number; letters

        def add(contexts, decisions, times: np.ndarray):
            for which, e in decisions:
                n = np.repeat(times[which].astype(np.uint32), e.bit.shape[1])
                for k, slots in zip(contexts, e.slots, strict=True):
                    slots *= 2
                    slots += e.bit
                    np.add.at(counts[k], slots.ravel(), n)

        def count(most: int):
            """Counts what is held, alike decisions at once, where it is more than most."""
            for k, parts in enumerate(held):
                if sum(map(len, parts)) > most:
                    some = np.sort(np.concatenate(parts))
                    starts = cc.runs(some)
                    some, times = some[starts], np.diff(starts, append=len(some))
                    parts.clear()
                    if k == INPUTS - 1:
                        add((0, 1), model.spelling(some), times)
                    else:
                        add((k,), model.decisions(model.tree, some >> 32, (model.hashed(k, some & ((1 << 32) - 1)),), 0), times)

        def spell(words):
            for at in range(0, len(words), BATCH_TOKENS):
                held[-1].append(model.letters_of(words[at : at + BATCH_TOKENS])[0])
                count(HELD)

        for batch in batches:
            if batch.schema.names == ["word"]:
                spell([w for w in batch.column("word").to_pylist() if w])
                continue
            for _, lot in lots_of([batch]):
                at = np.flatnonzero(lot.use)[lot.told & PLAIN > 0]
                at = at[lot.training[lot.owner[at]]]
                learn = np.zeros(len(lot.ids), bool)
                learn[at] = True
                for parts, tokens in zip(held, model.contexts(lot.ids, lot.place), strict=False):
                    parts.append(lot.ids[at] << 32 | tokens[at])
                spell([w for w, yes in zip(lot.cold, learn[lot.ids == model.escape].tolist(), strict=True) if yes])
                count(HELD)
        count(0)
        part = TaskContext.get().partitionId()
        for k in range(INPUTS - 1):
            for chunk in range(slots // CHUNK):
                c = counts[k, 2 * CHUNK * chunk : 2 * CHUNK * (chunk + 1)]
                if c.any():
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "context": pa.array([k], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "counts": pa.array([packed(c)], pa.binary())})

    def add(pdf):
        total = np.zeros(2 * CHUNK, np.int64)
        for x in pdf["counts"]:
            total += unpacked(x)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "context": pdf["context"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "counts": [packed(np.minimum(total, (1 << 32) - 1))]})

    def finish(batches):
        for b in batches:
            for k, chunk, x in zip(*(b.column(c).to_pylist() for c in ("context", "chunk", "counts")), strict=True):
                cells = to_cells(*unpacked(x).reshape(-1, 2).T.astype(np.int64))
                yield pa.RecordBatch.from_pydict({"context": pa.array([k], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})

    parts = lots.rdd.getNumPartitions() + words.rdd.getNumPartitions()
    tables = lots.mapInArrow(run, schema).unionByName(words.where("c > 1").select("word").mapInArrow(run, schema))
    while parts > 1:
        parts = -(-parts // FAN_IN)
        tables = tables.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part", "context", "chunk").applyInPandas(add, schema)
    cells = np.zeros((INPUTS - 1, slots), np.uint16)
    for r in tables.mapInArrow(finish, "context int, chunk int, cells binary").toLocalIterator():
        cells[r["context"], r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["cells"], "<u2")
    return cells


def favourites_of(lot: Lot, situations: np.ndarray) -> bytes:
    """How often each decision on a favourite has come in the lot's training documents: (place, times) of those that have."""
    came, n = np.bincount(situations[lot.training[lot.owner[lot.use]]]), np.zeros((LEVELS, 2 * CELLS))
    seen = np.flatnonzero(came)
    for level, (some, cells, hit) in enumerate(chain_of(seen)[0]):
        n[level] = np.bincount(hit * CELLS + cells, came[seen[some]], 2 * CELLS)
    at = np.flatnonzero(n.ravel())
    return squeeze(at.astype("<u4"), n.ravel()[at].astype("<u4"))


def count_favourites(lots: DataFrame, shared) -> np.ndarray:
    """(level, hit, cell): how often each decision on a favourite has come, over all training documents."""
    import pyarrow as pa

    def run(batches):
        n = np.zeros(LEVELS * 2 * CELLS, np.int64)
        for batch in batches:
            for data in batch.column("favourites").to_pylist():
                at, times = stretch_out(data, "<u4", "<u4")
                n[at] += times
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(n[at])})

    got = lots.select("favourites").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(LEVELS * 2 * CELLS, np.int64)
    n[got["at"]] = got["n"]
    return n.reshape(LEVELS, 2, CELLS)


def fit_favourites(n: np.ndarray) -> np.ndarray:
    """LEVELS x 2 x CELLS: log10 of a favourite's being wrong and right in each cell.

    Bit predictors that see a part of the situation are mixed by weights that the length of the run chooses, fitted by
    Newton steps on the counts; the cell's own counts refine what the mix says.
    """
    out, cell = np.zeros((LEVELS, 2, CELLS)), np.arange(CELLS)
    run, same, second, first = cell % RUNS, cell // RUNS % 2, cell // (2 * RUNS) % cc.STATES, cell // (2 * RUNS * cc.STATES)
    for level in range(LEVELS):
        total, ones = n[level].sum(0).astype(float), n[level, 1].astype(float)
        views = (cell,) if level == LEVELS - 1 else (first * RUNS + run, (first * cc.STATES + second) * 2 + same, second * RUNS + run)
        x = np.array([np.log((np.bincount(v, ones) + 0.4) / (np.bincount(v, total - ones) + 0.4))[v] for v in views] + [np.full(CELLS, 0.3)]).T
        s = np.zeros(CELLS)
        for gate in range(RUNS):
            i = np.flatnonzero((total > 0) & (run == gate))
            w = np.array([1 / len(views)] * len(views) + [0.0])
            for _ in range(20 if len(i) else 0):
                p = squash(np.clip(x[i] @ w, -12, 12))
                hessian = (x[i] * (total[i] * p * (1 - p))[:, None]).T @ x[i] + np.eye(len(w))
                w = w + np.clip(np.linalg.solve(hessian, x[i].T @ (ones[i] - total[i] * p)), -1, 1)
            s[run == gate] = x[run == gate] @ w
        p = (ones + 10 * squash(np.clip(s, -8, 8))) / (total + 10)
        out[level] = np.log10(1 - p), np.log10(p)
    return out


def count_views(lots: DataFrame, shared, cells=None) -> np.ndarray:
    """(bucket, view, bit): how often each decision on a path has come, over all training documents; cells: broadcast,
    where the model hasn't any."""
    import pandas as pd
    import pyarrow as pa

    schema = "part long, bucket int, counts binary"

    def run(batches):
        from pyspark import TaskContext

        model, n = shared.value.ready(), np.zeros((BUCKETS, 2 * VIEWS), np.uint32)
        model.cells = model.cells if cells is None else cells.value
        for _, lot in lots_of(batches):
            one, recent = model.contexts(lot.ids, lot.place)
            at = np.flatnonzero(lot.use)[lot.told & PLAIN > 0]
            at = at[lot.training[lot.owner[at]]]
            # buckets of rows, by their texts and ids
            bucket = cc.mix(lot.key.astype(np.uint64) + np.array([i or 0 for i in lot.doc_id], np.int64).astype(np.uint64) * cc.K[0]) >> np.uint64(60)
            bucket = bucket.astype(np.int64)[lot.owner[at]] * VIEWS
            for which, e in model.paths(lot.ids[at], one[at], recent[at]):
                view = model.views(e)
                view += bucket[which][:, None]
                np.add.at(n.ravel(), (2 * view + e.bit).ravel(), np.uint32(1))
        model.kinds, part = None, TaskContext.get().partitionId()
        for k in range(BUCKETS):
            if n[k].any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "bucket": pa.array([k], pa.int32()), "counts": pa.array([packed(n[k])], pa.binary())})

    def add(pdf):
        total = np.zeros(2 * VIEWS, np.int64)
        for x in pdf["counts"]:
            total += unpacked(x)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bucket": pdf["bucket"].iloc[:1], "counts": [packed(np.minimum(total, (1 << 32) - 1))]})

    parts, tables = lots.rdd.getNumPartitions(), lots.mapInArrow(run, schema)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        tables = tables.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part", "bucket").applyInPandas(add, schema)
    out = np.zeros((BUCKETS, VIEWS, 2), np.int64)
    for r in tables.toLocalIterator():
        out[r["bucket"]] = unpacked(r["counts"]).reshape(VIEWS, 2)
    return out


def follow(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, refined) from count_views: each bucket in turn is foretold by the weights so far, which refined maps
    compare with what has come, and then learnt from by a Newton step on all that has been seen."""
    view = np.flatnonzero(n.any(axis=(0, 2)))
    n = n[:, view]
    second, rest = view % KINDS, view // KINDS
    first, rest = rest % KINDS, rest // KINDS
    gate = rest // len(PRIORS) * 16 + KIND_SEEN[first] * 4 + KIND_SEEN[second]
    x = np.stack([PRIORS[rest % len(PRIORS)], KIND_SAYS[first], KIND_SAYS[second], np.full(len(view), 0.3)], axis=1)
    weights = Model.start().astype(float)
    curved = np.tile(64 * np.eye(INPUTS + 1), (GATES, 1, 1))
    total, ones = np.zeros((2, GATES * BINS))
    for both in n:
        came = both.sum(1)
        s = np.clip((x * weights[gate]).sum(1), -8, 8)
        bins = gate * BINS + ((s + 8) * ((BINS - 1) / 16) + 0.5).astype(np.intp)
        total += np.bincount(bins, came, GATES * BINS)
        ones += np.bincount(bins, both[:, 1], GATES * BINS)
        p = squash(s)
        error, bend = both[:, 1] - came * p, came * p * (1 - p)
        slope = np.stack([np.bincount(gate, error * x[:, k], GATES) for k in range(INPUTS + 1)], axis=1)
        for k in range(INPUTS + 1):
            for j in range(INPUTS + 1):
                curved[:, k, j] += np.bincount(gate, bend * x[:, k] * x[:, j], GATES)
        weights += np.clip(np.linalg.solve(curved, slope[:, :, None])[:, :, 0], -1, 1)
    total, ones = total.reshape(GATES, BINS), ones.reshape(GATES, BINS)
    p = (ones + 20 * squash(np.linspace(-8, 8, BINS)[None, :])) / (total + 20)
    return weights.astype(np.float32), stretch(np.clip(p, 1e-4, 1 - 1e-4)).astype(np.float32)


def vocabulary(rows: DataFrame, words: DataFrame) -> Model:
    """The tree over the training words and what else comes from their counts alone."""
    facts = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    documents = rows.count()
    # words met once stay outside, so that escapes and their spelling are learnt as well; of the others, those from a
    # count on that leaves at most VOCABULARY and their bytes, found from a histogram of a few thousand classes of counts
    size, fits = F.floor(F.log2("c") * 64), (F.col("c") > 1) & (F.length("word") <= LONG_WORD)
    classes = words.where(fits).groupBy(size.alias("k")).agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("bytes")).toPandas().sort_values("k", ascending=False)
    fit = classes[(classes["n"].cumsum() <= VOCABULARY) & (classes["bytes"].cumsum() <= VOCABULARY_BYTES)]
    inside = fits & (size >= (int(fit["k"].min()) if len(fit) else 1 << 40))
    top = words.where(inside).toPandas().sort_values(["c", "word"], ascending=[False, True])
    cold = words.where(~inside).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") == 1, 1))).first()
    counts = top["c"].to_numpy(np.int64)
    tokens, distinct = int(facts[0]) + documents, int(facts[1]) + (documents > 0)
    known = [bytes(w) for w in top["word"]]
    bytes_seen = np.ones(END_OF_WORD + 1)
    for w, c in zip(known, np.sqrt(counts).tolist(), strict=True):
        for x in w:
            bytes_seen[x] += c
        bytes_seen[END_OF_WORD] += c
    slots = 1 << int(np.clip(np.ceil(np.log2(max(1, tokens / TOKENS_A_SLOT))), np.log2(LEAST_SLOTS), np.log2(MOST_SLOTS)))
    weights = np.concatenate([counts, [max(1, documents), max(1, int(cold[0]))]])
    return Model(known, counts, Tree.of(weights), Tree.of(bytes_seen), slots, tokens, distinct, documents, int(cold[0]), int(cold[1]))


def learn(rows: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """rows (doc_id, fold, key, text) -> the model, (word, c) of all training words, and the lots with what they are told."""
    return learn_shared(rows)[:3]


def learn_shared(rows: DataFrame) -> tuple:
    """As learn, and the broadcasts of the model without and of its cells: the tree goes out and is stored but once."""
    training = rows.where(F.col("fold") != HELD_OUT)
    words = written(count_words(training), "words")
    model, context = vocabulary(training, words), rows.sparkSession.sparkContext
    shared = context.broadcast(model)
    lots = written(make_lots(rows, shared), "lots")
    told = written(with_told(lots, shared, cc.chunks_for(model.tokens)), "told")
    drop(lots)
    model.favourites = fit_favourites(count_favourites(told, shared))
    model.cells = gather_counts(told, words, shared, model.slots)
    cells = context.broadcast(model.cells)
    model.weights, model.refined = follow(count_views(told, shared, cells))
    return model, words, told, shared, cells


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Null texts count as empty: one token, the end. Rows with a null id are held out. Without training documents every
    token is unknown. bits_per_byte is of the words and the spaces or end behind them. Repeated ids are rows of their
    own. A text's pieces of PIECE words are scored one by one, with the words before them in sight.
    """
    import pyarrow as pa

    body = text_column(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), fold_of(docs["doc_id"]).alias("fold"), F.xxhash64(body).alias("key"), body.alias("text"))
    model, words, lots, shared, cells = learn_shared(rows)
    learnt = model.favourites, model.weights, model.refined
    cold_type = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64()), ("plain", pa.int64()), ("spelt", pa.float32())]))
    out_schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("fold", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("cold", cold_type)])

    def run(batches):
        model = shared.value.ready()
        model.cells, (model.favourites, model.weights, model.refined) = cells.value, learnt
        for _, lot in lots_of(batches):
            logs, plain = model.score(lot)
            ids, owner, n = lot.ids[lot.use], lot.owner[lot.use], len(lot.size)
            escaped = ids == model.escape
            score, base, size, hot = (np.bincount(owner, w, minlength=n) for w in (logs, model.logs.take(ids), np.ones(len(ids)), ~escaped))
            told = told_apart(model, lot, owner[escaped], plain[escaped], cold_type)
            known = hot.astype(np.int64) if model.documents else np.zeros(n, np.int64)
            values = [lot.row, lot.doc_id, lot.fold, size.astype(np.int64), known, base, score, lot.n_bytes, told]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, out_schema, strict=True)], schema=out_schema)

    types = "row long, doc_id long, fold long, n_tokens long, n_known long, base double, score double, n_bytes long, cold array<struct<word: binary, k: long, plain: long, spelt: float>>"
    scored = written(lots.mapInArrow(run, types), "scored")
    drop(lots)
    shared.destroy()
    cells.destroy()
    floor, known, total = float(np.log10(model.tokens + model.distinct + 1.0)), model.known_share, float(max(1, model.cold_tokens))
    # words outside the vocabulary meet their counts in a shuffle; each text's are summed before and after
    own = F.when(F.coalesce(F.col("fold") != HELD_OUT, F.lit(False)), 1).otherwise(0)
    rare = scored.where(F.size("cold") > 0).select("row", own.alias("own"), F.explode("cold").alias("cold")).select("row", "own", "cold.*")
    rare = rare.join(words, "word", "left")
    others = F.coalesce("c", F.lit(0)) - F.col("own")
    class_ = F.when(others > 0, F.log10(F.lit(known) * others / total)).otherwise(F.lit(float(np.log10(1 - known))))
    rare = rare.groupBy("row").agg(
        F.sum(F.col("k") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - floor)).alias("more"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("known"),
        F.sum(F.col("plain") * class_).alias("classes"),
        F.sum(F.when(others > 0, 0.0).otherwise(F.col("plain") * F.col("spelt"))).alias("spelling"),
    )
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score", "n_bytes")]
    full = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("fold").alias("fold"), *sums).join(rare, "row", "left")
    score = F.col("score") + F.coalesce("classes", F.lit(0.0))
    return full.select(
        "doc_id",
        F.coalesce(F.col("fold") == HELD_OUT, F.lit(True)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (-(score + F.coalesce("spelling", F.lit(0.0))) * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def told_apart(model: Model, lot: Lot, owner: np.ndarray, plain: np.ndarray, cold_type):
    """For each of the lot's pieces its distinct words outside the tree, as an array of cold_type: how often they come, how
    often no favourite is right, and how they are spelt where none is. owner, plain: of each of their scored occurrences."""
    import pyarrow as pa

    scored = pa.array(lot.cold, pa.binary()).filter(pa.array(lot.use[lot.ids == model.escape]))
    known = scored.dictionary_encode()
    words, of = known.dictionary, known.indices.to_numpy().astype(np.int64)
    # pieces and words as one number, in order
    pairs, which, k = np.unique(owner * max(1, len(words)) + of, return_inverse=True, return_counts=True)
    piece, word = pairs // max(1, len(words)), pairs % max(1, len(words))
    q = np.bincount(which, plain, len(pairs)).astype(np.int64)
    spelt, lists = np.zeros(len(pairs), np.float32), words.to_pylist()
    for own in (False, True):
        some = np.flatnonzero((q > 0) & (lot.training[piece] == own))
        each, back = np.unique(word[some], return_inverse=True)
        spelt[some] = spell(model, [lists[w] for w in each.tolist()], own)[back]
    columns = [words.take(pa.array(word)), pa.array(k, pa.int64()), pa.array(q), pa.array(spelt)]
    stops = np.concatenate([[0], np.cumsum(np.bincount(piece, minlength=len(lot.size)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), pa.StructArray.from_arrays(columns, fields=list(cold_type.value_type)), type=cold_type)


def spell(model: Model, words: list[bytes], own: bool) -> np.ndarray:
    """log10 of the probability of each word's bytes; own: without its own occurrence."""
    out = np.zeros(len(words))
    for at in range(0, len(words), BATCH_TOKENS):
        letters, starts = model.letters_of(words[at : at + BATCH_TOKENS])
        out[at : at + BATCH_TOKENS] = np.add.reduceat(model.logs_of_letters(letters, own), starts)
    return out
