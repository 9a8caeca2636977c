"""Encoding whole texts with a public tokenizer, a word at a time with a bounded memory of words seen."""

from __future__ import annotations

import functools
import itertools
import re
import struct
from unicodedata import normalize

import numpy as np

END_ID = 2
#: White space other than space and line feed; where one stands beside a space or line feed, the text is encoded at once.
ODD = [chr(c) for c in (9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
LONG = 64
KEPT = 100_000
#: How byte-level vocabularies write a space, and each byte.
SPACE = "\u0120"
SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = {b: 0x100 + k for k, b in enumerate(sorted({*range(256)} - SHOWN))}
#: Marks that no split joins to the letters before them; apostrophes begin endings of words.
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")
#: Latin letters, each composed and a letter in every version of Unicode.
LATIN = re.compile("[ A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch


class Memory(dict):
    """key -> make(key), remembering between size and twice size recent short keys."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """ids(text): the library's ids as bytes of little-endian unsigned 32-bit integers.

    Both public files split a text before merging, and never merge over a space or line feed that follows another
    kind of character; so a text's ids are those of its units, one after another. units: "words" for files that
    drop white space and case, "spaced" for those that keep both, white space with the word that follows. Neither
    merges letters with the MARKS behind them, so those are remembered apart.
    """

    def __init__(self, path: str, units: str, size: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.added = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]  # these are found before case is dropped
        self.known = Memory({"words": self.word, "spaced": self.spaced}[units], size)
        self.after_space = Memory(self.after, size) if units == "spaced" else None
        self.keeps_case = units == "spaced"
        self.units = {"words": self.words, "spaced": re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall}[units]
        self.unsafe = re.compile(r"[^\S \n][ \n]|[ \n][^\S \n]").search

    def at_once(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, unit: str) -> bytes:
        """Ids of letters, with a space before them or none: no split divides them, so where they are Latin and of
        normal form the tokenizer's own merges are called alone, and its splits and offsets are left out."""
        if unit.isascii():
            found = self.merge(SPACE + unit[1:] if unit[0] == " " else unit)
        elif LATIN(unit) and (self.keeps_case or unit == unit.lower()):
            found = self.merge(unit.encode().decode("latin-1").translate(BYTES))
        else:
            return self.at_once(unit)
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def word(self, unit: str) -> bytes:
        body = unit.rstrip(MARKS)
        # marks that normal form or lower case split off a letter go with those behind it
        if not (body if body.isascii() else normalize("NFC", body).lower()).isalpha():
            return self.at_once(unit)
        low = body.lower() if body.isascii() else body
        if low == unit:
            return self.letters(unit)
        return self.known[low] + self.known[unit[len(body) :]]

    def spaced(self, unit: str) -> bytes:
        body = unit.rstrip(MARKS)
        letters = body[1:] if body[:1] in (" ", "\n") else body
        if not letters.isalpha():
            return self.at_once(unit)
        if body == unit and unit[0] != "\n":
            return self.letters(unit)
        if body[0] == "\n":
            return self.known["\n"] + self.known[letters] + self.known[unit[len(body) :]]
        return self.known[body] + self.known[unit[len(body) :]]

    def after(self, unit: str) -> bytes:
        """Ids of a unit that its space or line feed has been split from; a line feed is still there."""
        body = unit.rstrip(MARKS)
        if unit[0] == "\n":
            return self.spaced(unit)
        if body == unit or not body.isalpha():
            return self.spaced(" " + unit)
        return self.after_space[body] + self.known[unit[len(body) :]]

    def forget(self) -> None:
        """Drops all but KEPT of the words seen, those met first: what a worker holds on to between its tasks."""
        for m in (self.known, self.after_space):
            if m is not None:
                first = list(itertools.islice(m.items(), KEPT))
                m.clear()
                m.update(first)
                m.old = {}

    @staticmethod
    def words(text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def ids(self, text: str) -> bytes:
        if not self.keeps_case and text.isascii():
            low = text.lower()  # at once, and so a word is remembered once
            if not any(token in low for token in self.added):
                text = low
        if any(c in text for c in ODD) and self.unsafe(text):
            return self.at_once(text)
        if self.after_space is not None and text[:1] not in ("", " ", "\n") and text[-1] not in " \n" and not any(pair in text for pair in ("  ", "\n\n", " \n", "\n ")):
            # single spaces and line feeds only: a plain split, with the space of each unit left out of what is looked up
            first, *rest = text.replace("\n", " \n").split(" ")
            return self.known[first] + b"".join(map(self.after_space.__getitem__, rest))
        return b"".join(map(self.known.__getitem__, self.units(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str, units: str) -> Encoder:
    """One for each Python worker, kept between its tasks."""
    return Encoder(path, units)
