"""License scans: Aho-Corasick over whole texts for notice phrases and identifier tags, and licence expressions.

Texts become lower-case words; one automaton over the words, a space at each end, finds every phrase wherever its
words stand one after another. Where it finds an identifier tag, the expression behind each tag in the text is parsed
by the shunting-yard algorithm and evaluated.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame

from tidewright.llm.common import rows_of, text_column

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further phrases, their labels and how sure each makes the scan that the text states its licence.
MORE = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0 1 0": ("cc0", 0.9),
    "released into the public domain": ("public-domain", 0.8),
    "all rights reserved": ("all-rights-reserved", 0.6),
}
TAG = "spdx license identifier"
#: Identifiers that count as permissive when an expression is evaluated.
PERMISSIVE = frozenset("mit apache-2.0 bsd-2-clause bsd-3-clause isc zlib unlicense cc0-1.0 cc-by-4.0 0bsd".split())
BASE_SURE = 0.8
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
TAGGED = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
TOKEN = re.compile(r"[()]|(?<=[A-Za-z0-9+.)])/(?=[A-Za-z0-9(])|[A-Za-z0-9][A-Za-z0-9.+:_-]*")
RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: identifiers and operators in postfix order, lower case; None if the expression isn't one.

    Reading stops where what follows can't go on an expression, as in a tag with other words behind it. An exception
    (WITH) goes with one licence and is one name: behind or before a bracket it is no expression.
    """
    out, stack, want_name, last = [], [], True, ""
    # a slash right between two names is an old way to write or
    for token in ("or" if m.group() == "/" else m.group().lower().rstrip(".:") for m in TOKEN.finditer(expression)):
        if token == "(":
            if not want_name:
                break
            if last == "with":
                return None
            stack.append(token)
        elif token == ")":
            if want_name or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in RANK:
            if want_name or token == "with" and last == ")":
                return None
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            want_name = True
        else:
            if not want_name:
                break
            out.append(token)
            want_name = False
        last = token
    if want_name or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: list[str], allowed: frozenset = PERMISSIVE) -> tuple[bool, list[str]]:
    """(whether the expression can be met with allowed licences alone, its licences; an exception goes with its own)."""
    stack: list[tuple[bool, list[str]]] = []
    for token in expression:
        if token in RANK:
            (b, right), (a, left) = stack.pop(), stack.pop()
            both = [f"{left[-1]} with {right[-1]}"] if token == "with" else left + right
            stack.append((a if token == "with" else a and b if token == "and" else a or b, both))
        else:
            stack.append((token.rstrip("+") in allowed, [token]))
    return stack[0]


@functools.lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE, *MORE, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, permissive, expressions) of a text."""
    words = text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    base, labels, unsure, starts, tagged = set(), set(), 1.0, [], False
    for end, phrase in automaton().iter(line):
        if phrase in BASE:
            base.add(BASE[phrase])
            starts.append(end - len(phrase) - 1)
        elif phrase == TAG:
            tagged = True
        elif MORE[phrase][0] not in labels:
            labels.add(MORE[phrase][0])
            unsure *= 1 - MORE[phrase][1]
    unsure *= (1 - BASE_SURE) ** len(base)
    permissive, expressions = None, []
    for found in TAGGED.finditer(text) if tagged else ():
        parsed = postfix(found.group(1))
        if parsed:
            ok, names = evaluate(parsed)
            permissive = ok if permissive is None else permissive and ok
            labels.update(names)
            expressions.append(" ".join(parsed))
            unsure = 0.0
    first = line.count(" ", 0, min(starts)) if starts else None
    last = line.count(" ", 0, max(starts)) if starts else None
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - unsure, permissive, expressions


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean, expressions array<string>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs: n_words, n_base, first_word, last_word, base_labels, labels, score, permissive, expressions.

    Null texts count as empty: 0 words, empty labels, score 0. first_word and last_word are null without a base
    phrase, permissive without an expression. Ids and rows may repeat; each row is scanned by itself. No shuffle.
    """
    import pyarrow as pa

    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.string())]
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches):
        out = []
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            out.append((doc_id, *scan(text)))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(run, COLUMNS)
