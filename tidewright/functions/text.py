"""Text of filings: visible text of HTML, item sections, links, and word pieces."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAP = 8192
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
HIDDEN = re.compile(r"style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
ITEM = re.compile(r"(?<![A-Za-z0-9])item (?=\d)", re.I | re.A)


def visible(html: str | None, cap: int = CAP) -> str:
    """Text outside comments and hidden elements (scripts, styles, inline headers, undisplayed divisions).

    Tags count as spaces. The text is cut at cap characters and white space collapsed after that, in this order. A
    hidden element ends with the end tag of its own kind at its own depth, or with the page.
    """
    out, size, at, hidden, depth = [], 0, 0, None, 0
    for m in TAG.finditer(html or ""):
        if hidden is None:
            out.append(html[at : m.start()] + " ")
            size += len(out[-1])
            if size >= cap:
                break
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name or m.group(3).rstrip().endswith("/") or name in VOID:
            continue
        if hidden is None:
            if not m.group(1) and (name in ("script", "style", "ix:header") or name == "div" and HIDDEN.search(m.group(3))):
                hidden, depth = name, 1
        elif name == hidden:
            depth += -1 if m.group(1) else 1
            hidden = hidden if depth else None
    else:
        if hidden is None:
            out.append((html or "")[at:])
    return " ".join("".join(out)[:cap].split())


def item_sections(text: str | None, cap: int = CAP) -> str:
    """Sections that begin at "item" and a number, but for item 9.01, joined by a space and cut at cap characters.

    A text without such sections is returned itself, cut in the same way.
    """
    text = text or ""
    starts = [m.start() for m in ITEM.finditer(text)]
    parts = [text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)], strict=False)]
    return (" ".join(p for p in parts if not p.lower().startswith("item 9.01")) or text)[:cap]


def mapped(f):
    # row by row: texts are long, and a batch of Arrow holds ten thousand of them
    return F.udf(f, "string", useArrow=False)


def visible_text(html: Column) -> Column:
    return mapped(visible)(html)


def sections(text: Column) -> Column:
    return mapped(item_sections)(text)


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row for each href, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)href\s*=\s*[\"']([^\"']*)"), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("position", "href"))


def is_exhibit(c: Column) -> Column:
    return c.rlike(r"(?i)(ex(hibit)?[-_ ]?99)")


def resolved(base: Column, href: Column) -> Column:
    """An href against its page: absolute as it is, with the host for a leading slash, else in the page's folder."""
    host = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace(base, r"[^/]*$", "")
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(folder, href))


@functools.lru_cache(maxsize=1)
def public_pieces(path: str) -> list[str]:
    """A vocabulary for WordPieces from a public sentencepiece file, lower-cased.

    Its marked pieces begin words, the others go on with them; single characters do both.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = dict.fromkeys(["[PAD]", "[UNK]", "[CLS]", "[SEP]"])
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).lower()
        body = piece.removeprefix("▁")
        if body and "▁" not in body:
            out |= dict.fromkeys([body, "##" + body] if len(body) == 1 else [body if piece != body else "##" + body])
    return list(out)


class WordPieces:
    """Lower-cased words and signs, cut greedily into the longest pieces of a vocabulary, later ones marked by ##."""

    def __init__(self, vocabulary: list[str]):
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.longest = max(map(len, vocabulary), default=1)

    @functools.lru_cache(maxsize=100_000)  # noqa: B019
    def word(self, w: str) -> tuple[int, ...]:
        out, at = [], 0
        while at < len(w):
            for to in range(min(len(w), at + self.longest), at, -1):
                i = self.ids.get(("##" if at else "") + w[at:to])
                if i is not None:
                    out.append(i)
                    at = to
                    break
            else:
                return (self.ids["[UNK]"],)
        return tuple(out)

    def encode(self, text: str | None, length: int) -> tuple[list[int], list[int]]:
        """(ids, mask) of exactly `length`, with [CLS] and [SEP], cut or padded with [PAD]."""
        # words are cut up until there are enough ids
        words = re.finditer(r"[^\W_]+|[^\w\s]|_", (text or "").lower())
        ids = list(itertools.islice((i for w in words for i in self.word(w[0])), length - 2))
        ids = [self.ids["[CLS]"], *ids, self.ids["[SEP]"]]
        return ids + [self.ids["[PAD]"]] * (length - len(ids)), [1] * len(ids) + [0] * (length - len(ids))


def word_pieces(rows: DataFrame, text: str, vocabulary: list[str], length: int, version: str = "v1") -> DataFrame:
    """Adds ids, mask and their input hash, which names equal model inputs."""
    pieces = WordPieces(vocabulary)

    @F.pandas_udf("struct<ids:array<int>,mask:array<int>,input_hash:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        found = [pieces.encode(x, length) for x in s]
        hashes = [hashlib.sha256(f"{version}|{','.join(map(str, i))}|{','.join(map(str, m))}".encode()).hexdigest() for i, m in found]
        return pd.DataFrame({"ids": [f[0] for f in found], "mask": [f[1] for f in found], "input_hash": hashes})

    return rows.withColumn("_w", run(F.col(text))).select(*rows.columns, "_w.*")
