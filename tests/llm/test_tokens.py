import random
import string

import public_tokenizers
import pytest

from tidewright.llm.tokens import Encoder

FILES = [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "words")]


@pytest.mark.parametrize("file, units", FILES)
def test_latin_words_and_marks_are_merged_without_the_splits(file, units):
    known, asked = Encoder(public_tokenizers.path(file), units), []
    at_once = known.at_once
    known.at_once = lambda unit: asked.append(unit) or at_once(unit)
    text = "queóra laètion&&& überst!! thheinou###, ñmita?"
    assert known.ids(text) == at_once(text)
    assert sorted(asked) == ["!!", "###,", "&&&", "?"]  # each run of marks once, no word


def test_a_word_of_any_case_is_remembered_once():
    known = Encoder(public_tokenizers.path("word_bpe_49k.json"), "words")
    text = "Queora QUEORA queora, Queora, <b> X1Y"
    assert known.ids(text) == known.at_once(text)
    assert sorted(known.known) == sorted(["queora", "queora,", ",", "<b>", "x1y"])
    for added in known.added:
        for odd in (added, added.upper(), added.title()):
            for text in (f"Aa {odd} Bb", f"AA{odd}BB", odd):
                assert known.ids(text) == known.at_once(text)


@pytest.mark.parametrize("file, units", FILES)
def test_odd_units_have_the_ids_of_the_library(file, units):
    known, r = Encoder(public_tokenizers.path(file), units), random.Random(1)
    letters = "aZéßÖñİıŉǅſ́ʼn" + string.punctuation + "  \n19中"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    texts += [f"a{chr(c)}{end} {chr(c)}b<|endoftext|> {chr(c)}{end}" for c in range(0xC0, 0x250) for end in ("", "!'", "'s!")]
    assert [t for t in texts if known.ids(t) != known.at_once(t)] == []
