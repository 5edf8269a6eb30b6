"""Packing's ids against the tokenizer's."""

import random

import pytest

from tessera.llm import packing
from tessera.llm.queries import default_tokenizer


@pytest.mark.parametrize("text", ["end <|EndOfText|> next", "<|STARTOFTEXT|>", "a <|endoftext|> b <|EndOfText|> c", "x<|endoftexT|>y"])
def test_special_strings_in_other_case(text):
    words = packing.WordIds(default_tokenizer())
    assert words.text(text) == words._encode(text)


@pytest.mark.parametrize("text", ["İKİ, DERSLERİ.", "MERSİNLİ, VE TÜRKİYE'NİN GENELİ.", "İ. İ, Aİ. ẞ. ǰ, ΐ."])
def test_capitals_that_become_letter_and_mark(text):
    words = packing.WordIds(default_tokenizer())
    assert words.text(text) == words._encode(text)


def test_hard_characters_have_the_tokenizers_ids():
    """Words of all characters whose lower or upper case is longer, of marks that combine, and of plain letters."""
    rng = random.Random(3)
    hard = [chr(c) for c in range(0x80, 0x1F000) if not 0xD800 <= c < 0xE000 and (len(chr(c).lower()) > 1 or len(chr(c).upper()) > 1 or not chr(c).lower().isalpha() and chr(c).isalpha())]
    hard += [chr(c) for c in range(0x300, 0x345)] + list("İıſKÅΣσς가각ᄀ") + ["가", "é"]
    words = packing.WordIds(default_tokenizer())
    for _ in range(8000):
        word = "".join(rng.choice(hard if rng.random() < 0.4 else "abXYZé") for _ in range(rng.randrange(1, 6))) + rng.choice(["", ",", ".", "..", "'s"])
        assert words.text(word) == words._encode(word), ascii(word)


@pytest.mark.parametrize("text", ["NASA cafe\u0301 ABC, K", "e\u0301 Don'T \"SAID's\" X-Y", "\u0301 I'LL 'SAY ΟΔΟΣ, A.\u0301"])
def test_capitals_in_a_text_with_marks(text):
    words = packing.WordIds(default_tokenizer())
    assert words.text(text) == words._encode(text)


def test_printable_words_have_the_tokenizers_ids():
    rng, words = random.Random(4), packing.WordIds(default_tokenizer())
    some = ["'s", "'LL", "'re", "'d", "'", '"', "abc", "The", "s", "d", "2019", "7", "-", "...", "://", "_", "%", "<|", "~"]
    for _ in range(8000):
        word = "".join(rng.choice(some) for _ in range(rng.randrange(1, 6)))
        assert words.text(word) == words._encode(word), word


def test_rare_words_are_remembered():
    """Words that come again after a quarter of a million others are not merged again."""
    words, calls = packing.WordIds(default_tokenizer()), []
    merges = words.merges

    class Counted:
        def tokenize(self, text):
            calls.append(text)
            return merges.tokenize(text)

    words.merges = Counted()
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in letters[:14])
    first = words.text(text)
    made = len(calls)
    assert words.text(text) == first and len(calls) == made == 26**3 * 14


@pytest.mark.parametrize("text", ["Naïve, CAFÉ. naïve CAFÉ, É. é", "Ünï., ÑU,. ñu.. ., .é", "ABC. abc, Abc., abc,. x. é.É,"])
def test_words_with_a_mark_have_the_tokenizers_ids(text):
    words = packing.WordIds(default_tokenizer())
    assert words.text(text) == words._encode(text) == words.text(text)
