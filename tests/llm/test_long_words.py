"""Long words take merge rounds as any others, and give the library's ids."""

import random

import pytest
import sentencepiece

from brindle.llm import pieces

LETTERS = "abcdefghijklmnopqrstuvwxyz"
LONG = {
    "letters": lambda r: "".join(r.choice(LETTERS) for _ in range(1_000_000)),
    "spaces": lambda r: " " * 1_000_000,
    "spaces and words": lambda r: "".join(" " * r.randrange(1, 60) + r.choice(["x", "the", "\n", "ab"]) for _ in range(20_000)),
    "one letter": lambda r: "a" * 300_000,
    "two letters": lambda r: "th" * 300_000,
    "overlaps": lambda r: "entheration" * 30_000,
    "printable": lambda r: "".join(chr(r.randrange(33, 127)) for _ in range(300_000)),
}


@pytest.fixture(scope="module")
def both():
    path = pieces.default_model()
    return pieces.Encoder(pieces.Vocabulary(path)), sentencepiece.SentencePieceProcessor(model_file=path)


@pytest.mark.parametrize("name", sorted(LONG))
def test_one_long_word(both, name):
    encoder, library = both
    text = LONG[name](random.Random(1))
    assert encoder.encode([text])[0] == library.encode(text)


def test_short_words_of_few_letters(both):
    encoder, library = both
    r = random.Random(2)
    alphabets = [" ", " a", "th e", LETTERS, "=- ", "äöüßéñ日本語😀 ", " \n\t.,=-_09"]
    texts = ["".join(r.choice(a) for _ in range(r.randrange(1, 70))) for a in alphabets for _ in range(400)]
    assert encoder.encode(texts) == library.encode(texts)
