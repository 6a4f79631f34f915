"""op2: numbers of words are kept byte by byte, so that slices take less room where they are written and shuffled."""

import zlib

import numpy as np

from brindle.llm import pseudo_likelihood as pl


def test_numbers_in_planes_are_the_same_and_smaller():
    rng = np.random.default_rng(1)
    numbers = np.minimum(rng.zipf(1.2, 50_000), 60_000).astype(np.uint32)
    for x in (numbers, numbers[:1], numbers[:0], np.array([2**32 - 1, 0, 1 << 24], np.uint32)):
        assert (pl.from_planes(pl.in_planes(x)) == x).all() and len(pl.in_planes(x)) == 4 * len(x)
    assert len(zlib.compress(pl.in_planes(numbers), 1)) < 0.9 * len(zlib.compress(numbers.tobytes(), 1))


def test_slices_hold_planes(spark):
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(40))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    row = pl.sliced(docs).first()
    words = [bytes(w) for w in row["words"]]
    flat = pl.from_planes(bytes(row["tokens"]))
    assert b" ".join(words[i] for i in flat).decode() == " ".join(t for _, t in rows)
