"""Dense groups of the near-duplicate stage: compared in blocks, with no row for each pair."""

import random

import numpy as np
import pytest

from brindle.llm import near_copies
from tests.llm.test_llm import DOC
from tests.llm.test_near_copies import brute_groups


def dense():
    """Texts around one, of which most pairs are near the threshold, and some that are near none."""
    rng = random.Random(5)
    base, texts = [f"w{i}" for i in range(146)], {}
    for i in range(240):
        words = list(base)
        for j in rng.sample(range(len(words)), rng.randrange(1, 6)):
            words[j] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    return texts | {i: " ".join(f"y{rng.randrange(10**6)}" for _ in range(50)) for i in range(240, 260)}


@pytest.mark.parametrize("block", [16, 512])
def test_dense_group_without_a_row_per_pair(spark, monkeypatch, block):
    texts, met = dense(), []
    real = near_copies._met
    monkeypatch.setattr(near_copies, "_met", lambda *a: met.append(real(*a)) or met[-1])
    monkeypatch.setattr(near_copies, "BLOCK", block)  # so that homes are cut into pairs of blocks
    docs = spark.createDataFrame([(k, x, "en", "s", None) for k, x in texts.items()], DOC).repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    groups, near = brute_groups(texts)
    assert got == groups and len(near) > 3000 and 1 < len({*groups.values()}) < len(texts)
    assert sum(m.count() for m in met) < 500


def test_estimates_lose_no_pair():
    """Sets at a similarity of exactly 0.8, of sizes from 9 to 900, are compared in full in a block; below it none is joined."""
    rng = np.random.default_rng(2)
    for n in (9, 90, 900):
        found = 0
        for _ in range(200):
            x = np.sort(rng.integers(0, 1 << 63, n * 10 // 9, np.uint64))
            mixed = rng.permutation(len(x))
            part = len(x) // 10
            one, two = np.sort(x[mixed[: 9 * part]]), np.sort(x[mixed[part:]])
            shared = len(np.intersect1d(one, two))
            similar = shared >= 0.8 * (len(one) + len(two) - shared) - 1e-9
            got = near_copies.joining([one, two], np.arange(2), np.arange(2), 0.8)
            assert not got or similar
            found += (got == [(0, 1)]) == similar
        assert found >= 198


def test_chance_crowds_no_key():
    """Of sets that are dealt to keys evenly fewer than one key in a hundred thousand is crowded, however many there are."""
    rng = np.random.default_rng(3)
    for share in (0.5, 0.99, 1, 1.99, 2, 3.9, 8):
        assert (rng.poisson(share, 300_000) > near_copies.crowded_from(int(share * 2**24))).sum() <= 3
