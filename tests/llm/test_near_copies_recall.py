"""Recall of the stage's tables at the threshold, rows of repeated and null ids, and groups without a row per pair."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from brindle.llm import near_copies, simhash
from tests.llm.test_llm import DOC, SF
from tests.llm.test_near_copies import brute_shingles


def test_tables_find_pairs_at_the_threshold():
    """Sets at a similarity of exactly 0.8, of sizes from 9 to 900."""
    rng = np.random.default_rng(1)
    for n in (9, 90, 900):
        one, two = [], []
        for _ in range(300):
            x = rng.integers(0, 1 << 63, n * 10 // 9, np.uint64)  # 8 of 10 parts shared, one each of their own
            part = len(x) // 10
            one.append(near_copies.margins(x[: 9 * part]))
            two.append(near_copies.margins(np.concatenate([x[: 8 * part], x[9 * part : 10 * part]])))
        stored, asked = zip(*[near_copies.golay_keys(np.array(m)) for m in (one, two)], strict=True)
        found = [bool(np.isin(stored[0][i], asked[1][i]).any() or np.isin(stored[1][i], asked[0][i]).any()) for i in range(300)]
        assert np.mean(found) >= 0.97
        fps = [np.packbits(np.array(m)[:, :64] > 0, axis=1, bitorder="little").view("<u8")[:, 0] for m in (one, two)]
        assert (np.bitwise_count(fps[0] ^ fps[1]) <= near_copies.FAR).all()


def rows_of(spark, rows):
    docs = spark.createDataFrame([(i, x, "en", s, None) for i, x, s in rows], DOC).repartition(3)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect()
    return sorted(((-1 if r.doc_id is None else r.doc_id, r.text, r.source) for r in kept), key=str)


def test_one_text_of_each_group_whatever_the_ids(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    assert rows_of(spark, [(2, two, "s"), (5, one, "s"), (5, two, "s")]) == [(2, two, "s"), (5, one, "s")]
    assert rows_of(spark, [(1, one, "s"), (None, one, "s"), (None, two, "s")]) == [(-1, two, "s"), (1, one, "s")]
    assert rows_of(spark, [(1, one, "s"), (1, one, "t")]) == rows_of(spark, [(1, one, "t"), (1, one, "s")])


@pytest.mark.parametrize("seed", range(3))
def test_repeated_and_null_ids_against_brute_force(spark, seed):
    rng = random.Random(seed)
    bases = [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(6)]
    texts = bases + [b + " tail" for b in bases] + ["", None]
    rows = [(rng.choice([None, *range(8)]), rng.choice(texts), rng.choice("st")) for _ in range(60)]
    sets = {x: brute_shingles(x) for x in {x for _, x, _ in rows}}
    group = {x: min((y or "" for y in sets if (sets[x] == sets[y]) or (sets[x] | sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]))), key=str) for x in sets}
    kept = rows_of(spark, rows)
    least = collections.defaultdict(list)
    for i, x, _ in rows:
        least[group[x]].append((i is None, i or 0))
    assert collections.Counter(group[x] for _, x, _ in kept) == collections.Counter(least.keys())
    assert {group[x]: i for i, x, _ in kept} == {g: (-1 if min(v)[0] else min(v)[1]) for g, v in least.items()}


def test_dense_groups_reach_the_same(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 30)  # so that keys are cut into pairs of blocks
    monkeypatch.setattr(simhash, "HOT", 5)
    rng = random.Random(3)
    fps = {0, 1, 7, 2**64 - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        fps |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), k)) for _ in range(40) for k in (1, 2, 3)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    root = {x: x for x in signed}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(pairs):
        for a, b in pairs:
            x, y = sorted((top(a), top(b)))
            root[y] = x
        return {x: top(x) for x in signed}

    pairs = simhash.reaching(nodes).collect()
    got = join((r.a, r.b) for r in pairs)
    root = {x: x for x in signed}
    want = join((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert got == want and len(pairs) < sum(1 for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
