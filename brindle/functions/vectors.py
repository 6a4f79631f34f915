"""Functions on vectors and spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.patterns import leftmost_longest
from brindle.functions.text import base_form

DIMENSIONS = 384


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays over their common length; 0 if one is empty or zero."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, F.greatest(n, F.lit(1))), F.slice(b, 1, F.greatest(n, F.lit(1)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    return F.when((n > 0) & (norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def slots(tokens: Sequence[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(place, sign) of each token by its MD5 as one number: the remainder by the dimensions, and 1 where bit 9 is set, else -1.

    The number is read as four parts of 32 bits, from the highest; the remainder is carried from part to part.
    """
    parts = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest() for t in tokens), ">u4").reshape(-1, 4).astype(np.int64)
    place = np.zeros(len(parts), np.int64)
    for part in parts.T:
        place = (place * ((1 << 32) % dimensions) + part) % dimensions
    return place, np.where(parts[:, 3] >> 9 & 1, 1, -1)


def hash_embedding(text: Column | str, dimensions: int = DIMENSIONS) -> Column:
    """Signed counts by slot of the words in lower case, or of the character triples if there is no word, to length 1; zeros without either.

    Each different token of a batch is hashed once, and counts are numpy sums over the batch.
    """

    def run(texts: pd.Series) -> pd.Series:
        found = [re.findall(r"\w+", t.lower()) or [t[i : i + 3] for i in range(len(t) - 2)] for t in (x or "" for x in texts)]
        number = {t: i for i, t in enumerate(dict.fromkeys(t for f in found for t in f))}
        place, sign = slots(list(number), dimensions)
        each = np.fromiter((number[t] for f in found for t in f), np.int64)
        out = np.zeros((len(found), dimensions))
        np.add.at(out, (np.repeat(np.arange(len(found)), [len(f) for f in found]), place[each]), sign[each])
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return pd.Series(list(out / np.where(norm > 0, norm, 1.0)))

    return F.pandas_udf(run, "array<double>")(text)


#: Letters up to which names are compared side by side (6 bits hold a place), and pairs that are at a time.
SIDE, PAIRS_AT_ONCE = 60, 8192


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, k) for each pair of rows: the longest block a[i : i + k] == b[j : j + k], the first in a and there the first in b."""
    n, columns = len(a), np.ascontiguousarray(b.T)
    place = (63 - np.arange(len(columns), dtype=np.uint16))[:, None]
    run, best, end = np.zeros((len(columns) + 1, n), np.uint16), np.zeros(n, np.uint16), np.zeros(n, np.int64)
    for i, letter in enumerate(np.ascontiguousarray(a.T)):
        run[1:] = (run[:-1] + np.uint16(64)) * (letter == columns)  # 64 times the letters of the block that ends at i and here
        top = (run[1:] + place).max(axis=0)
        better = top >> 6 > best >> 6
        best, end = np.where(better, top, best), np.where(better, i, end)
    k = (best >> 6).astype(np.int64)
    return end - k + 1, 64 - (best & 63).astype(np.int64) - k, k


def matching_ratios(names: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """SequenceMatcher(None, names[i], names[j]).ratio() of each pair; those of names that aren't long are found in numpy, block after block of many pairs."""
    lengths = np.array([len(x) for x in names], np.int64)
    short = np.flatnonzero(lengths <= SIDE)
    flat = np.frombuffer("".join(names[x] for x in short).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, flat = np.unique(flat, return_inverse=True)
    codes = np.zeros((len(names), lengths[short].max(initial=0) + 1), np.min_scalar_type(len(letters) + 2))
    within = np.arange(codes.shape[1]) < lengths[:, None]
    within[lengths > SIDE] = False
    codes[within] = flat + 2

    def window(of: np.ndarray, low: np.ndarray, high: np.ndarray, beyond: int) -> np.ndarray:
        at = low[:, None] + np.arange((high - low).max())
        return np.where(at < high[:, None], codes[of[:, None], np.minimum(at, codes.shape[1] - 1)], codes.dtype.type(beyond))

    def matched(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        who, total = np.arange(len(i)), np.zeros(len(i), np.int64)
        a0, b0, a1, b1 = np.zeros_like(i), np.zeros_like(j), lengths[i], lengths[j]
        while len(who):
            x, y, k = _longest(window(i[who], a0, a1, 0), window(j[who], b0, b1, 1))
            x, y = x + a0, y + b0
            total += np.bincount(who, k, len(total)).astype(np.int64)
            left, right = (k > 0) & (x > a0) & (y > b0), (k > 0) & (x + k < a1) & (y + k < b1)
            both = lambda low, high: np.concatenate([low[left], high[right]])  # noqa: E731, B023
            who, a0, a1, b0, b1 = both(who, who), both(a0, x + k), both(x, a1), both(b0, y + k), both(y, b1)
        return total

    i, j = np.asarray(i, np.int64), np.asarray(j, np.int64)
    side, out = (lengths[i] <= SIDE) & (lengths[j] <= SIDE), np.ones(len(i))
    for at in np.flatnonzero(~side).tolist():
        out[at] = SequenceMatcher(None, names[i[at]], names[j[at]]).ratio()
    some = np.flatnonzero(side & (lengths[i] + lengths[j] > 0))
    for s in range(0, len(some), PAIRS_AT_ONCE):
        at = some[s : s + PAIRS_AT_ONCE]
        out[at] = 2.0 * matched(i[at], j[at]) / (lengths[i[at]] + lengths[j[at]])
    return out


def entity_similarity(a: Column | str, b: Column | str, least: float = 0.0) -> Column:
    """1 for equal names or bases, 0.95 if one is the other's base, else the matching-blocks ratio of a to b, which alone needs Python.

    A ratio whose upper bounds, by lengths and by letters in common, lie below ``least`` is not worked out and counts as 0.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    base_a, base_b = base_form(a), base_form(b)

    def one(p: str | None, q: str | None) -> float:
        if p is None or q is None:
            return 0.0
        found = SequenceMatcher(None, p, q)
        return found.ratio() if found.real_quick_ratio() >= least and found.quick_ratio() >= least else 0.0

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(*pair) for pair in zip(x, y, strict=True)], dtype=float)

    alike = (a == b) | ((base_a != "") & (base_a == base_b))
    near = (base_a != "") & ((base_a == b) | (base_b == a))
    settled = alike | near
    nothing = F.lit(None).cast("string")
    measured = F.pandas_udf(ratio, "double")(F.when(settled, nothing).otherwise(a), F.when(settled, nothing).otherwise(b))
    return F.when(alike, 1.0).when(near, 0.95).otherwise(measured)


def span_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap of two spans by the stretch that both cover; 0 without overlap."""
    common = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    return F.when(common > 0, common / (F.greatest(a_end, b_end) - F.least(a_start, b_start))).otherwise(0.0)


#: Bytes of surfaces that one automaton holds, or little more.
SURFACE_BYTES = 1 << 16


def resolve_spans(text: Column | str, surfaces: Column | str) -> Column:
    """array of (start, stop, surface) of an array of surfaces in a text: those that don't overlap, the leftmost and there the longest first.

    One automaton finds the surfaces of many rows in one pass over their texts. Null and empty surfaces have no place.
    """

    def spans(texts: list[bytes], lists: list[list[bytes]]) -> list[list[dict]]:
        return [[{"start": p, "stop": q, "surface": s.decode()} for p, q, s in found] for found in leftmost_longest(texts, lists)]

    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out, held, size = [], ([], []), 0
        for t, own in zip(texts, lists, strict=True):
            known = [s.encode() for s in (() if own is None else own) if s]
            held[0].append((t or "").encode())
            held[1].append(known)
            size += sum(map(len, known))
            if size > SURFACE_BYTES:
                out += spans(*held)
                held, size = ([], []), 0
        return pd.Series(out + spans(*held), index=texts.index)

    return F.pandas_udf(run, "array<struct<start:int,stop:int,surface:string>>")(text, surfaces)
