"""Finding many terms in many texts at once: an Aho-Corasick automaton as numpy tables.

A state is the longest beginning of a term that the text read so far ends with, and a table tells the next state for
each class of bytes. Texts are laid end to end with a byte between them that no term has, and cut into lanes that are
read side by side, one byte of every lane at a step; a lane begins as far ahead of its own bytes as the longest term reaches.
So the work is a table look-up for each byte, whatever the number of terms.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Lanes that are read side by side, at most.
LANES = 4096
#: Stands between texts; no UTF-8 text holds it.
BETWEEN = b"\xff"


class Automaton:
    """Finds all places of some terms; empty and repeated terms are left out. ``terms`` are in the order of their numbers."""

    def __init__(self, terms: Sequence[bytes]) -> None:
        self.terms = [t for t in dict.fromkeys(terms) if t]
        self.length = np.array([len(t) for t in self.terms], np.int64)
        self.longest = int(self.length.max(initial=0))
        used = sorted(set(b"".join(self.terms)) - set(BETWEEN))
        self.kind = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)  # 0: in no term
        self.kind[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for number, term in enumerate(self.terms):
            state = 0
            for k in self.kind[np.frombuffer(term, np.uint8)].tolist():
                state = children[state].setdefault(k, len(children))
                if state == len(children):
                    children.append({})
            ends[state] = number
        self.next = np.zeros((len(children), len(used) + 1), np.int32)
        #: The term that ends at a state, or -1, and the next shorter state where a term ends, or 0.
        self.ends = np.full(len(children), -1, np.int32)
        self.ends[list(ends)] = list(ends.values())
        self.shorter = np.zeros(len(children), np.int32)
        back = np.zeros(len(children), np.int32)
        level = [0]
        while level:
            links = np.array([(s, k, c) for s in level for k, c in children[s].items()], np.int32).reshape(-1, 3)
            state, kind, child = links.T
            rest = self.next[back[state], kind]  # where the state without its first byte goes
            back[child] = np.where(state == 0, 0, rest)
            self.next[level] = self.next[back[level]]
            self.next[state, kind] = child
            self.shorter[child] = np.where(self.ends[back[child]] >= 0, back[child], self.shorter[back[child]])
            level = child.tolist()
        self.told = (self.ends >= 0) | (self.shorter > 0)

    def find(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end, term): every place of every term, overlapping ones too, in bytes, in the order of text and end."""
        none = (np.zeros(0, np.int64),) * 4
        if not self.terms or not texts:
            return none
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        line = self.kind[np.frombuffer(BETWEEN.join([*texts, b""]), np.uint8)]
        ahead = self.longest - 1
        lanes = max(1, min(LANES, len(line) // (4 * self.longest)))
        width = -(-len(line) // lanes)
        padded = np.zeros(ahead + lanes * width, line.dtype)
        padded[ahead : ahead + len(line)] = line
        begin = np.arange(lanes) * width
        state, hits = np.zeros(lanes, np.int32), []
        for step in range(ahead + width):
            state = self.next[state, padded[begin + step]]
            if step >= ahead:
                found = np.flatnonzero(self.told[state])
                if len(found):
                    hits.append((begin[found] + (step - ahead), state[found]))
        if not hits:
            return none
        end, state = (np.concatenate(x) for x in zip(*hits, strict=True))
        ends, terms = [], []
        while len(state):
            own = self.ends[state] >= 0
            ends.append(end[own] + 1)
            terms.append(self.ends[state[own]].astype(np.int64))
            end, state = end[self.shorter[state] > 0], self.shorter[state][self.shorter[state] > 0]
        end, term = np.concatenate(ends), np.concatenate(terms)
        order = np.lexsort((term, end))
        end, term = end[order], term[order]
        text = np.searchsorted(np.cumsum(sizes), end - 1, "right")
        end = end - (np.cumsum(sizes) - sizes)[text]
        return text, end - self.length[term], end, term


def leftmost_longest(texts: Sequence[bytes], surfaces: Sequence[Sequence[bytes]]) -> list[list[tuple[int, int, bytes]]]:
    """For each text the places of its own surfaces that don't overlap, in characters: the leftmost, and there the longest, is taken first."""
    automaton = Automaton([s for own in surfaces for s in own])
    text, start, end, term = automaton.find(texts)
    number = {t: i for i, t in enumerate(automaton.terms)}
    asked = np.unique(np.array([i * len(number) + number[s] for i, own in enumerate(surfaces) for s in own if s], np.int64))
    mine = np.isin(text * len(number) + term, asked)
    text, start, end, term = (x[mine] for x in (text, start, end, term))
    order = np.lexsort((-end, start, text))
    out: list[list[tuple[int, int, bytes]]] = [[] for _ in texts]
    at, free = -1, 0
    for i, a, b, t in zip(*(x[order].tolist() for x in (text, start, end, term)), strict=True):
        if i != at:
            at, free = i, 0
        if a >= free:
            out[i].append((a, b, automaton.terms[t]))
            free = b
    for i, (x, spans) in enumerate(zip(texts, out, strict=True)):
        if spans and not x.isascii():
            chars = np.r_[0, np.cumsum((np.frombuffer(x, np.uint8) & 0xC0) != 0x80)]
            out[i] = [(int(chars[a]), int(chars[b]), s) for a, b, s in spans]
    return out
