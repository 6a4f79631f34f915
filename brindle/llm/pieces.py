"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut where no piece of the vocabulary can reach across, and every different
word is encoded once. A word is cut further between characters that stand next to each
other in no piece. The symbols of all these stretches lie in one flat numpy array. In each
round every stretch finds its least rank by a segmented minimum, and merges the places that
have it at once, from the left and without overlap, up to and with the first whose result
makes a pair of the same or a lower rank with a neighbour: one merge after the other would
turn to that pair next. Then the array is compacted, until no pair remains. A run of a symbol
whose pieces all tie is merged by position: it falls into equal pieces that can't grow.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from brindle.llm._common import small_batches, table

SPACE = "▁"
NO_PAIR = np.int64(1 << 30)
#: Words whose encodings a task remembers at most.
MOST_WORDS = 300_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """What encoding needs of a model: pieces, the rank of each, and which are bytes. Small, and sent to tasks as it is."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.is_byte = [model.is_byte(i) for i in range(n)]
        self.normal = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        scores = [model.get_score(i) for i in range(n)]
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in range(n) if self.normal[i]}, reverse=True))}
        self.rank = [order[scores[i]] if self.normal[i] else -1 for i in range(n)]


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        v = vocabulary
        self.n = len(v.pieces)
        normal = [i for i in range(self.n) if v.normal[i]]
        symbol = {v.pieces[i]: i for i in normal}
        for c in sorted({c for i in normal for c in v.pieces[i]} - set(symbol)):
            symbol[c] = len(v.pieces) + len(symbol)  # a character that only occurs within pieces
        self.width = max(symbol.values()) + 1
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        pairs: dict[int, tuple[int, int]] = {}
        grows: dict[int, int] = {}  # least rank of a piece that has this one as a part of a pair
        for i in normal:
            p = v.pieces[i]
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (i, v.rank[i])
                    for part in (a, b):
                        grows[part] = min(grows.get(part, v.rank[i]), v.rank[i])
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.ranks = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.next_to = np.array(sorted({ord(a) << 21 | ord(b) for i in normal for a, b in zip(v.pieces[i], v.pieces[i][1:], strict=False)}), np.int64)
        self.tied = [t for s in symbol.values() if (t := self._tied_run(s, pairs, grows))]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(v.pieces) if v.is_byte[i]}
        self.piece_bytes = [bytes([int(p[3:5], 16)]) if v.is_byte[i] else p.replace(SPACE, " ").encode() if v.normal[i] else b"" for i, p in enumerate(v.pieces)]
        reach = [v.pieces[i] for i in normal]
        apart = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in reach)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if apart else "(?s).+")
        self.words: dict[str, tuple[list[int], bytes, bytes]] = {}

    def _tied_run(self, s: int, pairs: dict[int, tuple[int, int]], grows: dict[int, int]) -> tuple[int, int, int, int, np.ndarray] | None:
        """(symbol, rank, length, piece, what mustn't stand before) if a run of the symbol falls into pieces of that length.

        All merges of such a run have one rank, none of their results grows at a lower one, and the piece that so many symbols
        end as grows no further. Merging from the left then is a stack: what lies below its top never merges again.
        """
        hit = pairs.get(s * self.width + s)
        if hit is None or grows.get(hit[0]) != hit[1]:
            return None
        rank, stack, chain = hit[1], [s], {s}
        for length in range(2, 64):
            stack.append(s)
            while len(stack) > 1 and (hit := pairs.get(stack[-2] * self.width + stack[-1])):
                if hit[1] != rank or grows.get(hit[0], rank) < rank:
                    return None
                stack[-2:] = [hit[0]]
                chain.add(hit[0])
            if len(stack) == 1 and stack[0] not in grows:
                return s, rank, length, stack[0], np.array(sorted({k // self.width for k in pairs if k % self.width in chain}), np.int64)
        return None

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; NO_PAIR where there is none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NO_PAIR), self.merged[at]

    def _due(self, symbols: np.ndarray, part: np.ndarray, rank: np.ndarray, result: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The places that are merged in this round: those of their stretch's least rank, up to and with the first that makes a pair which comes before the others."""
        place, equal = np.arange(len(symbols)), rank == least
        starts = equal & ~np.r_[False, equal[:-1]]
        run = place - np.maximum.accumulate(np.where(starts, place, 0))
        at = np.flatnonzero(equal & (run % 2 == 0))
        own, made, low = part[at], result[at], rank[at]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbols) - 1)
        glued = np.r_[False, (at[1:] - at[:-1] == 2) & (own[1:] == own[:-1])]  # the symbol before is the result of the place before
        left = np.where((at > 0) & (part[before] == own), np.where(glued, np.r_[0, made[:-1]], symbols[before]), -1)
        right = np.where((at + 2 < len(symbols)) & (part[after] == own), symbols[after], -1)
        turns = (self._pair(left, made)[0] <= low) | (self._pair(made, right)[0] <= low)
        earlier = np.cumsum(turns) - turns
        at_start = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], earlier, 0))
        return at[earlier == at_start]

    def _runs(self, symbols: np.ndarray, part: np.ndarray, least: np.ndarray) -> np.ndarray | None:
        """Merges tied runs by position, in place; which symbols stay, or None if there was nothing to merge."""
        kept = None
        for s, rank, length, piece, apart in self.tied:
            inside = (symbols == s) & (least == rank)
            if not inside.any():
                continue
            begins = inside & ~np.r_[False, inside[:-1] & (part[1:] == part[:-1])]
            start = np.flatnonzero(begins)
            ends = np.r_[start[1:], len(symbols)]
            size = np.add.reduceat(inside.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
            size = np.minimum(size, ends - start)
            before = np.where((start > 0) & (part[np.maximum(start - 1, 0)] == part[start]), symbols[np.maximum(start - 1, 0)], -1)
            whole = np.where(np.isin(before, apart), 0, size // length)
            if not whole.any():
                continue
            kept = np.ones(len(symbols), bool) if kept is None else kept
            n = whole * length
            places = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) % length == 0
            symbols[places[first]] = piece
            kept[places[~first]] = False
        return kept

    def merge(self, words: Sequence[str]) -> list[list[int]]:
        """The ids of each word; words aren't empty."""
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        symbols, word = self.of_char[codes], np.repeat(np.arange(len(words)), lengths)
        if not len(symbols):
            return [[] for _ in words]
        char = np.where(symbols < 0, codes, 0)  # of what isn't in the vocabulary
        two = codes[:-1] << 21 | codes[1:]
        apart = self.next_to[np.minimum(np.searchsorted(self.next_to, two), len(self.next_to) - 1)] != two
        fresh = np.r_[True, (word[1:] != word[:-1]) | apart]
        part, owner = np.cumsum(fresh) - 1, word[fresh]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def ranked() -> tuple[np.ndarray, np.ndarray]:
            rank, result = np.full(len(symbols), NO_PAIR), np.zeros(len(symbols), np.int64)
            rank[:-1], result[:-1] = self._pair(symbols[:-1], symbols[1:])
            rank[:-1][part[1:] != part[:-1]] = NO_PAIR
            return rank, result

        rank, result = ranked()
        while len(symbols):
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            size = np.diff(np.r_[first, len(symbols)])
            best = np.minimum.reduceat(rank, first)
            open_ = best < NO_PAIR
            if not open_.all():
                shut = np.repeat(~open_, size)
                done.append((part[shut], symbols[shut], char[shut]))
                kept = ~shut
                symbols, part, char, rank, result = symbols[kept], part[kept], char[kept], rank[kept], result[kept]
                continue
            least = np.repeat(best, size)
            if self.tied and (kept := self._runs(symbols, part, least)) is not None:
                symbols, part, char = symbols[kept], part[kept], char[kept]
                rank, result = ranked()
                continue
            at = self._due(symbols, part, rank, result, least)
            symbols[at] = result[at]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            moved = at - np.arange(len(at))  # where the merged symbols come to lie
            symbols, part, char, rank, result = symbols[kept], part[kept], char[kept], rank[kept], result[kept]
            for i in (moved, moved[moved > 0] - 1):
                last = i == len(symbols) - 1
                j = np.where(last, i, i + 1)
                r, m = self._pair(symbols[i], symbols[j])
                rank[i] = np.where(last | (part[i] != part[j]), NO_PAIR, r)
                result[i] = m
        part, symbols, char = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(part, kind="stable")
        return self._split(owner[part[order]], symbols[order], char[order], len(words))

    def _split(self, word: np.ndarray, symbols: np.ndarray, char: np.ndarray, n: int) -> list[list[int]]:
        """The ids of each word; a character that is no piece gives the ids of its bytes."""
        rare = np.flatnonzero((symbols < 0) | (symbols >= self.n))
        spelt = {i: self._bytes(s, c) for i, s, c in zip(rare.tolist(), symbols[rare].tolist(), char[rare].tolist(), strict=True)}
        times = np.ones(len(symbols), np.int64)
        times[rare] = [len(x) for x in spelt.values()]
        ids, first = np.repeat(symbols, times), np.cumsum(times) - times
        for i, x in spelt.items():
            ids[first[i] : first[i] + len(x)] = x
        flat, ends = ids.tolist(), np.cumsum(np.bincount(np.repeat(word, times), minlength=n)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _bytes(self, symbol: int, char: int) -> list[int]:
        c = chr(char) if symbol < 0 else self.char_of(symbol)
        return [self.byte_id[b] for b in c.encode()]

    def char_of(self, symbol: int) -> str:
        return chr(int(np.flatnonzero(self.of_char == symbol)[0]))

    def cut_up(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, texts: Sequence[list[str]]) -> None:
        """Encodes the words of some texts that aren't known yet."""
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        fresh = list(dict.fromkeys(w for t in texts for w in t if w not in self.words))
        found = dict(zip(fresh, self.merge(fresh) if fresh else [], strict=True))
        for w, ids in found.items():
            self.words[w] = (ids, ",".join(map(str, ids)).encode(), self.decoded(ids))

    def decoded(self, ids: Sequence[int]) -> bytes:
        """The bytes of some ids, the space before the text not yet taken away; unknown ids have none."""
        return b"".join(self.piece_bytes[i] for i in ids)

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        cut = [self.cut_up(t) for t in texts]
        self.learn(cut)
        return [[i for w in t for i in self.words[w][0]] for t in cut]

    def decode(self, ids: Sequence[int]) -> str:
        return self.decoded(ids).removeprefix(b" ").decode("utf-8", "replace")

    def digest(self, texts: Sequence[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, digest of the ids, digest of the text that they decode to."""
        cut = [self.cut_up(t) for t in texts]
        self.learn(cut)
        out = []
        for t in cut:
            known = [self.words[w] for w in t]
            ids, text = b",".join([k[1] for k in known]), b"".join([k[2] for k in known]).removeprefix(b" ")
            out.append((sum([len(k[0]) for k in known]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
        return out


_ready: dict[str, Encoder] = {}


def _run(docs: DataFrame, model: str | None, schema: str, work) -> DataFrame:
    path = model or default_model()
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))  # as large as the model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ready.get(path) or _ready.setdefault(path, Encoder(vocabulary.value))
        for batch in small_batches(batches, 500):
            yield work(encoder, batch)

    return docs.mapInArrow(run, schema)


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(docs: DataFrame, model: str | None = None, carry: Sequence[str] = ("doc_id",), text: str = "text", decoded: bool = False) -> DataFrame:
    """The carried columns, n_tokens, and ids (array of int) of each whole text, without begin or end ids.

    With ``decoded`` the ids are decoded again, and decoded_sha256 is the digest of that text.
    A null or empty text has no ids. Repeated rows get a row each; an empty table gives none.
    Other columns, whatever their names, are left out.
    """
    carried = docs.select(*[docs[c] for c in carry], docs[text].alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[:-1])
    names = [*carry, "n_tokens", "ids", *["decoded_sha256"] * decoded]

    def work(encoder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder.encode(_texts(batch.column(len(carry))))
        columns = [*batch.columns[:-1], pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
        if decoded:
            columns.append(pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names)

    return _run(carried, model, f"{kinds}, n_tokens long, ids array<int>{', decoded_sha256 string' * decoded}", work)


def decode(encoded: DataFrame, model: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of arrays of ids; a null array is an empty text, and control ids have none."""

    def work(encoder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [encoder.decode(x or []) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _run(encoded.select(key, ids), model, "doc_id long, text string", work)


def digests(docs: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded again."""

    def work(encoder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, decoded = zip(*encoder.digest(_texts(batch.column(1))), strict=True) if batch.num_rows else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _run(docs.select("doc_id", text), model, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
