"""Text to token ids: byte-level BPE in CLIP's fixed layout, and greedy WordPiece."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cached_property, lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the layout: start and end ids, length.
SOT, EOT, LENGTH = 49406, 49407, 77
#: Longer words are merged anew each time.
REMEMBERED = 64
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """A printable symbol for each byte: printable bytes stand for themselves, others for code points from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class ClipTokenizer:
    """BPE over a vocabulary and an ordered list of merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>") -> None:
        self.vocab, self.ranks, self.end = vocab, {m: i for i, m in enumerate(merges)}, end
        self.symbols, self.names = byte_symbols(), {i: t for t, i in vocab.items()}
        self._word = lru_cache(1 << 16)(self._merge)

    def __reduce__(self) -> tuple:
        return type(self), (self.vocab, list(self.ranks), self.end)

    @classmethod
    def load(cls, vocab_path: str, merges_path: str) -> ClipTokenizer:
        return cls.of(*(Path(p).read_text(encoding="utf-8") for p in (vocab_path, merges_path)))

    @classmethod
    def of(cls, vocab: str, merges: str) -> ClipTokenizer:
        """By the contents of both files."""
        return cls(json.loads(vocab), [tuple(x.split()) for x in merges.splitlines() if x.strip() and not x.startswith("#version")])

    def _merge(self, word: str) -> tuple[int, ...]:
        """Pairs merge by rank, the leftmost of equals first; a heap over linked parts, so that long runs stay cheap."""
        parts = [self.symbols[b] for b in word.encode("utf-8", "replace")]
        parts[-1] += self.end
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = lambda i: self.ranks.get((parts[i], parts[after[i]])) if after[i] < n else None
        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if parts[i] is None or rank(i) != r:
                continue  # one of the two has been merged since
            j = after[i]
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return tuple(self.vocab[p] for p in parts if p is not None and p in self.vocab)

    def ids(self, text: str, most: int | None = None) -> list[int]:
        """Ids of a text; of its words only as many are merged as give ``most`` ids."""
        if text is None:
            raise ValueError("a text is needed")
        out: list[int] = []
        for m in WORDS.finditer(text.lower()):
            out += self._word(m[0]) if len(m[0]) <= REMEMBERED else self._merge(m[0])
            if most is not None and len(out) >= most:
                return out[:most]
        return out

    def encode(self, text: str, length: int = LENGTH) -> list[int]:
        """Start, at most length - 2 ids, end, then zeros."""
        ids = [SOT, *self.ids(text, length - 2), EOT]
        return ids + [0] * (length - len(ids))

    def decode(self, ids: list[int]) -> str:
        """Text without the markers and without id 0, which also pads."""
        back = {s: b for b, s in enumerate(self.symbols)}
        text = "".join(self.names.get(i, "") for i in ids if i not in (SOT, EOT, 0)).replace(self.end, " ")
        return bytes(back.get(c, 32) for c in text).decode("utf-8", "replace").strip()


class _Pieces:
    """A trie of pieces whose failure links cut a word in one pass, longest match first, in time linear in its length.

    Where a node has no way on, its longest matches so far are certain: ``done`` are those pieces' ids, and ``fail`` is
    the node of what is left behind them, which begins anew inside the word. Both are worked out once, for each node
    from those above it: at a node that is a piece itself nothing but that piece is certain; at any other the certain
    pieces are those of the node above, and then those that turn up while the last letter looks for a way.
    """

    def __init__(self, vocab: dict[str, int]) -> None:
        self.ways: list[dict[str, int]] = [{}, {}]  # the word's beginning, and its inside
        self.inside = 1
        self.ids: list[int | None] = [None, None]
        for piece, i in vocab.items():
            within = piece.startswith("##") and len(piece) > 2
            self._add(0, piece, i)
            if within:
                self._add(1, piece[2:], i)
        self.done: list[tuple[int, ...]] = [()] * len(self.ways)
        self.fail: list[int | None] = [None] * len(self.ways)
        level = [(c, 0, at) for c, at in self.ways[0].items()] + [(c, 1, at) for c, at in self.ways[1].items()]
        while level:
            below = []
            for letter, above, at in level:
                if self.ids[at] is not None:
                    self.done[at], self.fail[at] = (self.ids[at],), self.inside
                else:
                    certain, z = self.done[above], self.fail[above]
                    while z is not None and letter not in self.ways[z]:
                        certain, z = certain + self.done[z], self.fail[z]
                    if z is not None:
                        self.done[at], self.fail[at] = certain, self.ways[z][letter]
                below += [(c, at, n) for c, n in self.ways[at].items()]
            level = below

    def _add(self, at: int, letters: str, i: int) -> None:
        for c in letters:
            if c not in self.ways[at]:
                self.ways[at][c] = len(self.ways)
                self.ways.append({})
                self.ids.append(None)
            at = self.ways[at][c]
        self.ids[at] = i

    def pieces(self, word: str) -> list[int] | None:
        """The ids of a word's pieces, None if it can't be cut."""
        out, at = [], 0
        for c in word:
            while c not in self.ways[at]:
                if self.fail[at] is None:
                    return None
                out += self.done[at]
                at = self.fail[at]
            at = self.ways[at][c]
        while at != self.inside:
            if self.fail[at] is None:
                return None
            out += self.done[at]
            at = self.fail[at]
        return out


class WordPieceTokenizer:
    """Longest-match-first pieces of white-space and punctuation words."""

    SPLIT = regex.compile(r"[\p{P}\p{S}]|[^\s\p{P}\p{S}]+")

    def __init__(self, vocab: list[str], lower: bool = True, unknown: str = "[UNK]", longest: int | None = None) -> None:
        """A word of more than ``longest`` characters is unknown, if that is given."""
        self.vocab, self.names, self.lower, self.unknown = {t: i for i, t in enumerate(vocab)}, vocab, lower, unknown
        self.longest = longest

    @classmethod
    def load(cls, path: str, lower: bool = True, longest: int | None = None) -> WordPieceTokenizer:
        return cls(Path(path).read_text(encoding="utf-8").splitlines(), lower, longest=longest)

    @cached_property
    def _trie(self) -> _Pieces:
        return _Pieces(self.vocab)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_trie"}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        unknown = self.vocab.get(self.unknown, 0)
        for m in self.SPLIT.finditer(text.lower() if self.lower else text):
            pieces = self._trie.pieces(m[0]) if self.longest is None or m.end() - m.start() <= self.longest else None
            out += [unknown] if pieces is None else pieces
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids if 0 <= i < len(self.names)).replace(" ##", "")

    def question(self, text: str, length: int, bos: int, eos: int) -> list[int]:
        return [bos, *self.encode(text)[: length - 2], eos]


def encode(text: str | Column, tokenizer: ClipTokenizer, length: int = LENGTH) -> Column:
    """Ids of a text column in the fixed layout, null for a null text."""

    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else tokenizer.encode(t, length) for t in s], dtype=object)

    return F.pandas_udf(udf, "array<int>")(text)


def pieces(text: str | Column, tokenizer: WordPieceTokenizer) -> Column:
    """Ids of all pieces of a whole text column, null for a null text."""

    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else tokenizer.encode(t) for t in s], dtype=object)

    return F.pandas_udf(udf, "array<int>")(text)


def decode(ids: str | Column, tokenizer: ClipTokenizer) -> Column:
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else tokenizer.decode(t) for t in s], dtype=object)

    return F.pandas_udf(udf, "string")(ids)


def fallback_ids(length: int = LENGTH) -> list[int]:
    """The ids of a prompt without a vocabulary: the start and then ends only."""
    return [SOT] + [EOT] * (length - 1)
