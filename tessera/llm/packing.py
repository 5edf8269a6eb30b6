"""Sequence packing: bounded-space online best fit.

Every input partition keeps a fixed number of open windows. A document is tokenized once and cut into pieces: whole
windows first, then a rest that goes to the open window it fits best. When none fits, the fullest open window takes
the head of the rest if its gap is worth a cut, and is emitted. What is open at the end of a partition is a leftover;
leftovers of many partitions are merged best-fit in groups of bounded size, whole windows at a time.

The pieces are written to the shared folder once, so that no document is tokenized twice and a retried task gives
the same windows. Empty and null texts still hold the closing id and become a piece of length 1.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from codecs import charmap_decode
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_table, text_of
from tessera.operators.tokenize import byte_symbols

WINDOW, OPEN, MIN_CUT, END_ID, MERGE = 2048, 64, 64, 1, 4096
#: Words whose ids one Python worker remembers, twice over: the latest ones and those before them.
REMEMBERED = 300_000
#: Longer words, in bytes, are not remembered.
LONGEST = 64
#: Marks that compose with a letter before them.
MARK = re.compile("[\u0300-\u036f]")
#: The tokenizer's pieces of a lower-case word of printable ASCII.
PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PRINTABLE = re.compile(rb"[!-~]+")

_tokenizers: dict[str, "WordIds"] = {}


class WordIds(dict):
    """Packed little-endian 32-bit ids of lower-case words, remembered up to a bound.

    The tokenizer lower-cases, and neither normalization nor merges reach over an ASCII space, so the ids of a text
    are those of its words in order. A word of letters alone is one piece before the merges, so that it can go to
    the tokenizer's merges directly; a word of printable ASCII is cut into such pieces here, which are remembered as
    words are. Texts that hold a special token's string are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.symbols = "".join(byte_symbols())
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.before: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    @staticmethod
    def _letters(word: str) -> str | None:
        """The lower case of a word that is letters alone, in lower case too: some capitals become letter and mark."""
        low = word.lower() if "Σ" not in word else "".join(c.lower() for c in word)  # no other small letter depends on its place
        return low if low.isalpha() and unicodedata.is_normalized("NFC", word) else None

    def _merged(self, low: str) -> bytes:
        """The ids of one piece in lower case."""
        packed = self.packed
        mapped = low if low.isascii() else charmap_decode(low.encode("utf-8"), "strict", self.symbols)[0]
        return b"".join([packed[t.id] for t in self.merges.tokenize(mapped)])

    def _ids(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters, most words
            return self._merged(word.decode("ascii").lower())
        stem, last = word[:-1], word[-1:]
        if last in b".," and stem.isalpha():  # letters and one mark are pieces of their own
            return self[stem] + self[last]
        if PRINTABLE.fullmatch(word):
            pieces = PIECES.findall(word.lower())
            return b"".join(map(self.__getitem__, pieces)) if len(pieces) > 1 else self._merged(pieces[0].decode("ascii"))
        if last not in b".,":
            stem, last = word, b""
        low = self._letters(stem.decode("utf-8"))
        if low is None:
            return self._encode(word.decode("utf-8"))
        ids = self.get(stem) or self._merged(low)
        return ids + self[last] if last else ids

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word) or self._ids(word)
        if len(word) > LONGEST:
            return ids
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        low = text.lower()
        if any(s in text or s in low for s in self.special):
            return self._encode(text)
        raw = text.encode("utf-8", "replace")
        # Some marks compose with the small letter alone; the tokenizer composes before it lower-cases.
        if text.isascii() or not MARK.search(text):
            raw = raw.lower()
        return b"".join(map(self.__getitem__, raw.split()))


def word_ids(path: str) -> WordIds:
    """The tokenizer of this Python worker; its file is a parameter that every executor can read."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


class BestFit:
    """Open windows by their gap: the best fit for a piece, and the fullest when too many are open."""

    def __init__(self, window: int, n_open: int) -> None:
        self.window, self.n_open = window, n_open
        self.gaps: list[tuple[int, int]] = []  # sorted (gap, window id)

    def best(self, n: int) -> tuple[int, int] | None:
        at = bisect_left(self.gaps, (n, -1))
        return self.gaps.pop(at) if at < len(self.gaps) else None

    def put(self, gap: int, key: int) -> None:
        if gap:
            insort(self.gaps, (gap, key))

    def fullest_if_crowded(self) -> tuple[int, int] | None:
        return self.gaps.pop(0) if len(self.gaps) >= self.n_open else None


PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window_id long, offset long, fill long, open boolean"
)


def _pack(batches: Iterator[pd.DataFrame], path: str, window: int, n_open: int, min_cut: int) -> Iterator[pd.DataFrame]:
    ids_of, fit = word_ids(path), BestFit(window, n_open)
    base, made = TaskContext.get().partitionId() << 33, 0
    waiting: dict[int, list[tuple]] = {}  # pieces of open windows
    fills: dict[int, int] = {}
    out: list[tuple] = []
    end = END_ID.to_bytes(4, "little")

    def close(key: int, is_open: bool = False) -> None:
        fill = fills.pop(key)
        out.extend((*p, fill, is_open) for p in waiting.pop(key))

    def frame() -> pd.DataFrame:
        nonlocal out
        rows, out = out, []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE_SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    for pdf in batches:
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            ids = memoryview(ids_of.text(text) + end)
            total, start = len(ids) // 4, 0
            doc_id = None if pd.isna(doc_id) else int(doc_id)

            def put(key: int, n: int) -> None:
                nonlocal start
                crc = zlib.crc32(ids[4 * start : 4 * (start + n)])
                waiting.setdefault(key, []).append((doc_id, start, n, crc, total, key, fills.get(key, 0)))
                fills[key] = fills.get(key, 0) + n
                start += n
                if fills[key] == window:
                    close(key)

            while start < total:
                rest = total - start
                if rest >= window:
                    put(base + made, window)
                    made += 1
                elif found := fit.best(rest):
                    fit.put(found[0] - rest, found[1])
                    put(found[1], rest)
                else:
                    if full := fit.fullest_if_crowded():
                        gap, key = full
                        if gap >= min_cut:
                            put(key, gap)
                        else:
                            close(key)
                        continue
                    fit.put(window - rest, base + made)
                    put(base + made, rest)
                    made += 1
            if len(out) >= 20_000:
                yield frame()
    for _, key in fit.gaps:
        close(key, True)
    yield frame()


def _merge(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """Leftover windows of one group, fullest first and best fit: where each goes and at which offset."""
    pdf = pdf.sort_values(["fill", "window_id"], ascending=[False, True])
    fit, used, rows = BestFit(window, 1 << 62), {}, []
    for key, fill in zip(pdf["window_id"], pdf["fill"], strict=True):
        gap, into = fit.best(fill) or (window, key)
        rows.append((key, into, used.get(into, 0)))
        used[into] = used.get(into, 0) + fill
        fit.put(gap - fill, into)
    out = pd.DataFrame(rows, columns=["window_id", "sequence_id", "shift"])
    out["total"] = out["sequence_id"].map(used)
    return out


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, n_open: int = OPEN, min_cut: int = MIN_CUT
) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text) in sequences of at most ``window`` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (gapless from 0) and padded_length
    (the window, or the sequence's own length where that is a power of two). Repeated rows are packed each.
    """
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(
        lambda it: _pack(it, tokenizer_path, window, n_open, min_cut), PIECE_SCHEMA
    )
    pieces = shared_table(pieces, "pieces")
    # A partition leaves at most n_open windows, so that MERGE / n_open neighbouring partitions make one group.
    group = F.floor(F.shiftright("window_id", 33) / max(1, MERGE // n_open))
    moves = (
        pieces.where("open and offset = 0").select("window_id", "fill", group.alias("g"))
        .groupBy("g").applyInPandas(
            lambda pdf: _merge(pdf, window), "window_id long, sequence_id long, shift long, total long"
        )
    )
    moves = shared_table(moves, "moves")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "total"]
    closed = pieces.where("not open").withColumns({"sequence_id": F.col("window_id"), "total": F.col("fill")})
    merged = pieces.where("open").join(moves, "window_id").withColumn("offset", F.col("offset") + F.col("shift"))
    both = closed.select(*columns).union(merged.select(*columns))
    power = F.col("total").bitwiseAND(F.col("total") - 1) == 0
    return both.withColumn("padded_length", F.when(power, F.col("total")).otherwise(F.lit(window).cast("long"))).drop("total")
