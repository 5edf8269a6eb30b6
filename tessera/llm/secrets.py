"""Secret scans by grammar inference.

Three fixed rules find and label credentials. From a bounded sample of them a probabilistic automaton is inferred
for each label: a prefix tree of the credentials, whose states are merged while their outgoing frequencies are
statistically compatible (Hoeffding bounds, the ALERGIA test). Letters keep their case, so that literal prefixes and
the case of an alphabet are part of what is learned. A further automaton is inferred from a sample of the corpus's
other words. Every candidate string of the corpus is then scored by its likelihood under each automaton, and reported
where a format explains it better than the other words do, by more than the odds against a credential.

Texts are read twice, once for the samples and once to score them; no credential is written to a table.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import text_of

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Strings of a kind that an automaton is inferred from, the longest one among them, the merge test's significance.
SAMPLE, LONGEST, ALPHA = 300, 256, 0.05
#: Other words that stand for the corpus, and the logarithm of the odds against a string being a credential.
WORDS, ODDS = 1_000, math.log(1e6)
#: Symbols of a candidate and its end: what an automaton has not seen is one of these.
SYMBOLS = 68


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind's rank, end, credential) of the fixed rules, leftmost and non-overlapping per kind, in order."""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), m[2]))
    for rank, rule, least in ((1, ACCESS, 20), (2, HEX, 24)):
        for m in rule.finditer(text):
            if m.end() - m.start() >= least:
                found.append((m.start(), rank, m.end(), m[0]))
    return sorted(found)


def runs(text: str, taken: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, string) of the runs of 6 and more credential symbols outside of what the fixed rules have found.

    A run that holds a find gives the parts before and after it. Marks at either end belong to the text around.
    """
    at, n = 0, len(taken)
    for m in RUN.finditer(text):
        start, end = m.span()
        while at < n and taken[at][2] <= start:
            at += 1
        parts, k = [], at
        while k < n and taken[k][0] < end:
            parts.append((start, taken[k][0]))
            start = max(start, taken[k][2])
            k += 1
        for a, b in [*parts, (start, end)]:
            s = text[a:b]
            a += len(s) - len(s.lstrip(".=-/+"))
            s = s.strip(".=-/+")
            if len(s) >= 6:
                yield a, a + len(s), s


def is_candidate(s: str) -> bool:
    """Runs with a digit and a letter are candidates; others are words or numbers, as every text is full of."""
    return not s.isalpha() and DIGIT.search(s) is not None and LETTER.search(s) is not None


class Automaton:
    """A probabilistic automaton: transition and end counts per state, as learned from labelled strings.

    One more observation, spread over all symbols, smooths every state: an unseen symbol costs, and the walk goes on
    from the start.
    """

    def __init__(self, strings: list[str], alpha: float = ALPHA) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        for s in strings:
            at = 0
            for c in s:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.seen.append({})
                    self.ends.append(0)
                self.seen[at][c] = self.seen[at].get(c, 0) + 1
                at = self.next[at][c]
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        scores = sorted(self.score(s) / (len(s) + 1) for s in strings)
        #: Scores a symbol of the labelled strings themselves put the line: all but the lowest hundredth pass.
        self.line = scores[len(scores) // 100] - 1e-9 if scores else math.inf

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.seen[q].values())

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        """Whether the futures of two states agree; q is the root of a tree, so the walk ends."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n, m = self._total(p), self._total(q)
            if not n or not m:
                continue
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for c in self.seen[p].keys() | self.seen[q].keys():
                if self._differ(self.seen[p].get(c, 0), n, self.seen[q].get(c, 0), m):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    stack.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to the automaton at p."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            self.ends[p] += self.ends[q]
            for c, n in self.seen[q].items():
                self.seen[p][c] = self.seen[p].get(c, 0) + n
                if c in self.next[p]:
                    stack.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _merge_states(self) -> None:
        kept, known = [0], {0}
        while True:
            border = [(self._total(t), -q, c) for q in kept for c, t in self.next[q].items() if t not in known]
            if not border:
                return
            _, parent, c = max(border)
            parent = -parent
            state = self.next[parent][c]
            for q in kept:
                if self._compatible(q, state):
                    self.next[parent][c] = q
                    self._fold(q, state)
                    break
            else:
                kept.append(state)
                known.add(state)

    def score(self, s: str) -> float:
        """Log-likelihood of a string, its end included."""
        at, total = 0, 0.0
        for c in s:
            n = self._total(at) + 1
            total += math.log((self.seen[at].get(c, 0) + 1 / SYMBOLS) / n)
            at = self.next[at].get(c, 0)
        return total + math.log((self.ends[at] + 1 / SYMBOLS) / (self._total(at) + 1))

    def accepts(self, s: str) -> bool:
        """Whether a string is as likely, by symbol, as the labelled ones."""
        return self.score(s) >= self.line * (len(s) + 1)


def cases(s: str) -> list[str]:
    """A string, and in the other case if all its letters are of one: formats of one case are written in either."""
    return [s] if s != s.lower() and s != s.upper() else [s, s.swapcase()]


class Formats:
    """The automata of the kinds and that of other words."""

    def __init__(self, labelled: dict[str, list[str]], words: list[str]) -> None:
        self.kinds = {k: Automaton(v) for k, v in labelled.items() if v}
        self.words = Automaton(words)

    def best(self, s: str) -> tuple[str, float] | None:
        """The most likely format of a candidate and its log odds; None where none passes."""
        against, best = self.words.score(s) + ODDS, None
        for c in cases(s):
            for kind, a in self.kinds.items():
                score = a.score(c)
                if score >= a.line * (len(c) + 1) and score > against and (best is None or score - against > best[1]):
                    best = kind, score - against
        return best


SCAN_SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "grammar array<struct<start:int,end:int,format:string,score:double>>"
)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[rank]}:{start}:{end}" for start, rank, end in sorted(spans))


class Smallest:
    """The strings of the smallest hashes of a stream, up to a bound: each once, or each place of it once."""

    def __init__(self, bound: int) -> None:
        self.bound, self.heap, self.there = bound, [], set()

    def add(self, s: str, place: int = 0) -> None:
        h = crc32(s.encode(), place)
        if len(self.heap) == self.bound and h >= -self.heap[0][0] or (h, s) in self.there:
            return
        self.there.add((h, s))
        heapq.heappush(self.heap, (-h, s))
        if len(self.heap) > self.bound:
            h, s = heapq.heappop(self.heap)
            self.there.discard((-h, s))


def _samples(batches: Iterator[pd.DataFrame], sample: int, words: int) -> Iterator[pd.DataFrame]:
    """Of one partition, the strings of the smallest hashes of each kind, and other words."""
    found = [Smallest(sample) for _ in range(3)] + [Smallest(words)]
    for pdf in batches:
        for text in pdf["text"]:
            base = base_spans(text)
            for _, rank, _, value in base:
                if len(value) <= LONGEST:
                    found[rank].add(value)
            place = crc32(text.encode("utf-8", "replace"))
            for a, _, s in runs(text, base):
                if len(s) <= LONGEST:
                    found[3].add(s, place ^ a)
    rows = [(rank, -h, s) for rank, f in enumerate(found) for h, s in f.heap]
    yield pd.DataFrame(rows, columns=["rank", "hash", "value"])


def learn(docs: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> Formats:
    """Automata from at most ``sample`` distinct labelled credentials of each kind and ``words`` other words of docs
    (``text``), as often as they occur, those of the smallest hashes; strings over 256 symbols don't take part. All
    texts are looked at."""
    found = docs.mapInPandas(lambda it: _samples(it, sample, words), "rank int, hash long, value string")
    # One pass over the texts; the partitions' samples are merged in two steps, so that no task gets all of them.
    bound = F.when(F.col("rank") < 3, sample).otherwise(words)
    merged = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(512)))
    for keys in (["rank", "part"], ["rank"]):
        place = F.dense_rank().over(Window.partitionBy(*keys).orderBy("hash", "value"))
        merged = merged.withColumn("place", place).where(F.col("place") <= bound).select("rank", "hash", "value", *keys[1:]).distinct()
    values: dict[int, list[str]] = {}
    for r in merged.collect():
        values.setdefault(r["rank"], []).append(r["value"])
    return Formats({KINDS[r]: sorted(values.get(r, [])) for r in range(3)}, sorted(values.get(3, [])))


def scan_secrets(docs: DataFrame, sample: int = SAMPLE, formats: Formats | None = None) -> DataFrame:
    """One row per document (null text: empty): counts of the rules' finds, their digest, all spans, and the grammar
    finds (``grammar``: array of start, end, format, score: the log odds that it is a credential).

    Formats are learned from docs unless they are given. A corpus without credentials has no automata and adds no
    spans; repeated rows are scanned each. Columns other than doc_id and text are not looked at.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs["text"]).alias("text"))
    formats = learn(texts.select("text"), sample) if formats is None else formats

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found = base_spans(text)
                base, added = [(a, r, e) for a, r, e, _ in found], []
                if formats.kinds:
                    for a, e, s in runs(text, found):
                        if is_candidate(s) and (best := formats.best(s)):
                            added.append({"start": a, "end": e, "format": best[0], "score": best[1]})
                rows.append((
                    None if pd.isna(doc_id) else int(doc_id), *(sum(f[1] == rank for f in found) for rank in range(3)),
                    hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + [(x["start"], 3, x["end"]) for x in added]), added,
                ))
            names = [c.split()[0] for c in SCAN_SCHEMA.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return texts.mapInPandas(scan, SCAN_SCHEMA)
