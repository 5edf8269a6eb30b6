"""Exact Jaccard join of n-gram sets by PartEnum signatures.

Sizes fall into bands whose ends differ by the similarity, so that similar sets are in one band or in neighbours, and
every set signs for its own band and the next. In a band similar sets differ in at most k features, those of either
set that the other lacks. The feature domain is cut by hash into n1 parts and each part into n2; a signature is what a
set has in all but one of the n2 pieces of a part. As each difference spoils one piece, 2 * n1 - k signatures at least
are shared by similar sets, and so all but the lightest ``2 * n1 - k - 1`` of them, those with fewest features, need
to be made: a signature's weight is part of what it says, so both sets leave out the same ones. Nothing is lost by it,
and signatures of nothing or of one common feature, which strangers share, go.

Signatures travel packed: a row of bytes for each batch of texts and bucket of signatures, 11 bytes a signature. In a
bucket equal signatures meet. Every set is first compared with the one partner that has most company in its buckets;
texts meet once for that. Only blocks that the links leave in several components are looked at again: of their pairs between components those
whose sketches (counts of features by hash, which differ in no more than the sets do) allow the similarity are verified.
All verification is by the shingles themselves.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import jaccard
from tessera.llm.common import drop_table, shared_table, skew_join, text_of
from tessera.llm.graph import component_roots

SHINGLE, PERCENT, SEED = 5, 80, 42
#: Bands of sets up to this size cut their parts in 3 pieces, others in 2; for every 3 signatures needed one is spare.
FINE, SPARE = 64, 3
#: Counters of a small set's sketch; four times as many for sets of over one feature a counter, 4 ** WIDER times at most.
SKETCH, WIDER = 128, 3
#: Signatures of a bucket, about, and of a batch of packed rows.
BUCKET, BATCH = 1 << 21, 1 << 21
#: Buckets whose open blocks meet in one place.
PLACE = 4
#: Words whose hashes a Python worker remembers, and their length in bytes at most.
REMEMBERED, LONGEST = 200_000, 64
#: Candidate pairs of a bucket that are held before repeats are removed.
HELD = 1 << 22
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


_words = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def features(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of a whole text's distinct word shingles; fewer words are one shingle, none is none."""
    words = text.encode("utf-8", "replace").lower().split()
    k = min(size, len(words))
    if not k:
        return np.array([], dtype=np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = _mixed(h * _ODD[2] + w[j : len(w) - k + 1 + j])
    return np.unique(h)


def set_hash(found: np.ndarray, seed: int = SEED) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set of features."""
    h = xxhash.xxh3_128_intdigest(found.tobytes(), seed)
    return tuple(int(x) - (1 << 64) if x >> 63 else int(x) for x in (h >> 64, h & ((1 << 64) - 1)))


def sketch_of(found: np.ndarray) -> bytes:
    """How many features fall to each counter, packed. Sketches differ in no more than their sets do, all counters
    together; a wider sketch folds to a narrower one."""
    width = SKETCH
    while len(found) > width and width < SKETCH << (2 * WIDER):
        width *= 4
    counts = np.bincount((found % np.uint64(width)).astype(np.int64), minlength=width)
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)


class Sketches:
    """The sketches of many sets, by width: those of a width, and those of the next that are folded to it.

    Sets of similar sizes are of one width or of neighbours. Only at the greatest width may a counter be full, and sets
    of that width which have narrower partners are too small for that.
    """

    def __init__(self, packed: list[bytes]) -> None:
        rows = [np.frombuffer(zlib.decompress(b), np.uint8) for b in packed]
        self.width = np.array([len(r) for r in rows], dtype=np.int64)
        self.table: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        for width in np.unique(self.width).tolist():
            parts = []
            for own in (width, 4 * width):
                at = np.flatnonzero(self.width == own)
                if len(at):
                    parts.append((at, np.stack([rows[i] for i in at]).astype(np.int16).reshape(len(at), -1, width).sum(axis=1, dtype=np.int16)))
            self.table[width] = np.concatenate([m for _, m in parts])
            self.place[width] = np.full(len(rows), -1)
            self.place[width][np.concatenate([at for at, _ in parts])] = np.arange(len(self.table[width]))

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of sets a number that they differ in no less than."""
        out, common = np.zeros(len(x), dtype=np.int64), np.minimum(self.width[x], self.width[y])
        for width in np.unique(common).tolist():
            these = np.flatnonzero((common == width) & (self.width[x] <= 4 * width) & (self.width[y] <= 4 * width))
            table, place = self.table[width], self.place[width]
            step = max(1, (1 << 22) // width)
            for k in range(0, len(these), step):
                part = these[k : k + step]
                out[part] = np.abs(table[place[x[part]]] - table[place[y[part]]]).sum(axis=1)
        return out


class Bands:
    """Size bands of one similarity, in hundredths: the largest size of each, and how its sets are signed."""

    def __init__(self, percent: int) -> None:
        self.percent, self.tops = percent, [1]

    def of(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append((self.tops[-1] + 1) * 100 // self.percent)
        return bisect_left(self.tops, size)

    def cut(self, band: int) -> tuple[int, int, int]:
        """(parts, pieces of a part, signatures left out); no parts where only equal sets are similar."""
        while len(self.tops) <= band:
            self.tops.append((self.tops[-1] + 1) * 100 // self.percent)
        k = 2 * self.tops[band] * (100 - self.percent) // (100 + self.percent)
        parts = -(-(k + 1 + (k + 1) // SPARE) // 2)
        return (parts, 3 if self.tops[band] <= FINE else 2, 2 * parts - k - 1) if k else (0, 0, 0)


def band_signatures(found: np.ndarray, bands: Bands, band: int) -> np.ndarray:
    """The signatures of a set for one band."""
    parts, pieces, spare = bands.cut(band)
    if not parts:
        return np.array([], dtype=np.uint64)
    at = ((found >> np.uint64(32)) * np.uint64(parts * pieces) >> np.uint64(32)).astype(np.int64)
    sums, weight = np.zeros(parts * pieces, dtype=np.uint64), np.bincount(at, minlength=parts * pieces)
    np.add.at(sums, at, found * _ODD[3])
    sums, weight = sums.reshape(parts, pieces), weight.reshape(parts, pieces)
    left, weight = (sums.sum(axis=1, keepdims=True) - sums).ravel(), (weight.sum(axis=1, keepdims=True) - weight).ravel()
    place = np.arange(parts * pieces, dtype=np.uint64) + np.uint64(band << 40)
    keys = _mixed(left + _mixed(weight.astype(np.uint64) + place * _ODD[2]))
    # Heaviest first: the weight stands above 48 bits of the hash.
    keys = (np.uint64(0xFFFF) - np.minimum(weight, 0xFFFF).astype(np.uint64)) << np.uint64(48) | keys >> np.uint64(16)
    return _mixed(np.partition(keys, len(keys) - spare - 1)[: len(keys) - spare])


def signatures(found: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of a set: for its own band and for the next."""
    if not len(found):
        return np.array([], dtype=np.uint64)
    own = bands.of(len(found))
    return np.concatenate([band_signatures(found, bands, own), band_signatures(found, bands, own + 1)])


def _bytes(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _numbers(parts: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def _packed(batches: Iterator[pd.DataFrame], buckets: int, size: int, percent: int, seed: int) -> Iterator[pd.DataFrame]:
    """(bucket, keys, nodes): 40 bits of every signature of a task's sets, and the upper 48 of what stands for the set."""
    bands, seen, keys, nodes, held = Bands(percent), set(), [], [], 0

    def rows() -> pd.DataFrame:
        key, node = np.concatenate(keys), np.repeat(np.array(nodes, dtype=np.uint64), list(map(len, keys)))
        at = (key >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order])) + 1
        groups = np.split(order, cuts)
        return pd.DataFrame({"bucket": [int(at[g[0]]) for g in groups], "keys": [_bytes(key[g], 5) for g in groups], "nodes": [_bytes(node[g], 6) for g in groups]})

    for pdf in batches:
        for text in pdf["text"]:
            found = features(text, size)
            node = set_hash(found, seed)[0]
            if node in seen:  # a copy in the same task
                continue
            seen.add(node)
            got = signatures(found, bands)
            if len(got):
                keys.append(got)
                nodes.append((node & ((1 << 64) - 1)) >> 16)
                held += len(got)
            if held >= BATCH:
                yield rows()
                keys, nodes, held = [], [], 0
    if held:
        yield rows()


MET = "bucket int, short long, hub long, weight long, lengths binary, blocks binary"


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: every set that shares a signature, with the partner of most company, and a row of the blocks."""
    bucket = int(pdf["bucket"].iat[0])
    key, (nodes, who) = _numbers(pdf["keys"].to_list(), 5), np.unique(_numbers(pdf["nodes"].to_list(), 6), return_inverse=True)
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
    key, who = key[new], who[new]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    lengths = np.diff(np.concatenate((starts, [len(key)])))
    shared = np.repeat(lengths > 1, lengths)
    who, lengths = who[shared], lengths[lengths > 1]
    if not len(who):
        return pd.DataFrame([], columns=[c.split()[0] for c in MET.split(", ")])
    near = np.bincount(who, weights=np.repeat(lengths, lengths), minlength=len(nodes)).astype(np.int64)
    run = np.repeat(np.arange(len(lengths)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    hub = np.repeat(who[np.lexsort((who, -near[who], run))][first], lengths)
    best = np.lexsort((hub, -near[hub], hub == who, who))  # a set is no partner of its own
    best = best[np.concatenate(([True], who[best][1:] != who[best][:-1]))]
    member, partner = who[best], hub[best]
    blocks, seen = [], set()
    for a, n in zip(first.tolist(), lengths.tolist(), strict=True):
        block = who[a : a + n].tobytes()
        if block not in seen:  # families share many signatures
            seen.add(block)
            blocks.append(who[a : a + n])
    short = nodes.astype(np.int64)
    rows = pd.DataFrame({"bucket": bucket, "short": short[member], "hub": pd.Series(short[partner]).where(member != partner).astype("Int64"), "weight": near[partner]})
    packed = {"bucket": [bucket], "lengths": [np.array(list(map(len, blocks)), dtype="<i4").tobytes()], "blocks": [short[np.concatenate(blocks)].astype("<i8").tobytes()]}
    return pd.concat([rows.astype({"short": "Int64", "weight": "Int64"}), pd.DataFrame(packed)], ignore_index=True)


OPEN = "place int, node long, lengths binary, blocks binary"


def _open(members: pd.DataFrame, packed: pd.DataFrame, percent: int, places: int) -> pd.DataFrame:
    """Of one bucket: the sets that have a partner of another component and a similar size in some block, and the blocks
    that these sets form, packed. A block goes to the place of its least set, so that blocks of much the same sets,
    which meet in many buckets, come together in one place and send each set there once."""
    none = pd.DataFrame([], columns=[c.split()[0] for c in OPEN.split(", ")])
    if not len(members) or not len(packed):
        return none
    node, root, size = (members[c].to_numpy(dtype=np.int64) for c in ("node", "root", "size"))
    lengths = np.concatenate([np.frombuffer(b, "<i4") for b in packed["lengths"]])
    short = np.concatenate([np.frombuffer(b, "<i8") for b in packed["blocks"]])
    # A set is known by 48 bits here: each of those that have them is a member.
    rows = pd.DataFrame({"run": np.repeat(np.arange(len(lengths)), lengths), "short": short})
    rows = rows.merge(pd.DataFrame({"short": members["short"].to_numpy(), "at": np.arange(len(members))}), on="short")
    run, at = rows["run"].to_numpy(), rows["at"].to_numpy()
    order = np.lexsort((node[at], size[at], run))
    run, at = run[order], at[order]
    # By size, a set's possible partners are a stretch of its block, in which some root follows another or not.
    spot, least, most = run << 40 | size[at], -(-percent * size[at] // 100), 100 * size[at] // percent
    first, last = np.searchsorted(spot, run << 40 | least), np.searchsorted(spot, run << 40 | most, "right") - 1
    turns = np.concatenate(([0], np.cumsum(root[at][1:] != root[at][:-1])))[: len(at)]
    used = turns[last] > turns[first]
    run, found = run[used], node[at[used]]
    if not len(found):
        return none
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    lengths = np.diff(np.concatenate((starts, [len(run)])))
    place = (np.minimum.reduceat(found, starts) & 0x7FFFFFFF) % places
    sent = pd.DataFrame({"place": np.repeat(place, lengths), "node": found}).drop_duplicates()
    rows = [sent.astype({"node": "Int64"})]
    for p in np.unique(place).tolist():
        blocks = dict.fromkeys(found[a : a + n].tobytes() for a, n in zip(starts[place == p].tolist(), lengths[place == p].tolist(), strict=True))
        rows.append(pd.DataFrame({"place": [p], "lengths": [np.array([len(b) // 8 for b in blocks], dtype="<i4").tobytes()], "blocks": [b"".join(blocks)]}))
    return pd.concat(rows, ignore_index=True)


def _crossing(members: pd.DataFrame, packed: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The distinct pairs of one place's blocks between different components, as far as sizes and sketches allow."""
    done = [np.empty((0, 2), dtype=np.int64)]
    if len(members) and len(packed):
        members = members.sort_values("node")
        node, root, size = (members[c].to_numpy(dtype=np.int64) for c in ("node", "root", "size"))
        sketches, met = Sketches(members["sketch"].to_list()), set()
        for lengths, blocks in zip(packed["lengths"], packed["blocks"], strict=True):
            ends = 8 * np.cumsum(np.frombuffer(lengths, "<i4"))
            met.update(blocks[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        blocks = (np.searchsorted(node, np.frombuffer(b, "<i8")) for b in met)
        held, n = [], 0

        def settle() -> None:
            pairs = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *held]))
            x, y = pairs >> 32, pairs & 0xFFFFFFFF
            ok = (100 + percent) * sketches.apart(x, y) <= (100 - percent) * (size[x] + size[y])
            done.append(np.stack([np.minimum(node[x], node[y])[ok], np.maximum(node[x], node[y])[ok]], axis=1))

        for block in blocks:
            for i in range(len(block) - 1):
                x, y = block[i], block[i + 1 :]
                y = y[(root[y] != root[x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
                held.append(np.minimum(x, y) << 32 | np.maximum(x, y))
                n += len(y)
            if n >= HELD:
                settle()
                held, n = [], 0
        settle()
    return pd.DataFrame(np.unique(np.concatenate(done), axis=0), columns=["a", "b"])


def _prints(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """(id, t1, t2, node, again, size, sketch): a row for each document; t1 and t2 stand for its text, node for its set."""

    def one(texts: pd.Series) -> pd.DataFrame:
        rows = [(*set_hash(found, seed), len(found), sketch_of(found)) for found in (features(t, size) for t in texts)]
        return pd.DataFrame(rows, columns=["node", "again", "size", "sketch"])

    text = text_of("text")
    made = F.pandas_udf(one, "node long, again long, size long, sketch binary")(text)
    return docs.select("id", *_text_keys(text), made.alias("p")).select("id", "t1", "t2", "p.*")


def _text_keys(text: F.Column) -> list:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _linked(docs: DataFrame, classes: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """(node, root) of every node of classes that is linked to a smaller one; classes holds a row for each set."""
    total = classes.agg(F.sum("size")).first()[0] or 0
    # A set of n features has 0.6 n signatures, more or less.
    buckets = max(1, int(0.6 * total) // BUCKET)
    texts = docs.select(text_of("text").alias("text"))
    packed = texts.mapInPandas(lambda it: _packed(it, buckets, size, percent, seed), "bucket int, keys binary, nodes binary")
    met = shared_table(packed.groupBy("bucket").applyInPandas(_met, MET), "met")
    members = met.where("short is not null").select("bucket", "short", "hub", "weight")
    short = F.shiftrightunsigned("node", 16)
    nodes = shared_table(
        classes.select("node", "size", "sketch", "t1", "t2", short.alias("short")).join(members.select("short").distinct(), "short", "left_semi"), "nodes"
    )
    # One partner for each set: that of most company in any bucket.
    stars = members.where("hub is not null").groupBy("short").agg(F.max_by("hub", F.struct("weight", -F.col("hub"))).alias("hub"))
    stars = stars.join(nodes.select("short", F.col("node").alias("a"), F.col("size").alias("m")), "short")
    stars = stars.join(nodes.select(F.col("short").alias("hub"), F.col("node").alias("b"), F.col("size").alias("n")), "hub")
    alike = 100 * F.least("m", "n") >= percent * F.greatest("m", "n")
    stars = shared_table(stars.where(alike).where("a <> b").select("a", "b"), "stars")
    # Copies become one row before texts are sorted or shuffled whole.
    whole = docs.select(*_text_keys(text_of("text")), text_of("text").alias("text")).groupBy("t1", "t2").agg(F.first("text").alias("text"))
    # A text learns its partner before it is written, so that it is shuffled once more only, to meet it.
    salted, hubs = jaccard.dealt(stars)
    own = nodes.select("t1", "t2", "node").join(salted.withColumnRenamed("a", "node"), "node", "left")
    own = shared_table(whole.join(own, ["t1", "t2"]).select("node", "text", "b", "salt"), "texts")
    texts, left = own.select("node", "text"), own.where("b is not null")
    left = left.select(F.col("node").alias("a"), "b", "salt", F.col("text").alias("text_a"))
    links = jaccard.compared(left, texts, hubs, size, percent / 100)
    roots = shared_table(component_roots(links), "roots")
    # Only the sets of open blocks go on with their sketches, and to fewer places than there are buckets.
    places = -(-buckets // PLACE)
    placed = nodes.select("short", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = members.select("bucket", "short").join(placed, "short")
    blocks = met.where("blocks is not null").select(F.col("bucket").alias("at"), "lengths", "blocks")
    opened = placed.groupBy("bucket").cogroup(blocks.groupBy("at")).applyInPandas(lambda m, p: _open(m, p, percent, places), OPEN)
    opened = shared_table(opened, "open")
    drop_table(met)
    placed = opened.where("node is not null").select("place", "node").distinct().join(nodes.select("node", "size", "sketch"), "node")
    placed = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocks = opened.where("blocks is not null").select(F.col("place").alias("at"), "lengths", "blocks")
    crossing = placed.groupBy("place").cogroup(blocks.groupBy("at")).applyInPandas(lambda m, p: _crossing(m, p, percent), "a long, b long")
    seen = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = shared_table(crossing.distinct().join(seen, ["a", "b"], "left_anti"), "pairs")
    drop_table(opened)
    # The node with more pairs is the one whose text is dealt out once for many.
    each = shared_table(pairs.select("a").union(pairs.select("b")).groupBy("a").agg(F.count("*").alias("n")), "each")
    pairs = pairs.join(each.select("a", F.col("n").alias("na")), "a").join(each.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b")
    turn = F.col("na") > F.col("nb")
    pairs = pairs.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))
    # A table of its own, whose size is known: few pairs are sent to the texts, not all texts to the pairs.
    salted, hubs = jaccard.dealt(shared_table(pairs, "turned"))
    left = shared_table(salted, "salted").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    more = jaccard.compared(left, texts, hubs, size, percent / 100)
    drop_table(own)
    found = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("a", "b"))
    return shared_table(component_roots(found), "roots")


def linked_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, the smallest id reachable over links.

    Two rows link when the Jaccard similarity of their sets of word shingles is ``percent`` hundredths or more; all
    links count, none is lost. Null and empty texts, and those of spaces alone, have an empty set and are linked with
    nothing, not even each other: they are their own component. Repeated rows stay repeated. A null id takes the
    smallest id of its component, or null if that has none.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for seed in count(SEED):
        prints = shared_table(_prints(docs, size, seed), "prints")
        text = F.min(F.struct("t1", "t2")).alias("text")
        classes = prints.where("size > 0").groupBy("node").agg(
            F.min("id").alias("first_id"), F.count("*").alias("_n"), F.max("size").alias("size"), F.first("sketch").alias("sketch"), text, F.min("again").alias("x"), F.max("again").alias("y")
        )
        classes = shared_table(classes.select("node", "first_id", "_n", "size", "sketch", "text.*", "x", "y"), "classes")
        if not classes.where("x <> y").head(1):  # no two sets share their first hash
            break
        drop_table(prints)
    roots = _linked(docs, classes, size, percent, seed)
    linked = shared_table(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), "linked")
    best = linked.join(classes, "node").groupBy("root").agg(F.min("first_id").alias("component"), F.count("*").alias("_n"))
    moved = skew_join(linked, shared_table(best, "best"), ["root"], linked.count()).select("node", "component")
    found = shared_table(classes.join(moved, "node", "left").select("node", F.coalesce("component", "first_id").alias("component_id"), "_n"), "components")
    sets = prints.where("size > 0").select("id", "node", F.col("size").alias("n_shingles"))
    rows = skew_join(sets, found, ["node"], sets.count()).select("id", "n_shingles", "component_id")
    rows = rows.unionByName(prints.where("size = 0").select("id", F.col("size").alias("n_shingles"), F.col("id").alias("component_id")))
    return rows.withColumnRenamed("id", id_col)
