"""Near-copies by exact Jaccard similarity of word shingles.

The caller brings pairs of near texts, by their SimHash fingerprints and pivot tables, which are verified here. Texts
whose word shingles agree to four fifths differ in 10 of 64 fingerprint bits on average, though, and in up to about 20,
and no blocking key is shared by all pairs at that radius. Candidates for the rest are texts that share one of 32 keys,
each made of 4 minima of hash permutations: a pair of similarity 0.8 misses all of them once in 20 million times. A
candidate pair whose 128 minima agree to less than ``similarity - SLACK`` is discarded (5.6 standard deviations), and
every other one is verified by its shingles, in the second round by their 64-bit hashes.

A block's centre is the node that has most others in all its blocks together: the text that edited copies were made
from has the keys that they have in common, while two copies may be too far apart. A first round verifies each node
against one other: its near text or, where fingerprints show none, the centre that it shares most keys with. Only blocks that this leaves in more than one component go on to a second round, which looks at their
pairs between components, chunk by chunk. The minima alone show there which texts have a partner at all; only those
are met by their sets of hashes. Pairs that turn out not to be similar never become rows, and those that are become a
spanning forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import drop_table, shared_table, skew_join
from tessera.llm.graph import component_roots

SHINGLE, SIMILARITY, SEED, BANDS, ROWS, SLACK, CHUNK = 5, 0.8, 42, 32, 4, 0.2, 512
#: Bytes of shingle hashes in a chunk, about.
CHUNK_BYTES = 32 << 20
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_MULTIPLY, _ADD = _FACTORS[0] * np.uint64(2) + np.uint64(1), _FACTORS[1]


def shingles(text: str, size: int = SHINGLE) -> set[bytes]:
    """The distinct word shingles of a whole text; a shorter text is one shingle, a text without words has none."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return set()
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    k, starts = min(size, len(words)), np.concatenate(([0], ends[:-1] + 1))
    return {joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)}


def similar(a: set[bytes], b: set[bytes], similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets reaches the limit; two empty sets are equal."""
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """The 64-bit hashes of the distinct shingles."""
    found = shingles(text, size)
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), dtype=np.uint64, count=len(found))


def minima(h: np.ndarray) -> tuple[int, bytes]:
    """The number of distinct hashes of shingles, and the 32 bits each of the least under each permutation."""
    least = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for at in range(0, len(h), 2048):
        np.minimum(least, (h[None, at : at + 2048] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=least)
    return len(h), (least >> np.uint64(16)).astype("<u4").tobytes()


def node_of(text: Column) -> Column:
    """What stands for a text: its 64-bit hash."""
    return F.xxhash64(text)


def _partners(pdf: pd.DataFrame, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each place in one chunk, or in two: the later places of other roots, of a size that allows the similarity,
    that have enough equal minima and share no earlier key."""
    sig = np.frombuffer(b"".join(pdf["sig"]), dtype="<u4").reshape(len(pdf), BANDS * ROWS)
    node, root, size = (pdf[c].to_numpy() for c in ("node", "root", "size"))
    chunk, t, within = pdf["chunk"].to_numpy(), pdf["t"].iat[0], pdf["i"].iat[0] == pdf["j"].iat[0]
    for x in range(len(pdf)):
        other = (node > node[x]) if within else (chunk > chunk[x])
        y = np.flatnonzero(other & (root != root[x]))
        y = y[np.minimum(size[y], size[x]) >= similarity * np.maximum(size[y], size[x]) - 1e-9]
        if len(y):
            same = sig[y] == sig[x]
            keys = same.reshape(len(y), BANDS, ROWS).all(axis=2)
            yield x, y[(same.mean(axis=1) >= similarity - SLACK) & (keys.argmax(axis=1) == t)]


def _paired(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """The rows of one chunk, or of two, that have a partner to be compared with."""
    used = np.zeros(len(pdf), dtype=bool)
    for x, y in _partners(pdf, similarity):
        used[y] = True
        used[x] |= len(y) > 0
    return pdf.loc[used, list(PLACE)]


def _crossing(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """A forest of the links of one chunk, or between two, between nodes of different roots."""
    node, first = pdf["node"].to_numpy(), {}
    sets = [frozenset(np.frombuffer(x, "<u8").tolist()) for x in pdf["set"]]
    up = [first.setdefault(r, i) for i, r in enumerate(pdf["root"].tolist())]

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for x, y in _partners(pdf, similarity):
        for k in y.tolist():
            a, b = top(x), top(k)
            if a != b and similar(sets[x], sets[k], similarity):
                up[max(a, b)] = min(a, b)
                out.append((max(node[x], node[k]), min(node[x], node[k])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _by_task(batches: Iterator[pd.DataFrame], each: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by task key; a key may go on in the next batch."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        pdf = (pdf if held is None else pd.concat([held, pdf])).reset_index(drop=True)
        groups = [g for _, g in pdf.groupby(["t", "key", "i", "j"], sort=False)]
        held = groups.pop() if groups else None
        for g in groups:
            yield each(g)
    if held is not None:
        yield each(held)


def _verified(batches: Iterator[pd.DataFrame], size: int, similarity: float) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        last, base, close = None, set(), []
        for a, b in zip(pdf["text_a"], pdf["text_b"], strict=True):
            if b != last:  # a hub's pairs come one after the other
                last, base = b, shingles(b, size)
            close.append(similar(shingles(a, size), base, similarity))
        yield pdf.loc[close, ["a", "b"]]


PLACE = {"t": "int", "key": "long", "i": "int", "j": "int", "chunk": "int", "node": "long", "root": "long", "size": "long"}
PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Each of the nodes with its text, once.

    Copies of a text become one row before the shuffle, so that many of them are no single task.
    """
    need = shared_table(nodes.select("node").distinct(), "need")
    return shared_table(docs.groupBy("node").agg(F.first("text").alias("text")).join(need, "node", "left_semi"), "texts")


def dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) with a ``salt``, and the nodes b with as many ``salts`` as their pairs need tasks."""
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("salts"), F.count("*").alias("_n"))
    hubs = shared_table(hubs, "hubs")
    salted = skew_join(pairs, hubs, ["b"], pairs.count()).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    return salted.drop("salts"), hubs


def compared(left: DataFrame, texts: DataFrame, hubs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of left (``a``, ``b``, ``salt`` and ``text_a``) whose texts are similar; texts holds each node
    and its text, and that of a node b is dealt to each of its salts."""
    right = texts.withColumnRenamed("text", "text_b").join(hubs.drop("_n"), F.col("node") == F.col("b")).select(
        "b", "text_b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    both = left.join(right, ["b", "salt"]).select("a", "b", "text_a", "text_b")
    return shared_table(both.mapInPandas(lambda it: _verified(it, size, similarity), PAIR), "links")


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar; texts holds each node and its text.

    The text of a node with many pairs is dealt to as many tasks as its pairs need.
    """
    salted, hubs = dealt(pairs)
    left = salted.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return compared(left, texts, hubs, size, similarity)


def similar_roots(
    docs: DataFrame, nodes: DataFrame, near: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, chunk: int = CHUNK
) -> DataFrame:
    """(node, root) of every node of docs (``node`` and ``text``) that is linked to a smaller one.

    nodes holds each node once with its minima (``size`` and ``sig``), near at most one pair (a, b) for each node a.
    """
    width = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.substring("sig", 1 + width * t, width)) for t in range(BANDS)])
    keyed = nodes.select("node", "size", F.posexplode(keys).alias("t", "key"))
    blocks = keyed.groupBy("t", "key").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("n", F.col("_n"))
    total = nodes.count()
    found = shared_table(skew_join(keyed, shared_table(blocks, "blocks"), ["t", "key"], total), "members")
    company = found.groupBy("node").agg(F.sum("n").alias("company"))
    hubs = found.join(company, "node").groupBy("t", "key").agg(
        F.max_by(F.struct("node", "size"), F.struct("company", -F.col("node"))).alias("h"), F.count("*").alias("_n")
    )
    hubs = shared_table(hubs.select("t", "key", F.col("h.node").alias("hub"), F.col("h.size").alias("hub_size"), "_n"), "centres")
    members = shared_table(skew_join(found.drop("n"), hubs, ["t", "key"], total), "members")
    drop_table(found)
    # Sets whose sizes are too far apart can't reach the similarity.
    alike = F.least("size", "hub_size") >= similarity * F.greatest("size", "hub_size") - 1e-9
    # A node without a near text has one centre, the one that it shares most keys with: each text meets one other.
    stars = members.where("node <> hub").where(alike).groupBy("node", "hub").agg(F.count("*").alias("k"))
    stars = stars.groupBy("node").agg(F.max_by("hub", F.struct("k", -F.col("hub"))).alias("hub"))
    stars = stars.select(F.col("node").alias("a"), F.col("hub").alias("b")).join(near, "a", "left_anti")
    stars = shared_table(stars.unionByName(near), "stars")
    met = stars.select(F.col("a").alias("node")).union(stars.select(F.col("b").alias("node")))
    texts = texts_of(members.select("node").union(met), docs)
    links = verified(stars, texts, size, similarity)
    drop_table(stars)
    roots = shared_table(component_roots(links), "roots")
    placed = members.drop("hub", "hub_size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = shared_table(placed, "placed")
    drop_table(members)
    wide = F.greatest(F.col("n") / chunk, F.col("bytes") / CHUNK_BYTES)
    open_blocks = (
        placed.groupBy("t", "key")
        .agg(F.count("*").alias("n"), F.sum(8 * F.col("size")).alias("bytes"), F.min("root").alias("x"), F.max("root").alias("y"))
        .where("x <> y").select("t", "key", F.ceil(wide).cast("int").alias("c"), F.col("n").alias("_n"))
    )
    member = skew_join(placed, shared_table(open_blocks, "open"), ["t", "key"], total)
    member = member.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    key = ["t", "key", "i", "j"]
    tasks = (
        member.join(nodes.select("node", "sig"), "node").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .withColumns({"i": F.least("chunk", "o"), "j": F.greatest("chunk", "o")}).select(*PLACE, "sig")
        .repartition(*key).sortWithinPartitions(*key)
    )
    # Minima alone show which rows have a partner at all; only those are met by their sets of hashes.
    place = ", ".join(f"{name} {kind}" for name, kind in PLACE.items())
    paired = tasks.mapInPandas(lambda it: _by_task(it, lambda g: _paired(g, similarity)), place)
    paired = shared_table(paired, "paired")
    hashed = F.pandas_udf(lambda texts: texts.map(lambda t: hashes(t, size).astype("<u8").tobytes()), "binary")
    sets = texts.join(paired.select("node").distinct(), "node", "left_semi")
    sets = shared_table(sets.select("node", hashed("text").alias("set")), "sets")
    tasks = paired.join(nodes.select("node", "sig").join(sets, "node"), "node").repartition(*key).sortWithinPartitions(*key)
    more = tasks.mapInPandas(lambda it: _by_task(it, lambda g: _crossing(g, similarity)), PAIR)
    more = shared_table(more, "more")
    for table in (placed, texts, paired, sets):
        drop_table(table)
    return component_roots(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
