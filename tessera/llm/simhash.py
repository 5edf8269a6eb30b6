"""Near-duplicates by SimHash fingerprints and pivot distance tables.

Every distinct fingerprint gets a row of Hamming distances to reference fingerprints (pivots). By the triangle
inequality two fingerprints that differ in at most ``limit`` bits differ by at most ``limit`` in every coordinate
of that row, so a pair is discarded by its largest coordinate difference and only survivors are compared bit by bit.

Pairs meet in blocks: the 64 bits are cut into 6 pieces, and two fingerprints within 3 bits agree on at least 3 of
them, so that each of the 20 choices of 3 pieces is a blocking key and no link is lost. A block of two rows is
settled while it is counted. A larger block is cut into chunks by a hash, and every pair of chunks is a task row of
its own, so that the largest block (one third of the corpus, say) is spread over many tasks. In a chunk pair the
fingerprints are sorted by their distance to the first pivot; only those whose distances differ by ``limit`` at most
are looked at together, and a pair returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import jaccard
from tessera.llm.common import drop_table, shared_table, skew_join, text_of, whole_row
from tessera.llm.graph import component_roots

SHINGLE, SEED, LIMIT, PIVOTS, PIECES, CHUNK = 3, 42, 3, 16, 6, 2048


def shingle_hashes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit hashes of the word shingles of a whole text, repeats included; none without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.array([], dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), dtype="<u8", count=len(words) - k + 1)


def simhash_of(h: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of the hashes of shingles; zero for none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(part) // 255 * 255  # sums of up to 255 ones stay in a byte
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text; zero without words."""
    return simhash_of(shingle_hashes(text, shingle, seed))


def pivots(n: int = PIVOTS) -> list[int]:
    """n reference fingerprints, as signed longs, from the splitmix64 sequence."""
    out, mask = [], (1 << 64) - 1
    for i in range(1, n + 1):
        z = (i * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        z ^= z >> 31
        out.append(z - (1 << 64) if z >> 63 else z)
    return out


def pivot_row(fp: Column, n: int = PIVOTS) -> Column:
    """The row of the pivot distance table: Hamming distances of a fingerprint to the n pivots."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p).cast("long"))).cast("tinyint") for p in pivots(n)])


def block_masks(pieces: int = PIECES, limit: int = LIMIT) -> list[int]:
    """Masks, as signed longs, of which one at least covers no bit that a pair within limit differs in."""
    edges = [round(64 * i / pieces) for i in range(pieces + 1)]
    single = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(pieces)]
    masks = [sum(c) for c in combinations(single, pieces - limit)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fp: np.ndarray, rows: np.ndarray, side: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one chunk, or between two: (members, roots) of a spanning forest of the pairs within limit."""
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side != side.min())
    within = len(right) == 0
    right = left if within else right
    right = right[np.argsort(rows[right, 0], kind="stable")]
    first, dense = rows[right, 0], min(4, rows.shape[1])
    found_a, found_b = [np.array([], dtype=int)], [np.array([], dtype=int)]
    for value in np.unique(rows[left, 0]):
        mine = left[rows[left, 0] == value]
        near = right[np.searchsorted(first, value - limit) : np.searchsorted(first, value + limit, "right")]
        step = max(1, (1 << 20) // max(1, len(near)))
        for at in range(0, len(mine), step):
            part = mine[at : at + step]
            alive = np.ones((len(part), len(near)), dtype=bool)
            for p in range(1, dense):
                alive &= np.abs(rows[part, p][:, None] - rows[near, p][None, :]) <= limit
            i, j = np.nonzero(alive)
            i, j = part[i], near[j]
            if within:
                i, j = i[i < j], j[i < j]
            # The largest coordinate difference decides, and what is left is compared bit by bit.
            kept = np.abs(rows[i, dense:] - rows[j, dense:]).max(axis=1, initial=0) <= limit
            i, j = i[kept], j[kept]
            close = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= limit
            found_a.append(i[close])
            found_b.append(j[close])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    label = np.arange(len(fp))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _links(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by task key; a key may go on in the next batch."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if pdf.empty:
            continue
        keys = pdf[["t", "key", "i", "j"]].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        last = cuts[-1] if len(cuts) else 0
        yield _settle(pdf.iloc[:last], cuts[:-1] if len(cuts) else cuts, limit)
        held = pdf.iloc[last:]
    if held is not None and len(held):
        yield _settle(held, np.array([], dtype=int), limit)


def _settle(pdf: pd.DataFrame, cuts: np.ndarray, limit: int) -> pd.DataFrame:
    a, b = [np.array([], dtype=np.int64)], [np.array([], dtype=np.int64)]
    if len(pdf):
        fp, side = pdf["fp"].to_numpy(dtype=np.int64), pdf["chunk"].to_numpy()
        rows = np.stack(pdf["row"].to_list()).astype(np.int8)
        for lo, hi in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
            one_sided = pdf["i"].iat[lo] != pdf["j"].iat[lo] and side[lo] == side[hi - 1] and (side[lo:hi] == side[lo]).all()
            if hi - lo > 1 and not one_sided:
                x, y = _forest(fp[lo:hi], rows[lo:hi], side[lo:hi], limit)
                a.append(x)
                b.append(y)
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def close_pairs(prints: DataFrame, limit: int = LIMIT, chunk: int = CHUNK, n_pivots: int = PIVOTS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints ``fp`` within limit bits."""
    masks = block_masks(PIECES, limit)
    table = prints.select("fp", pivot_row(F.col("fp"), n_pivots).alias("row"))
    keyed = table.select(
        "fp", "row",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("t", "key"),
    )
    blocks = (
        keyed.groupBy("t", "key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    )
    blocks = shared_table(blocks, "blocks")
    apart = F.zip_with(pivot_row(F.col("a"), n_pivots), pivot_row(F.col("b"), n_pivots), lambda x, y: F.abs(x - y))
    twos = (
        blocks.where("n = 2").where(F.array_max(apart) <= limit)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit).select("a", "b")
    )
    large = blocks.where("n > 2").select("t", "key", F.ceil(F.col("n") / chunk).cast("int").alias("c"), F.col("n").alias("_n"))
    member = skew_join(keyed, large, ["t", "key"], prints.count())
    member = member.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    tasks = (
        member.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select("t", "key", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "fp", "row")
        .repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    )
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return twos.union(tasks.mapInPandas(lambda it: _links(it, limit), schema))


def _text_prints(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, fp, size, sig) of each distinct text (``node`` and ``text``): its fingerprint and its minima, by one pass
    over its shingles."""

    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for text in part:
                h = shingle_hashes(text, shingle)
                rows.append((int(np.uint64(simhash_of(h)).astype(np.int64)), *jaccard.minima(np.unique(h))))
            yield pd.DataFrame(rows, columns=["fp", "size", "sig"])

    made = texts.select("node", F.pandas_udf(prints, "fp long, size long, sig binary")("text").alias("p"))
    made = made.groupBy("node").agg(F.max("p.fp").alias("fp"), F.max("p.size").alias("size"), F.first("p.sig").alias("sig"))
    return shared_table(made, "nodes")


def near_texts(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b) of nodes (``node`` and ``fp``): each with another of its component of fingerprints within limit bits.

    All of a component are paired with the same one, so that a text meets one other when the pairs are verified.
    """
    classes = shared_table(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("_n")), "classes")
    total = nodes.count()
    roots = shared_table(component_roots(close_pairs(classes.select("fp"), limit)), "near")
    heads = roots.groupBy("root").agg(F.count("*").alias("_n"))
    heads = shared_table(heads.join(classes.select(F.col("fp").alias("root"), F.col("first").alias("head")), "root"), "heads")
    moved = skew_join(roots, heads, ["root"], total).select(F.col("node").alias("fp"), "head")
    heads = classes.join(moved, "fp", "left").select("fp", F.coalesce("head", "first").alias("head"), "_n")
    pairs = skew_join(nodes.select("node", "fp"), shared_table(heads, "heads"), ["fp"], total)
    return pairs.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))


def _linked(prints: DataFrame, docs: DataFrame, text: Column, limit: int, shingle: int, similarity: float | None) -> DataFrame:
    """``fp``, ``component``, the least ``id`` of its component, and ``_n``, its rows, for the distinct fp of prints
    (``id`` and ``fp``)."""
    classes = prints.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("_n"))
    classes = shared_table(classes, "classes")
    if similarity is None:
        roots = component_roots(close_pairs(classes.select("fp"), limit))
    else:
        texts = docs.select(jaccard.node_of(text).alias("node"), text.alias("text"))
        nodes = _text_prints(texts, shingle)
        near = shared_table(near_texts(nodes, limit), "near")
        roots = jaccard.similar_roots(texts, nodes.drop("fp"), near, shingle, similarity)
        drop_table(nodes)
    linked = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = shared_table(linked, "linked")
    best = (
        linked.join(classes, linked["node"] == classes["fp"])
        .groupBy("root").agg(F.min("first_id").alias("component"), F.count("*").alias("_n"))
    )
    moved = skew_join(linked, shared_table(best, "best"), ["root"], linked.count()).select(F.col("node").alias("fp"), "component")
    found = classes.join(moved, "fp", "left").select("fp", F.coalesce("component", "first_id").alias("component"), "_n")
    return shared_table(found, "components")


def _print_of(text: Column, shingle: int, similarity: float | None) -> Column:
    if similarity is not None:
        return jaccard.node_of(text)
    return F.pandas_udf(lambda texts: texts.map(lambda t: np.uint64(fingerprint(t, shingle)).astype(np.int64)), T.LongType())(text)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
    shingle: int = SHINGLE, similarity: float | None = None,
) -> DataFrame:
    """One row per input row: id, ``fp`` (signed long), ``component_id`` (smallest id reachable over links).

    Texts are linked within ``limit`` bits of their fingerprints. Where a similarity is given, links are those of the
    exact Jaccard similarity of shingles: those within ``limit`` bits are verified by it, and similar texts that are
    further apart are found by their minima (``llm/jaccard.py``); fp is then a hash of the text. Null and empty texts have fingerprint zero
    and link like any other. Repeated rows stay repeated. A null id stays null and takes the smallest id of its
    component, or null if that has none.
    """
    text = text_of(text_col)
    prints = shared_table(docs.select(F.col(id_col).alias("id"), _print_of(text, shingle, similarity).alias("fp")), "prints")
    classes = _linked(prints, docs, text, limit, shingle, similarity).withColumnRenamed("component", "component_id")
    return skew_join(prints, classes, ["fp"], prints.count()).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The documents without near-copies, by near_duplicates(): of each component one row stays, that with the smallest id.

    The survivor is a row, not an id: rows go by id, those without one last, then by a hash of the text. Of rows
    that agree in both one stays; they are told apart before the shuffle, in which every text takes part once.
    """
    text = text_of()
    key = F.struct(F.col("doc_id").isNull().alias("lost"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"))
    prints = shared_table(docs.select(key.alias("id"), _print_of(text, shingle, similarity).alias("fp")), "prints")
    first = _linked(prints, docs, text, LIMIT, shingle, similarity).select("component.*").distinct()
    # No null may stand in a join's key: a lost id is joined as zero beside its flag.
    flat = lambda lost, doc_id, h: [lost.alias("_lost"), F.coalesce(doc_id, F.lit(0)).alias("_id"), h.alias("_hash")]
    first = shared_table(first.select(*flat(F.col("lost"), F.col("id"), F.col("hash"))), "first")
    rows = docs.select(whole_row(docs).alias("_doc"), *flat(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(text)))
    keys = ["_lost", "_id", "_hash"]
    return rows.dropDuplicates(keys).join(first, keys, "left_semi").select("_doc.*")
