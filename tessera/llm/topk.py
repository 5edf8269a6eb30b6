"""Exact top-k search by inner product over KD-trees, one per shard.

Vectors are dealt to cells, the leaves of a coarse KD-tree over a bounded sample, and each cell to shards of bounded
size. A shard's tree splits at medians and keeps the tight bounding box of every node, and a ball around its
vectors' mean; the largest inner product that both allow bounds all of its vectors. Queries go in blocks, cell by cell. Every block first searches one shard of
its own cell, and the kth score found there is each query's floor. Before any tree is sent to it, a block's queries
are held against the tight boxes and balls of all cells (a bounded table), and go on to those cells only whose bound reaches
their floor, 32 blocks at a time to each shard. Within a tree the box with the highest bound is opened first.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shared_table, skew_join

K, SHARD, BLOCK, LEAF = 5, 4096, 512, 64
#: Numbers in the sample of vectors that cells are cut from, cells at most, and blocks that visit a shard together.
SAMPLE, CELLS, TOGETHER = 2_560_000, 1024, 32


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(payload: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(payload)) as f:
        return {k: f[k] for k in f.files}


def build_tree(ids: np.ndarray, rows: np.ndarray, vecs: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Rows in leaf order with ids; per node its box, its ball (centre and radius), its row range, and its left child
    (0: a leaf; right is next)."""
    order = np.lexsort((rows, ids))
    lo, hi, centre, radius, first, last, child = [], [], [], [], [], [], []

    def node(at: int, end: int) -> None:
        part = vecs[order[at:end]]
        lo.append(part.min(axis=0))
        hi.append(part.max(axis=0))
        centre.append(part.mean(axis=0))
        radius.append(np.linalg.norm(part - centre[-1], axis=1).max())
        first.append(at)
        last.append(end)
        child.append(0)

    node(0, len(order))
    at = 0
    while at < len(first):
        a, b = first[at], last[at]
        spread = hi[at] - lo[at]
        axis = int(spread.argmax())
        if b - a > leaf and spread[axis] > 0:
            mid = (b - a) // 2
            part = order[a:b]
            order[a:b] = part[np.argpartition(vecs[part, axis], mid)]
            child[at] = len(first)
            node(a, a + mid)
            node(a + mid, b)
        at += 1
    return {
        "ids": ids[order], "rows": rows[order], "vecs": vecs[order], "lo": np.array(lo), "hi": np.array(hi),
        "centre": np.array(centre), "radius": np.array(radius), "first": np.array(first), "last": np.array(last), "child": np.array(child),
    }


def upper(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each query and box the most that an inner product with what is inside can be: what the box allows, and what
    the ball allows (the product with its centre, and the query's length times its radius), whichever is less."""
    box = np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T
    ball = queries @ centre.T + np.linalg.norm(queries, axis=1)[:, None] * radius
    return np.minimum(box, ball + 1e-9 * np.abs(ball) + 1e-6)  # widened by what rounding may hide


def search_tree(
    tree: dict[str, np.ndarray], qrows: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int
) -> list[tuple[int, int, int, int]]:
    """(query row, vector, vector's row, score) of each query's k best in this tree that reach its floor; a row is no
    candidate of its own."""
    bounds = upper(queries, tree["lo"], tree["hi"], tree["centre"], tree["radius"])
    out = []
    for q in range(len(qrows)):
        bound, kth = bounds[q], floor[q]
        best: list[tuple[float, int, int]] = []  # (score, -id, -row): the smallest goes first
        heap = [(-bound[0], 0)]
        while heap:
            up, at = heapq.heappop(heap)
            if -up < kth:
                break
            left = tree["child"][at]
            if left:
                for c in (left, left + 1):
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = tree["first"][at], tree["last"][at]
            scores = tree["vecs"][a:b] @ queries[q]
            for i in np.flatnonzero(scores >= kth):
                entry = (scores[i], -int(tree["ids"][a + i]), -int(tree["rows"][a + i]))
                if -entry[2] == qrows[q]:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                kth = max(kth, best[0][0])
        out += [(int(qrows[q]), -i, -r, int(s)) for s, i, r in best]
    return out


def cut_cells(sample: np.ndarray, cells: int) -> list[tuple[int, float, int]]:
    """A KD-tree of at most ``cells`` leaves over a sample: (axis, value, left child) per node, axis -1 and the leaf's
    number for leaves. A row goes left if its component is below the value; the right child is the next node."""
    nodes, parts, leaves = [(-1, 0.0, 0)], [np.arange(len(sample))], 1
    queue = [(-len(sample), 0)]
    while queue and leaves < cells:
        _, at = heapq.heappop(queue)
        rows = sample[parts[at]]
        if len(rows) < 2:
            continue
        axis = int((rows.max(axis=0) - rows.min(axis=0)).argmax())
        value = float(np.median(rows[:, axis]))
        below = rows[:, axis] < value
        if not below.any():
            value = float(np.nextafter(value, np.inf))
            below = rows[:, axis] < value
        if not below.any() or below.all():
            continue
        nodes[at], left = (axis, value, len(nodes)), len(nodes)
        for part in (parts[at][below], parts[at][~below]):
            nodes.append((-1, 0.0, 0))
            parts.append(part)
            heapq.heappush(queue, (-len(part), len(nodes) - 1))
        parts[at], leaves = np.array([], dtype=int), leaves + 1
        assert left + 2 == len(nodes)
    leaf = iter(range(leaves))
    return [n if n[0] >= 0 else (-1, 0.0, next(leaf)) for n in nodes]


def cell_of(nodes: list[tuple[int, float, int]], vecs: np.ndarray) -> np.ndarray:
    """The leaf that each row falls into, level by level for all rows at once."""
    axis, value, child = (np.array(x) for x in zip(*nodes, strict=True))
    at = np.zeros(len(vecs), dtype=np.int64)
    inner = np.flatnonzero(axis[at] >= 0)
    while len(inner):
        n = at[inner]
        at[inner] = child[n] + (vecs[inner, axis[n]] >= value[n])
        inner = inner[axis[at[inner]] >= 0]
    return child[at]


def _vecs(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["vec"].to_list()).astype(np.float64)


def _plant(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = build_tree(pdf["vec_id"].to_numpy(), pdf["row"].to_numpy(), _vecs(pdf))
    at = {k: [pdf[k].iat[0]] for k in ("dim", "cell", "shard")}
    ball = {"centre": [tree["centre"][0]], "radius": [float(tree["radius"][0])]}
    return pd.DataFrame(at | {"low": [tree["lo"][0]], "high": [tree["hi"][0]], **ball, "tree": [_dump(**tree)]})


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("row")
    at = {k: [pdf[k].iat[0]] for k in ("dim", "cell", "block")}
    return pd.DataFrame(at | {"queries": [_dump(rows=pdf["row"].to_numpy(), vecs=_vecs(pdf))]})


def top_k(vectors: DataFrame, query_mod: int = 50, k: int = K, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every vector whose id is divisible by query_mod.

    vectors holds vec_id and embedding; components become floor(256 x) and scores are exact while they stay below
    2^53. Rows with a null id, and vectors that are null, empty or hold a null or non-finite component, take no
    part. Vectors of another length than the query's have no inner product with it. Every row is a query, or a
    candidate of all queries but itself, of its own, also where ids or whole rows repeat: ranks of rows that share an id
    stand beside each other. Ties go to the smaller id; a query with fewer candidates returns all.
    """
    x = F.col("embedding")
    number = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & number).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.size(x).alias("dim"),
        F.transform(x, lambda v: F.floor(256 * v.cast("double"))).alias("vec"),
    )
    rows = shared_table(rows, "vectors")  # where a row has its number once and for all
    spark = rows.sparkSession
    # The coarse trees: SAMPLE numbers at most reach the driver, those of the smallest id hashes, for each length of
    # vectors its share; a length that has none is one cell.
    h = F.xxhash64("vec_id")
    taken: dict[int, list] = {}
    longest = rows.agg(F.max("dim")).first()[0] or 1
    for r in rows.orderBy(h, "vec_id").limit(max(1, SAMPLE // longest)).select("dim", "vec").collect():
        taken.setdefault(r["dim"], []).append(r["vec"])
    # Cells of a quarter of a shard, as far as they go; the cells of a larger table hold many shards each.
    share = rows.count() / max(1, sum(map(len, taken.values())))
    least = max(1, shard_rows // 4)
    n_cells = {d: int(min(max(1, CELLS // len(taken)), 1 + len(v) * share // least)) for d, v in taken.items()}
    coarse = spark.sparkContext.broadcast({d: cut_cells(np.array(v, dtype=np.float64), n_cells[d]) for d, v in taken.items()})

    def cells(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for dims, vecs in batches:
            out, dims = np.zeros(len(dims), dtype=np.int32), dims.to_numpy()
            for d in np.unique(dims):
                if d in coarse.value:
                    here = np.flatnonzero(dims == d)
                    out[here] = cell_of(coarse.value[d], np.stack(vecs.iloc[here].to_list()).astype(np.float64))
            yield pd.Series(out)

    asks = F.pmod("vec_id", F.lit(query_mod)) == 0
    placed = rows.withColumn("cell", F.pandas_udf(cells, "int")("dim", "vec"))
    placed = shared_table(placed, "placed")
    counts = placed.groupBy("dim", "cell").agg(
        F.count("*").alias("_n"), F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"),
        F.greatest(F.ceil(F.count_if(asks) / block_rows), F.lit(1)).cast("int").alias("blocks"),
    )
    dealt = skew_join(placed, shared_table(counts, "counts"), ["dim", "cell"], placed.count())
    trees = shared_table(
        dealt.withColumn("shard", F.pmod(h, F.col("shards")).cast("int"))
        .groupBy("dim", "cell", "shard").applyInPandas(_plant, "dim int, cell int, shard int, low array<double>, high array<double>, centre array<double>, radius double, tree binary"), "trees",
    )
    blocks = shared_table(
        dealt.where(asks).withColumn("block", F.pmod(h, F.col("blocks")).cast("int"))
        .groupBy("dim", "cell", "block").applyInPandas(_block, "dim int, cell int, block int, queries binary"), "queries",
    )
    # Tight boxes and balls of the cells, and the shards that hold rows of each: CELLS rows, or one for each length of
    # vectors. A cell's ball is that of its first shard, as wide as all its shards' balls need.
    edges = trees.select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("pos", "x"))
    edges = edges.groupBy("dim", "cell", "pos").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).groupBy("dim", "cell")
    edges = edges.agg(F.sort_array(F.collect_list(F.struct("pos", "low", "high"))).alias("box"))
    middle = trees.groupBy("dim", "cell").agg(F.min_by("centre", "shard").alias("middle"))
    away = F.sqrt(F.aggregate(F.zip_with("centre", "middle", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)) + F.col("radius")
    balls = trees.select("dim", "cell", "centre", "radius").join(F.broadcast(middle), ["dim", "cell"])
    balls = balls.groupBy("dim", "cell").agg(F.first("middle").alias("middle"), F.max(away).alias("wide"))
    boxes: dict[int, tuple] = {}
    for r in edges.join(balls, ["dim", "cell"]).orderBy("dim", "cell").collect():
        at, low, high, centre, wide = boxes.setdefault(r["dim"], ([], [], [], [], []))
        at.append(r["cell"])
        low.append([x["low"] for x in r["box"]])
        high.append([x["high"] for x in r["box"]])
        centre.append(r["middle"])
        wide.append(r["wide"])
    boxed = spark.sparkContext.broadcast({d: tuple(map(np.array, b)) for d, b in boxes.items()})
    shards = shared_table(trees.groupBy("dim", "cell").agg(F.sort_array(F.collect_list("shard")).alias("all")), "shards")

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's floors by its pilot shard, and the queries that go on to each cell."""
        for pdf in batches:
            for dim, cell, block, t, q in zip(pdf["dim"], pdf["cell"], pdf["block"], pdf["tree"], pdf["queries"], strict=True):
                q = _load(q)
                scores: dict[int, list[int]] = {}
                for query, _, _, s in search_tree(_load(t), q["rows"], q["vecs"], np.full(len(q["rows"]), -np.inf), k):
                    scores.setdefault(query, []).append(s)
                floor = np.array([min(s) if len(s := scores.get(i, [])) == k else -np.inf for i in q["rows"].tolist()], dtype=np.float64)
                to, *sides = boxed.value[dim]
                reach = upper(q["vecs"], *sides) >= floor[:, None]
                out = []
                for c in np.flatnonzero(reach.any(axis=0)):
                    some = reach[:, c]
                    payload = _dump(rows=q["rows"][some], vecs=q["vecs"][some], floor=floor[some])
                    out.append((dim, int(to[c]), (int(cell) * 31 + int(block)) % (1 << 30), int(some.sum()), payload))
                yield pd.DataFrame(out, columns=["dim", "cell", "block", "n", "queries"])

    pilots = blocks.join(shards, ["dim", "cell"]).withColumn("shard", F.get("all", F.pmod(F.col("block"), F.size("all")))).drop("all")
    first = pilots.join(trees.select("dim", "cell", "shard", "tree"), ["dim", "cell", "shard"])
    visits = shared_table(
        first.select("dim", "cell", "block", "tree", "queries").mapInPandas(floors, "dim int, cell int, block int, n int, queries binary"), "visits"
    )
    # Visits of one cell, as many as half fill a group of blocks, travel as one row to each of its shards.
    groups = visits.groupBy("dim", "cell").agg(F.ceil(F.sum("n") / (TOGETHER * block_rows)).cast("int").alias("g"), F.count("*").alias("_n"))
    grouped = skew_join(visits, shared_table(groups, "groups"), ["dim", "cell"], visits.count())
    grouped = grouped.groupBy("dim", "cell", F.pmod(F.xxhash64("block"), F.col("g")).alias("group")).agg(F.collect_list("queries").alias("queries"))
    grouped = grouped.join(shards, ["dim", "cell"]).withColumn("shard", F.explode("all")).drop("all")

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, group in zip(pdf["tree"], pdf["queries"], strict=True):
                tree = _load(t)
                for q in map(_load, group):
                    yield pd.DataFrame(search_tree(tree, q["rows"], q["vecs"], q["floor"], k), columns=["query", "vec_id", "row", "score"])

    met = grouped.join(trees.select("dim", "cell", "shard", "tree"), ["dim", "cell", "shard"]).select("tree", "queries")
    hits = met.mapInPandas(rest, "query long, vec_id long, row long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = rows.where(asks).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")
