"""Nearest neighbours by cosine without a row for every pair, and all pairs where they are asked for.

Vectors, made unit vectors, are dealt to cells by the nearest of a bounded number of centres, and each cell to blocks of
bounded size. A block's products with itself give its rows their first ``k`` neighbours and so a floor. Another block is
visited only if its centre and both radii allow a product that reaches the lowest floor. A visit is one matrix product in
single precision, and only what reaches a row's own floor, less the error of that, is reckoned again in double. What is
exact is kept exact: no bound ever excludes a winner.

Blocks meet in a cartesian product of parts: a task takes a part of each side and reads both where they lie, so that what
is written grows with the blocks and not with their pairs, and of a task ``k`` rows a vector are left at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V

BLOCK, CELLS = 2048, 256
#: Products are compared by so many digits, ties going to the smaller id; a bound is widened by what rounding may hide.
DIGITS, SLACK = 9, 1e-8
BEST = "a long, b long, cosine double"
#: All pairs come from blocks of so many vectors, since a visit makes a row for each of its pairs.
PAIRS_BLOCK = 256
#: The right side's numbers that a task holds (64 MB), and the tasks that a core gets if there are few.
HELD, TASKS = 1 << 23, 8
#: Rows of a block that are multiplied at a time, so that their products stay near the processor.
#: If more numbers than these belong to the pairs that are reckoned again, all rows are, and the best sorted out.
LINES, MANY = 512, 1 << 22


class Best:
    """The k best others so far of a block's rows: by product, rounded, ties to the smaller id; a row's own id is none."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k, self.single = ids, x, k, x.astype(np.float32)
        self.p, self.b = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        #: Twice what a product of unit vectors may be wrong by in single precision.
        self.error = np.float32((x.shape[1] + 4) * 2.0**-23)

    def meet(self, others: np.ndarray, y: np.ndarray) -> None:
        """Ids of others ascend."""
        single = y.astype(np.float32).T
        parts = [self._found(slice(i, i + LINES), others, y, single) for i in range(0, len(self.ids), LINES)]
        row, col, p = map(np.concatenate, zip(*parts, strict=True))
        self._take(row, others[col], p)

    def _found(self, lines: slice, others: np.ndarray, y: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place among the others, product) of what may be among the best of these rows."""
        m, k, ids, x, floor = len(others), self.k, self.ids[lines], self.x[lines], self.p[lines, -1]
        s = self.single[lines] @ single
        if (floor == -np.inf).any():
            # k others of this block reach its (k + 1)-th product, be one of them the row itself.
            first = np.partition(s, m - k - 1, axis=1)[:, m - k - 1] if m > k else np.full(len(ids), -np.inf)
            floor = np.maximum(floor, np.where(np.isnan(first), -np.inf, first - self.error))
        flat = np.flatnonzero(s >= (floor.astype(np.float32) - self.error)[:, None])
        if len(flat) > max(4 * k * len(ids), MANY // y.shape[1]):
            p = np.round(x @ y.T, DIGITS) + 0.0
            p[ids[:, None] == others[None, :]] = -np.inf
            col = np.argsort(-p, axis=1, kind="stable")[:, :k]
            row, col = np.repeat(np.arange(len(ids)), col.shape[1]), col.ravel()
            p = p[row, col]
        else:
            row, col = np.divmod(flat, m)
            p = np.round(np.einsum("ij,ij->i", x[row], y[col]), DIGITS) + 0.0
            p[ids[row] == others[col]] = -np.inf
        keep = p > -np.inf
        return row[keep] + lines.start, col[keep], p[keep]

    def _take(self, row: np.ndarray, b: np.ndarray, p: np.ndarray) -> None:
        which = np.unique(row)
        row, b, p = np.concatenate([row, np.repeat(which, self.k)]), np.concatenate([b, self.b[which].ravel()]), np.concatenate([p, self.p[which].ravel()])
        order = np.lexsort((b, -p, row))
        at = order[np.searchsorted(row[order], which)[:, None] + np.arange(self.k)]
        self.p[which], self.b[which] = p[at], b[at]

    def rows(self) -> pd.DataFrame:
        row, at = np.nonzero(self.p > -np.inf)
        return pd.DataFrame({"a": self.ids[row], "b": self.b[row, at], "cosine": self.p[row, at]})


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(n, -1)


def _pack(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """A block as one row: its ids and vectors, centre, radius, and the lowest floor of its rows."""
    pdf = pdf.sort_values("id")
    ids, x = pdf["id"].to_numpy(dtype=np.int64), np.stack(pdf["v"].to_list()).astype(np.float64)
    centre = x.mean(axis=0)
    best = Best(ids, x, k)
    best.meet(ids, x)
    lowest = float(best.p.min())
    return pd.DataFrame({
        "at": [pdf["at"].iat[0]], "n": [len(ids)], "ids": [ids.astype("<i8").tobytes()], "vectors": [x.astype("<f8").tobytes()],
        "centre": [centre], "radius": [float(np.linalg.norm(x - centre, axis=1).max())], "floor": [lowest if lowest > -np.inf else -2.0],
    })


def blocks_of(unit: DataFrame, k: int, block: int) -> DataFrame:
    """A row for each block of unit vectors (``id`` and ``v``): its number, and what _pack makes of it. Blocks are dealt out
    and kept once, for both sides of their meetings."""
    few = int(min(CELLS, -(-unit.count() // block)))
    # CELLS vectors at most: those of the smallest hashes.
    centres = np.array([r["v"] for r in unit.orderBy(F.xxhash64("id"), "id").limit(few).collect()], dtype=np.float64)
    sent = unit.sparkSession.sparkContext.broadcast(centres)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=(np.stack(pdf["v"].to_list()) @ sent.value.T).argmax(axis=1).astype(np.int32))

    placed = unit.mapInPandas(cells, "id long, v array<double>, cell int")
    # CELLS rows at most.
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    shards = [-(-counts.get(c, 1) // block) for c in range(max(few, 1))]
    listed = lambda numbers: F.get(F.array(*map(F.lit, numbers)), F.col("cell"))
    at = listed([sum(shards[:c]) for c in range(len(shards))]) + F.pmod(F.xxhash64("id"), listed(shards))
    packed = "at int, n int, ids binary, vectors binary, centre array<double>, radius double, floor double"
    blocks = placed.withColumn("at", at.cast("int")).groupBy("at").applyInPandas(lambda pdf: _pack(pdf, k), packed)
    left, _ = parts_of(unit.sparkSession, sum(shards), block * centres.size // max(few, 1))
    return blocks.repartitionById(left, F.col("at")).persist()


def parts_of(spark: SparkSession, n: int, numbers: int) -> tuple[int, int]:
    """Parts of the left and of the right side of n blocks of so many numbers: on the right as few as a task can hold, on
    the left as many as make work for all cores."""
    right = max(1, min(n, -(-n * numbers // HELD)))
    return max(1, min(n, max(right, -(-TASKS * spark.sparkContext.defaultParallelism // right)))), right


def meetings(blocks: DataFrame, n: int, numbers: int, on: Column) -> DataFrame:
    """Every two of n blocks for which ``on`` holds, the columns of one named _a and of the other _b. Blocks lie in the
    parts of the left side; the right side's are some of these each."""
    side = lambda name, df: df.select(*[F.col(c).alias(f"{c}_{name}") for c in df.columns])
    _, right = parts_of(blocks.sparkSession, n, numbers)
    return side("a", blocks).join(side("b", blocks.coalesce(right)).hint("shuffle_replicate_nl"), on)


def visits_of(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks (_b) that each block (_a) has to visit. A few numbers for each pair of blocks decide, and no vector is
    looked at: a product of unit vectors is that of the centres plus what the radii allow at most."""
    last, width = blocks.agg(F.coalesce(F.max("at"), F.lit(-1)), F.coalesce(F.max(F.size("centre")), F.lit(0))).first()
    reach = V.dot(F.col("centre_a"), F.col("centre_b")) + F.col("radius_a") * V.norm(F.col("centre_b")) + F.col("radius_b")
    return meetings(blocks, last + 1, block * width, reach + SLACK >= F.col("floor_a"))


def candidates_of(blocks: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """a, b, cosine: of each vector and each part of the right side the k best others."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, best = None, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                # A task's visits come block by block of the left side.
                if r.at_a != at:
                    if best is not None:
                        yield best.rows()
                    at, best = r.at_a, Best(np.frombuffer(r.ids_a, "<i8"), _matrix(r.vectors_a, r.n_a), k)
                best.meet(np.frombuffer(r.ids_b, "<i8"), _matrix(r.vectors_b, r.n_b))
        if best is not None:
            yield best.rows()

    met = visits_of(blocks, block).select(*[f"{c}_{side}" for side in "ab" for c in ("at", "n", "ids", "vectors")])
    return met.mapInPandas(visit, BEST)


def nearest(df: DataFrame, k: int = 3, id_col: str = "vec_id", vector: str = "e", block: int = BLOCK) -> DataFrame:
    """a, rank (from 1), b, cosine: the k nearest others of every vector, ties to the smaller id.

    Ids are unique. Null ids and null or empty vectors take no part; a zero vector's cosine is 0. All vectors have one
    length.
    """
    rows = df.where(F.col(id_col).isNotNull() & (F.size(vector) > 0))
    blocks = blocks_of(rows.select(F.col(id_col).cast("long").alias("id"), V.l2_normalize(vector).alias("v")), k, block)
    order = F.struct((-F.col("cosine")).alias("n"), F.col("b").alias("b"))
    ranked = candidates_of(blocks, k, block).groupBy("a").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("m"))
    return ranked.select("a", F.posexplode("m").alias("at", "x")).select("a", (F.col("at") + 1).alias("rank"), "x.b", (-F.col("x.n")).alias("cosine"))


def all_pairs(df: DataFrame, id_col: str = "vec_id", vector: str = "e", block: int = PAIRS_BLOCK) -> DataFrame:
    """a, b, cosine of all pairs a < b: quadratic by definition, but each visit of two blocks is one matrix product.

    Null ids take no part. The cosine is 0 where either vector is zero or empty, and null where one is null or holds a
    null. All others have one length.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.when(~F.exists(vector, lambda x: x.isNull()), F.col(vector)).alias("v"))
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n, numbers = max(1, -(-count // block)), block * max(width, 0)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["v"].notna().to_numpy()
        found = [np.asarray(v, dtype=np.float64) for v in pdf["v"][known]]
        width = max(map(len, found), default=0)
        x = np.zeros((len(pdf), width))
        if width:
            x[known] = np.stack([v if len(v) else np.zeros(width) for v in found])
        ids = pdf["id"].to_numpy(dtype="<i8")
        return pd.DataFrame({"at": [pdf["at"].iat[0]], "n": [len(ids)], "ids": [ids.tobytes()], "known": [known.tobytes()], "vectors": [x.astype("<f8").tobytes()]})

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                (a, known_a, x), (b, known_b, y) = ((np.frombuffer(r[f"ids_{s}"], "<i8"), np.frombuffer(r[f"known_{s}"], bool), _matrix(r[f"vectors_{s}"], r[f"n_{s}"])) for s in "ab")
                if 0 in (x.shape[1], y.shape[1]):
                    x, y = x[:, :0], y[:, :0]
                over = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
                with np.errstate(invalid="ignore", divide="ignore"):
                    cosine = np.where(over == 0, 0.0, x @ y.T / over)
                keep = a[:, None] < b[None, :] if r["at_a"] == r["at_b"] else a[:, None] != b[None, :]
                lost = ~(known_a[:, None] & known_b[None, :])
                ends = np.minimum(a[:, None], b[None, :])[keep], np.maximum(a[:, None], b[None, :])[keep]
                yield pa.RecordBatch.from_arrays([*map(pa.array, ends), pa.array(cosine[keep], mask=lost[keep])], names=["a", "b", "cosine"])

    placed = rows.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    blocks = placed.groupBy("at").applyInPandas(pack, "at int, n int, ids binary, known binary, vectors binary")
    # Of two blocks one visits the other, and each has much the same number of visits to make.
    ahead = 2 * F.pmod(F.col("at_b") - F.col("at_a"), F.lit(n))
    once = (ahead < n) | ((ahead == n) & (F.col("at_a") < F.col("at_b")))
    left, _ = parts_of(df.sparkSession, n, numbers)
    return meetings(blocks.repartitionById(left, F.col("at")), n, numbers, once).mapInArrow(visit, BEST)
