"""Whitening of embeddings by digit-slice matrix products.

Vectors become integers, and their covariance is computed without any rounding until its last division. With n vectors
of per-dimension sums S every row is centred as ``d = n * x - S``, an integer, and split by magnitude into limbs of
LIMB bits with the row's signs. A product of two limb matrices over BLOCK rows stays below 2^53, so that float64 BLAS
gives it exactly. Products of one power add up as 64-bit integers in a task and as decimals between tasks; the driver
recombines the powers to big integers, a matrix of the vectors' length, and decomposes it.

Three passes read the vectors: sums, products, results. What reaches the driver depends on the length of the vectors,
never on their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import shared_table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Bits of a limb, and rows of one product: 2 * LIMB + log2(BLOCK) are 53 bits at most.
LIMB, BLOCK = 20, 4096
#: Blocks whose products are summed as 64-bit integers, for all limb pairs of one power together.
FLUSH = 64


def to_integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 of each entry. An entry beyond 2^52 / 1024 has no exact integer here and is an error."""
    scaled = np.floor(SCALE * vectors.astype(np.float64))
    if scaled.size and np.abs(scaled).max() > 2.0**52:
        raise ValueError("an embedding holds an entry beyond 2^42, too large to be an exact integer when scaled")
    return scaled.astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: as 64-bit integers where they hold it, else as Python's."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=np.int64)
    y = x - whole
    if n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 62:
        return n * y - rest
    return n * y.astype(object) - rest.astype(object)


def limbs(d: np.ndarray, count: int) -> list[np.ndarray]:
    """Matrices of float64 whose sum, each times 2^(LIMB * its place), is d; entries are smaller than 2^LIMB."""
    sign, left, out = np.where(d < 0, -1, 1), np.abs(d), []
    for _ in range(count):
        out.append(((left & ((1 << LIMB) - 1)) * sign).astype(np.float64))
        left = left >> LIMB
    return out


def powers(d: np.ndarray, count: int) -> np.ndarray:
    """The products of d's columns with each other by power of 2^LIMB: exact 64-bit integers of at most BLOCK rows."""
    parts, dim = limbs(d, count), d.shape[1]
    out = np.zeros((2 * count - 1, dim, dim), dtype=np.int64)
    for a in range(count):
        for b in range(a, count):
            product = (parts[a].T @ parts[b]).astype(np.int64)  # float64 holds every partial sum exactly
            out[a + b] += product if a == b else product + product.T
    return out


def squares(d: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if len(d) and d.dtype == np.int64 and int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 1 << 63:
        return np.einsum("ij,ij->i", d, d).tolist()
    return [sum(int(v) ** 2 for v in row) for row in d]


class Fit:
    """Counts, sums and components of the vectors of one length."""

    def __init__(self, n: int, sums: list[int], most: int) -> None:
        self.n, self.sums = n, sums
        #: A bound of every |n * x - S|, and the limbs that it needs.
        self.count = max(1, -(-int(most).bit_length() // LIMB))

    def decompose(self, products: list[list[int]], components: int) -> None:
        """Whitening rows and explained shares by the big-integer products of n * x - S.

        Components whose eigenvalue can't be told from zero in double precision don't exist: there's no scale for them.
        """
        cube = self.n**3
        v = np.array([[p / cube for p in row] for row in products])  # integers divided with one rounding
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        least = len(e) * np.finfo(float).eps * max(e[0], 0.0) if len(e) else 0.0
        kept = [i for i in range(min(components, len(e))) if e[i] > least]
        self.rows = u[:, kept] / np.sqrt(e[kept]) if kept else np.zeros((len(e), 0))
        trace = sum(products[i][i] for i in range(len(products))) / cube
        self.explained = [float(e[i] / trace) for i in kept]


def _matrix(embeddings: pd.Series) -> np.ndarray:
    return to_integers(np.stack(embeddings.to_list()).astype(np.float64))


def _by_length(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    for dim, part in pdf.groupby("dim"):
        yield int(dim), part


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each length and dimension of a task's vectors: count, sum, least and greatest integer."""
    found: dict[int, list] = {}
    for pdf in batches:
        for dim, part in _by_length(pdf):
            x = _matrix(part["vec"])
            # High and low halves are summed apart, since 64 bits may not hold the sum itself.
            s = [(int(h) << 32) + int(w) for h, w in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
            low, high = x.min(axis=0).tolist(), x.max(axis=0).tolist()
            if dim not in found:
                found[dim] = [len(x), s, low, high]
            else:
                was = found[dim]
                found[dim] = [was[0] + len(x), [a + b for a, b in zip(was[1], s, strict=True)], list(map(min, was[2], low)), list(map(max, was[3], high))]
    rows = [(dim, j, n, Decimal(s[j]), low[j], high[j]) for dim, (n, s, low, high) in found.items() for j in range(dim)]
    yield pd.DataFrame(rows, columns=["dim", "j", "n", "s", "low", "high"])


SUMS = "dim int, j int, n long, s decimal(38,0), low long, high long"
PRODUCTS = "dim int, power int, i int, products array<long>"


def _products(batches: Iterator[pd.DataFrame], fits: dict[int, Fit]) -> Iterator[pd.DataFrame]:
    """Rows of the limb products of a task's vectors, by length and power."""
    held: dict[int, tuple[np.ndarray, int]] = {}

    def rows(dim: int) -> pd.DataFrame:
        m, _ = held.pop(dim)
        return pd.DataFrame([(dim, p, i, m[p, i]) for p in range(len(m)) for i in range(dim)], columns=["dim", "power", "i", "products"])

    for pdf in batches:
        for dim, part in _by_length(pdf):
            fit = fits[dim]
            for at in range(0, len(part), BLOCK):
                m = powers(centred(_matrix(part["vec"].iloc[at : at + BLOCK]), fit.n, fit.sums), fit.count)
                was, k = held.get(dim, (np.zeros_like(m), 0))
                held[dim] = (was + m, k + 1)
                if k + 1 == FLUSH:
                    yield rows(dim)
    for dim in list(held):
        yield rows(dim)


def _results(batches: Iterator[pd.DataFrame], fits: dict[int, Fit]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for dim, part in _by_length(pdf):
            fit = fits[dim]
            for at in range(0, len(part), BLOCK):
                some = part.iloc[at : at + BLOCK]
                d = centred(_matrix(some["vec"]), fit.n, fit.sums)
                white = (d / fit.n).astype(np.float64) @ fit.rows
                yield pd.DataFrame({"vec_id": some["vec_id"].to_list(), "dim": dim, "n": fit.n, "deviation": list(map(Decimal, squares(d))), "white": list(white)})


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, dict[int, Fit]]:
    """(vec_id as text, dim, n, deviation, white) of every row of vectors (vec_id and embedding), and the fits by length.

    white holds a number for each component, those of the largest eigenvalues first. Vectors that are null, empty or
    hold a null or non-finite entry take no part; rows that repeat count as often as they occur. Vectors of one length
    are fitted together and apart from others. A fit without variance has no component, and one of lower rank has
    fewer. A null id stays null.
    """
    x = F.col("embedding")
    number = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), F.size(x).alias("dim"), x.alias("vec")).where(number)
    spark = vectors.sparkSession
    totals = rows.mapInPandas(_sums, SUMS).groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    # A row for each length and dimension.
    by: dict[int, list] = {}
    for r in totals.orderBy("dim", "j").collect():
        by.setdefault(r["dim"], []).append(r)
    fits = {
        dim: Fit(js[0]["n"], [int(r["s"]) for r in js], max(max(abs(r["n"] * r["low"] - int(r["s"])), abs(r["n"] * r["high"] - int(r["s"]))) for r in js))
        for dim, js in by.items()
    }
    shared = spark.sparkContext.broadcast(fits)
    parts = rows.mapInPandas(lambda it: _products(it, shared.value), PRODUCTS)
    parts = parts.select("dim", "power", "i", F.posexplode("products").alias("j", "p"))
    merged = parts.groupBy("dim", "power", "i", "j").agg(F.sum(F.col("p").cast("decimal(20,0)")).alias("p"))
    merged = merged.groupBy("dim", "power", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "p"))), lambda s: s["p"]).alias("p"))
    # A row for each length, power and dimension: the products of the dimensions with each other.
    products = {dim: [[0] * dim for _ in range(dim)] for dim in fits}
    for r in merged.collect():
        into = products[r["dim"]][r["i"]]
        for j, p in enumerate(r["p"]):
            into[j] += int(p) << (LIMB * r["power"])
    for dim, fit in fits.items():
        fit.decompose(products[dim], components)
    decomposed = spark.sparkContext.broadcast(fits)
    white = rows.mapInPandas(lambda it: _results(it, decomposed.value), "vec_id string, dim int, n long, deviation decimal(38,0), white array<double>")
    return shared_table(white, "white"), fits


def identity_errors(white: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """By length, the largest absolute entry of the whitened rows' covariance minus the identity."""
    out = {}
    for dim, fit in fits.items():
        k = len(fit.explained)
        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        if pairs:
            w = F.col("white")
            some = white.where(F.col("dim") == dim)
            got = some.agg(*[F.covar_pop(w[a], w[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
            out[dim] = max(abs(got[i] - (a == b)) for i, (a, b) in enumerate(pairs))
    return out


def components_of(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation (exact, a long; a fit whose sums
    of squares exceed it is an error), whitened, explained and identity_error."""
    white, fits = whiten(vectors, components)
    errors = identity_errors(white, fits)
    known = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("explained", T.ArrayType(T.DoubleType())), T.StructField("identity_error", T.DoubleType())])
    # A row for each length of vectors.
    table = white.sparkSession.createDataFrame([(dim, fit.explained, errors.get(dim)) for dim, fit in fits.items()], known)
    rows = white.join(F.broadcast(table), "dim").select("*", F.posexplode("white").alias("at", "whitened"))
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"),
        "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error",
    )
