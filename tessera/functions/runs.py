"""Masks as runs: (class, length) of equal pixels, row after row, in place of a number for each pixel.

A mask of 512 x 512 has a quarter of a million pixels and some thousand runs. Histograms, counts and labels are column
functions on the runs of one row, so that nothing is exploded or shuffled; only resizing, which makes new runs, is an
Arrow batch of numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vectors import let

RUNS = "array<struct<class_id:int,length:int>>"


def encode(ids: Column) -> Column:
    """The runs of a mask's class ids; null for a null mask, none for an empty one."""

    def runs(v: Column) -> Column:
        every = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1)).otherwise(F.array().cast("array<int>"))
        begins = F.filter(every, lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))
        ends = lambda s: F.concat(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.size(v)))
        return let(begins, lambda s: F.zip_with(s, ends(s), lambda a, b: F.struct(F.get(v, a).cast("int").alias("class_id"), (b - a).cast("int").alias("length"))))

    return let(ids, lambda v: F.when(v.isNotNull(), F.filter(runs(v), lambda r: r["class_id"].isNotNull())))


def decode(runs: Column) -> Column:
    """The class id of every pixel."""
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["class_id"], r["length"])))


def pixels(runs: Column) -> Column:
    """How many pixels there are."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["length"])


def histogram(runs: Column) -> Column:
    """array of (class_id, pixels, percent) of the classes that occur, lowest first."""

    def of(v: Column, classes: Column, total: Column) -> Column:
        count = lambda c: F.aggregate(v, F.lit(0).cast("long"), lambda n, r: n + F.when(r["class_id"] == c, r["length"]).otherwise(0))
        return F.transform(classes, lambda c: let(count(c), lambda n: F.struct(c.alias("class_id"), n.alias("pixels"), (100 * n / total).alias("percent"))))

    present = lambda v: F.array_sort(F.array_distinct(F.transform(v, lambda r: r["class_id"])))
    return let(runs, lambda v: let(present(v), lambda c: let(pixels(v), lambda n: of(v, c, n))))


def foreground(runs: Column, background: int = 0) -> Column:
    """How many pixels are not of the background."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + F.when(r["class_id"] != background, r["length"]).otherwise(0))


def class_at(runs: Column, x: int, y: int, width: int, height: int) -> Column:
    """The class at (x, y); an error outside of the picture."""
    if not (0 <= x < width and 0 <= y < height):
        raise IndexError(f"({x}, {y}) is outside of {width} x {height}")
    start = F.struct(F.lit(y * width + x).cast("long").alias("left"), F.lit(None).cast("int").alias("found"))
    step = lambda s, r: F.struct(
        (s["left"] - r["length"]).alias("left"), F.when((s["left"] >= 0) & (s["left"] < r["length"]), r["class_id"]).otherwise(s["found"]).alias("found")
    )
    return F.aggregate(runs, start, step, lambda s: s["found"])


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes, lengths) of a mask, row after row."""
    v = np.asarray(mask).ravel()
    begins = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.array([], dtype=np.int64)
    return v[begins], np.diff(np.concatenate((begins, [len(v)])))


def resized(classes: np.ndarray, lengths: np.ndarray, height: int, width: int, to_height: int, to_width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest resize by whole-number scaling, from runs to runs: no pixel of either mask is ever made.

    Runs are cut at the ends of lines; of a line's part from a to b the new line has what lies between both, scaled up.
    A line of the new mask is its line of the old one.
    """
    ends = np.cumsum(lengths)
    if not len(ends) or ends[-1] != height * width:
        raise ValueError("the runs don't fill the mask")
    cuts = np.union1d(np.concatenate(([0], ends)), np.arange(0, height * width + 1, width))
    a, b = cuts[:-1], cuts[1:]
    kind, line = classes[np.searchsorted(ends, a, "right")], a // width
    scaled = lambda x: -(-x * to_width // width)  # noqa: E731  the first new column whose old one is x or later
    n = scaled(b - line * width) - scaled(a - line * width)
    first = np.searchsorted(line, np.arange(height + 1))
    source = np.arange(to_height) * height // to_height
    parts = first[source + 1] - first[source]
    at = np.repeat(first[source] - np.concatenate(([0], np.cumsum(parts)[:-1])), parts) + np.arange(parts.sum())
    kind, n = kind[at][n[at] > 0], n[at][n[at] > 0]
    new = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    return kind[new], np.add.reduceat(n, new)


def resize_nearest(runs: Column, height: Column, width: Column, to_height: Column, to_width: Column) -> Column:
    """The runs of the mask in another size; null where the old runs don't fill the old size."""

    def udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for masks, *sizes in batches:
            out = []
            for mask, *size in zip(masks, *sizes, strict=True):
                if mask is None or any(pd.isna(s) for s in size) or sum(r["length"] for r in mask) != size[0] * size[1] or min(size) < 1:
                    out.append(None)
                    continue
                classes, lengths = (np.array([r[k] for r in mask], dtype=np.int64) for k in ("class_id", "length"))
                found = resized(classes, lengths, *map(int, size))
                out.append([{"class_id": int(c), "length": int(n)} for c, n in zip(*found, strict=True)])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(udf, RUNS)(runs, height, width, to_height, to_width)
