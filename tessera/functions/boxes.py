"""Column functions for detection: decoding, overlap, non-maximum suppression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vectors import label_of, let, no_nan


def transpose(v: Column, rows: int, cols: int) -> Column:
    """A row-major (rows, cols) matrix as (cols, rows)."""
    source = lambda p: ((p % rows) * cols + F.floor(p / rows)).cast("int")
    return let(v, lambda v: F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda p: F.get(v, source(p))))


def decode(raw: Column, classes: int, boxes: int, threshold: float, labels: Column | None = None) -> Column:
    """Boxes of a (4 + classes, boxes) tensor whose best class score is above the threshold.

    Centres become corners, in model-input pixels. The first best class wins; ``box`` is the position in the tensor.
    """

    def one(raw: Column, b: Column) -> Column:
        at = lambda r: F.get(raw, r * boxes + b)
        scores = no_nan(F.transform(F.sequence(F.lit(4), F.lit(classes + 3)), at))
        best = lambda s: let(F.array_max(s), lambda m: F.struct(m.alias("score"), (F.array_position(s, m) - 1).cast("int").alias("kind")))
        return let(let(scores, best), lambda k: F.struct(
            (at(F.lit(0)) - at(F.lit(2)) / 2).alias("x"), (at(F.lit(1)) - at(F.lit(3)) / 2).alias("y"),
            at(F.lit(2)).alias("width"), at(F.lit(3)).alias("height"),
            label_of(labels, k["kind"]).alias("label"), k["kind"].alias("class_id"), k["score"].alias("score"), b.alias("box"),
        ))

    every = lambda raw: F.transform(F.sequence(F.lit(0), F.lit(boxes - 1)), lambda b: one(raw, b))
    return F.filter(let(raw, every), lambda s: s["score"] > threshold)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes, 0 where the union is empty."""
    wide = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    inside = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    union = a["width"] * a["height"] + b["width"] * b["height"] - inside
    return F.when(union > 0, inside / union).otherwise(F.lit(0.0))


def by_score(boxes: Column) -> Column:
    """Highest score first, then the lower class and the lower position."""
    fields = ("x", "y", "width", "height", "label", "class_id", "score", "box")
    keyed = F.transform(boxes, lambda b: F.struct((-b["score"]).alias("n"), b["class_id"].alias("c"), b["box"].alias("b"), b.alias("v")))
    return F.transform(F.array_sort(keyed), lambda k: F.struct(*[k["v"][f].alias(f) for f in fields]))


def suppress(boxes: Column, threshold: float = 0.45, most: int | None = None) -> Column:
    """Greedy suppression within a class: a box goes if it overlaps a better kept one by the threshold or more."""
    rival = lambda acc, b: F.exists(acc, lambda k: (k["class_id"] == b["class_id"]) & (iou(k, b) >= threshold))
    kept = let(by_score(boxes), lambda order: F.aggregate(
        order, F.slice(order, 1, 0), lambda acc, b: F.when(rival(acc, b), acc).otherwise(F.concat(acc, F.array(b))),
    ))
    return kept if most is None else F.slice(kept, 1, most)


def flatten(boxes: Column) -> Column:
    """Six numbers a box: x, y, width, height, class, score."""
    fields = ("x", "y", "width", "height", "class_id", "score")
    return F.flatten(F.transform(boxes, lambda b: F.array(*[b[f].cast("float") for f in fields])))
