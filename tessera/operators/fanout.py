"""Table functions for SQL: one row of scores in, many typed rows out, called laterally.

SELECT vec_id, d.* FROM pictures, LATERAL detections(raw, classes => 2, boxes => 8) AS d

What columns come out is decided when the query is analysed, from the options that are given as constants. Scoring stays
a column of whole batches; the functions hold no model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from tessera.functions import kernels
from tessera.functions.runs import runs_of


def _constant(name: str, options: dict[str, AnalyzeArgument], default: object) -> object:
    """An option's value; it has to be known before there is any row."""
    if name not in options:
        return default
    if not options[name].isConstantExpression or options[name].value is None:
        raise ValueError(f"{name} must be a constant")
    return options[name].value


def _fields(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields])


class Detections:
    """Boxes of a (4 + classes, boxes) tensor, best first: place, x, y, width, height, class_id and score, a label where
    labels (separated by commas) are given, and no more than ``most``."""

    @staticmethod
    def analyze(raw: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
        unknown = set(options) - {"classes", "boxes", "score", "iou", "most", "labels"}
        if unknown:
            raise ValueError(f"no such option: {', '.join(sorted(unknown))}")
        if not isinstance(raw.dataType, T.ArrayType):
            raise ValueError("raw must be an array of numbers")
        if min(int(_constant("classes", options, 0)), int(_constant("boxes", options, 0))) < 1:
            raise ValueError("classes and boxes must be given")
        number = [(c, T.DoubleType()) for c in ("x", "y", "width", "height")]
        label = [("label", T.StringType())] if _constant("labels", options, "") else []
        return AnalyzeResult(_fields(("place", T.IntegerType()), *number, ("class_id", T.IntegerType()), *label, ("score", T.DoubleType())))

    def eval(self, raw: list | None, classes: int, boxes: int, score: float = 0.5, iou: float = 0.45, most: int | None = None, labels: str = "") -> Iterator[tuple]:
        names = labels.split(",") if labels else []
        if raw is None:
            return
        found = kernels.detect(np.array(raw, dtype=np.float64), classes, boxes, float(score), float(iou), most)
        for place, (x, y, w, h, c, p) in enumerate(found.tolist()):
            label = [names[int(c)] if int(c) < len(names) else str(int(c))] if labels else []
            yield (place, x, y, w, h, int(c), *label, p)


class Regions:
    """Classes of a (classes, height, width) tensor's pixels by size: class_id, pixels and percent, a label where labels
    are given; with ``runs`` set a row for each run, place and length, in their place."""

    @staticmethod
    def analyze(raw: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
        unknown = set(options) - {"classes", "height", "width", "labels", "runs"}
        if unknown:
            raise ValueError(f"no such option: {', '.join(sorted(unknown))}")
        if min(int(_constant(k, options, 0)) for k in ("classes", "height", "width")) < 1:
            raise ValueError("classes, height and width must be given")
        label = [("label", T.StringType())] if _constant("labels", options, "") else []
        if _constant("runs", options, False):
            return AnalyzeResult(_fields(("place", T.IntegerType()), ("length", T.IntegerType()), ("class_id", T.IntegerType()), *label))
        return AnalyzeResult(_fields(("class_id", T.IntegerType()), *label, ("pixels", T.IntegerType()), ("percent", T.DoubleType())))

    def eval(self, raw: list | None, classes: int, height: int, width: int, labels: str = "", runs: bool = False) -> Iterator[tuple]:
        names = labels.split(",") if labels else []
        if raw is None:
            return
        label = lambda c: [names[c] if c < len(names) else str(c)] if labels else []
        mask = kernels.class_map(np.array(raw, dtype=np.float64), classes, height, width)
        kinds, lengths = runs_of(mask)
        if runs:
            for place, (c, n) in enumerate(zip(kinds.tolist(), lengths.tolist(), strict=True)):
                yield (place, n, c, *label(c))
            return
        for c in sorted(set(kinds.tolist())):
            n = int(lengths[kinds == c].sum())
            yield (c, *label(c), n, 100 * n / (height * width))


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL as detections() and regions()."""
    spark.udtf.register("detections", udtf(Detections))
    spark.udtf.register("regions", udtf(Regions))
