"""Column functions over score vectors: softmax, top-k, pooling, normalisation, similarity, masks, depth.

All are built from Spark's own array functions and stay in the JVM. NaN never wins a comparison: it counts as minus
infinity wherever a largest element is sought.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = float("-inf")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body and its lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: str | Column) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def no_nan(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(F.isnan(x), F.lit(NONE)).otherwise(x))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def softmax(v: str | Column) -> Column:
    """Probabilities of logits, shifted by their maximum."""
    shifted = lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(let(doubles(v), shifted), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def label_of(labels: Column | None, i: Column) -> Column:
    """The label of class i, or the number itself where there is none."""
    number = i.cast("string")
    return number if labels is None else F.coalesce(F.get(labels, i), number)


def ranked(p: Column, labels: Column | None = None, k: int | None = None) -> Column:
    """array of (label, probability, class_id), most probable first, ties to the lower class; k first if given."""
    pairs = F.transform(p, lambda x, i: F.struct((-x).alias("n"), i.alias("i"), x.alias("p")))
    order = F.array_sort(pairs)
    order = order if k is None else F.slice(order, 1, k)
    return F.transform(
        order, lambda s: F.struct(label_of(labels, s["i"]).alias("label"), s["p"].alias("probability"), s["i"].alias("class_id"))
    )


def argmax(v: str | Column) -> Column:
    """Index of the largest element, the first of equals; NaN only if it is all there is."""
    return let(no_nan(_col(v)), lambda clean: (F.array_position(clean, F.array_max(clean)) - 1).cast("int"))


def top_label(predictions: Column) -> Column:
    """The best label, empty without predictions."""
    return F.coalesce(F.get(predictions, F.lit(0))["label"], F.lit(""))


def cls_pool(v: str | Column, dim: int | Column) -> Column:
    return F.slice(_col(v), F.lit(1), F.lit(dim))


def mean_pool(v: str | Column, dim: int | Column) -> Column:
    """Mean over the rows of a (length / dim, dim) matrix, the first row included."""
    dim = F.lit(dim)

    def means(v: Column) -> Column:
        rows = F.floor(F.size(v) / dim).cast("int")
        parts = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.slice(v, r * dim + 1, dim))
        sums = F.aggregate(parts, F.array_repeat(F.lit(0.0), dim), lambda a, p: F.zip_with(a, p, lambda x, y: x + y))
        return F.transform(sums, lambda x: x / rows)

    return let(doubles(v), lambda v: F.when(F.size(v) >= dim, means(v)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: str | Column) -> Column:
    """The vector over its length; a zero vector stays."""
    over = lambda v, n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)
    return let(doubles(v), lambda v: let(norm(v), lambda n: over(v, n)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where either vector is zero."""
    return let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))


def clip_scores(image: Column, texts: list[list[float]], scale: float = 100.0) -> Column:
    """Softmax of scaled cosines of an image to candidate texts, which are few and given as literals."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in t]) for t in texts])
    return softmax(let(doubles(image), lambda v: F.transform(rows, lambda t: cosine(v, t) * scale)))


def pixel_argmax(v: str | Column, classes: int, height: int, width: int) -> Column:
    """Class of every pixel of a (classes, height, width) tensor, the lowest class of equals."""
    n = height * width
    by_pixel = lambda v: F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda p: argmax(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.get(v, c * n + p))),
    )
    return let(_col(v), by_pixel)


def resize_nearest(v: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    """Nearest neighbour by whole-number scaling."""
    source = lambda p: (F.floor(F.floor(p / to_width) * height / to_height) * width + F.floor((p % to_width) * width / to_width)).cast("int")
    return let(v, lambda v: F.transform(F.sequence(F.lit(0), F.lit(to_height * to_width - 1)), lambda p: F.get(v, source(p))))


def resize_bilinear(v: Column, height: int, width: int, to_height: int, to_width: int, edge: str = "reference") -> Column:
    """Bilinear with half-pixel centres; see config.Preprocess for edge."""

    def axis(i: Column, size: int, to: int) -> tuple[Column, Column, Column]:
        at = (i + 0.5) * (size / to) - 0.5
        at = F.greatest(at, F.lit(0.0)) if edge == "replicate" else at
        low = F.greatest(F.floor(at), F.lit(0)).cast("int")
        return low, F.least(low + 1, F.lit(size - 1)), at - F.floor(at)

    def pixel(v: Column, p: Column) -> Column:
        y0, y1, fy = axis(F.floor(p / to_width), height, to_height)
        x0, x1, fx = axis(p % to_width, width, to_width)
        at = lambda y, x: F.get(v, y * width + x)
        return (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy

    return let(doubles(v), lambda v: F.transform(F.sequence(F.lit(0), F.lit(to_height * to_width - 1)), lambda p: pixel(v, p)))


def pixel_at(v: Column, x: int, y: int, width: int, height: int) -> Column:
    """Value at (x, y); an error outside of the picture."""
    if not (0 <= x < width and 0 <= y < height):
        raise IndexError(f"({x}, {y}) is outside of {width} x {height}")
    return F.element_at(v, y * width + x + 1)


def depth_map(raw: str | Column, height: int, width: int) -> Column:
    """(values in 0..1, width, height, min_depth, max_depth) of the last height x width numbers of raw."""
    n = height * width

    def scaled(v: Column, low: Column, high: Column) -> Column:
        spread = F.when(high - low < 1e-8, F.lit(1.0)).otherwise(high - low)
        return F.struct(
            let(spread, lambda s: F.transform(v, lambda x: (x - low) / s)).alias("values"),
            F.lit(width).alias("width"), F.lit(height).alias("height"), low.alias("min_depth"), high.alias("max_depth"),
        )

    last = F.slice(doubles(raw), F.size(_col(raw)) - n + 1, F.lit(n))
    return let(last, lambda v: let(F.struct(F.array_min(v).alias("a"), F.array_max(v).alias("b")), lambda x: scaled(v, x["a"], x["b"])))


def binarize(v: Column, threshold: float = 0.0) -> Column:
    """1 above the threshold, else 0."""
    return F.transform(v, lambda x: F.when(x > threshold, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"))


def best_mask(masks: Column, iou: Column) -> Column:
    """The mask of the highest predicted IoU, the first of equals."""
    return F.get(masks, argmax(iou))


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.when(x != 0, 1).otherwise(0))


def eos_position(mask: Column) -> Column:
    """The last position whose mask is not 0; 0 without one."""
    at = F.transform(mask, lambda x, i: F.when(x != 0, i).otherwise(0))
    return F.coalesce(F.array_max(at), F.lit(0))


def euler_step(sample: Column, noise: Column, sigma: float, after: float) -> Column:
    return F.zip_with(sample, noise, lambda x, e: x + (after - sigma) * e)


def scale_input(sample: Column, sigma: float) -> Column:
    return F.transform(sample, lambda x: x / F.sqrt(F.lit(sigma * sigma + 1)))


def guided(noise: Column, guidance: float) -> Column:
    """The unconditional half of a doubled batch, moved towards the conditional one."""
    halves = lambda v, n: F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, n + 1, n), lambda u, c: u + guidance * (c - u))
    return let(noise, lambda v: halves(v, F.floor(F.size(v) / 2).cast("int")))
