import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import PRESETS, Preprocess
from tessera.functions import boxes as B
from tessera.functions import diffusion, kernels
from tessera.functions import vectors as V


def lit(xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("edge, want", [("reference", [0.75, 0.25, 0.75, 1.0]), ("replicate", [0, 0.25, 0.75, 1])])
def test_bilinear_in_both_forms(spark, edge, want):
    assert kernels.bilinear(np.array([[0, 1]]), 1, 4, edge)[0].tolist() == pytest.approx(want)
    assert one(spark, V.resize_bilinear(lit([0, 1]), 1, 2, 1, 4, edge)) == pytest.approx(want)


def test_bilinear_square():
    want = [2.25, 1.75, 2.25, 2.5, 1.25, 0.75, 1.25, 1.5, 2.25, 1.75, 2.25, 2.5, 2.75, 2.25, 2.75, 3.0]
    assert kernels.bilinear(np.array([[0, 1], [2, 3]]), 4, 4).ravel().tolist() == pytest.approx(want)


def test_preprocess_solid_colour():
    rgb = np.tile(np.array([255, 0, 0], np.uint8), (4, 4, 1))
    out = kernels.preprocess(rgb, Preprocess((4, 4)))
    assert out.shape == (3, 4, 4)
    assert [float(p[0, 0]) for p in out] == pytest.approx([2.2489, -2.0357, -1.8044], abs=1e-3)
    assert all(np.ptp(p) == 0 for p in out)
    batch = kernels.preprocess_batch([rgb, rgb[:, :, ::-1]], Preprocess((4, 4)))
    assert np.array_equal(batch[0], out)
    with pytest.raises(ValueError):
        kernels.preprocess_batch([], Preprocess((4, 4)))


def test_presets():
    assert all(min(c.size) > 0 and min(c.std) > 0 and len(c.mean) == 3 for c in PRESETS.values())
    assert not PRESETS["yolov8"].normalize


CASES = {
    "apart": ([[50, 200, 400], [50, 200, 400], [20] * 3, [20] * 3, [0.9, 0.8, 0.7], [0.1] * 3], [(0, 0.9), (0, 0.8), (0, 0.7)]),
    "overlap": ([[100, 102], [100, 102], [50, 50], [50, 50], [0.9, 0.7], [0, 0]], [(0, 0.9)]),
    "threshold": ([[100, 300], [100, 300], [20, 20], [20, 20], [0.9, 0.3], [0, 0]], [(0, 0.9)]),
    "per_class": ([[100, 100], [100, 100], [50, 50], [50, 50], [0.9, 0.1], [0.1, 0.9]], [(0, 0.9), (1, 0.9)]),
    "none": ([[100, 300], [100, 300], [20, 20], [20, 20], [0.1, 0.2], [0, 0]], []),
    "at_threshold": ([[100], [100], [20], [20], [0.5], [0.1]], []),
    "nan": ([[100], [100], [20], [20], [math.nan], [0.8]], [(1, 0.8)]),
    "no_area": ([[5, 5], [5, 5], [0, 0], [0, 0], [0.9, 0.8], [0, 0]], [(0, 0.9), (0, 0.8)]),
}


@pytest.mark.parametrize("name", CASES)
def test_detection_in_both_forms(spark, name):
    rows, want = CASES[name]
    raw, n = [x for r in rows for x in r], len(rows[0])
    got = one(spark, B.suppress(B.decode(lit(raw), 2, n, 0.5), 0.45))
    assert [(b["class_id"], b["score"]) for b in got] == want
    assert [(int(r[4]), r[5]) for r in kernels.detect(np.array(raw), 2, n)] == want


def test_transpose(spark):
    got = one(spark, B.transpose(lit(range(1, 19)), 6, 3))
    assert got == [1, 4, 7, 10, 13, 16, 2, 5, 8, 11, 14, 17, 3, 6, 9, 12, 15, 18]


def test_segmentation_in_both_forms(spark):
    raw = [5, 1, 1, 5, 1, 5, 5, 1]
    ids = V.pixel_argmax(lit(raw), 2, 2, 2)
    assert one(spark, ids) == [0, 1, 1, 0] == kernels.class_map(np.array(raw), 2, 2, 2).ravel().tolist()
    want = np.kron([[0, 1], [1, 0]], np.ones((2, 2))).ravel().tolist()
    assert one(spark, V.resize_nearest(ids, 2, 2, 4, 4)) == want
    assert kernels.nearest(np.array([[0, 1], [1, 0]]), 4, 4).ravel().tolist() == want
    with pytest.raises(IndexError):
        V.pixel_at(ids, 2, 0, 2, 2)


def test_depth_in_both_forms(spark):
    got = one(spark, V.depth_map(lit([99, 10, 20, 30, 40]), 2, 2))
    assert got["values"] == pytest.approx([0, 1 / 3, 2 / 3, 1]) and (got["min_depth"], got["max_depth"]) == (10, 40)
    d, low, high = kernels.depth(np.array([99, 10, 20, 30, 40]), 2, 2)
    assert d.ravel().tolist() == pytest.approx([0, 1 / 3, 2 / 3, 1]) and (low, high) == (10, 40)
    assert one(spark, V.depth_map(lit([7] * 4), 2, 2))["values"] == [0] * 4


def test_zero_shot_scores(spark):
    p = one(spark, V.clip_scores(lit([0.6, 0.8, 0]), [[1, 0, 0], [0, 1, 0], [0, 0, 1]]))
    assert sum(p) == pytest.approx(1) and p[1] > 0.99 and p[0] == pytest.approx(2.06e-9, rel=0.01)
    assert one(spark, V.cosine(lit([0, 0]), lit([1, 0]))) == 0


def test_ranked_ties_and_labels(spark):
    got = one(spark, V.ranked(lit([0.2, 0.4, 0.4]), F.array(F.lit("a"), F.lit("b")), 2))
    assert [(g["label"], g["class_id"]) for g in got] == [("b", 1), ("2", 2)]
    assert one(spark, V.argmax(lit([math.nan, 1, 3, 3]))) == 2
    assert one(spark, V.softmax(lit([1000, 1000]))) == [0.5, 0.5]


def test_pooling_and_norm(spark):
    assert one(spark, V.mean_pool(lit([1, 2, 3, 4]), 2)) == [2, 3]
    assert one(spark, V.l2_normalize(lit([3, 4]))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.l2_normalize(lit([0, 0]))) == [0, 0]


def test_schedule(spark):
    for steps, first in ((1, [14.6147]), (4, [14.6147, 4.0817, 1.6129]), (20, [14.6147, 10.9042, 8.3028])):
        t, s = diffusion.sigmas(steps)
        assert s[: len(first)] == pytest.approx(first, abs=1e-3) and s[-1] == 0 and len(t) == steps
        assert all(a > b for a, b in zip(s, s[1:], strict=False))
        rows = diffusion.schedule(spark, steps).orderBy("step").collect()
        assert [r["t"] for r in rows] == t and [r["sigma"] for r in rows] == pytest.approx(s[:-1], rel=1e-6)
    with pytest.raises(ValueError):
        diffusion.sigmas(0)


def test_diffusion_columns(spark):
    assert one(spark, V.guided(lit([1, 2, 3, 4]), 2.0)) == [5, 6]
    assert one(spark, V.euler_step(lit([1]), lit([2]), 2.0, 1.5)) == [0]
    assert one(spark, V.scale_input(lit([3]), 2.0)) == pytest.approx([3 / math.sqrt(5)])
    assert one(spark, V.eos_position(F.array(*map(F.lit, [1, 1, 0])))) == 1
