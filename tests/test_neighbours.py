"""Neighbours without all pairs, and tables of prompts, each against the plain form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbours, tasks, toy_onnx
from tests.test_tasks import TINY, picture


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    p = np.round(x @ x.T, neighbours.DIGITS) + 0.0
    out = []
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-p[a, b], ids[b]))
        out += [(int(ids[a]), r + 1, int(ids[b]), round(float(p[a, b]), 7)) for r, b in enumerate(order[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 40, 5000])
def test_neighbours_equal_all_pairs(spark, block):
    """Clusters, repeats, opposite and zero vectors, in blocks of every size."""
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 8)) * 5
    x = np.concatenate([centres[rng.integers(0, 6, 150)] + rng.normal(size=(150, 8)) * 0.3, rng.normal(size=(30, 8)), np.zeros((2, 8))])
    x = np.concatenate([x, x[:10], -x[:5]])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    d = spark.createDataFrame([*rows, (None, x[0].tolist()), (1000, None), (1001, [])], "vec_id long, e array<double>").repartition(4)
    got = neighbours.nearest(d, 3, block=block)
    assert sorted((r["a"], r["rank"], r["b"], round(r["cosine"], 7)) for r in got.collect()) == brute(rows, 3)


def test_few_or_no_vectors(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, e array<double>")
    assert sorted(tuple(r) for r in neighbours.nearest(d).collect()) == [(1, 1, 2, 0.0), (2, 1, 1, 0.0)]
    assert neighbours.nearest(d.limit(1)).count() == 0 and neighbours.nearest(d.limit(0)).count() == 0


def test_blocks_far_from_each_other_are_not_visited(spark, monkeypatch):
    """Tight clusters in different directions: a block meets itself in its own cell, and no vector is sent elsewhere."""
    x = np.concatenate([np.eye(4)[c] + np.random.default_rng(c).normal(size=(60, 4)) * 0.01 for c in range(4)])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, e array<double>")
    got = neighbours.nearest(d, 3, block=20)
    assert sorted((r["a"], r["rank"], r["b"], round(r["cosine"], 7)) for r in got.collect()) == brute(list(enumerate(x.tolist())), 3)
    facts = neighbours.blocks_of(d.selectExpr("vec_id as id", "e as v"), 3, 20)
    n, visits = facts.count(), neighbours.visits_of(facts).count()
    assert n >= 12 and n <= visits < n * n / 2


@pytest.mark.parametrize("many", [0, 1 << 22])
def test_close_products_and_copies(spark, monkeypatch, many):
    """Products that single precision can't tell apart, and more copies than neighbours, by either way of a visit."""
    monkeypatch.setattr(neighbours, "MANY", many)
    monkeypatch.setattr(neighbours, "LINES", 16)
    rng = np.random.default_rng(many)
    x = np.concatenate([np.ones((1, 8)) + rng.normal(size=(60, 8)) * 1e-4, np.repeat(rng.normal(size=(2, 8)), 20, axis=0), rng.normal(size=(40, 8))])
    ids = rng.permutation(len(x))
    best = neighbours.Best(ids, x / np.linalg.norm(x, axis=1, keepdims=True), 3)
    for at in np.array_split(np.argsort(ids), 5):
        best.meet(ids[at], best.x[at])
    got = best.rows()
    found = [(a, b, round(c, 7)) for a, b, c in zip(got["a"].tolist(), got["b"].tolist(), got["cosine"].tolist(), strict=True)]
    assert sorted(found) == sorted((a, b, c) for a, _, b, c in brute([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], 3))


def test_visits_write_nothing(spark):
    """blocks meet where they lie, and a task leaves its best of all visits, not of each."""
    x = np.random.default_rng(4).normal(size=(300, 8))
    d = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    blocks = neighbours.blocks_of(d, 3, 20)
    assert neighbours.visits_of(blocks, 20).count() > 150
    assert neighbours.candidates_of(blocks, 3, 20).count() == 900
    plan = neighbours.candidates_of(blocks, 3, 20)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
    n = blocks.agg(F.max("at")).first()[0] + 1
    assert blocks.rdd.getNumPartitions() == n and neighbours.parts_of(spark, n, neighbours.HELD // 4) == (min(n, -(-64 // -(-n // 4))), -(-n // 4))
    assert neighbours.meetings(blocks, n, neighbours.HELD // 4, F.lit(True)).rdd.getNumPartitions() == n * -(-n // 4)  # four are held


def test_all_pairs(spark):
    """each pair once, whatever the number of blocks; null ids, and null, zero and empty vectors."""
    rng = np.random.default_rng(1)
    x = [*rng.normal(size=(60, 8)).tolist(), [0.0] * 8, [], None, [1.0, None, *[2.0] * 6], rng.normal(size=8).tolist()]
    ids = [*rng.permutation(64).tolist(), None]
    d = spark.createDataFrame(list(zip(ids, x, strict=True)), "vec_id long, e array<double>")
    want = {}
    for i, v in zip(ids[:-1], x, strict=False):
        for j, w in zip(ids[:-1], x, strict=False):
            if i < j:
                lost = v is None or w is None or None in v or None in w
                n = 0 if lost or not v or not w else np.linalg.norm(v) * np.linalg.norm(w)
                want[i, j] = None if lost else round(float(np.dot(v, w) / n), 9) if n else 0.0
    for block in (1, 10, 13, 1000):
        got = neighbours.all_pairs(d, block=block).collect()
        assert len(got) == len(want)
        assert {(r["a"], r["b"]): r["cosine"] if r["cosine"] is None else round(r["cosine"], 9) for r in got} == want
    assert neighbours.all_pairs(d.limit(0)).count() == 0


def sam():
    return toy_onnx.model(
        [toy_onnx.node("Gather", ["p", "zero"], ["q"]), toy_onnx.node("Reshape", ["q", "flat"], ["f"]), toy_onnx.node("Gather", ["f", "zero"], ["a"]),
         toy_onnx.node("Sub", ["x", "a"], ["masks"]), toy_onnx.node("Identity", ["c"], ["iou"])],
        {"x": [1, 3, 4, 4], "p": [1, "n", 2]}, {"masks": [1, 3, 4, 4], "iou": [1, 3]},
        {"c": np.array([[0.25, 0.75, 0.75]], np.float32), "zero": np.array(0), "flat": np.array([-1])},
    )


PROMPTS = "id long, prompt_id long, Prompt struct<points:array<struct<x:float,y:float>>,labels:array<float>,previous_mask:array<float>>, extra string"


def test_a_table_of_prompts_equals_prompts_in_rows(spark):
    """Images without prompts, prompts without an image, a picture that can't be seen, null prompts and one hot image."""
    images = spark.createDataFrame([(i, picture(40 * i, 255 - 40 * i, 7 * i)) for i in range(5)] + [(5, None)], "id long, Image " + __import__("tessera.schema", fromlist=["IMAGE"]).IMAGE)
    encodings = tasks.encode_images(images, tasks.Task(toy_onnx.reshaping([3, 4, 4], [3, 4, 4]), TINY))
    prompt = lambda x: ([(float(x), 1.0)], [1.0], None)
    rows = [(0, k, prompt(k % 7 - 3), "x") for k in range(50)] + [(i, 100 + i, prompt(i), "x") for i in (1, 2, 5, 77)] + [(1, 200, None, "x"), (None, 201, prompt(1), "x")]
    prompts = spark.createDataFrame(rows, PROMPTS)
    got = {r["prompt_id"]: r for r in tasks.segment_table(encodings, prompts, sam(), "id", "prompt_id", together=8).collect()}
    want = {r["prompt_id"]: r for r in tasks.segment_prompts(encodings.join(prompts, "id"), sam()).collect()}
    assert got.keys() == {r[1] for r in rows}
    for k, r in got.items():
        if k in want:
            assert (r["id"], r["SegmentAnythingMask"], r["SegmentAnythingMask_IoU"], r["SegmentAnythingMask_Width"]) == (
                want[k]["id"], want[k]["SegmentAnythingMask"], want[k]["SegmentAnythingMask_IoU"], want[k]["SegmentAnythingMask_Width"])
        else:
            assert r["SegmentAnythingMask"] == [] and r["SegmentAnythingMask_IoU"] is None
    assert got[0]["Segments"]["masks"] and got[105]["SegmentAnythingMask"] == []


def test_an_encoding_is_sent_for_many_prompts_once(spark):
    pictures = spark.createDataFrame([(str(i), i) for i in range(10)], "key string, seen int")
    asked = spark.createDataFrame([("0", str(k)) for k in range(1000)] + [("1", "a"), ("2", "b"), ("2", "c"), ("99", "d")], "key string, _prompt_id string")
    dealt, rows = tasks.sent_encodings(pictures, asked, "key", 64)
    assert {r["key"]: r["count"] for r in dealt.groupBy("key").count().collect()} == {"0": 16, "1": 1, "2": 1}
    assert rows.count() == 1004 and rows.groupBy("key", "_salt").count().agg(F.max("count")).first()[0] < 110
    assert rows.join(dealt, ["key", "_salt"]).count() == 1003  # every prompt of a known image meets it
