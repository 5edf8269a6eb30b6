"""Model files of one name, weights in files of their own, and callers' columns beside a task's."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tessera.config import Preprocess
from tessera.operators import catalog, onnx, tasks, toy_onnx
from tests.test_tasks import TINY, table  # noqa: F401


def scaled(factor, bias, files=None):
    """48 numbers, times a factor, plus a bias for the first."""
    first = np.zeros(48, np.float32)
    first[0] = bias
    nodes = [toy_onnx.node("Reshape", ["x", "s"], ["f"]), toy_onnx.node("Mul", ["f", "k"], ["m"]), toy_onnx.node("Add", ["m", "b"], ["y"])]
    weights = {"s": np.array([0, 48]), "k": np.full(48, factor, np.float32), "b": first}
    return toy_onnx.model(nodes, {"x": ["batch", 3, 4, 4]}, {"y": ["batch", 48]}, weights, files=files)


def put(folder, model, **files):
    folder.mkdir(parents=True)
    (folder / "model.onnx").write_bytes(model)
    for name, a in files.items():
        (folder / name).write_bytes(a.astype(np.float32).tobytes())
    return str(folder / "model.onnx")


def test_two_models_of_one_name_in_a_pipeline(spark, tmp_path, table):
    stages = [
        catalog.image_classification(put(tmp_path / name, scaled(1, bias)), size=[4, 4], top_k=1, label=f"label_{name}", probability=f"p_{name}", details=f"d_{name}", labels=["first"])
        for name, bias in (("a", 100), ("b", -100))
    ]
    rows = Pipeline(stages=stages).fit(table).transform(table).where("Image is not null").collect()
    assert {r["label_a"] for r in rows} == {"first"} and "first" not in {r["label_b"] for r in rows}
    assert spark.range(5).selectExpr("sum(id)").first()[0] == 10  # and later jobs go on


@pytest.mark.parametrize("beside", [False, True])
def test_models_of_a_diffusion_folder_are_told_apart(spark, tmp_path, table, beside):
    """Three files of one name, with or without weights in files that have one name too, each scored."""
    want = {"text_encoder": 2.0, "unet": 3.0, "vae_decoder": 5.0}
    for name, factor in want.items():
        files = {"k": "weights.bin"} if beside else None
        put(tmp_path / name, scaled(factor, 0, files), **({"weights.bin": np.full(48, factor)} if beside else {}))
    models = tasks.diffusion_models(spark, str(tmp_path), beside)
    plain = table.where("id = 1").select(onnx.preprocess("Image", TINY)).first()[0]
    for name, factor in zip(models, want.values(), strict=True):
        raw = table.where("id = 1").select(tasks.Task(models[name], TINY).scores()["raw"]).first()[0]
        assert np.allclose(raw, factor * np.array(plain), rtol=1e-6)


def test_equal_models_share_a_session(spark, tmp_path):
    a, b = (onnx.ship(spark, put(tmp_path / x, scaled(1, 0))) for x in "ab")
    assert a.key == b.key and onnx.session(a) is onnx.session(b)
    assert onnx.ship(spark, put(tmp_path / "c", scaled(2, 0))).key != a.key


def test_callers_columns_stay(spark, tmp_path, table):
    names = ["_scored", "_mask", "_v", "_encoding", "_prompt", "_SCORED_"]
    d = table.withColumns({n: F.concat(F.lit(n), F.col("id").cast("string")) for n in names})
    want = sorted(tuple(r) for r in d.select("id", *names).collect())
    flat, six, mask = (tasks.Task(toy_onnx.reshaping([3, 4, 4], out), TINY, labels=("a", "b")) for out in ([48], [6, 8], [12, 2, 2]))
    path = tmp_path / "sam"
    encoder, decoder = put(path / "e", toy_onnx.reshaping([3, 4, 4], [3, 4, 4])), toy_onnx.model(
        [toy_onnx.node("Identity", ["x"], ["masks"]), toy_onnx.node("Identity", ["c"], ["iou"])],
        {"x": [1, 3, 4, 4]}, {"masks": [1, 3, 4, 4], "iou": [1, 3]}, {"c": np.array([[0.1, 0.9, 0.9]], np.float32)},
    )
    outs = [
        tasks.classify(d, flat), tasks.embed(d, tasks.Task(toy_onnx.reshaping([3, 4, 4], [3, 16]), TINY)), tasks.detect(d, six),
        tasks.segment(d, mask), tasks.estimate_depth(d, tasks.Task(toy_onnx.reshaping([3, 4, 4], [12, 4]), TINY)),
        tasks.zero_shot(d, flat, np.eye(48)[:2].tolist()),
        catalog.segment_anything(encoder, put(path / "d", decoder), size=[4, 4]).transform(d),
    ]
    for out in outs:
        assert out.columns[: len(d.columns)] == d.columns
        assert sorted(tuple(r) for r in out.select("id", *names).collect()) == want


def test_sizes_of_a_preset_can_be_set():
    assert tasks.task(b"", "clip", size=(8, 8)).config.size == (8, 8) and isinstance(tasks.task(b"", "clip").config, Preprocess)
