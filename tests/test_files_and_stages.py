"""Files as a data source, table functions, noise, and stages that carry their files."""

import json
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tessera.functions import diffusion
from tessera.operators import catalog, fanout, tasks, tokenize, toy_onnx
from tessera.sources import files, images
from tests.test_tasks import TINY, picture, table  # noqa: F401


def test_a_table_becomes_a_folder_and_a_table_again(spark, tmp_path):
    spark.dataSource.register(files.ImageFiles)
    rows = [(f"{i % 3}/sub/{i}.png" if i % 2 else f"é {i}.JPG", images.png(np.full((2, 2, 3), i, np.uint8))) for i in range(40)]
    out = str(tmp_path / "out")
    spark.createDataFrame(rows, "name string, data binary").repartition(5).write.format("image_files").mode("append").save(out)
    (tmp_path / "out" / "notes.txt").write_text("no picture")
    (tmp_path / "out" / "_hidden").mkdir()
    (tmp_path / "out" / "_hidden" / "x.png").write_bytes(b"x")
    back = spark.read.format("image_files").load(out)
    assert sorted((r["name"], bytes(r["data"]), r["length"]) for r in back.collect()) == sorted((n, d, len(d)) for n, d in rows)
    assert not list((tmp_path / "out").glob("_staging*"))
    more = spark.createDataFrame([("new.png", b"1")], "name string, data binary")
    more.write.format("image_files").mode("append").save(out)
    with pytest.raises(Exception, match="new.png"):
        more.write.format("image_files").mode("append").save(out)  # it is there already
    spark.createDataFrame([("new.png", b"2")], "name string, data binary").write.format("image_files").mode("overwrite").save(out)
    assert (tmp_path / "out" / "new.png").read_bytes() == b"2"
    empty = str(tmp_path / "empty")
    (tmp_path / "empty").mkdir()
    assert spark.read.format("image_files").load(empty).count() == 0


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    spark.dataSource.register(files.ImageFiles)
    good = [(f"{i}.png", b"x" * 10) for i in range(50)]
    for bad in [("a.png", None), ("../a.png", b"x"), ("", b"x"), (good[0][0], b"twice")]:
        d = spark.createDataFrame([*good, bad], "name string, data binary").repartition(6)
        with pytest.raises(Exception, match="no file can be written|one name"):
            d.write.format("image_files").mode("append").save(str(tmp_path / "out"))
        seen = [p for p in (tmp_path / "out").rglob("*") if p.is_file() and "_staging-" not in str(p)]
        assert seen == [] and not (tmp_path / "a.png").exists()
        if (tmp_path / "out").exists():
            assert spark.read.format("image_files").load(str(tmp_path / "out")).count() == 0
    with pytest.raises(Exception, match="name .string. and data"):
        spark.range(3).write.format("image_files").mode("append").save(str(tmp_path / "out"))


def test_large_folders_are_several_partitions(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PARTITION", 100)
    monkeypatch.setattr(files, "BATCH", 30)
    for i in range(20):
        (tmp_path / f"{i:02d}.gif").write_bytes(bytes([i]) * 20)
    reader = files.ImageReader(str(tmp_path))
    parts = reader.partitions()
    assert [len(p.names) for p in parts] == [5, 5, 5, 5]
    batches = [b for p in parts for b in reader.read(p)]
    assert len(batches) == 12 and [n for b in batches for n in b.column("name").to_pylist()] == [f"{i:02d}.gif" for i in range(20)]


def test_table_functions_equal_the_task(spark, table):
    fanout.register(spark)
    t = tasks.Task(toy_onnx.reshaping([3, 4, 4], [6, 8]), TINY, labels=("a", "b"))
    table.withColumn("raw", t.scores()["raw"]).createOrReplaceTempView("scored")
    want = tasks.detect(table, t, score=-9.0, most=3).select("id", F.posexplode("Detections").alias("place", "d")).select("id", "place", "d.*")
    got = spark.sql("SELECT id, d.* FROM scored, LATERAL detections(raw, classes => 2, boxes => 8, score => -9.0D, most => 3, labels => 'a,b') AS d")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
    assert "label" not in spark.sql("SELECT * FROM scored, LATERAL detections(raw, classes => 2, boxes => 8)").columns
    mask = tasks.Task(toy_onnx.reshaping([3, 4, 4], [3, 4, 4]), TINY)
    table.withColumn("raw", mask.scores()["raw"]).createOrReplaceTempView("masked")
    sizes = spark.sql("SELECT id, r.* FROM masked, LATERAL regions(raw, classes => 3, height => 4, width => 4, labels => 'x,y') AS r")
    want = tasks.segment(table, mask).select("id", F.explode("SegmentationMask").alias("class_id")).groupBy("id", "class_id").count()
    assert {(r["id"], r["class_id"], r["pixels"]) for r in sizes.collect()} == {tuple(r) for r in want.collect()}
    assert {r["label"] for r in sizes.collect()} <= {"x", "y", "2"} and sizes.agg(F.sum("percent")).first()[0] == pytest.approx(500)
    parts = spark.sql("SELECT id, r.* FROM masked, LATERAL regions(raw, classes => 3, height => 4, width => 4, runs => true) AS r")
    assert parts.groupBy("id").agg(F.sum("length").alias("n")).where("n <> 16").count() == 0
    for call, what in [("detections(raw, boxes => 8)", "classes and boxes"), ("detections(raw, classes => 2, boxes => 8, colour => 1)", "no such option"), ("detections(raw, classes => id, boxes => 8)", "constant|constants")]:
        with pytest.raises(Exception, match=what):
            spark.sql(f"SELECT * FROM (SELECT raw, CAST(id AS INT) AS id FROM scored), LATERAL {call}").collect()


def test_noise_depends_on_seed_and_place_alone(spark):
    d = spark.createDataFrame([(i if i else None,) for i in range(60)], "seed long")
    a, b = ({r["seed"]: r["n"] for r in d.repartition(n).select("seed", diffusion.noise(F.col("seed"), 64, 2.0).alias("n")).collect()} for n in (1, 7))
    assert a == b and a[None] is None
    for seed in (1, 59):
        assert np.allclose(np.array(a[seed], dtype=np.float32).reshape(4, 4, 4), diffusion.gaussian((4, 4, 4), seed, 2.0), atol=1e-6)
    x = diffusion.gaussian((40_000,), 3)
    assert abs(x.mean()) < 0.02 and abs(x.std() - 1) < 0.02 and abs((x[:-1] * x[1:]).mean()) < 0.02 and abs((np.abs(x) < 1.96).mean() - 0.95) < 0.01


def stages(folder):
    """A stage of each kind that has files beside its model."""
    folder.mkdir()
    put = lambda name, data: (folder / name).write_bytes(data) and str(folder / name)
    flat = put("flat.onnx", toy_onnx.reshaping([3, 4, 4], [48]))
    text = toy_onnx.model([toy_onnx.node("Gather", ["w", "ids"], ["t"]), toy_onnx.node("ReduceSum", ["t", "a"], ["r"]), toy_onnx.node("Reshape", ["r", "s"], ["y"])],
                          {"ids": [1, 77]}, {"y": [1, 48]}, {"w": np.random.default_rng(0).normal(size=(49408, 48)).astype(np.float32), "a": np.array([1]), "s": np.array([1, 48])}, ("ids",))
    s = tokenize.byte_symbols()
    vocab = put("vocab.json", json.dumps({x: i for i, x in enumerate([*s, *(c + "</w>" for c in s)])}).encode())
    zero = catalog.zero_shot_classification(flat, put("text.onnx", text), vocab, put("merges.txt", b"#version: 0.2\n"), ["cat", "dog"], 48, size=[4, 4], prompt="a {}")
    step = np.zeros((8, 8), np.float32)
    for a, b in ((1, 3), (3, 4), (4, 2)):
        step[a, b] = 1
    decoder = toy_onnx.model([toy_onnx.node("Gather", ["w", "ids"], ["y"])], {"ids": [1, "n"]}, {"y": [1, "n", 8]}, {"w": step}, ("ids",))
    says = catalog.image_captioning(flat, put("says.onnx", decoder), put("vocab.txt", b"[PAD]\n[B]\n[E]\na\ncat\ndog\nwhat\n##s"), size=[4, 4], length=10, bos=1, eos=2)
    sam = toy_onnx.model([toy_onnx.node("Identity", ["x"], ["masks"]), toy_onnx.node("Identity", ["c"], ["iou"])],
                         {"x": [1, 3, 4, 4]}, {"masks": [1, 3, 4, 4], "iou": [1, 3]}, {"c": np.array([[0.1, 0.9, 0.9]], np.float32)})
    seg = catalog.segment_anything(put("enc.onnx", toy_onnx.reshaping([3, 4, 4], [3, 4, 4])), put("sam.onnx", sam), size=[4, 4])
    return [zero, says, seg, catalog.image_embedding(put("emb.onnx", toy_onnx.reshaping([3, 4, 4], [3, 16])), size=[4, 4])]


OUT = ["id", "PredictedLabel", "Probability", "Caption", "SegmentAnythingMask", "SegmentAnythingMask_IoU", "Embedding"]
LATER = """
import sys, json
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.ml import PipelineModel
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
d = PipelineModel.load({model!r}).transform(spark.read.parquet({table!r})).orderBy("id").select(*{out!r})
print("ROWS" + json.dumps([r.asDict(True) for r in d.collect()]))
"""


def test_a_saved_pipeline_needs_none_of_its_files(spark, tmp_path, table):
    """Saved, the files removed, loaded in another application: the same rows."""
    made = Pipeline(stages=stages(tmp_path / "files")).fit(table)
    rows = [r.asDict(True) for r in made.transform(table).orderBy("id").select(*OUT).collect()]
    assert rows[0]["Caption"] == "a cat" and rows[0]["PredictedLabel"] in ("cat", "dog") and len(rows[0]["SegmentAnythingMask"]) == 16
    made.write().overwrite().save(str(tmp_path / "model"))
    table.write.parquet(str(tmp_path / "table"))
    shutil.rmtree(tmp_path / "files")
    again = PipelineModel.load(str(tmp_path / "model"))
    assert [r.asDict(True) for r in again.transform(table).orderBy("id").select(*OUT).collect()] == rows
    again.save(str(tmp_path / "copy"))  # what was loaded can be saved
    repo = str(__import__("pathlib").Path(catalog.__file__).parents[2])
    code = LATER.format(repo=repo, model=str(tmp_path / "copy"), table=str(tmp_path / "table"), out=OUT)
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert json.loads(said.stdout.split("ROWS")[1]) == json.loads(json.dumps(rows)), said.stderr[-500:]


def test_changed_files_are_noticed(spark, tmp_path, table):
    stage = stages(tmp_path / "files")[3]
    stage.save(str(tmp_path / "stage"))
    assert catalog.ImageTask.load(str(tmp_path / "stage")).transform(table).where("size(Embedding) = 16").count() == 5
    spark.createDataFrame([("model", b"other")], "name string, data binary").write.mode("overwrite").parquet(str(tmp_path / "stage" / "files"))
    with pytest.raises(ValueError, match="not those that were saved"):
        catalog.ImageTask.load(str(tmp_path / "stage"))
