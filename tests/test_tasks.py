import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import Preprocess
from tessera.operators import chat, onnx, tasks, tokenize, toy_onnx
from tessera.schema import IMAGE
from tessera.sources import images
from tessera.streaming import stream

TINY = Preprocess((4, 4))


def picture(*rgb, size=4):
    data = np.tile(np.array(rgb[::-1], np.uint8), (size, size, 1)).tobytes()
    return {"origin": "", "height": size, "width": size, "nChannels": 3, "mode": 16, "data": data}


@pytest.fixture
def table(spark):
    rows = [(i, picture(40 * i, 255 - 40 * i, 7 * i)) for i in range(5)] + [(5, None)]
    return spark.createDataFrame(rows, f"id long, Image {IMAGE}")


def test_batches_equal_single_rows(spark, table):
    raws = []
    for batch, size in ((1, "batch"), (32, "batch"), (1, 1)):
        t = tasks.Task(toy_onnx.reshaping([3, 4, 4], [48], size), TINY, batch=batch)
        raws.append([r[0] for r in table.orderBy("id").select(t.scores()["raw"]).collect()])
    assert raws[0] == raws[1] == raws[2] and raws[0][5] is None and len(raws[0][0]) == 48


def test_classify_keeps_columns_and_null_images(table):
    d = tasks.classify(table, tasks.Task(toy_onnx.reshaping([3, 4, 4], [48]), TINY, labels=("zero",)), 3)
    assert d.columns[:2] == ["id", "Image"]
    rows = {r["id"]: r for r in d.collect()}
    assert len(rows) == 6 and rows[5]["PredictedLabel"] == "" and rows[5]["Probability"] == []
    assert all(len(rows[i]["Probability"]) == 3 and rows[i]["Probability"] == sorted(rows[i]["Probability"], reverse=True) for i in range(5))


def test_embed_detect_segment_depth(table):
    e = tasks.embed(table, tasks.Task(toy_onnx.reshaping([3, 4, 4], [3, 16]), TINY), "mean").orderBy("id").collect()
    assert np.linalg.norm(e[0]["Embedding"]) == pytest.approx(1, abs=1e-5) and e[5]["Embedding"] == []
    for n, boxes in ((8, 32), (16, 128)):
        task = tasks.Task(toy_onnx.reshaping([3, n, n], [6, boxes]), Preprocess((n, n)))
        d = tasks.detect(table, task, score=-9.0, most=2).orderBy("id").collect()
        assert d[5]["DetectedObjects_Count"] == 0 and len(d[0]["DetectedObjects_Boxes"]) == 6 * d[0]["DetectedObjects_Count"] <= 12
    s = tasks.segment(table, tasks.Task(toy_onnx.reshaping([3, 4, 4], [12, 2, 2]), TINY)).orderBy("id").collect()
    assert s[0]["SegmentationMask_Width"] == 4 and len(s[0]["SegmentationMask"]) == 16 and s[5]["SegmentationMask"] == []
    z = tasks.estimate_depth(table, tasks.Task(toy_onnx.reshaping([3, 4, 4], [12, 4]), TINY)).orderBy("id").collect()
    assert min(z[1]["DepthMap"]) >= -0.5 and z[1]["Depth"]["max_depth"] > z[1]["Depth"]["min_depth"]


def test_zero_shot(table):
    texts = np.eye(48)[:3].tolist()
    d = tasks.zero_shot(table, tasks.Task(toy_onnx.reshaping([3, 4, 4], [48]), TINY, labels=("a", "b", "c")), texts, 2)
    rows = d.orderBy("id").collect()
    assert len(rows[0]["Probability"]) == 2 and rows[5]["PredictedLabel"] == ""
    with pytest.raises(ValueError):
        tasks.zero_shot(table, tasks.Task(b"", TINY), texts)


def test_caption_and_answer(spark, table):
    """A decoder whose best next id is a fixed function of the last one."""
    step = np.zeros((8, 8), np.float32)
    for a, b in ((1, 3), (3, 4), (4, 2), (6, 5), (5, 2), (2, 5)):
        step[a, b] = 1
    decoder = toy_onnx.model([toy_onnx.node("Gather", ["w", "ids"], ["y"])], {"ids": [1, "n"]}, {"y": [1, "n", 8]}, {"w": step}, ("ids",))
    words = tokenize.WordPieceTokenizer(["[PAD]", "[B]", "[E]", "a", "cat", "dog", "what", "##s"])
    t = tasks.Task(toy_onnx.reshaping([3, 4, 4], [48]), TINY)
    d = tasks.caption(table.withColumn("q", F.when(F.col("id") == 1, "what")), t, decoder, words, "q", 10, 1, 2).orderBy("id").collect()
    assert d[0]["Caption"] == "a cat" and d[1]["Caption"].startswith("dog") and d[5]["Caption"] == ""


def test_segment_anything(spark, table):
    decoder = toy_onnx.model(
        [toy_onnx.node("Identity", ["x"], ["masks"]), toy_onnx.node("Identity", ["c"], ["iou"])],
        {"x": [1, 3, 4, 4]}, {"masks": [1, 3, 4, 4], "iou": [1, 3]}, {"c": np.array([[0.1, 0.9, 0.9]], np.float32)},
    )
    enc = tasks.encode_images(table, tasks.Task(toy_onnx.reshaping([3, 4, 4], [3, 4, 4]), TINY))
    for prompt in (tasks.point(1, 2), tasks.box(0, 0, 3, 3), tasks.center(F.col("Image"))):
        rows = tasks.segment_prompts(enc.withColumn("Prompt", prompt), decoder).orderBy("id").collect()
        assert len(rows[0]["SegmentAnythingMask"]) == 16 and rows[0]["SegmentAnythingMask_IoU"] == pytest.approx(0.9)
        assert set(rows[3]["SegmentAnythingMask"]) <= {0.0, 1.0} and rows[5]["SegmentAnythingMask"] == []
    with pytest.raises(ValueError):
        tasks.points([(1, 1)], [])


def test_generation_is_repeatable(spark):
    text = toy_onnx.model([toy_onnx.node("Gather", ["w", "ids"], ["y"])], {"ids": [1, 77]}, {"y": [1, 77, 2]}, {"w": np.zeros((49408, 2), np.float32)}, ("ids",))
    unet = toy_onnx.model([toy_onnx.node("Identity", ["x"], ["y"])], {"x": [2, 4, 2, 2]}, {"y": [2, 4, 2, 2]})
    vae = toy_onnx.model([toy_onnx.node("Reshape", ["x", "s"], ["r"]), toy_onnx.node("Gather", ["r", "i"], ["y"])],
                         {"x": [1, 4, 2, 2]}, {"y": [1, 3, 2, 2]}, {"s": np.array([4, 2, 2]), "i": np.array([[0, 1, 2]])})
    g = tasks.Generator(text, unet, vae, steps=3, size=(16, 16))
    assert np.array_equal(g.generate("a", 5), g.generate("a", 5)) and not np.array_equal(g.generate("a", 5), g.generate("a", 6))
    d = tasks.generate(spark.createDataFrame([("x",), (None,)], "Prompt string"), g).collect()
    assert d[0]["Image"]["nChannels"] == 4 and d[0]["Image"]["data"] == d[1]["Image"]["data"]


def test_model_contract(tmp_path):
    with pytest.raises(ValueError):
        onnx.read_model("")
    with pytest.raises(FileNotFoundError):
        onnx.read_model(str(tmp_path / "none.onnx"))
    dynamic, fixed = toy_onnx.reshaping([4], [4]), toy_onnx.reshaping([4], [4], 1)
    assert onnx.model_info(dynamic).batch_dynamic and not onnx.model_info(fixed).batch_dynamic
    assert onnx.session(dynamic, ("NoSuchProvider",)) is not None
    with pytest.raises(RuntimeError):
        onnx.session(dynamic, ("NoSuchProvider",), False)


def toy():
    s = tokenize.byte_symbols()
    vocab = {x: i + 1 for i, x in enumerate([*s, *(c + "</w>" for c in s), "ca", "cat</w>"])} | {"!": 0}
    return tokenize.ClipTokenizer(vocab, [("c", "a"), ("ca", "t</w>")])


def test_clip_tokenizer(spark):
    t = toy()
    ids = t.encode("a cat")
    assert len(ids) == 77 and ids[0] == tokenize.SOT and ids.count(tokenize.EOT) == 1 and ids[4:] == [0] * 73
    assert t.encode("A CAT") == ids and t.decode(ids) == "a cat"
    assert len(t.encode("cat " * 500)) == 77 and t.encode("cat " * 500)[-1] == tokenize.EOT
    with pytest.raises(ValueError):
        t.encode(None)
    d = spark.createDataFrame([("a cat",)], "s string").select(tokenize.decode(tokenize.encode("s", t), t).alias("s"))
    assert d.first()["s"] == "a cat"


def test_png_round_trip_and_image_source(spark, tmp_path):
    p = np.random.default_rng(0).integers(0, 256, (12, 16, 3), dtype=np.uint8)
    assert np.array_equal(images.unpng(images.png(p)), p)
    with pytest.raises(ValueError):
        images.unpng(b"")
    (tmp_path / "a.png").write_bytes(images.png(p))
    (tmp_path / "b.png").write_bytes(b"junk")
    rows = images.read_images(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["Image"]["data"] == p[:, :, ::-1].tobytes()


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.png").write_bytes(images.png(np.full((4, 4, 3), 80 * i, np.uint8)))
    task = tasks.Task(toy_onnx.reshaping([3, 4, 4], [48]), TINY)
    apply = lambda d: tasks.classify(d.select(images.decode("content").alias("Image")), task, 1).select("PredictedLabel", "Probability")
    stream.run_available(stream.image_stream(spark, str(tmp_path / "in")), apply, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = apply(spark.read.format("binaryFile").load(str(tmp_path / "in"))).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 3


def test_chat_routes(spark):
    kind = "array<struct<media_type:string,data:binary,text:string>>"
    img, txt = ("image/png", b"x", None), lambda s: ("text/plain", None, s)
    rows = [(1, 1, "user", [img]), (2, 1, "user", [txt("hi")]), (3, 1, "user", [img]), (3, 2, "assistant", [txt("?")]),
            (3, 3, "user", [img, txt(" "), txt("what")]), (4, 1, "assistant", [img])]
    d = chat.route(spark.createDataFrame(rows, f"conv_id long, turn long, role string, contents {kind}"))
    assert {r["conv_id"]: (r["route"], r["question"]) for r in d.collect()} == {1: ("caption", None), 2: ("none", "hi"), 3: ("answer", "what")}


def test_merges_equal_a_plain_search():
    """The heap against merging the best pair of the whole list again and again, also for a very long run."""
    import random

    rng, s = random.Random(3), tokenize.byte_symbols()
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("ab", "ab"), ("a", "a</w>"), ("ba", "b"), ("aba", "b</w>")]
    vocab = {x: i for i, x in enumerate([*s, *(c + "</w>" for c in s), *(a + b for a, b in merges)])}
    t, ranks = tokenize.ClipTokenizer(vocab, merges), {m: i for i, m in enumerate(merges)}
    for n in [1, 2, 3, *[rng.randrange(4, 30) for _ in range(60)]]:
        word = "".join(rng.choice("aab") for _ in range(n))
        parts = [*word[:-1], word[-1] + "</w>"]
        while found := [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]:
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert t._merge(word) == tuple(vocab[p] for p in parts)
    assert len(t.encode("ab" * 100_000)) == 77 and t.ids("", 5) == []


def test_null_texts_have_null_ids(spark):
    d = spark.createDataFrame([("cat",), (None,)], "s string").select(tokenize.encode("s", toy()).alias("ids"))
    assert sorted(r["ids"] is None for r in d.collect()) == [False, True]
    back = d.select(tokenize.decode("ids", toy()).alias("s")).collect()
    assert {r["s"] for r in back} == {"cat", None}


def filtered(pixels, kinds):
    """The lines of a PNG file with a filter for each, by the definition of the filters."""
    h, w, c = pixels.shape
    flat, out = pixels.reshape(h, -1).astype(int), bytearray()
    for y in range(h):
        out.append(kinds[y])
        for i in range(w * c):
            a, b = (flat[y, i - c] if i >= c else 0), (flat[y - 1, i] if y else 0)
            d = flat[y - 1, i - c] if y and i >= c else 0
            p = a + b - d
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
            out.append((flat[y, i] - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256)
    return bytes(out)


def png_file(w, h, depth, color, raw, palette=b"", interlace=0):
    import struct
    import zlib

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, interlace)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels,color", [(1, 0), (3, 2), (4, 6)])
def test_png_filters(channels, color):
    rng = np.random.default_rng(channels)
    for h, w in ((1, 1), (5, 9), (9, 2), (7, 7)):
        p = rng.integers(0, 256, (h, w, channels), dtype=np.uint8)
        assert np.array_equal(images.unpng(png_file(w, h, 8, color, filtered(p, rng.integers(0, 5, h).tolist()))), p)


def test_other_files(spark):
    rng = np.random.default_rng(1)
    p = rng.integers(0, 256, (5, 3, 3), dtype=np.uint8)
    assert np.array_equal(images.unbmp(images.bmp(p)), p)
    palette = bytes([9, 8, 7, 1, 2, 3])
    two = images.unpng(png_file(3, 1, 1, 3, bytes([0, 0b01000000]), palette))
    assert two.tolist() == [[[9, 8, 7], [1, 2, 3], [9, 8, 7]]]
    assert images.unpng(png_file(1, 1, 16, 0, bytes([0, 200, 5]))).tolist() == [[[200]]]
    assert images.unpng(png_file(4, 1, 2, 0, bytes([0, 0b00011011]))).tolist() == [[[0], [85], [170], [255]]]
    assert images.unpng(png_file(1, 1, 8, 4, bytes([0, 7, 9]))).tolist() == [[[7, 7, 7, 9]]]
    bad = [None, b"", b"junk", images.png(p)[:40], b"BM", png_file(1, 1, 8, 0, b"\0\0", interlace=1)]
    rows = spark.createDataFrame([(b,) for b in [*bad, images.png(p)]], "b binary").select(images.decode("b").alias("i")).collect()
    assert [r["i"] is None or r["i"]["data"] is None for r in rows] == [True] * len(bad) + [False]


def test_limit_and_labels(spark, tmp_path):
    for d in "ab":
        (tmp_path / d).mkdir()
        for i in range(3):
            (tmp_path / d / f"{i}.png").write_bytes(images.png(np.full((2, 2, 3), i, np.uint8)))
    paths = [str(tmp_path / d) for d in "ab"]
    assert images.read_images(spark, *paths).count() == 6 and images.read_images(spark, *paths, limit=4).count() == 4
    (tmp_path / "labels.txt").write_text("cat\ndog\n")
    assert images.read_labels(spark, str(tmp_path / "labels.txt")) == ["cat", "dog"]
    d = onnx.with_row_id(spark.range(20, numPartitions=3))
    assert d.select("RowId").distinct().count() == 20


def test_vocabulary_files(tmp_path):
    import json

    t = toy()
    (tmp_path / "vocab.json").write_text(json.dumps(t.vocab), encoding="utf-8")
    (tmp_path / "merges.txt").write_text("#version: 0.2\nc a\nca t</w>\n\n", encoding="utf-8")
    assert tokenize.ClipTokenizer.load(str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt")).encode("a cat") == t.encode("a cat")
    (tmp_path / "vocab.txt").write_text("[PAD]\n[UNK]\ncat\n##s\n")
    w = tokenize.WordPieceTokenizer.load(str(tmp_path / "vocab.txt"))
    assert w.encode("Cats cat dog") == [2, 3, 2, 1] and w.decode([2, 3]) == "cats"


def test_models_go_out_once(spark, tmp_path, table):
    path = tmp_path / "m.onnx"
    path.write_bytes(toy_onnx.reshaping([3, 4, 4], [48]))
    for model in (onnx.ship(spark, str(path)), onnx.ship(spark, str(path), True), onnx.shipped(path.read_bytes())):
        assert isinstance(model, onnx.Model)
        rows = table.orderBy("id").select(tasks.Task(model, TINY, batch=2).scores()["raw"].alias("raw")).collect()
        assert len(rows[0]["raw"]) == 48 and rows[5]["raw"] is None
    assert onnx.shipped(path.read_bytes()).data is onnx.shipped(path.read_bytes()).data
    with pytest.raises(FileNotFoundError):
        tasks.diffusion_models(spark, str(tmp_path))


def test_a_worker_holds_the_tensors_of_one_batch():
    held = []

    def tensor(v):
        held.append(v)
        return np.zeros(4, np.float32)

    out = onnx._outputs(list(range(10)), onnx.Scorer(toy_onnx.reshaping([4], [4]), (4,), batch=3), tensor, onnx._raw)
    assert len(next(out)) == 3 and held == [0, 1, 2] and sum(map(len, out)) == 7


def test_providers_reach_every_session(spark, table):
    bad = {"providers": (("NoSuchProvider", {"device_id": 1}),), "fallback": False}
    model = toy_onnx.reshaping([3, 4, 4], [48])
    with pytest.raises(RuntimeError):
        onnx.model_info(model, **bad)
    with pytest.raises(RuntimeError):
        tasks.Generator(model, model, model, **bad).generate("x")
    runs = [
        lambda: tasks.classify(table, tasks.Task(model, TINY, **bad)),
        lambda: table.select(tasks.encode_text(F.lit("a"), model, toy(), 4, **bad)),
        lambda: tasks.segment_prompts(tasks.encode_images(table, tasks.Task(model, TINY)).withColumn("Prompt", tasks.point(1, 1)), model, **bad),
    ]
    for run in runs:
        with pytest.raises(Exception, match="NoSuchProvider|no such execution provider"):
            run().collect()


def test_dynamic_boxes(table):
    shape = toy_onnx.model([toy_onnx.node("Reshape", ["x", "s"], ["y"])], {"x": ["batch", 3, 4, 4]}, {"y": ["batch", 6, "boxes"]}, {"s": np.array([0, 6, 8])})
    a, b = (tasks.detect(table, tasks.Task(m, TINY), -9.0).orderBy("id").collect() for m in (shape, toy_onnx.reshaping([3, 4, 4], [6, 8])))
    assert [r["DetectedObjects_Boxes"] for r in a] == [r["DetectedObjects_Boxes"] for r in b] and a[0]["DetectedObjects_Count"] > 0


def test_catalog_stages_are_saved_and_loaded(spark, tmp_path, table):
    from pyspark.ml import Pipeline, PipelineModel

    from tessera.operators import catalog

    for name, out in (("c", [48]), ("e", [3, 16]), ("d", [6, 8]), ("s", [12, 2, 2]), ("z", [12, 4])):
        (tmp_path / f"{name}.onnx").write_bytes(toy_onnx.reshaping([3, 4, 4], out))
    at = lambda n: str(tmp_path / f"{n}.onnx")
    size = {"size": [4, 4]}
    stages = [
        catalog.image_classification(at("c"), top_k=2, labels=["zero"], label="Best", **size), catalog.image_embedding(at("e"), pooling="mean", **size),
        catalog.object_detection(at("d"), most=1, **size), catalog.image_segmentation(at("s"), **size), catalog.depth_estimation(at("z"), batch=2, **size),
    ]
    model = Pipeline(stages=stages).fit(table)
    model.write().overwrite().save(str(tmp_path / "saved"))
    want, got = (m.transform(table).drop("Image").orderBy("id").collect() for m in (model, PipelineModel.load(str(tmp_path / "saved"))))
    assert want == got and len(want[0]["Probability"]) == 2 and want[0]["DetectedObjects_Count"] <= 1
    assert want[5]["Best"] == "" and len(want[0]["Embedding"]) == 16 and len(want[0]["DepthMap"]) == 16
    with pytest.raises(ValueError):
        catalog.image_classification("")
    with pytest.raises(ValueError):
        catalog.zero_shot_classification(at("c"), at("c"), "", "", [], 4)


def test_adapters(spark, tmp_path, table):
    from tessera.operators import adapters

    (tmp_path / "net.onnx").write_bytes(toy_onnx.reshaping([3, 4, 4], [3, 16]))
    a = adapters.EmbeddingAdapter.of_file(str(tmp_path / "net.onnx"), TINY)
    assert a.metadata == adapters.Metadata("onnx", "net", 16)
    assert a.generate(table).orderBy("id").collect() == tasks.embed(table, tasks.Task(toy_onnx.reshaping([3, 4, 4], [3, 16]), TINY)).orderBy("id").collect()
    for folder in ("text_encoder", "unet", "vae_decoder"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "model.onnx").write_bytes(toy_onnx.reshaping([4], [4]))
    g = adapters.GeneratorAdapter.of_folder(spark, str(tmp_path), False)
    assert isinstance(g.generator.unet, onnx.Model)


def test_cancelling_by_tag(spark):
    import threading
    import time

    from tessera.operators import adapters

    def slow(batches):
        for pdf in batches:
            time.sleep(60)
            yield pdf

    caught = []

    def work():
        try:
            with adapters.cancellable(spark, "stop-me"):
                spark.range(1, numPartitions=1).mapInPandas(slow, "id long").collect()
        except Exception as e:  # noqa: BLE001
            caught.append(e)

    from pyspark import InheritableThread

    t, began = InheritableThread(target=work), time.time()
    t.start()
    while t.is_alive() and time.time() - began < 50:
        time.sleep(1)
        adapters.cancel(spark, "stop-me")
    t.join(60)
    assert caught and time.time() - began < 50 and isinstance(t, threading.Thread)


def test_chat_replies(spark):
    from tessera.plans.queries import captioner

    kind = "array<struct<media_type:string,data:binary,text:string>>"
    shade = lambda v: ("image/png", images.png(np.full((4, 4, 3), v, np.uint8)), None)
    txt = lambda s: ("text/plain", None, s)
    rows = [(1, 1, "user", [shade(250)]), (2, 1, "user", [txt("hi")]), (3, 1, "user", [shade(250)]), (3, 3, "user", [shade(3), txt("what")]),
            (4, 1, "user", [("image/png", b"junk", None)])]
    decoder, words = captioner()
    adapter = chat.ChatAdapter(tasks.Task(toy_onnx.reshaping([3, 4, 4], [48]), TINY), decoder, words, 10, 1, 2)
    out = adapter.reply(spark.createDataFrame(rows, f"conv_id long, turn long, role string, contents {kind}"))
    assert {r["conv_id"]: r["text"] for r in out.collect()} == {1: "a cat", 2: chat.NO_IMAGE, 3: "dog", 4: ""}
