"""The registered queries: every operator over a view of the driver's tables.

The 64 numbers of an embedding stand for model outputs of different shapes (logits, token rows, box tensors, pixel
grids), so that each operator runs over a whole table and can be held against SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import Preprocess
from tessera.functions import boxes as B
from tessera.functions import diffusion, kernels, runs
from tessera.functions import vectors as V
from tessera.operators import chat, fanout, neighbours, onnx, tasks, tokenize, toy_onnx
from tessera.sources import files, images
from tessera.streaming import stream

LABELS = [f"class_{i}" for i in range(40)]
YOLO_CLASSES, YOLO_BOXES = 4, 8
SIGMA, SIGMA_AFTER, GUIDANCE = 2.0, 1.5, 7.5

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and e: the embedding as doubles."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", V.doubles("embedding").alias("e"))


def flat(df: DataFrame, array: Column, digits: int | None = 5) -> DataFrame:
    """A row for every element of an array: vec_id, pos, value."""
    rows = df.select("vec_id", F.posexplode(array).alias("pos", "value"))
    return rows if digits is None else rows.withColumn("value", F.round("value", digits) + 0.0)  # no negative zero


def label_column() -> Column:
    return F.array(*map(F.lit, LABELS))


def yolo_raw() -> Column:
    """(8, 8) tensor of e: centres (e + 1) 50, sizes 20 + 40 |e|, scores at most 1 of 4 |e|."""
    e = F.col("e")
    return F.transform(
        e, lambda x, i: F.when(i < 16, (x + 1) * 50).when(i < 32, 20 + 40 * F.abs(x)).otherwise(F.least(F.lit(1.0), 4 * F.abs(x)))
    )


def box_rows(df: DataFrame, boxes: Column) -> DataFrame:
    rows = df.select("vec_id", F.inline(boxes))
    return rows.select(
        "vec_id", "box", "class_id", *[F.round(c, 5).alias(c) for c in ("x", "y", "width", "height", "score")]
    )


def decoded(threshold: float = 0.25) -> Column:
    return B.decode(yolo_raw(), YOLO_CLASSES, YOLO_BOXES, threshold)


@query
def softmax_topk(spark, sf_dir):
    df = vectors(spark, sf_dir).select("vec_id", F.posexplode(V.ranked(V.softmax("e"), None, 5)).alias("rank", "p"))
    return df.select("vec_id", (F.col("rank") + 1).alias("rank"), "p.class_id", F.round("p.probability", 6).alias("probability"))


@query
def label_lookup(spark, sf_dir):
    df = vectors(spark, sf_dir).select("vec_id", F.posexplode(V.ranked(V.softmax("e"), label_column(), 3)).alias("rank", "p"))
    return df.select("vec_id", (F.col("rank") + 1).alias("rank"), "p.label")


@query
def argmax_label(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", V.label_of(label_column(), V.argmax("e")).alias("predicted"))


@query
def cls_pool(spark, sf_dir):
    return flat(vectors(spark, sf_dir), V.cls_pool("e", 16))


@query
def mean_pool(spark, sf_dir):
    return flat(vectors(spark, sf_dir), V.mean_pool("e", 16))


@query
def l2_normalize(spark, sf_dir):
    return flat(vectors(spark, sf_dir).withColumn("m", V.mean_pool("e", 16)), V.l2_normalize("m"))


@query
def transpose(spark, sf_dir):
    return flat(vectors(spark, sf_dir), B.transpose(F.col("e"), 4, 16))


@query
def yolo_decode(spark, sf_dir):
    return box_rows(vectors(spark, sf_dir), decoded())


@query
def iou_pairs(spark, sf_dir):
    d = vectors(spark, sf_dir).select("vec_id", decoded().alias("b"))
    pairs = F.flatten(F.transform("b", lambda x: F.transform(
        F.filter("b", lambda y: y["box"] > x["box"]),
        lambda y: F.struct(x["box"].alias("box_a"), y["box"].alias("box_b"), F.round(B.iou(x, y), 5).alias("iou")),
    )))
    return d.select("vec_id", F.inline(pairs))


@query
def nms(spark, sf_dir):
    return box_rows(vectors(spark, sf_dir), B.suppress(decoded(), 0.45))


@query
def max_detections(spark, sf_dir):
    return box_rows(vectors(spark, sf_dir), B.suppress(decoded(), 0.45, 2))


@query
def box_flatten(spark, sf_dir):
    d = vectors(spark, sf_dir).select("vec_id", B.suppress(decoded(), 0.45, 2).alias("b"))
    rows = d.select("vec_id", F.size("b").alias("n_boxes"), F.posexplode(B.flatten(F.col("b"))).alias("pos", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 3))


def class_ids() -> Column:
    return V.pixel_argmax("e", 4, 4, 4)


@query
def seg_argmax(spark, sf_dir):
    return flat(vectors(spark, sf_dir), class_ids(), None)


@query
def seg_resize_nearest(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("c", class_ids())
    return flat(d, V.resize_nearest(F.col("c"), 4, 4, 8, 6), None)


@query
def seg_label_at(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("c", class_ids())
    at = V.pixel_at(F.col("c"), 2, 1, 4, 4)
    return d.select("vec_id", at.alias("class_id"), F.get(F.array(F.lit("road"), F.lit("sky"), F.lit("tree")), at).alias("name"))


@query
def seg_histogram(spark, sf_dir):
    """Pixels of every class by the mask's runs: a row comes out for each class, none for a pixel, and nothing is shuffled."""
    d = vectors(spark, sf_dir).select("vec_id", F.inline(runs.histogram(runs.encode(class_ids()))))
    return d.withColumn("percent", F.round("percent", 4))


@query
def seg_runs(spark, sf_dir):
    """A mask's runs in another size, as pixels again, its pixels that aren't background, and one pixel's class."""
    d = vectors(spark, sf_dir).select("vec_id", runs.encode(class_ids()).alias("r"))
    big = runs.resize_nearest(F.col("r"), F.lit(4), F.lit(4), F.lit(8), F.lit(6))
    return d.select("vec_id", F.array_join(runs.decode(big), "").alias("pixels"), runs.foreground(F.col("r")).alias("foreground"),
                    runs.class_at(F.col("r"), 2, 1, 4, 4).alias("class_id"))


@query
def nms_together(spark, sf_dir):
    """Suppression by grid: the boxes of 16 vectors are one picture of 128, so that a class has many."""

    def kept(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "box"], ignore_index=True)
        xywh, kind, score = pdf[["x", "y", "width", "height"]].to_numpy(), pdf["class_id"].to_numpy(), pdf["score"].to_numpy()
        found = kernels.suppressed(xywh, kind, np.lexsort((np.arange(len(pdf)), kind, -score)), 0.45)
        return pdf.loc[found, ["picture", "vec_id", "box", "class_id", "score"]]

    rows = vectors(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 16).alias("picture"), F.inline(decoded()))
    rows = rows.select("picture", "vec_id", "box", "class_id", "x", "y", "width", "height", "score")
    found = rows.groupBy("picture").applyInPandas(kept, "picture long, vec_id long, box int, class_id int, score double")
    return found.withColumn("score", F.round("score", 5))


@query
def depth_minmax(spark, sf_dir):
    return flat(vectors(spark, sf_dir).withColumn("d", V.depth_map("e", 8, 8)), F.col("d.values"))


@query
def depth_stats(spark, sf_dir):
    d = vectors(spark, sf_dir).select("vec_id", V.depth_map("e", 8, 8).alias("d"))
    v = F.array_sort("d.values")
    return d.select(
        "vec_id", F.round(V.total(F.col("d.values")) / 64, 5).alias("mean"), F.round(F.element_at(v, 33), 5).alias("median"),
        F.round("d.min_depth", 5).alias("low"), F.round("d.max_depth", 5).alias("high"),
    )


@query
def depth_preview(spark, sf_dir):
    """The upper left corner in four shades."""
    d = vectors(spark, sf_dir).select("vec_id", V.depth_map("e", 8, 8).alias("d"))
    rows = d.select("vec_id", F.posexplode("d.values").alias("pos", "v")).where((F.col("pos") % 8 < 4) & (F.col("pos") < 32))
    shade = F.greatest(F.lit(0), F.least(F.lit(3), F.floor(F.col("v") * 4))).cast("int")
    return rows.select("vec_id", "pos", shade.alias("shade"))


@query
def depth_resize_bilinear(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("d", V.depth_map("e", 8, 8))
    return flat(d, V.resize_bilinear(F.col("d.values"), 8, 8, 12, 12))


TINY = Preprocess((4, 4))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image: 4 x 4 BGRA pixels, floor((e + 1) 127.5) a byte."""
    code = F.transform("e", lambda x: F.lpad(F.hex(F.floor((x + 1) * 127.5).cast("long")), 2, "0"))
    data = F.unhex(F.array_join(code, ""))
    return vectors(spark, sf_dir).withColumn("Image", images.from_pixels(F.lit(4), F.lit(4), data))


@query
def image_preprocess(spark, sf_dir):
    """The tensor of a picture in its own size: channels in order, rescaled and normalised."""
    d = onnx.with_tensor(pictures(spark, sf_dir), "Image", TINY)
    return flat(d, F.col("PreprocessedTensor").cast("array<double>"), 4)


@query
def image_resize_preprocess(spark, sf_dir):
    """The tensor of a picture stretched to 8 x 8, neither rescaled nor normalised, so that every number is exact."""
    d = onnx.with_tensor(pictures(spark, sf_dir), "Image", Preprocess((8, 8), rescale=False, normalize=False))
    return flat(d, F.col("PreprocessedTensor").cast("array<double>"))


@query
def image_round_trip(spark, sf_dir):
    """The pixels of a picture after a PNG file and back, and after a BMP file, which has no alpha."""
    d = pictures(spark, sf_dir).withColumn("file", images.encode("Image")).withColumn("back", images.decode("file.data"))
    d = d.withColumn("bmp", images.encode("Image", "image/bmp")).withColumn("rgb", images.decode("bmp.data"))
    return d.select("vec_id", "back.width", "back.height", "file.media_type", F.hex("back.data").alias("pixels"),
                    F.col("bmp.media_type").alias("other_type"), F.hex("rgb.data").alias("other_pixels"))


@query
def image_formats(spark, sf_dir):
    """The pixels of a picture after a GIF file and back, and how far a JPEG file's are away: 3 a channel at most."""
    d = pictures(spark, sf_dir).withColumn("gif", images.encode("Image", "image/gif")).withColumn("a", images.decode("gif.data"))
    d = d.withColumn("jpeg", images.encode("Image", "image/jpeg", 100)).withColumn("b", images.decode("jpeg.data"))
    byte = lambda c, i: F.conv(F.substring(F.hex(c), 2 * i + 1, 2), 16, 10).cast("int")
    apart = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: F.abs(byte("a.data", i) - byte("b.data", i)))
    return d.select("vec_id", "gif.media_type", F.hex("a.data").alias("pixels"), F.col("jpeg.media_type").alias("other_type"),
                    F.col("b.width").alias("width"), F.col("b.height").alias("height"), (F.array_max(apart) <= 3).alias("near"))


#: What a table of candidate labels may hold, since it goes into the plan as numbers.
MOST_CANDIDATES = 1_000


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text embedding per label: the mean of its vectors, by position. Ten rows of sums per task are shuffled."""
    rows = vectors(spark, sf_dir).select("label", F.posexplode("e").alias("pos", "x"))
    means = rows.groupBy("label", "pos").agg(F.avg("x").alias("x")).groupBy("label")
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("t"))


def zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, candidate, cosine and probability. The candidates are a bounded list and part of the plan."""
    table = candidates(spark, sf_dir).orderBy("label").limit(MOST_CANDIDATES + 1).collect()
    if len(table) > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidate labels")
    texts = F.array(*[F.array(*map(F.lit, r["t"])) for r in table])
    names = F.array(*[F.lit(r["label"]) for r in table])
    cosines = V.let(F.col("e"), lambda e: F.transform(texts, lambda t: V.cosine(e, t)))
    d = vectors(spark, sf_dir).withColumn("cos", cosines)
    d = d.withColumn("p", V.softmax(F.transform("cos", lambda c: 100 * c)))
    each = F.transform("cos", lambda c, i: F.struct(F.get(names, i).alias("candidate"), c.alias("cos"), F.get("p", i).alias("p")))
    return d.select("vec_id", F.inline(each))


@query
def zero_shot_scores(spark, sf_dir):
    return zero_shot(spark, sf_dir).select("vec_id", "candidate", F.round("cos", 5).alias("cosine"),
                                           F.round("p", 4).alias("probability"))


@query
def zero_shot_topk(spark, sf_dir):
    order = Window.partitionBy("vec_id").orderBy(F.desc("p"), "candidate")
    d = zero_shot(spark, sf_dir).select("vec_id", "candidate", "p").withColumn("rank", F.row_number().over(order))
    return d.where("rank <= 3").select("vec_id", "rank", "candidate")


def masks() -> Column:
    return F.array(*[F.slice("e", 1 + 16 * i, 16) for i in range(3)])


@query
def best_mask(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("iou", F.slice("e", 49, 3)).withColumn("m", V.best_mask(masks(), F.col("iou")))
    return flat(d, V.binarize(F.col("m")).cast("array<double>"), 1)


@query
def mask_foreground(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("m", masks())
    rows = d.select("vec_id", F.posexplode("m").alias("mask", "v"))
    return rows.select("vec_id", "mask", F.size(F.filter(V.binarize(F.col("v")), lambda x: x == 1)).alias("pixels"))


@query
def greedy_decode(spark, sf_dir):
    """Ids from start 0 to the end marker 7, at most 6, by 8 x 8 next-token scores."""

    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            tables = [np.asarray(e, dtype=np.float64).reshape(8, 8) for e in s]
            yield pd.Series([" ".join(map(str, tasks.greedy(lambda ids, t=t: t[ids[-1]], [0], 7, 6))) for t in tables], dtype=object)

    return vectors(spark, sf_dir).select("vec_id", F.pandas_udf(walk, "string")("e").alias("tokens"))


@query
def chat_last_user(spark, sf_dir):
    return chat.last_user(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def chat_route(spark, sf_dir):
    """Messages whose text starts with an even turn carry an image."""
    parts = lambda kind, data, text: F.struct(kind.alias("media_type"), data.alias("data"), text.alias("text"))
    none = F.lit(None)
    words = parts(F.lit("text/plain"), none.cast("binary"), F.col("text"))
    image = parts(F.lit("image/png"), F.lit("x").cast("binary"), none.cast("string"))
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    d = d.withColumn("contents", F.when(F.col("turn") % 4 == 0, F.array(image, words)).otherwise(F.array(words)))
    return chat.route(d).select("conv_id", "question", "route")


def toy_tokenizer() -> tokenize.ClipTokenizer:
    symbols = tokenize.byte_symbols()
    vocab = {s: i for i, s in enumerate([*symbols, *(s + "</w>" for s in symbols), "th", "the</w>", "an", "in"])}
    return tokenize.ClipTokenizer(vocab, [("t", "h"), ("th", "e</w>"), ("a", "n"), ("i", "n")])


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", tokenize.encode("text", toy_tokenizer()).alias("ids"))


@query
def tokenize_clip(spark, sf_dir):
    """All 77 ids of every document; null for a null text."""
    return tokenized(spark, sf_dir).select("doc_id", F.array_join("ids", " ").alias("ids"))


@query
def attention_mask(spark, sf_dir):
    d = tokenized(spark, sf_dir).withColumn("mask", V.attention_mask(F.col("ids")))
    return d.select("doc_id", F.array_join("mask", "").alias("mask"), V.eos_position(F.col("mask")).alias("last"))


#: Pieces at the beginning of words and inside them, of few letters, so that every word of the documents has several.
HEADS = ["[UNK]", *"etaoinshrdlucmwfgypbvk", "th", "an", "er", "ed", "ti", "thin", "ander", "the"]
INSIDE = [*"etaoinshrdlucmwfgypbvk", "he", "nd", "er", "ion", "tion", "ing", "thion", "re", "ndth"]


@query
def wordpiece(spark, sf_dir):
    """Pieces of every word of all documents, longest first: how many, how many words can't be cut, and all ids."""
    words = tokenize.WordPieceTokenizer([*HEADS, *("##" + p for p in INSIDE)])
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokenize.pieces("text", words).alias("ids"))
    unknown = F.size(F.filter("ids", lambda i: i == 0))
    return d.select("doc_id", F.size("ids").alias("pieces"), unknown.alias("unknown"), F.md5(F.array_join("ids", " ").cast("binary")).alias("ids"))


def text_model() -> bytes:
    """One number for each of the tokens "the", "an" and "in", and a fourth that is 1 for any token, summed up over a text."""
    w = np.zeros((49408, 4), np.float32)
    w[[513, 514, 515], [0, 1, 2]] = 1
    w[:, 3] = 1
    return toy_onnx.model(
        [toy_onnx.node("Gather", ["w", "ids"], ["t"]), toy_onnx.node("ReduceSum", ["t", "axis"], ["r"]), toy_onnx.node("Reshape", ["r", "s"], ["y"])],
        {"ids": [1, 77]}, {"y": [1, 4]}, {"w": w, "axis": np.array([1]), "s": np.array([1, 4])}, ("ids",),
    )


@query
def text_encode(spark, sf_dir):
    """Unit embeddings of all texts by a model that counts three tokens."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    v = tasks.encode_text("text", text_model(), toy_tokenizer(), 4)
    d = d.select("doc_id", F.posexplode(v).alias("pos", "value"))
    return d.withColumn("value", F.round("value", 4))


@query
def scheduler_sigmas(spark, sf_dir):
    return diffusion.schedule(spark, 20).withColumn("sigma", F.round("sigma", 5))


@query
def scheduler_requests(spark, sf_dir):
    """A schedule for every row of a table of requests, each of its own number of steps."""
    d = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.inline(diffusion.schedule_of(F.col("item_id") % 30)))
    return d.withColumn("sigma", F.round("sigma", 5))


@query
def euler_step(spark, sf_dir):
    d = flat(vectors(spark, sf_dir), V.euler_step(F.slice("e", 1, 32), F.slice("e", 33, 32), SIGMA, SIGMA_AFTER))
    return d


@query
def scale_model_input(spark, sf_dir):
    return flat(vectors(spark, sf_dir), V.scale_input(F.col("e"), SIGMA))


@query
def cfg_combine(spark, sf_dir):
    return flat(vectors(spark, sf_dir), V.guided(F.col("e"), GUIDANCE))


@query
def cosine_pairs(spark, sf_dir):
    """All pairs; the fourth digit is rounded half away from zero in the number's own arithmetic, as SQL does."""
    c = F.col("cosine")
    return neighbours.all_pairs(vectors(spark, sf_dir)).withColumn("cosine", F.signum(c) * F.floor(F.abs(c) * 10000 + 0.5) / 10000 + 0.0)


@query
def cosine_topk_neighbors(spark, sf_dir):
    """The three nearest others of every vector: no pair leaves a task that isn't among the best of a block."""
    return neighbours.nearest(vectors(spark, sf_dir)).withColumn("cosine", F.round("cosine", 5))


def scorer(out: list[int], batch: int | str = "batch") -> onnx.Scorer:
    return onnx.Scorer(toy_onnx.reshaping([64], out, batch), (64,))


def scored(spark: SparkSession, sf_dir: str, out: list[int], batch: int | str = "batch") -> DataFrame:
    d = vectors(spark, sf_dir).withColumn("s", onnx.score(F.col("e").cast("array<float>"), scorer(out, batch)))
    return d.withColumn("e", V.doubles("s.raw"))


@query
def onnx_score(spark, sf_dir):
    d = scored(spark, sf_dir, [64], 1)
    return d.select("vec_id", F.size("e").alias("n"), F.element_at("s.dims", -1).alias("width"), F.round(V.total(F.col("e")), 4).alias("total"))


@query
def onnx_classify(spark, sf_dir):
    d = scored(spark, sf_dir, [64]).withColumn("p", V.ranked(V.softmax("e"), label_column(), 1))
    return d.select("vec_id", V.top_label(F.col("p")).alias("predicted"))


@query
def onnx_embed(spark, sf_dir):
    d = scored(spark, sf_dir, [4, 16]).withColumn("m", V.mean_pool("e", 16))
    return flat(d, V.l2_normalize("m"))


@query
def onnx_detect(spark, sf_dir):
    d = scored(spark, sf_dir, [8, 8])
    return box_rows(d, B.suppress(decoded(), 0.45))


@query
def onnx_segment(spark, sf_dir):
    return flat(scored(spark, sf_dir, [4, 4, 4]), class_ids(), None)


@query
def onnx_depth(spark, sf_dir):
    return flat(scored(spark, sf_dir, [8, 8]).withColumn("d", V.depth_map("e", 8, 8)), F.col("d.values"))


@query
def score_table(spark, sf_dir):
    """The scoring table operation: raw scores beside the other columns, and a row id."""
    d = vectors(spark, sf_dir).withColumn("t", F.col("e").cast("array<float>"))
    d = onnx.with_row_id(onnx.with_scores(d, "t", scorer([64])))
    return d.select("vec_id", "label", F.posexplode(F.slice("RawScores", 1, 4)).alias("pos", "value")).withColumn("value", F.round(F.col("value").cast("double"), 4))


@query
def depth_at(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("d", V.depth_map("e", 8, 8))
    return d.select("vec_id", F.round(V.pixel_at(F.col("d.values"), 5, 2, 8, 8), 5).alias("depth"))


@query
def vae_scale(spark, sf_dir):
    return flat(vectors(spark, sf_dir), diffusion.vae_input(F.col("e")), 4)


@query
def pixel_bytes(spark, sf_dir):
    """4 x 4 pixels of the first 48 numbers."""
    return flat(vectors(spark, sf_dir), diffusion.pixel_bytes(F.transform("e", lambda x: 4 * x), 4, 4), None)


@query
def guided_batch(spark, sf_dir):
    """An embedding behind that of no prompt, and the ids that stand for a prompt without a vocabulary."""
    both = diffusion.doubled(F.transform(F.slice("e", 1, 4), lambda x: x * 0), F.slice("e", 1, 4))
    ids = diffusion.unguided_ids(tokenize.SOT, tokenize.EOT, tokenize.LENGTH)
    return flat(vectors(spark, sf_dir).withColumn("ids", ids).where(F.col("ids") == F.array(*map(F.lit, tokenize.fallback_ids()))), both)


@query
def task_classify(spark, sf_dir):
    """The whole task on pictures: the tensor is the model's output, so the top class is the largest input."""
    t = tasks.Task(toy_onnx.reshaping([3, 4, 4], [48]), TINY)
    d = tasks.classify(pictures(spark, sf_dir), t, 2).select("vec_id", F.posexplode("Predictions").alias("rank", "p"))
    return d.select("vec_id", "rank", "p.class_id", F.round("p.probability", 4).alias("probability"))


@query
def task_segment(spark, sf_dir):
    t = tasks.Task(toy_onnx.reshaping([3, 4, 4], [12, 2, 2]), TINY)
    d = tasks.segment(pictures(spark, sf_dir), t)
    return d.select("vec_id", "SegmentationMask_Width", "SegmentationMask_Height", F.posexplode("SegmentationMask").alias("pos", "class_id"))


@query
def task_depth(spark, sf_dir):
    """Depths of 12 x 4, brought back to the picture's 4 x 4, in steps of a 200th that no simple fraction stands at.

    Tensor and depths are of single precision, as the model's input is and the task's depths are."""
    t = tasks.Task(toy_onnx.reshaping([3, 4, 4], [12, 4]), TINY)
    d = tasks.estimate_depth(pictures(spark, sf_dir), t)
    d = d.select("vec_id", F.round(F.col("Depth.min_depth").cast("double"), 3).alias("low"), F.posexplode("DepthMap").alias("pos", "value"))
    return d.withColumn("value", F.floor(200 * F.col("value") + 0.37).cast("int"))


@query
def task_embed(spark, sf_dir):
    """Unit embeddings of the first 16 numbers."""
    t = tasks.Task(toy_onnx.reshaping([3, 4, 4], [3, 16]), TINY)
    return flat(tasks.embed(pictures(spark, sf_dir), t), F.col("Embedding").cast("array<double>"), 3)


@query
def task_detect(spark, sf_dir):
    """Eight boxes of two classes, suppressed."""
    t = tasks.Task(toy_onnx.reshaping([3, 4, 4], [6, 8]), TINY)
    d = tasks.detect(pictures(spark, sf_dir), t)
    rows = d.select("vec_id", F.col("DetectedObjects_Count").alias("boxes"), F.posexplode("DetectedObjects_Boxes").alias("pos", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 3) + 0.0)


@query
def task_zero_shot(spark, sf_dir):
    t = tasks.Task(toy_onnx.reshaping([3, 4, 4], [48]), TINY, labels=("first", "second", "third"))
    d = tasks.zero_shot(pictures(spark, sf_dir), t, np.eye(48)[:3].tolist())
    return d.select("vec_id", F.col("PredictedLabel").alias("predicted"), F.size("Predictions").alias("n"))


def captioner() -> tuple[bytes, tokenize.WordPieceTokenizer]:
    """A decoder that says "a cat" or "a dog", or that word alone for a question, as the first number it sees is positive or not."""
    step, sees = np.zeros((8, 8), np.float32), np.zeros((48, 8), np.float32)
    for a, b in ((1, 3), (3, 4), (3, 5), (4, 2), (2, 4), (2, 5), (5, 2)):
        step[a, b] = 1
    sees[0, 4], sees[0, 5] = 0.1, -0.1
    decoder = toy_onnx.model(
        [toy_onnx.node("Gather", ["w", "ids"], ["g"]), toy_onnx.node("MatMul", ["x", "m"], ["b"]), toy_onnx.node("Reshape", ["b", "s"], ["c"]),
         toy_onnx.node("Add", ["g", "c"], ["y"])],
        {"ids": ["batch", "n"], "x": ["batch", 48]}, {"y": ["batch", "n", 8]}, {"w": step, "m": sees, "s": np.array([0, 1, 8])}, ("ids",),
    )
    return decoder, tokenize.WordPieceTokenizer(["[PAD]", "[B]", "[E]", "a", "cat", "dog", "what", "##s"])


@query
def task_caption(spark, sf_dir):
    """Captions, and one word where there is a question: what is said after the first is the end marker."""
    decoder, words = captioner()
    d = pictures(spark, sf_dir).withColumn("question", F.when(F.col("vec_id") % 2 == 0, "what"))
    d = tasks.caption(d, tasks.Task(toy_onnx.reshaping([3, 4, 4], [48]), TINY), decoder, words, "question", 10, 1, 2)
    return d.select("vec_id", F.col("Caption").alias("caption"))


def messages_of(d: DataFrame) -> DataFrame:
    """Messages of which every fourth turn shows a picture of one shade."""
    shade = F.lpad(F.hex((F.col("conv_id") * 37) % 256), 2, "0")
    d = d.withColumn("file", images.encode(images.from_pixels(F.lit(4), F.lit(4), F.unhex(F.repeat(shade, 64)))))
    parts = lambda kind, data, text: F.struct(kind.alias("media_type"), data.alias("data"), text.alias("text"))
    words = parts(F.lit("text/plain"), F.lit(None).cast("binary"), F.when(F.col("turn") % 8 != 0, F.lit("what")))
    image = parts(F.col("file.media_type"), F.col("file.data"), F.lit(None).cast("string"))
    return d.withColumn("contents", F.when(F.col("turn") % 4 == 0, F.array(image, words)).otherwise(F.array(words)))


def adapter() -> chat.ChatAdapter:
    decoder, tokens = captioner()
    return chat.ChatAdapter(tasks.Task(toy_onnx.reshaping([3, 4, 4], [48]), TINY), decoder, tokens, 10, 1, 2)


@query
def chat_reply(spark, sf_dir):
    """Replies to the last user message of each conversation."""
    return adapter().reply(messages_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@query
def chat_stream(spark, sf_dir):
    """The same replies by a stream: the messages arrive in an order of their own, some files at a time, and of a
    conversation's replies the one to the latest turn counts."""
    arrived, out, done = (stream.shared_folder(spark, f"chat-{x}") for x in ("messages", "replies", "checkpoint"))
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    d.repartition(6, F.xxhash64("conv_id", "turn")).write.parquet(arrived)
    come = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(arrived)
    stream.run_available(come, lambda s: adapter().reply_stream(messages_of(s)), out, done)
    return spark.read.parquet(out).groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text"))


def segmenter() -> bytes:
    """Three masks, moved by the prompt's first coordinate, with fixed qualities."""
    return toy_onnx.model(
        [toy_onnx.node("Gather", ["p", "zero"], ["q"]), toy_onnx.node("Reshape", ["q", "flat"], ["f"]), toy_onnx.node("Gather", ["f", "zero"], ["a"]),
         toy_onnx.node("Sub", ["x", "a"], ["masks"]), toy_onnx.node("Identity", ["c"], ["iou"])],
        {"x": [1, 3, 4, 4], "p": [1, "n", 2]}, {"masks": [1, 3, 4, 4], "iou": [1, 3]},
        {"c": np.array([[0.25, 0.75, 0.75]], np.float32), "zero": np.array(0), "flat": np.array([-1])},
    )


@query
def task_segment_prompts(spark, sf_dir):
    """The best of three masks for several prompts of one encoding: a point each at x = 0 and 1, and the picture's middle."""
    d = tasks.encode_images(pictures(spark, sf_dir), tasks.Task(toy_onnx.reshaping([3, 4, 4], [3, 4, 4]), TINY))
    d = tasks.with_prompts(d, tasks.point(0, 1), tasks.point(1, 3), tasks.center(F.col("Image")))
    d = tasks.segment_prompts(d, segmenter())
    pixels = F.size(F.filter("SegmentAnythingMask", lambda x: x > 0))
    return d.select("vec_id", F.col("PromptIndex").alias("prompt"), pixels.alias("pixels"), F.col("SegmentAnythingMask_IoU").cast("double").alias("iou"))


@query
def segment_prompt_table(spark, sf_dir):
    """A table of prompts: every event asks about the picture of its user, at x = 0, 1 or 2; there may be no such picture."""
    d = tasks.encode_images(pictures(spark, sf_dir), tasks.Task(toy_onnx.reshaping([3, 4, 4], [3, 4, 4]), TINY))
    at = F.struct((F.col("event_id") % 3).cast("float").alias("x"), F.lit(1.0).cast("float").alias("y"))
    prompt = F.struct(F.array(at).alias("points"), F.array(F.lit(1.0).cast("float")).alias("labels"), F.lit(None).cast("array<float>").alias("previous_mask"))
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("vec_id"), prompt.alias("Prompt"))
    d = tasks.segment_table(d.select("vec_id", "Encoding", "Image"), asked, segmenter(), "vec_id", "event_id")
    pixels = F.size(F.filter("SegmentAnythingMask", lambda x: x > 0))
    return d.select("event_id", "vec_id", pixels.alias("pixels"), F.col("SegmentAnythingMask_IoU").cast("double").alias("iou"))


def painter() -> tasks.Generator:
    """Red, green and blue for the tokens "the", "an" and "in". One step over the first noise level removes the noise."""
    noise = diffusion.sigmas(1)[1][0]
    text = toy_onnx.model([toy_onnx.node("Gather", ["w", "ids"], ["y"])], {"ids": [1, 77]}, {"y": [1, 77, 4]},
                          {"w": np.eye(49408, 4, -513, np.float32)}, ("ids",))
    unet = toy_onnx.model(
        [toy_onnx.node("ReduceSum", ["e", "axis"], ["r"]), toy_onnx.node("Min", ["r", "one"], ["m"]), toy_onnx.node("Reshape", ["m", "s"], ["c"]),
         toy_onnx.node("Mul", ["x", "k"], ["n"]), toy_onnx.node("Add", ["n", "c"], ["y"])],
        {"x": [2, 4, 2, 2], "t": [1], "e": [2, 77, 4]}, {"y": [2, 4, 2, 2]},
        {"axis": np.array([1]), "one": np.array([1], np.float32), "s": np.array([2, 4, 1, 1]), "k": np.array([np.sqrt(noise**2 + 1) / noise], np.float32)},
        ("t",),
    )
    grow = np.kron(np.eye(2), np.ones((1, 8)))
    shade = -0.5 * diffusion.VAE_SCALE / (GUIDANCE * noise)
    vae = toy_onnx.model(
        [toy_onnx.node("Reshape", ["x", "flat"], ["f"]), toy_onnx.node("MatMul", ["f", "w"], ["g"]), toy_onnx.node("Reshape", ["g", "s"], ["y"])],
        {"x": [1, 4, 2, 2]}, {"y": [1, 3, 16, 16]},
        {"flat": np.array([1, 16]), "w": (shade * np.kron(np.eye(4, 3), np.kron(grow, grow))).astype(np.float32), "s": np.array([1, 3, 16, 16])},
    )
    return tasks.Generator(text, unet, vae, toy_tokenizer(), 1, GUIDANCE, (16, 16))


@query
def task_generate(spark, sf_dir):
    """A picture for every text: its size, its first pixel (blue, green, red, alpha), and whether all are alike."""
    d = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    d = tasks.generate(d, painter(), "text")
    pixels = F.hex("Image.data")
    first = F.substring(pixels, 1, 8)
    return d.select("item_id", "Image.width", "Image.height", first.alias("first"), (pixels == F.repeat(first, 256)).alias("plain"))


@query
def prompt_noise(spark, sf_dir):
    """Starting noise for every prompt, 2 x 2 of 4 channels, by its id: the same in any partitioning, and in SQL."""
    d = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.posexplode(diffusion.noise(F.col("item_id"), 16)).alias("pos", "value"))
    return d.withColumn("value", F.round("value", 6))


@query
def detections_udtf(spark, sf_dir):
    """Detections as a table function, called laterally from SQL: the boxes of task_detect, a row each."""
    fanout.register(spark)
    d = onnx.with_tensor(pictures(spark, sf_dir), "Image", TINY).select("vec_id", "PreprocessedTensor")
    d.createOrReplaceTempView("tessera_tensors")
    digits = ", ".join(f"round({c}, 3) + 0.0 AS {c}" for c in ("x", "y", "width", "height", "score"))
    call = "detections(PreprocessedTensor, classes => 2, boxes => 8, labels => 'cat,dog')"
    return spark.sql(f"SELECT vec_id, place, class_id, label, {digits} FROM tessera_tensors, LATERAL {call}")


@query
def image_folder(spark, sf_dir):
    """Every picture as a file of a folder, and the folder as a table again."""
    spark.dataSource.register(files.ImageFiles)
    folder = stream.shared_folder(spark, "pictures")
    d = pictures(spark, sf_dir).select(F.format_string("%d/%d.png", F.col("vec_id") % 7, F.col("vec_id")).alias("name"), images.encode("Image")["data"].alias("data"))
    d.write.format("image_files").mode("append").save(folder)
    back = spark.read.format("image_files").load(folder).withColumn("image", images.decode("data"))
    vec_id = F.regexp_extract("name", "([0-9]+)[.]png$", 1).cast("long")
    return back.select(vec_id.alias("vec_id"), "name", "image.width", "image.height", F.hex("image.data").alias("pixels"))


@query
def event_windows(spark, sf_dir):
    """The windowed counts of streams, over a table that is all there."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    d = stream.windowed_counts(events, "event_type")
    return d.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")
