"""The catalog of image tasks, as pyspark.ml stages that can be saved, loaded and put into a Pipeline.

A stage names its model file and the other files of its options. Saved, it takes their contents along, so that it can be
loaded where none of them is; a digest of each, kept with the parameters, is checked then.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import replace
from pathlib import Path

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from tessera.config import PRESETS
from tessera.operators import tasks
from tessera.operators.onnx import checked, shipped
from tessera.operators.tokenize import ClipTokenizer, WordPieceTokenizer


#: Options that name files.
FILES = ("decoder", "text_model", "vocab", "merges")


class ImageTask(Transformer, MLReadable, MLWritable):
    """One task over an image column. Options are those of the task's function in tessera.operators.tasks, and
    ``size``, ``batch``, ``providers`` and ``labels`` of its Task."""

    task = Param(Params._dummy(), "task", "name of the task", TypeConverters.toString)
    model = Param(Params._dummy(), "model", "path of the model file", TypeConverters.toString)
    preset = Param(Params._dummy(), "preset", "preprocessing", TypeConverters.toString)
    imageCol = Param(Params._dummy(), "imageCol", "column of images", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "options as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, task=None, model=None, preset=None, imageCol="Image", options="{}") -> None:
        super().__init__()
        #: Contents of files that came with a saved stage.
        self.kept: dict[str, bytes] = {}
        self._setDefault(imageCol="Image", options="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    def contents(self) -> dict[str, bytes]:
        """The model and the files that options name, by what they are."""
        named = {"model": self.getOrDefault("model")} | {k: v for k, v in json.loads(self.getOrDefault("options")).items() if k in FILES}
        return {k: self.kept[k] if k in self.kept else checked(path).read_bytes() for k, path in named.items()}

    def _transform(self, df: DataFrame) -> DataFrame:
        more, files = json.loads(self.getOrDefault("options")), self.contents()
        more = {k: v for k, v in more.items() if k not in FILES}
        size, config = more.pop("size", None), PRESETS[self.getOrDefault("preset")]
        own = {k: more.pop(k) for k in ("batch", "providers", "fallback", "output_index") if k in more}
        if "providers" in own:
            own["providers"] = tuple(p if isinstance(p, str) else (p[0], p[1]) for p in own["providers"])
        if "output_index" in own:
            own["output"] = own.pop("output_index")
        task = tasks.Task(
            shipped(files["model"]), replace(config, size=tuple(size)) if size else config,
            self.getOrDefault("imageCol"), labels=tuple(more.pop("labels", ())), **own,
        )
        return _RUN[self.getOrDefault("task")](df, task, more, files)


class _Writer(MLWriter):
    """Parameters and digests as Spark keeps them, and beside them the files as a table, a row each."""

    def __init__(self, stage: ImageTask) -> None:
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:  # noqa: N802
        spark, files = SparkSession.getActiveSession(), self.stage.contents()
        digests = {k: hashlib.sha256(data).hexdigest() for k, data in files.items()}
        DefaultParamsWriter.saveMetadata(self.stage, path, spark, {"files": digests})
        spark.createDataFrame(list(files.items()), "name string, data binary").coalesce(1).write.parquet(f"{path}/files")


class _Reader(MLReader):
    def load(self, path: str) -> ImageTask:
        spark = SparkSession.getActiveSession()
        metadata, stage = DefaultParamsReader.loadMetadata(path, spark), ImageTask()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.kept = {r["name"]: bytes(r["data"]) for r in spark.read.parquet(f"{path}/files").collect()}
        found = {k: hashlib.sha256(data).hexdigest() for k, data in stage.kept.items()}
        if found != metadata["files"]:
            raise ValueError(f"the files of {path} are not those that were saved")
        return stage


def _zero_shot(df: DataFrame, task: tasks.Task, more: dict, files: dict[str, bytes]) -> DataFrame:
    tokenizer = ClipTokenizer.of(files["vocab"].decode("utf-8"), files["merges"].decode("utf-8"))
    text_model, dim = shipped(files["text_model"]), more.pop("dim")
    prompts = [more.get("prompt", "{}").format(x) for x in task.labels]
    more.pop("prompt", None)
    texts = tasks.text_embeddings(df.sparkSession, text_model, tokenizer, prompts, dim, task.providers, task.fallback)
    return tasks.zero_shot(df, task, texts, **more)


def _caption(df: DataFrame, task: tasks.Task, more: dict, files: dict[str, bytes]) -> DataFrame:
    tokenizer = WordPieceTokenizer(files["vocab"].decode("utf-8").splitlines(), more.pop("lower", True))
    return tasks.caption(df, task, shipped(files["decoder"]), tokenizer, **more)


def _segment_anything(df: DataFrame, task: tasks.Task, more: dict, files: dict[str, bytes]) -> DataFrame:
    """The prompt of each picture's middle."""
    decoder = shipped(files["decoder"])
    encoding, prompt = tasks.spare(df, "_encoding"), tasks.spare(df, "_prompt")
    d = tasks.encode_images(df, task, encoding).withColumn(prompt, tasks.center(df[task.image]))
    more = {"providers": task.providers, "fallback": task.fallback} | more
    return tasks.segment_prompts(d, decoder, encoding, prompt, task.image, **more).drop(encoding, prompt)


_RUN = {
    "classification": lambda df, t, more, files: tasks.classify(df, t, **more),
    "embedding": lambda df, t, more, files: tasks.embed(df, t, **more),
    "detection": lambda df, t, more, files: tasks.detect(df, t, **more),
    "segmentation": lambda df, t, more, files: tasks.segment(df, t, **more),
    "depth": lambda df, t, more, files: tasks.estimate_depth(df, t, **more),
    "zero_shot": _zero_shot, "captioning": _caption, "segment_anything": _segment_anything,
}


def _stage(task: str, preset: str, model: str, image: str, options: dict) -> ImageTask:
    return ImageTask(task=task, model=str(Path(checked(model)).resolve()), preset=preset, imageCol=image, options=json.dumps(options))


def image_classification(model: str, preset: str = "imagenet", image: str = "Image", **options: object) -> ImageTask:
    return _stage("classification", preset, model, image, options)


def image_embedding(model: str, preset: str = "clip", image: str = "Image", **options: object) -> ImageTask:
    return _stage("embedding", preset, model, image, options)


def object_detection(model: str, preset: str = "yolov8", image: str = "Image", **options: object) -> ImageTask:
    return _stage("detection", preset, model, image, options)


def image_segmentation(model: str, preset: str = "segformer", image: str = "Image", **options: object) -> ImageTask:
    return _stage("segmentation", preset, model, image, options)


def depth_estimation(model: str, preset: str = "dpt", image: str = "Image", **options: object) -> ImageTask:
    return _stage("depth", preset, model, image, options)


def zero_shot_classification(model: str, text_model: str, vocab: str, merges: str, labels: list[str], dim: int,
                             preset: str = "clip", image: str = "Image", **options: object) -> ImageTask:
    """Labels, put into a ``prompt`` such as "a photo of a {}" if one is given, are embedded once."""
    if not labels:
        raise ValueError("candidate labels are needed")
    more = {"text_model": str(checked(text_model)), "vocab": vocab, "merges": merges, "labels": list(labels), "dim": dim}
    return _stage("zero_shot", preset, model, image, more | options)


def image_captioning(model: str, decoder: str, vocab: str, preset: str = "git", image: str = "Image", **options: object) -> ImageTask:
    """Captions; with ``question``, the name of a text column, answers."""
    return _stage("captioning", preset, model, image, {"decoder": str(checked(decoder)), "vocab": vocab} | options)


def segment_anything(model: str, decoder: str, preset: str = "sam2", image: str = "Image", **options: object) -> ImageTask:
    return _stage("segment_anything", preset, model, image, {"decoder": str(checked(decoder)), "batch": 1} | options)
