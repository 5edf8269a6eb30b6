"""Adapters: embedding and picture generators with what is known of their models, and the cancelling of what runs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.config import PRESETS, Preprocess
from tessera.operators.onnx import model_info, read_model
from tessera.operators.tasks import Generator, Task, diffusion_models, embed, generate


@dataclass(frozen=True)
class Metadata:
    """The name of a model's file without its ending, and the width of its embeddings (-1: known by row only)."""

    provider: str
    model_id: str | None
    dimensions: int


@dataclass(frozen=True)
class EmbeddingAdapter:
    """Embeddings of an image column."""

    task: Task
    model_id: str | None = None
    pooling: str = "cls"
    normalize: bool = True

    @classmethod
    def of_file(cls, path: str, config: Preprocess = PRESETS["clip"], **more: object) -> EmbeddingAdapter:
        return cls(Task(read_model(path), config, **more), Path(path).stem)

    @property
    def metadata(self) -> Metadata:
        info = model_info(self.task.model, self.task.providers, self.task.fallback)
        return Metadata("onnx", self.model_id, info.output_shapes[self.task.output][-1])

    def generate(self, df: DataFrame, output: str = "Embedding") -> DataFrame:
        return embed(df, self.task, self.pooling, self.normalize, output)


@dataclass(frozen=True)
class GeneratorAdapter:
    """Pictures of a prompt column."""

    generator: Generator

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, external_data: bool = True, **more: object) -> GeneratorAdapter:
        return cls(Generator(**diffusion_models(spark, folder, external_data), **more))

    def generate(self, df: DataFrame, prompt: str = "Prompt", output: str = "Image") -> DataFrame:
        return generate(df, self.generator, prompt, output)


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that start inside carry a tag; cancel(spark, tag), from another thread, ends them between two rows."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)
