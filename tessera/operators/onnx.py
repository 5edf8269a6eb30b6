"""ONNX scoring as columns: one session per Python worker and model, whole Arrow batches where the model allows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Preprocess
from tessera.functions import kernels
from tessera.schema import SCORED

CPU = "CPUExecutionProvider"
#: A provider's name, or its name and options such as device_id.
Provider = str | tuple[str, dict]

_sessions: dict[tuple, object] = {}
_shipped: dict[tuple[str, bytes], Model] = {}


@dataclass(frozen=True)
class Model:
    """A model on its way to the workers, in broadcasts: its bytes, and those of the files that it keeps weights in, by
    the names that it calls them. The key is a digest of all of them and names the worker's session, so that models
    whose files have one name are different models."""

    key: str
    data: Broadcast
    external: Broadcast | None = None

    def source(self) -> bytes:
        return self.data.value

    def files(self) -> dict[str, bytes]:
        return self.external.value if self.external is not None else {}


def checked(path: str) -> Path:
    """An empty path and a missing file are errors at once."""
    if not path:
        raise ValueError("a model needs a path")
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    return Path(path)


def read_model(path: str) -> bytes:
    """A model file's bytes, on the driver."""
    return checked(path).read_bytes()


def ship(spark: SparkSession, path: str, external_data: bool = False) -> Model:
    """A model file, sent to every node once; with external data the other files of its folder go along.

    Nothing is written to a node's disk but Spark's own broadcasts, and no name of a file matters.
    """
    file = checked(path)
    data, beside = file.read_bytes(), {}
    if external_data:
        others = sorted(f for f in file.parent.rglob("*") if f.is_file() and f.suffix != ".onnx")
        beside = {f.relative_to(file.parent).as_posix(): f.read_bytes() for f in others}
    digest = hashlib.sha256(data)
    for name, content in beside.items():
        digest.update(f"{name}:{len(content)}:".encode() + content)
    sent = spark.sparkContext.broadcast
    return Model(digest.hexdigest(), sent(data), sent(beside) if beside else None)


def shipped(model: bytes | Model) -> bytes | Model:
    """The bytes of a model as a broadcast of the active session, one for all columns that use it."""
    spark = SparkSession.getActiveSession()
    if isinstance(model, Model) or spark is None:
        return model
    at = (spark.sparkContext.applicationId, model)
    if at not in _shipped:
        _shipped[at] = Model(hashlib.sha256(model).hexdigest(), spark.sparkContext.broadcast(model))
    return _shipped[at]


def session(model: bytes | Model, providers: tuple[Provider, ...] = (CPU,), fallback: bool = True):
    """The worker's session for a model; providers that are missing give way to the CPU if fallback is set."""
    import onnxruntime as ort

    key = (model.key if isinstance(model, Model) else model, repr(providers), fallback)
    if key not in _sessions:
        name = lambda p: p if isinstance(p, str) else p[0]
        there = [p for p in providers if name(p) in ort.get_available_providers()]
        if len(there) < len(providers) and not fallback:
            raise RuntimeError(f"no such execution provider: {[name(p) for p in providers if p not in there]}")
        if fallback and CPU not in map(name, there):
            there.append(CPU)
        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        files = model.files() if isinstance(model, Model) else {}
        if files:
            options.add_external_initializers_from_files_in_memory(list(files), list(files.values()), list(map(len, files.values())))
        _sessions[key] = ort.InferenceSession(model.source() if isinstance(model, Model) else model, options, providers=there)
    return _sessions[key]


@dataclass(frozen=True)
class ModelInfo:
    """Names and shapes of inputs and outputs; -1 is a dynamic axis."""

    input_names: tuple[str, ...]
    input_shapes: tuple[tuple[int, ...], ...]
    output_names: tuple[str, ...]
    output_shapes: tuple[tuple[int, ...], ...]

    @property
    def batch_dynamic(self) -> bool:
        return bool(self.input_shapes and self.input_shapes[0]) and self.input_shapes[0][0] == -1


def model_info(model: bytes | Model, providers: tuple[Provider, ...] = (CPU,), fallback: bool = True) -> ModelInfo:
    s = session(model, providers, fallback)
    shape = lambda x: tuple(d if isinstance(d, int) else -1 for d in x.shape)
    ins, outs = s.get_inputs(), s.get_outputs()
    return ModelInfo(
        tuple(x.name for x in ins), tuple(map(shape, ins)), tuple(x.name for x in outs), tuple(map(shape, outs))
    )


@dataclass(frozen=True)
class Scorer:
    """A model with the shape of one input row; what every scoring column is made from."""

    model: bytes | Model
    shape: tuple[int, ...]
    output: int = 0
    batch: int = 32
    providers: tuple[Provider, ...] = (CPU,)
    fallback: bool = True

    def run(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """One output per row: in batches for a dynamic first axis, else row by row."""
        if not rows:
            return []
        s = session(self.model, self.providers, self.fallback)
        first = s.get_inputs()[0]
        size = self.batch if not isinstance(first.shape[0], int) else 1
        out: list[np.ndarray] = []
        for at in range(0, len(rows), size):
            x = np.stack(rows[at : at + size]).astype(np.float32).reshape(-1, *self.shape)
            y = s.run(None, {first.name: x})[self.output]
            out += [np.asarray(part)[None] for part in y] if size > 1 else [np.asarray(y)]
        return out


def _raw(y: np.ndarray | None, row: object) -> dict:
    """What the model returned for a row: its numbers and dimensions, nulls without an input."""
    return {"raw": None, "dims": None} if y is None else {"raw": y.ravel().astype(np.float32), "dims": list(map(int, y.shape))}


def _outputs(values: list, scorer: Scorer, tensor: Callable, make: Callable) -> Iterator[pd.DataFrame]:
    """make(output or None, value) of every value. Tensors are built for one batch of the model at a time, and what is
    made of it goes on at once, so that a worker never holds the tensors of a whole Arrow batch."""
    for at in range(0, len(values), scorer.batch):
        part = values[at : at + scorer.batch]
        scored = iter(scorer.run([tensor(v) for v in part if v is not None]))
        yield pd.DataFrame([make(next(scored) if v is not None else None, v) for v in part])


def score(tensor: str | Column, scorer: Scorer) -> Column:
    """struct(raw, dims) of a column of flat tensors."""
    sent = replace(scorer, model=shipped(scorer.model))

    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield from _outputs(list(s), sent, lambda v: np.asarray(v, dtype=np.float32), _raw)

    return F.pandas_udf(udf, SCORED)(tensor)


def _pixels(row: dict, config: Preprocess) -> np.ndarray:
    return kernels.preprocess(kernels.rgb_of(row["data"], int(row["height"]), int(row["width"])), config)


def _pictures(pdf: pd.DataFrame) -> list[dict | None]:
    """Image structs by row; null where there is no picture."""
    return [r if r["data"] and r["height"] > 0 else None for r in pdf.to_dict("records")]


def preprocess(image: str | Column, config: Preprocess, step: int = 32) -> Column:
    """Flat (3, H, W) tensor of an image struct, null for a null or undecodable image."""

    def udf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            rows = _pictures(pdf)
            for at in range(0, len(rows), step):
                yield pd.Series([_pixels(r, config).ravel() if r else None for r in rows[at : at + step]], dtype=object)

    return F.pandas_udf(udf, "array<float>")(image)


def score_image(image: str | Column, config: Preprocess, scorer: Scorer, make: Callable = _raw, kind: str = SCORED) -> Column:
    """make(output or None, image) of an image struct, as a struct of type kind; the raw numbers by default.

    Neither tensor nor output leaves the worker unless make returns it.
    """
    sent = replace(scorer, model=shipped(scorer.model))

    def udf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _outputs(_pictures(pdf), sent, lambda r: _pixels(r, config), make)

    return F.pandas_udf(udf, kind)(image)


def with_scores(df: DataFrame, tensor: str, scorer: Scorer, output: str = "RawScores") -> DataFrame:
    """df with one more column of raw scores, the others as they are."""
    return df.withColumn(output, score(tensor, scorer)["raw"])


def with_tensor(df: DataFrame, image: str, config: Preprocess, output: str = "PreprocessedTensor") -> DataFrame:
    return df.withColumn(output, preprocess(image, config))


def with_row_id(df: DataFrame, output: str = "RowId") -> DataFrame:
    """df with an id for each row: unique and growing within a partition, not gapless."""
    return df.withColumn(output, F.monotonically_increasing_id())
