"""The image tasks: an image column in, typed result columns appended.

Each task is a function over a DataFrame: preprocess and score in one Arrow column, then column functions on the raw
numbers. Source columns stay as they are and nothing else is read. Null or undecodable images give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import PRESETS, Preprocess
from tessera.functions import kernels, runs
from tessera.functions import vectors as V
from tessera.functions.boxes import flatten
from tessera.functions.diffusion import VAE_SCALE, gaussian, sigmas, to_pixels
from tessera.operators.onnx import CPU, Model, Provider, Scorer, checked, model_info, score_image, session, ship, shipped
from tessera.operators.tokenize import ClipTokenizer, WordPieceTokenizer, fallback_ids
from tessera.schema import DEPTH, IMAGE, MASK, SAM_RESULT


@dataclass(frozen=True)
class Task:
    """What all tasks share: the model, its preprocessing, the image column and the size of a batch."""

    model: bytes | Model
    config: Preprocess
    image: str = "Image"
    batch: int = 32
    output: int = 0
    providers: tuple[Provider, ...] = (CPU,)
    fallback: bool = True
    labels: tuple[str, ...] = field(default=())

    def scorer(self) -> Scorer:
        return Scorer(self.model, (3, *self.config.size), self.output, self.batch, self.providers, self.fallback)

    def scores(self) -> Column:
        return score_image(F.col(self.image), self.config, self.scorer())

    def made(self, make, kind: str) -> Column:
        """make(output or None, image) in the worker that scored the image."""
        return score_image(F.col(self.image), self.config, self.scorer(), make, kind)

    def label_column(self) -> Column | None:
        return F.array(*map(F.lit, self.labels)) if self.labels else None


def spare(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def classify(df: DataFrame, task: Task, top_k: int | None = None, apply_softmax: bool = True,
             label: str = "PredictedLabel", probability: str = "Probability", details: str = "Predictions") -> DataFrame:
    """Columns details (label, probability, class_id), label and probability, most probable first."""
    scored = spare(df, "_scored")
    raw = F.col(scored)["raw"]
    p = V.softmax(raw) if apply_softmax else V.doubles(raw)
    out = df.withColumn(scored, task.scores()).withColumn(details, V.ranked(p, task.label_column(), top_k)).drop(scored)
    return _labelled(out, label, probability, details)


def _labelled(df: DataFrame, label: str, probability: str, details: str) -> DataFrame:
    p = F.coalesce(details, F.array().cast("array<struct<label:string,probability:double,class_id:int>>"))
    return df.withColumn(details, p).withColumns({
        label: V.top_label(F.col(details)),
        probability: F.transform(details, lambda x: x["probability"].cast("float")),
    })


def embed(df: DataFrame, task: Task, pooling: str = "cls", normalize: bool = True, output: str = "Embedding") -> DataFrame:
    """Embedding of the width of the model's last axis, pooled by the first row or by the mean."""
    declared = model_info(task.model, task.providers, task.fallback).output_shapes[task.output][-1]
    scored = spare(df, "_scored")
    dim, raw = F.lit(declared) if declared > 0 else F.element_at(F.col(scored)["dims"], -1), F.col(scored)["raw"]
    v = V.cls_pool(raw, dim) if pooling == "cls" else V.mean_pool(raw, dim)
    v = V.l2_normalize(v) if normalize else v
    empty = F.array().cast("array<float>")
    return df.withColumn(scored, task.scores()).withColumn(output, F.coalesce(v.cast("array<float>"), empty)).drop(scored)


BOXES = "array<struct<x:double,y:double,width:double,height:double,label:string,class_id:int,score:double>>"


def detect(df: DataFrame, task: Task, score: float = 0.5, iou: float = 0.45, most: int | None = None,
           output: str = "DetectedObjects", details: str = "Detections") -> DataFrame:
    """Detections, their six numbers each and their count. The boxes are decoded and suppressed in the worker that
    scored the image, whatever their number and whether the model declares it."""
    labels = task.labels

    def make(y: np.ndarray | None, image: dict | None) -> dict:
        if y is None:
            return {"found": []}
        stride, n = y.shape[-2:]
        return {"found": [
            {"x": x, "y": top, "width": w, "height": h, "label": labels[int(c)] if c < len(labels) else str(int(c)),
             "class_id": int(c), "score": p}
            for x, top, w, h, c, p in kernels.detect(y, stride - 4, n, score, iou, most)
        ]}

    df = df.withColumn(details, task.made(make, f"struct<found:{BOXES}>")["found"])
    return df.withColumns({f"{output}_Boxes": flatten(F.col(details)), f"{output}_Count": F.size(details)})


def segment_runs(df: DataFrame, task: Task, resize: bool = True, output: str = "SegmentationRuns") -> DataFrame:
    """Runs (class_id, length) of the mask, in the image's own size if resize is set; see tessera.functions.runs.

    The mask is resized by its runs, and no pixel of it leaves the worker.
    """

    def make(y: np.ndarray | None, image: dict | None) -> dict:
        if y is None:
            return {"runs": [], "width": 0, "height": 0}
        m, size = kernels.class_map(y, *y.shape[-3:]), (int(image["height"]), int(image["width"]))
        found, (height, width) = runs.runs_of(m), size if resize else m.shape
        if (height, width) != m.shape:
            found = runs.resized(*found, *m.shape, height, width)
        return {"runs": [{"class_id": int(c), "length": int(n)} for c, n in zip(*found, strict=True)], "width": width, "height": height}

    mask = spare(df, "_mask")
    parts = {output: "runs", f"{output}_Width": "width", f"{output}_Height": "height"}
    made = task.made(make, f"struct<runs:{runs.RUNS},width:int,height:int>")
    return df.withColumn(mask, made).withColumns({k: F.col(mask)[v] for k, v in parts.items()}).drop(mask)


def segment(df: DataFrame, task: Task, resize: bool = True, output: str = "SegmentationMask") -> DataFrame:
    """Class of every pixel, in the image's own size if resize is set."""
    labels = list(task.labels) or None

    def make(y: np.ndarray | None, image: dict | None) -> dict:
        if y is None:
            return {"class_ids": [], "width": 0, "height": 0, "labels": labels}
        m, size = kernels.class_map(y, *y.shape[-3:]), (int(image["height"]), int(image["width"]))
        m = kernels.nearest(m, *size) if resize and size != m.shape else m
        return {"class_ids": m.ravel(), "width": m.shape[1], "height": m.shape[0], "labels": labels}

    mask = spare(df, "_mask")
    parts = {output: "class_ids", f"{output}_Width": "width", f"{output}_Height": "height"}
    return df.withColumn(mask, task.made(make, MASK)).withColumns({k: F.col(mask)[v] for k, v in parts.items()}).drop(mask)


def estimate_depth(df: DataFrame, task: Task, resize: bool = True, output: str = "DepthMap", details: str = "Depth") -> DataFrame:
    """Relative depth in 0..1, in the image's own size if resize is set, with the raw extremes in details."""
    edge = task.config.edge

    def make(y: np.ndarray | None, image: dict | None) -> dict:
        if y is None:
            return {"values": [], "width": 0, "height": 0, "min_depth": None, "max_depth": None}
        d, low, high = kernels.depth(y.ravel(), *(y.shape[1:3] if y.ndim == 3 else y.shape[2:4]))
        size = (int(image["height"]), int(image["width"]))
        d = kernels.bilinear(d, *size, edge) if resize and size != d.shape else d
        return {"values": d.ravel(), "width": d.shape[1], "height": d.shape[0], "min_depth": low, "max_depth": high}

    df = df.withColumn(details, task.made(make, DEPTH))
    return df.withColumns({output: F.col(f"{details}.values"), f"{output}_Width": F.col(f"{details}.width"),
                           f"{output}_Height": F.col(f"{details}.height")})


def encode_text(text: str | Column, model: bytes | Model, tokenizer: ClipTokenizer, dim: int,
                providers: tuple[Provider, ...] = (CPU,), fallback: bool = True) -> Column:
    """Unit embedding of a text column: the model's row at the end marker, or its pooled output; null for a null."""
    sent = shipped(model)

    def one(text: str) -> np.ndarray:
        s, ids = session(sent, providers, fallback), np.array([tokenizer.encode(text)], dtype=np.int64)
        y = s.run(None, dict(zip((i.name for i in s.get_inputs()), (ids, (ids != 0).astype(np.int64)), strict=False)))[0]
        v = (y[0, int(np.flatnonzero(ids[0])[-1])] if y.ndim == 3 else y[0])[:dim].astype(np.float64)
        return v / n if (n := np.linalg.norm(v)) > 0 else v

    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else one(t) for t in s], dtype=object)

    return F.pandas_udf(udf, "array<double>")(text)


def text_embeddings(spark: SparkSession, model: bytes | Model, tokenizer: ClipTokenizer, texts: list[str], dim: int,
                    providers: tuple[Provider, ...] = (CPU,), fallback: bool = True) -> list[list[float]]:
    """Unit embeddings of candidate labels, once for all images: a few hundred numbers for each label that is named."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = rows.select("i", encode_text("text", model, tokenizer, dim, providers, fallback).alias("v")).orderBy("i").collect()
    return [r["v"] for r in found]


def zero_shot(df: DataFrame, task: Task, texts: list[list[float]], top_k: int | None = None, label: str = "PredictedLabel",
              probability: str = "Probability", details: str = "Predictions") -> DataFrame:
    """Predictions over candidate labels by scaled cosine to their text embeddings."""
    if not task.labels or len(task.labels) != len(texts):
        raise ValueError("every candidate label needs a text embedding")
    name = spare(df, "_v")
    v = F.col(name)
    out = df.withColumn(name, V.l2_normalize(F.slice(task.scores()["raw"], 1, len(texts[0]))))
    out = out.withColumn(details, F.when(v.isNotNull(), V.ranked(V.clip_scores(v, texts), task.label_column(), top_k)))
    return _labelled(out.drop(name), label, probability, details)


def greedy(step, prefix: list[int], eos: int, length: int) -> list[int]:
    """Ids after a prefix: the best next one (the first of equals) until the end marker or the length."""
    ids = list(prefix)
    for _ in range(length):
        scores = np.asarray(step(ids), dtype=np.float64)
        best = int(np.where(np.isnan(scores), -np.inf, scores).argmax())
        if best == eos:
            break
        ids.append(best)
    return ids[len(prefix) :]


def greedy_together(step, prefixes: list[list[int]], eos: int, length: int, pad: int = 0) -> list[list[int]]:
    """What greedy() gives for each prefix, all rows together: step(ids, last, rows) is called once for all that go on.

    ids are the prefixes so far, filled up on the right, last the place of each one's last id, and rows which of the
    prefixes they are; it returns the scores of the ids that may come next. A row that ends is left out from then on.
    The model must not look ahead of a place, so that what fills up can't matter.
    """
    ids, going = [list(p) for p in prefixes], list(range(len(prefixes)))
    for _ in range(length):
        if not going:
            break
        width = max(len(ids[r]) for r in going)
        x = np.full((len(going), width), pad, dtype=np.int64)
        for i, r in enumerate(going):
            x[i, : len(ids[r])] = ids[r]
        scores = np.asarray(step(x, np.array([len(ids[r]) - 1 for r in going]), going), dtype=np.float64)
        best = np.where(np.isnan(scores), -np.inf, scores).argmax(axis=1)
        for r, b in zip(going, best.tolist(), strict=True):
            if b != eos:
                ids[r].append(b)
        going = [r for r, b in zip(going, best.tolist(), strict=True) if b != eos]
    return [i[len(p) :] for i, p in zip(ids, prefixes, strict=True)]


def _decoded(s, seen: list[np.ndarray], prefixes: list[list[int]], eos: int, length: int, batch: int) -> list[list[int]]:
    """Ids behind each prefix by a decoder of (ids, encoding): in batches where both have a dynamic first axis and rows
    have encodings of one shape, else row by row."""
    inputs = s.get_inputs()
    names, together = [i.name for i in inputs], all(not isinstance(i.shape[0], int) for i in inputs)
    run = lambda ids, what: s.run(None, dict(zip(names, (ids, what), strict=False)))[0]
    out: list[list[int]] = [[] for _ in seen]
    groups: dict[tuple, list[int]] = {}
    for r, e in enumerate(seen):
        groups.setdefault(e.shape[1:] if together and e.shape[0] == 1 else (r, "alone"), []).append(r)
    for shape, rows in groups.items():
        for at in range(0, len(rows), batch):
            part = rows[at : at + batch]
            if shape[-1:] == ("alone",):
                step = lambda ids, r=part[0]: run(np.array([ids], dtype=np.int64), seen[r])[0, -1]
                out[part[0]] = greedy(step, prefixes[part[0]], eos, length)
                continue
            stacked = np.concatenate([seen[r] for r in part])
            step = lambda ids, last, going, stacked=stacked: run(ids, stacked[going])[np.arange(len(going)), last]
            for r, found in zip(part, greedy_together(step, [prefixes[r] for r in part], eos, length), strict=True):
                out[r] = found
    return out


def caption(df: DataFrame, task: Task, decoder: bytes | Model, tokenizer: WordPieceTokenizer, question: str | None = None,
            length: int = 50, bos: int = 101, eos: int = 102, output: str = "Caption") -> DataFrame:
    """A caption of every image, or an answer where question names a text column that isn't null.

    Rows are decoded together, as many as the task's batch: a decoder call for each id that the longest of them has.
    """
    sent, providers, fallback, batch = shipped(decoder), task.providers, task.fallback, task.batch

    def udf(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        s = session(sent, providers, fallback)
        for scored, asked in batches:
            out, raws, dims = [""] * len(asked), scored["raw"].to_list(), scored["dims"].to_list()
            there = [r for r, raw in enumerate(raws) if raw is not None]
            for at in range(0, len(there), batch):
                rows = there[at : at + batch]
                seen = [np.asarray(raws[r], dtype=np.float32).reshape(dims[r]) for r in rows]
                prefixes = [[bos] if q is None else tokenizer.question(q, length, bos, eos) for q in (asked.iloc[r] for r in rows)]
                for r, ids in zip(rows, _decoded(s, seen, prefixes, eos, length, batch), strict=True):
                    out[r] = tokenizer.decode(ids)
            yield pd.Series(out, dtype=object)

    asked = F.col(question) if question else F.lit(None).cast("string")
    return df.withColumn(output, F.pandas_udf(udf, "string")(task.scores(), asked))


def point(x: float, y: float, foreground: bool = True) -> Column:
    return points([(x, y)], [1.0 if foreground else 0.0])


def points(coords: list[tuple[float, float]], labels: list[float]) -> Column:
    """A prompt of several points; 1 is foreground, 0 background, 2 and 3 are the corners of a box."""
    if len(coords) != len(labels):
        raise ValueError("every point needs a label")
    rows = F.array(*[F.struct(F.lit(float(x)).cast("float").alias("x"), F.lit(float(y)).cast("float").alias("y")) for x, y in coords])
    return F.struct(rows.alias("points"), F.array(*[F.lit(float(v)).cast("float") for v in labels]).alias("labels"),
                    F.lit(None).cast("array<float>").alias("previous_mask"))


def box(x0: float, y0: float, x1: float, y1: float) -> Column:
    return points([(x0, y0), (x1, y1)], [2.0, 3.0])


def center(image: Column) -> Column:
    """The prompt of a picture's middle."""
    at = F.struct((image["width"] / 2).cast("float").alias("x"), (image["height"] / 2).cast("float").alias("y"))
    one = F.array(F.lit(1.0).cast("float"))
    return F.struct(F.array(at).alias("points"), one.alias("labels"), F.lit(None).cast("array<float>").alias("previous_mask"))


def encode_images(df: DataFrame, task: Task, output: str = "Encoding") -> DataFrame:
    """Image encodings to be kept (persisted, or written) and met by any number of prompts later."""
    return df.withColumn(output, task.scores())


def with_prompts(df: DataFrame, *prompts: Column, output: str = "Prompt", place: str = "PromptIndex") -> DataFrame:
    """A row for each image and prompt: several prompts, by their place, meet one encoding."""
    return df.select("*", F.posexplode(F.array(*prompts)).alias(place, output))


def segment_prompts(df: DataFrame, decoder: bytes | Model, encoding: str = "Encoding", prompt: str = "Prompt", image: str = "Image",
                    threshold: float = 0.0, output: str = "SegmentAnythingMask", details: str = "Segments",
                    providers: tuple[Provider, ...] = (CPU,), fallback: bool = True) -> DataFrame:
    """Masks of a prompt column over encodings: all of them in details, the best one flat.

    The decoder takes encoding, coordinates, labels, previous mask, whether there is one, and the original size, as
    far as it has inputs, and returns masks and predicted IoUs.
    """
    sent = shipped(decoder)

    def udf(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        s = session(sent, providers, fallback)
        for scored, asked, heights, widths in batches:
            rows = zip(scored["raw"], scored["dims"], asked.to_dict("records"), heights, widths, strict=True)
            yield pd.DataFrame([_masks(s, None if raw is None else np.asarray(raw, np.float32).reshape(dims), p, h, w, threshold) for raw, dims, p, h, w in rows])

    found = F.pandas_udf(udf, SAM_RESULT)(encoding, prompt, F.col(f"{image}.height"), F.col(f"{image}.width"))
    return _with_best(df.withColumn(details, found), output, details)


def _masks(s, seen: np.ndarray | None, prompt: dict, height: int, width: int, threshold: float) -> dict:
    """What a decoder says to one prompt about an encoding."""
    pts, prev = prompt["points"], prompt["previous_mask"]
    if seen is None or pts is None:
        return {"masks": [], "iou": [], "width": 0, "height": 0}
    xy = np.array([[[p["x"], p["y"]] for p in pts]], dtype=np.float32)
    old = np.zeros((1, 1, 256, 256), np.float32) if prev is None else np.asarray(prev, np.float32).reshape(1, 1, 256, 256)
    feeds = (seen, xy, np.array([prompt["labels"]], np.float32), old, np.array([prev is not None], np.float32), np.array([height, width], np.int64))
    masks, iou = s.run(None, dict(zip((i.name for i in s.get_inputs()), feeds, strict=False)))[:2]
    m = (masks.reshape(masks.shape[-3], -1) > threshold).astype(np.float32)
    return {"masks": list(m), "iou": iou.ravel(), "width": masks.shape[-1], "height": masks.shape[-2]}


def _with_best(df: DataFrame, output: str, details: str) -> DataFrame:
    best = V.argmax(f"{details}.iou")
    return df.withColumns({
        output: F.coalesce(F.get(f"{details}.masks", best), F.array().cast("array<float>")),
        f"{output}_Width": F.col(f"{details}.width"), f"{output}_Height": F.col(f"{details}.height"),
        f"{output}_IoU": F.get(f"{details}.iou", best),
    })


def sent_encodings(encodings: DataFrame, prompts: DataFrame, key: str, together: int) -> tuple[DataFrame, DataFrame]:
    """Encodings and prompts by key and salt: an encoding goes out once for every ``together`` prompts of its image,
    and not at all without one. An image that has very many prompts is so no single group."""
    counts = prompts.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / together).cast("int").alias("_salts"))
    dealt = encodings.join(counts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    asked = prompts.join(counts, key, "left").withColumn("_salt", F.pmod(F.xxhash64("_prompt_id"), F.coalesce("_salts", F.lit(1))).cast("int"))
    return dealt, asked.drop("_salts")


def segment_table(encodings: DataFrame, prompts: DataFrame, decoder: bytes | Model, key: str, prompt_id: str, encoding: str = "Encoding",
                  prompt: str = "Prompt", image: str = "Image", threshold: float = 0.0, together: int = 256, output: str = "SegmentAnythingMask",
                  details: str = "Segments", providers: tuple[Provider, ...] = (CPU,), fallback: bool = True) -> DataFrame:
    """key, prompt_id and masks of a table of prompts (key, prompt_id, prompt) about encoded images (key, encoding, image).

    Keys of images and ids of prompts are unique. Both sides are grouped by the key, so that an encoding, some megabytes,
    is met by all its prompts where it is sent to; see sent_encodings. A prompt for no image has no mask.
    """
    sent = shipped(decoder)
    size = lambda side: F.col(f"{image}.{side}").alias(side)
    pictures = encodings.select(F.col(key).cast("string").alias("key"), F.col(encoding).alias("seen"), size("height"), size("width"))
    asked = prompts.select(F.col(key).cast("string").alias("key"), F.col(prompt_id).cast("string").alias("_prompt_id"), F.col(prompt).alias("asked"))
    dealt, asked = sent_encodings(pictures, asked, "key", together)

    def answer(pictures: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        s, seen, size = session(sent, providers, fallback), None, (0, 0)
        if len(pictures) and pictures["seen"].iat[0] is not None and pictures["seen"].iat[0]["raw"] is not None:
            one = pictures.iloc[0]
            seen, size = np.asarray(one["seen"]["raw"], np.float32).reshape(one["seen"]["dims"]), (one["height"], one["width"])
        rows = [_masks(s, seen, {"points": None, "previous_mask": None} if p is None else p, *size, threshold) for p in asked["asked"]]
        return pd.DataFrame({"key": asked["key"].to_list(), "_prompt_id": asked["_prompt_id"].to_list(), details: rows})

    by = ["key", "_salt"]
    found = dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(answer, f"key string, _prompt_id string, `{details}` {SAM_RESULT}")
    kinds = dict(prompts.dtypes)
    found = found.select(F.col("key").cast(kinds[key]).alias(key), F.col("_prompt_id").cast(kinds[prompt_id]).alias(prompt_id), details)
    return _with_best(found, output, details)


@dataclass(frozen=True)
class Generator:
    """Text to image: text encoder, noise predictor and decoder, with steps, guidance and size."""

    text_encoder: bytes | Model
    unet: bytes | Model
    vae: bytes | Model
    tokenizer: ClipTokenizer | None = None
    steps: int = 20
    guidance: float = 7.5
    size: tuple[int, int] = (512, 512)
    seed: int = 0
    negative: str = ""
    providers: tuple[Provider, ...] = (CPU,)
    fallback: bool = True

    def _session(self, model: bytes | Model):
        return session(model, self.providers, self.fallback)

    def embedding(self, prompt: str) -> np.ndarray:
        ids = self.tokenizer.encode(prompt) if self.tokenizer else fallback_ids()
        s = self._session(self.text_encoder)
        return s.run(None, {s.get_inputs()[0].name: np.array([ids], dtype=np.int64)})[0]

    def generate(self, prompt: str, seed: int | None = None) -> np.ndarray:
        """(H, W, 4) bytes; nothing is kept between calls."""
        text = np.concatenate([self.embedding(self.negative), self.embedding(prompt)])
        times, levels = sigmas(self.steps)
        h, w = self.size
        x = gaussian((1, 4, h // 8, w // 8), self.seed if seed is None else seed, levels[0])
        s = self._session(self.unet)
        names = [i.name for i in s.get_inputs()]
        for i, t in enumerate(times):
            scaled = np.repeat(x / np.float32(np.sqrt(levels[i] ** 2 + 1)), 2, axis=0)
            u, c = np.split(s.run(None, dict(zip(names, (scaled, np.array([t], np.int64), text), strict=False)))[0], 2)
            x = (x + np.float32(levels[i + 1] - levels[i]) * (u + np.float32(self.guidance) * (c - u))).astype(np.float32)
        v = self._session(self.vae)
        return to_pixels(v.run(None, {v.get_inputs()[0].name: x / np.float32(VAE_SCALE)})[0][0])


def generate(df: DataFrame, generator: Generator, prompt: str = "Prompt", output: str = "Image") -> DataFrame:
    """An image struct (BGRA bytes) for every prompt; rows share nothing, so any order gives the same pictures."""
    sent = replace(generator, **{k: shipped(getattr(generator, k)) for k in ("text_encoder", "unet", "vae")})

    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for text in s:
                p = sent.generate(text or "")
                rows.append({"origin": "", "height": p.shape[0], "width": p.shape[1], "nChannels": 4, "mode": 24,
                             "data": np.ascontiguousarray(p[:, :, [2, 1, 0, 3]]).tobytes()})
            yield pd.DataFrame(rows)

    return df.withColumn(output, F.pandas_udf(udf, IMAGE)(prompt))


def diffusion_models(spark: SparkSession, folder: str, external_data: bool = True) -> dict[str, Model]:
    """The models of a diffusion folder (text_encoder, unet, vae_decoder, each a model.onnx), every file checked first."""
    paths = {k: str(Path(folder) / d / "model.onnx") for k, d in (("text_encoder", "text_encoder"), ("unet", "unet"), ("vae", "vae_decoder"))}
    for path in paths.values():
        checked(path)
    return {k: ship(spark, path, external_data) for k, path in paths.items()}


def task(model: bytes | Model, preset: str, **more: object) -> Task:
    """A task with a named preset's preprocessing."""
    size = more.pop("size", None)
    config = PRESETS[preset]
    return Task(model, replace(config, size=size) if size else config, **more)
