"""The Euler discrete schedule as a table of its own."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import let

#: Fixed values of the scaled-linear schedule.
BETA_START, BETA_END, TRAIN_STEPS = 0.00085, 0.012, 1000
VAE_SCALE = 0.18215


def sigmas(steps: int, start: float = BETA_START, end: float = BETA_END, train: int = TRAIN_STEPS) -> tuple[list[int], list[float]]:
    """Timesteps and noise levels, the last level 0; a pure function, so that runs share no state."""
    if steps < 1:
        raise ValueError("steps must be positive")
    betas = np.linspace(np.sqrt(start), np.sqrt(end), train) ** 2
    alive = np.cumprod(1 - betas)
    t = [int(train - 1 - i * train / steps) for i in range(steps)]
    return t, [float(np.sqrt((1 - alive[i]) / alive[i])) for i in t] + [0.0]


def schedule(spark: SparkSession, steps: int, start: float = BETA_START, end: float = BETA_END, train: int = TRAIN_STEPS) -> DataFrame:
    """step, t, sigma by a running sum of logarithms over the training steps, whose number is fixed."""
    i = F.col("id")
    root = F.lit(start**0.5) + i / (train - 1) * (end**0.5 - start**0.5)
    alive = F.exp(F.sum(F.log(1 - root * root)).over(Window.orderBy("id")))
    levels = spark.range(train).select(i.alias("t"), F.sqrt((1 - alive) / alive).alias("sigma"))
    chosen = spark.range(steps).select(i.cast("int").alias("step"), F.floor(train - 1 - i * train / steps).alias("t"))
    return chosen.join(levels, "t").select("step", F.col("t").cast("int").alias("t"), "sigma")


def schedule_of(steps: Column, start: float = BETA_START, end: float = BETA_END, train: int = TRAIN_STEPS) -> Column:
    """array of (step, t, sigma) for a column of numbers of steps, null below one: a schedule for each request.

    The training levels, whose number is fixed, are part of the plan; a row looks its own up.
    """
    alive = np.cumprod(1 - np.linspace(np.sqrt(start), np.sqrt(end), train) ** 2)
    levels = F.lit(np.sqrt((1 - alive) / alive).tolist())
    place = lambda i: F.floor(train - 1 - i * train / steps).cast("int")
    one = lambda i: F.struct(i.alias("step"), place(i).alias("t"), F.get(levels, place(i)).alias("sigma"))
    return F.when(steps > 0, F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(1)).cast("int") - 1), one))


def noise(seed: Column, n: int, sigma: float = 1.0) -> Column:
    """n numbers of Gaussian noise for a seed, as a column of the JVM; null for a null seed.

    Each number depends on its seed and place alone: two parts of the MD5 of "seed:place", 48 bits each, make a pair of
    uniform numbers, and those (Box and Muller) one of the bell. Any engine with MD5 gives the same.
    """
    part = lambda h, at: F.conv(F.substring(h, at, 12), 16, 10).cast("double")
    bell = lambda h: F.sqrt(-2 * F.log((part(h, 1) + 0.5) / 2**48)) * F.cos(2 * F.pi() * part(h, 13) / 2**48)
    one = lambda i: let(F.md5(F.concat(seed.cast("string"), F.lit(":"), i.cast("string")).cast("binary")), bell) * sigma
    return F.when(seed.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one))


def gaussian(shape: tuple[int, ...], seed: int, sigma: float = 1.0) -> np.ndarray:
    """The numbers of noise() for a seed, in this shape."""
    n = int(np.prod(shape))
    hexed = [hashlib.md5(f"{seed}:{i}".encode(), usedforsecurity=False).hexdigest() for i in range(n)]
    u, v = (np.array([int(h[at : at + 12], 16) for h in hexed], dtype=np.float64) for at in (0, 12))
    bell = np.sqrt(-2 * np.log((u + 0.5) / 2**48)) * np.cos(2 * np.pi * v / 2**48)
    return (bell * sigma).astype(np.float32).reshape(shape)


def to_pixels(tensor: np.ndarray) -> np.ndarray:
    """A (3, H, W) tensor in -1..1 as (H, W, 4) bytes, opaque."""
    rgb = (np.clip(tensor / 2 + 0.5, 0, 1) * 255).astype(np.uint8).transpose(1, 2, 0)
    return np.concatenate([rgb, np.full((*rgb.shape[:2], 1), 255, dtype=np.uint8)], axis=2)


def vae_input(latent: Column) -> Column:
    """What the decoder is fed: the latent over the scale."""
    return F.transform(latent, lambda x: x / VAE_SCALE)


def pixel_bytes(tensor: Column, height: int, width: int) -> Column:
    """to_pixels as a column: the numbers 0..255 of a flat (3, H, W) tensor in -1..1, four a pixel, opaque."""
    byte = lambda x: F.floor(F.least(F.greatest(x / 2 + 0.5, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    n = height * width
    four = lambda p: F.array(*[byte(F.get(tensor, p + c * n)) for c in range(3)], F.lit(255))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), four))


def doubled(negative: Column, prompt: Column) -> Column:
    """The embeddings of both halves of a guided batch, the unconditional one first."""
    return F.concat(negative, prompt)


def unguided_ids(start: int, end: int, length: int) -> Column:
    """The ids of a prompt without a vocabulary, as a column."""
    return F.concat(F.array(F.lit(start)), F.array_repeat(F.lit(end), length - 1))
