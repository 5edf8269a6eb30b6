"""numpy kernels for picture-sized data, meant for Arrow batches: float32, one picture at a time."""

from __future__ import annotations

import numpy as np

from tessera.config import Preprocess


def rgb_of(data: bytes, height: int, width: int, order: str = "bgr") -> np.ndarray:
    """(H, W, 3) red, green, blue of raw pixel bytes of one, three or four channels; alpha is left out."""
    if height < 1 or width < 1 or not data:
        raise ValueError("an image needs pixels")
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, -1)
    if pixels.shape[2] == 1:
        return np.repeat(pixels, 3, axis=2)
    return pixels[:, :, 2::-1] if order == "bgr" else pixels[:, :, :3]


def _axis(size: int, to: int, edge: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = (np.arange(to) + 0.5) * (size / to) - 0.5
    if edge == "replicate":
        at = np.maximum(at, 0)
    low = np.clip(np.floor(at), 0, size - 1).astype(np.int64)
    return low, np.minimum(low + 1, size - 1), (at - np.floor(at)).astype(np.float32)


def bilinear(a: np.ndarray, height: int, width: int, edge: str = "reference") -> np.ndarray:
    """Bilinear resize of (H, W) or (H, W, C) with half-pixel centres."""
    y0, y1, fy = _axis(a.shape[0], height, edge)
    x0, x1, fx = _axis(a.shape[1], width, edge)
    a = a.astype(np.float32)
    shape = (1, -1) + (1,) * (a.ndim - 2)
    fx, fy = fx.reshape(shape), fy.reshape((-1, 1) + (1,) * (a.ndim - 2))
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def preprocess(rgb: np.ndarray, config: Preprocess) -> np.ndarray:
    """(3, H, W) tensor: stretched, rescaled, normalised."""
    x = bilinear(rgb, *config.size, config.edge)
    if config.rescale:
        x = x * np.float32(config.factor)
    if config.normalize:
        x = (x - np.array(config.mean, dtype=np.float32)) / np.array(config.std, dtype=np.float32)
    return x.transpose(2, 0, 1).astype(np.float32)


def preprocess_batch(images: list[np.ndarray], config: Preprocess) -> np.ndarray:
    if not images:
        raise ValueError("a batch needs images")
    return np.stack([preprocess(i, config) for i in images])


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of box a with boxes b, as (x, y, width, height)."""
    low, high = np.maximum(a[:2], b[:, :2]), np.minimum(a[:2] + a[2:], b[:, :2] + b[:, 2:])
    inside = np.prod(np.maximum(high - low, 0), axis=1)
    union = a[2] * a[3] + b[:, 2] * b[:, 3] - inside
    return np.where(union > 0, inside / np.where(union > 0, union, 1), 0)


def suppressed(xywh: np.ndarray, kind: np.ndarray, order: np.ndarray, iou: float, most: int | None = None) -> list[int]:
    """Boxes kept of those in order, best first: a box goes if a kept one of its class overlaps it by iou or more.

    Boxes lie in cells as large as the largest box of their class, by their corners: what overlaps a box is in its cell
    or in one of the eight around it, and only those kept there are compared. Many boxes far apart take linear time.
    Where cells say nothing (an overlap of none would do, or a corner isn't a number) all boxes share one.
    """
    size = np.maximum(np.abs(xywh[:, 2:]).max(axis=1), 1e-12)
    largest = np.zeros(int(kind[order].max()) + 1 if len(order) else 1)
    np.maximum.at(largest, kind[order], size[order])
    with np.errstate(invalid="ignore", over="ignore"):
        cell = np.floor(xywh[:, :2] / np.maximum(largest, 1e-12)[np.minimum(kind, len(largest) - 1)][:, None])
    flat = iou <= 0 or not (np.abs(cell[order]) < 2**40).all() or not np.isfinite(size[order]).all()
    cell = np.zeros((len(xywh), 2), dtype=np.int64) if flat else np.where(np.isfinite(cell), cell, 0).astype(np.int64)
    around = [(0, 0)] if flat else [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    kept: list[int] = []
    there: dict[tuple[int, int, int], list[int]] = {}
    for i in order.tolist():
        k, x, y = int(kind[i]), int(cell[i, 0]), int(cell[i, 1])
        rivals = [r for dx, dy in around if (found := there.get((k, x + dx, y + dy))) for r in found]
        if not rivals or overlap(xywh[i], xywh[rivals]).max() < iou:
            kept.append(i)
            there.setdefault((k, x, y), []).append(i)
            if len(kept) == most:
                break
    return kept


def detect(raw: np.ndarray, classes: int, boxes: int, score: float = 0.5, iou: float = 0.45, most: int | None = None) -> np.ndarray:
    """Rows of (x, y, width, height, class, score) kept from a (4 + classes, boxes) tensor, best first."""
    m = np.asarray(raw, dtype=np.float64).reshape(4 + classes, boxes)
    scores = np.where(np.isnan(m[4:]), -np.inf, m[4:])
    kind, best = scores.argmax(axis=0), scores.max(axis=0)
    ids = np.flatnonzero(best > score)
    ids = ids[np.lexsort((ids, kind[ids], -best[ids]))]
    xywh = np.stack([m[0] - m[2] / 2, m[1] - m[3] / 2, m[2], m[3]], axis=1)
    kept = suppressed(xywh, kind, ids, iou, most) if most != 0 else []
    return np.column_stack([xywh[kept], kind[kept], best[kept]]) if kept else np.zeros((0, 6))


def class_map(raw: np.ndarray, classes: int, height: int, width: int) -> np.ndarray:
    m = np.asarray(raw).reshape(classes, height, width)
    return np.where(np.isnan(m), -np.inf, m).argmax(axis=0).astype(np.int32)


def nearest(a: np.ndarray, height: int, width: int) -> np.ndarray:
    return a[np.arange(height) * a.shape[0] // height][:, np.arange(width) * a.shape[1] // width]


def depth(raw: np.ndarray, height: int, width: int) -> tuple[np.ndarray, float, float]:
    """(H, W) in 0..1, with the raw minimum and maximum."""
    v = np.asarray(raw, dtype=np.float32)[-height * width :].reshape(height, width)
    low, high = float(v.min()), float(v.max())
    return (v - np.float32(low)) / np.float32(high - low if high - low >= 1e-8 else 1), low, high
