"""Preprocessing presets: what a model's images are resized to and normalised by."""

from __future__ import annotations

from dataclasses import dataclass

IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
CLIP_STATS = ((0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711))


@dataclass(frozen=True)
class Preprocess:
    """Image size (height, width), channel means and deviations, and which steps are done.

    ``edge`` says how the first half pixel is interpolated: "reference" weighs by the unclamped fraction, "replicate"
    repeats the border.
    """

    size: tuple[int, int] = (224, 224)
    mean: tuple[float, float, float] = IMAGENET[0]
    std: tuple[float, float, float] = IMAGENET[1]
    rescale: bool = True
    normalize: bool = True
    factor: float = 1 / 255
    edge: str = "reference"

    def __post_init__(self) -> None:
        if min(self.size) < 1:
            raise ValueError("image size must be positive")
        if min(self.std) <= 0:
            raise ValueError("deviations must be positive")


def _square(n: int, stats: tuple = IMAGENET, **more: object) -> Preprocess:
    return Preprocess((n, n), *stats, **more)


PRESETS = {
    "imagenet": _square(224),
    "clip": _square(224, CLIP_STATS),
    "dinov2": _square(224),
    "midas": _square(256),
    "dpt": _square(384),
    "yolov8": _square(640, normalize=False),
    "segformer": _square(512),
    "git": _square(224, CLIP_STATS),
    "sam2": _square(1024),
    "git_vqa": _square(480, CLIP_STATS),
}
