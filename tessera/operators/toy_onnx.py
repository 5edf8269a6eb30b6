"""Tiny ONNX models, written as protobuf by hand, for tests and demonstrations without model files."""

from __future__ import annotations

import numpy as np


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _value(name: str, shape: list[int | str], kind: int = 1) -> bytes:
    dims = b"".join(_bytes(1, _bytes(2, d) if isinstance(d, str) else _number(1, d)) for d in shape)
    return _bytes(1, name) + _bytes(2, _bytes(1, _number(1, kind) + _bytes(2, dims)))


def _tensor(name: str, a: np.ndarray, file: str | None = None) -> bytes:
    """A weight; with a file its numbers are not in the model but there, from the first byte on."""
    kind = {"f": 1, "i": 7}[a.dtype.kind]
    a = a.astype(np.float32 if kind == 1 else np.int64)
    head = b"".join(_number(1, d) for d in a.shape) + _number(2, kind) + _bytes(8, name)
    if file is None:
        return head + _bytes(9, a.tobytes())
    entries = {"location": file, "offset": "0", "length": str(a.nbytes)}
    return head + b"".join(_bytes(13, _bytes(1, k) + _bytes(2, v)) for k, v in entries.items()) + _number(14, 1)


def node(op: str, inputs: list[str], outputs: list[str]) -> bytes:
    return b"".join(_bytes(1, i) for i in inputs) + b"".join(_bytes(2, o) for o in outputs) + _bytes(3, f"{op}_{outputs[0]}") + _bytes(4, op)


def model(nodes: list[bytes], inputs: dict[str, list], outputs: dict[str, list], weights: dict[str, np.ndarray] | None = None,
          integers: tuple[str, ...] = (), files: dict[str, str] | None = None) -> bytes:
    """A model file of float inputs and outputs; the inputs named in integers hold whole numbers. The weights named in
    files are kept there."""
    graph = b"".join(_bytes(1, n) for n in nodes) + _bytes(2, "toy")
    graph += b"".join(_bytes(5, _tensor(k, a, (files or {}).get(k))) for k, a in (weights or {}).items())
    graph += b"".join(_bytes(11, _value(k, s, 7 if k in integers else 1)) for k, s in inputs.items())
    graph += b"".join(_bytes(12, _value(k, s)) for k, s in outputs.items())
    return _number(1, 8) + _bytes(7, graph) + _bytes(8, _number(2, 13))


def reshaping(shape: list[int], out: list[int], batch: int | str = "batch") -> bytes:
    """A model whose output is its input in another shape; batch "batch" is a dynamic axis, 1 a fixed one."""
    target = np.array([0, *out], dtype=np.int64)
    return model([node("Reshape", ["x", "s"], ["y"])], {"x": [batch, *shape]}, {"y": [batch, *out]}, {"s": target})


def linear(weights: np.ndarray, batch: int | str = "batch") -> bytes:
    """y = x W on flat inputs."""
    n, m = weights.shape
    return model([node("MatMul", ["x", "w"], ["y"])], {"x": [batch, n]}, {"y": [batch, m]}, {"w": weights.astype(np.float32)})
