"""Whitening against exact rational arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import whitening

ROWS = "vec_id long, embedding array<float>, dim int, white string, n string"


def brute(vectors, components=8):
    """(n, deviations, covariance as fractions, integer rows) of plain Python."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dim)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(dim)) for r in x]
    cov = [[sum((r[i] - Fraction(s[i], n)) * (r[j] - Fraction(s[j], n)) for r in x) / n for j in range(dim)] for i in range(dim)]
    return n, dev, cov, [[float(r[j] - Fraction(s[j], n)) for j in range(dim)] for r in x]


def test_components_equal_exact_arithmetic(spark):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(150, 10)) @ rng.normal(size=(10, 10)) * 3).astype(np.float32)
    rows = [(i, v.tolist(), 1, "x", "y") for i, v in enumerate(data)]
    rows += [(7, data[7].tolist(), 1, "x", "y"), (None, data[8].tolist(), 1, "x", "y")]  # a repeated row and a lost id
    odd = [(900, None), (901, []), (902, [None] * 10), (903, [float("nan")] * 10), (904, [1.0] * 9 + [float("inf")])]
    rows += [(i, v, 1, "x", "y") for i, v in odd]
    got = whitening.components_of(spark.createDataFrame(rows, ROWS).repartition(5)).collect()
    used = [(i, v) for i, v, *_ in rows[:152]]
    n, dev, cov, x = brute([v for _, v in used])
    e, u = np.linalg.eigh(np.array(cov, dtype=float))
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 152 * 8 and {r["n"] for r in got} == {152} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for k in range(8):
        shown = [by[i, k + 1][0]["whitened"] for i, _ in used]
        want = np.array(x) @ u[:, k] / math.sqrt(e[k])
        assert np.allclose(shown, want, atol=1e-9) or np.allclose(shown, -want, atol=1e-9)
        assert {round(r["explained"], 12) for r in got if r["component"] == k + 1} == {round(e[k] / sum(e), 12)}
    assert {i: by[i, 1][0]["deviation"] for i, _ in used} == {i: d for (i, _), d in zip(used, dev, strict=True)}
    assert len(by[7, 1]) == 2


def test_lengths_ranks_and_emptiness(spark):
    rows = [(1, [1.0, 2.0], 0, "", ""), (2, [2.0, 4.0], 0, "", ""), (3, [3.0, 6.0], 0, "", ""), (4, [5.0], 0, "", ""), (5, [9.0], 0, "", ""), (6, [1.0] * 3, 0, "", "")]
    got = whitening.components_of(spark.createDataFrame(rows, ROWS))
    assert got.count() == 5  # two components of which one has no variance, one of length 1, none of a single vector
    seen = {(r["vec_id"], r["component"]): (r["n"], r["deviation"], round(abs(r["whitened"]), 9), r["explained"]) for r in got.collect()}
    assert seen[2, 1] == (3, 0, 0.0, pytest.approx(1)) and seen[4, 1] == (2, 4096**2, 1.0, 1.0) and seen[5, 1] == (2, 4096**2, 1.0, 1.0)
    empty = whitening.components_of(spark.createDataFrame([], ROWS))
    assert empty.count() == 0 and empty.columns == got.columns


@pytest.mark.parametrize("scale", [1, 10**6, 2**40, 10**17])
def test_products_are_exact_at_any_size(scale):
    rng = np.random.default_rng(scale % 97)
    d = rng.integers(-scale, scale + 1, (5000, 6))
    d[:40] = scale  # carries in every limb
    count = max(1, -(-int(scale).bit_length() // whitening.LIMB))
    found = sum(whitening.powers(d[at : at + whitening.BLOCK], count).astype(object) * 1 for at in range(0, 5000, whitening.BLOCK))
    total = [[sum(int(m) << (whitening.LIMB * p) for p, m in enumerate(found[:, i, j])) for j in range(6)] for i in range(6)]
    assert total == [[sum(int(a) * int(b) for a, b in zip(d[:, i], d[:, j], strict=True)) for j in range(6)] for i in range(6)]
    assert whitening.squares(d) == [sum(int(v) ** 2 for v in r) for r in d]


def test_centring_is_exact_beyond_64_bits():
    x = np.array([[2**52, -(2**52)], [2**51 + 1, 3]], dtype=np.int64)
    n, sums = 10**6 + 3, [7 * 10**20 + 1, -(10**18)]
    assert whitening.centred(x, n, sums).tolist() == [[n * int(v) - s for v, s in zip(r, sums, strict=True)] for r in x]
    with pytest.raises(ValueError, match="too large"):
        whitening.to_integers(np.array([[2.0**43]]))
