"""Masks as runs, suppression by grid, decoding together and pieces by trie, each against its plain form."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels, runs
from tessera.operators import tasks, tokenize, toy_onnx
from tests.test_tasks import TINY, table  # noqa: F401


def masks(rng):
    out = [np.zeros((1, 1), int), np.arange(12).reshape(3, 4), np.zeros((5, 7), int)]
    return out + [rng.integers(0, k, (h, w)) for k in (2, 150) for h, w in ((4, 4), (1, 9), (9, 1), (16, 24))] + [np.repeat(np.repeat(rng.integers(0, 5, (3, 4)), 4, 0), 5, 1)]


def test_runs_are_the_mask(spark):
    rng = np.random.default_rng(1)
    rows = [(i, m.ravel().tolist(), m.shape[0], m.shape[1]) for i, m in enumerate(masks(rng))] + [(100, [], 0, 0), (101, None, None, None)]
    d = spark.createDataFrame(rows, "i long, ids array<int>, h int, w int").withColumn("r", runs.encode(F.col("ids")))
    d = d.select("*", runs.decode(F.col("r")).alias("back"), runs.pixels(F.col("r")).alias("n"), runs.histogram(F.col("r")).alias("hist"), runs.foreground(F.col("r")).alias("front"))
    for r in d.collect():
        assert r["back"] == r["ids"]
        if r["ids"]:
            classes, counts = np.unique(r["ids"], return_counts=True)
            assert [(x["class_id"], x["pixels"]) for x in r["hist"]] == list(zip(classes.tolist(), counts.tolist(), strict=True))
            assert sum(x["percent"] for x in r["hist"]) == pytest.approx(100) and r["n"] == len(r["ids"]) and r["front"] == np.count_nonzero(r["ids"])
            kinds, lengths = runs.runs_of(np.array(r["ids"]))
            assert [(x["class_id"], x["length"]) for x in r["r"]] == list(zip(kinds.tolist(), lengths.tolist(), strict=True))
        elif r["ids"] is not None:
            assert r["r"] == [] and r["hist"] == [] and r["n"] == 0


@pytest.mark.parametrize("to", [(1, 1), (3, 5), (8, 8), (17, 4), (40, 60)])
def test_runs_are_resized_like_pixels(to):
    for m in masks(np.random.default_rng(2)):
        kinds, lengths = runs.resized(*runs.runs_of(m), *m.shape, *to)
        assert np.array_equal(np.repeat(kinds, lengths).reshape(to), kernels.nearest(m, *to))
        assert (kinds[1:] != kinds[:-1]).all() and (lengths > 0).all()
    with pytest.raises(ValueError):
        runs.resized(np.array([1]), np.array([5]), 2, 3, 1, 1)


def test_resizing_and_labels_as_columns(spark):
    d = spark.createDataFrame([(1, [1, 1, 2, 2, 3, 3], 2, 3), (2, [1, 1], 9, 9), (3, None, 1, 1)], "i long, ids array<int>, h int, w int")
    d = d.withColumn("r", runs.encode(F.col("ids"))).withColumn("big", runs.resize_nearest(F.col("r"), F.col("h"), F.col("w"), F.lit(4), F.lit(6)))
    rows = {r["i"]: r for r in d.select("i", runs.decode(F.col("big")).alias("p"), runs.class_at(F.col("r"), 1, 1, 3, 2).alias("c")).collect()}
    assert rows[1]["p"] == kernels.nearest(np.array([[1, 1, 2], [2, 3, 3]]), 4, 6).ravel().tolist() and rows[1]["c"] == 3
    assert rows[2]["p"] is None and rows[3]["p"] is None and rows[3]["c"] is None
    with pytest.raises(IndexError):
        runs.class_at(F.col("r"), 3, 0, 3, 2)


def test_the_task_gives_the_masks_runs(table):
    for resize in (True, False):
        t = tasks.Task(toy_onnx.reshaping([3, 4, 4], [12, 2, 2]), TINY)
        d = tasks.segment_runs(tasks.segment(table, t, resize), t, resize).withColumn("back", runs.decode(F.col("SegmentationRuns")))
        for r in d.collect():
            assert r["back"] == r["SegmentationMask"] and r["SegmentationRuns_Width"] == r["SegmentationMask_Width"]
    assert "Generate" not in d.select(runs.histogram(F.col("SegmentationRuns")))._jdf.queryExecution().toString()


def plain_suppression(xywh, kind, order, iou, most=None):
    kept = []
    for i in order:
        rivals = [k for k in kept if kind[k] == kind[i]]
        if not rivals or kernels.overlap(xywh[i], xywh[rivals]).max() < iou:
            kept.append(int(i))
    return kept[:most]


@pytest.mark.parametrize("spread", [5, 100, 3000])
@pytest.mark.parametrize("iou", [0.0, 0.2, 0.45, 1.0])
def test_grid_equals_every_pair(spread, iou):
    rng = np.random.default_rng(spread)
    for n, classes in ((1, 1), (40, 2), (400, 5)):
        xywh = np.concatenate([rng.uniform(-spread, spread, (n, 2)), rng.choice([0.0, 3.0, 40.0, 400.0], (n, 2), p=[0.1, 0.3, 0.5, 0.1])], axis=1)
        xywh[rng.random(n) < 0.2] = xywh[0]
        kind, order = rng.integers(0, classes, n), rng.permutation(n)
        for most in (None, 0, 3):
            assert kernels.suppressed(xywh, kind, order, iou, most)[:most] == plain_suppression(xywh, kind, order, iou, most)
    odd = np.array([[np.nan, 0, 5, 5], [np.inf, 0, 5, 5], [0, 0, 5, 5], [1, 1, 5, 5], [0, 0, np.inf, 5]])
    with np.errstate(invalid="ignore"):
        got = kernels.suppressed(odd, np.zeros(5, int), np.arange(5), iou)
        assert got == plain_suppression(odd, np.zeros(5, int), np.arange(5), iou)


def test_a_whole_detector_output():
    """8,400 boxes of 80 classes equal the plain loop; twice the boxes spread as far take no more than some twice the time."""
    rng = np.random.default_rng(7)

    def raw(n):
        m = np.concatenate([rng.uniform(0, 640, (2, n)), rng.uniform(5, 60, (2, n)), rng.random((80, n)) ** 6])
        return m.astype(np.float32)

    y = raw(8400)
    m = y.astype(np.float64)
    kind, best = m[4:].argmax(axis=0), m[4:].max(axis=0)
    ids = np.flatnonzero(best > 0.25)
    ids = ids[np.lexsort((ids, kind[ids], -best[ids]))]
    xywh = np.stack([m[0] - m[2] / 2, m[1] - m[3] / 2, m[2], m[3]], axis=1)
    want = plain_suppression(xywh, kind, ids, 0.45)
    assert np.array_equal(kernels.detect(y, 80, 8400, 0.25, 0.45)[:, :4], xywh[want]) and len(want) > 1000
    took = []
    for n in (8000, 16000):
        boxes = np.concatenate([rng.uniform(0, 30 * n, (n, 2)), np.full((n, 2), 20.0)], axis=1)
        began = time.process_time()
        kernels.suppressed(boxes, np.zeros(n, int), np.arange(n), 0.45)
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0] + 0.05


def test_rows_decoded_together_equal_rows_alone():
    """Ragged prefixes, rows that end at once, in the middle and never, and scores that aren't numbers."""
    rng = np.random.default_rng(5)
    nexts = rng.normal(size=(30, 12))
    nexts[3] = np.nan
    nexts[:, 7] += rng.choice([0, 3], 30)
    calls = []

    def step(ids, last, rows):
        calls.append(len(rows))
        return nexts[(ids[np.arange(len(rows)), last] * 5 + 3 * np.array(rows)) % 30]

    prefixes = [[int(x) for x in rng.integers(0, 12, rng.integers(1, 6))] for _ in range(25)]
    for length in (0, 1, 9):
        calls.clear()
        got = tasks.greedy_together(step, prefixes, 7, length)
        assert got == [tasks.greedy(lambda ids, r=r: nexts[(ids[-1] * 5 + 3 * r) % 30], p, 7, length) for r, p in enumerate(prefixes)]
        assert len(calls) <= length and calls == sorted(calls, reverse=True)
    assert tasks.greedy_together(step, [], 7, 5) == []


@pytest.mark.parametrize("batch", ["batch", 1])
def test_a_decoder_is_called_for_a_batch(batch):
    """A call for each id of the longest row where the model takes many rows, and the same ids where it takes one."""
    step = np.random.default_rng(0).normal(size=(8, 8)).astype(np.float32)
    decoder = toy_onnx.model(
        [toy_onnx.node("Gather", ["w", "ids"], ["g"]), toy_onnx.node("Reshape", ["x", "s"], ["c"]), toy_onnx.node("Add", ["g", "c"], ["y"])],
        {"ids": [batch, "n"], "x": [batch, 8]}, {"y": [batch, "n", 8]}, {"w": step, "s": np.array([0, 1, 8])}, ("ids",),
    )
    from tessera.operators.onnx import session

    class Counted:
        def __init__(self, s):
            self.s, self.calls = s, 0

        def get_inputs(self):
            return self.s.get_inputs()

        def run(self, *a):
            self.calls += 1
            return self.s.run(*a)

    rng = np.random.default_rng(1)
    seen = [rng.normal(size=(1, 8)).astype(np.float32) for _ in range(20)]
    prefixes = [[1] + [2, 4][: i % 3] for i in range(20)]
    s = Counted(session(decoder))
    got = tasks._decoded(s, seen, prefixes, 7, 6, 8)
    alone = [tasks.greedy(lambda ids, e=e: step[ids[-1]] + e[0], p, 7, 6) for e, p in zip(seen, prefixes, strict=True)]
    assert got == alone
    assert s.calls <= 3 * 6 if batch == "batch" else s.calls >= 20


def plain_pieces(vocab, word):
    pieces, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab), None)
        if end is None:
            return None
        pieces.append(vocab[("##" if at else "") + word[at:end]])
        at = end
    return pieces


@pytest.mark.parametrize("seed", range(6))
def test_pieces_by_trie_equal_the_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(40):
        letters = "ab" if seed % 2 else "abcd"
        made = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 14))}
        vocab = ["[UNK]", "##", *{("##" if rng.random() < 0.6 else "") + p for p in made}]
        t = tokenize.WordPieceTokenizer(vocab)
        for _ in range(40):
            word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 20)))
            want = plain_pieces(t.vocab, word)
            assert t.encode(word) == ([0] if want is None else want), (vocab, word)


def test_a_long_word_takes_linear_time():
    t = tokenize.WordPieceTokenizer(["[UNK]", "a", "##a", "##aa", "##aaaaaaab", "ab"])
    began = time.process_time()
    assert len(t.encode("a" * 1_000_000)) == 500_001  # the first, half of the rest in pairs, and one
    assert time.process_time() - began < 3
    assert tokenize.WordPieceTokenizer(["[UNK]", "a", "##a"], longest=5).encode("aaaaa aaaaaa") == [1, 2, 2, 2, 2, 0]
    import pickle

    assert pickle.loads(pickle.dumps(t)).encode("aaa") == t.encode("aaa")
