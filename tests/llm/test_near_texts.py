"""Near-copies with a similarity go through fingerprints and pivot tables before their exact check."""

import random

import numpy as np

from tessera.llm import simhash


def make():
    rng = random.Random(5)
    plain = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (300, 400, 500, 700)]
    edited = [p.rsplit(" ", 1)[0] + f" e{i}" for i, p in enumerate(plain)]
    # Repeats rule these fingerprints, while most of the distinct shingles differ.
    cycle = "a b c d e " * 500
    alike = [cycle + " ".join(f"{x}{i}" for i in range(40)) for x in "xy"]
    return list(enumerate(plain + edited + alike + [plain[0].upper(), "", " "]))


def signed(text):
    return int(np.uint64(simhash.fingerprint(text, 5)).astype(np.int64))


def test_stage_links_by_fingerprints_and_checks_them(spark, monkeypatch):
    docs = spark.createDataFrame(make(), "doc_id long, text string").repartition(3)
    met, plain = [], simhash.close_pairs

    def close_pairs(prints, *args):
        met.append({r["fp"] for r in prints.collect()})
        return plain(prints, *args)

    monkeypatch.setattr(simhash, "close_pairs", close_pairs)
    kept = sorted(r["doc_id"] for r in simhash.keep_first(docs, 5, 0.8).collect())
    assert met == [{signed(t) for _, t in make()}]
    assert kept == [0, 1, 2, 3, 8, 9, 11]  # 8 and 9 have one fingerprint, and few shingles in common


def test_near_texts_equal_brute_force(spark):
    rng = random.Random(6)
    prints = [rng.randrange(1 << 64) for _ in range(60)]
    for p in list(prints):
        for n in (1, 2, 3, 4, 5):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), n)))
    prints += prints[:20]
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)]
    got = {r["a"]: r["b"] for r in simhash.near_texts(spark.createDataFrame(rows, "node long, fp long")).collect()}
    label = list(range(len(prints)))
    for _ in range(6):
        for i, p in enumerate(prints):
            label[i] = min(label[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3)
    groups = {}
    for i, r in enumerate(label):
        groups.setdefault(r, set()).add(i)
    want = sorted(map(sorted, (g for g in groups.values())))
    found = {}
    for i in range(len(prints)):
        found.setdefault(got.get(i, i), set()).add(i)
    assert sorted(map(sorted, found.values())) == want
