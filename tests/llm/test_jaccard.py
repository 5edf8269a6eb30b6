"""Near-copies against brute-force Jaccard similarity."""

import random

import pytest

from tessera.llm import jaccard, simhash


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        text[rng.randrange(len(text))] = f"e{rng.randrange(10**9)}"
    return text


def brute_kept(rows):
    """Smallest id of each component of pairs of Jaccard 0.8 and more, for (id, text) rows."""
    sets = [{tuple(w[i : i + min(5, len(w))]) for i in range(max(len(w) - 4, min(1, len(w))))} for w in (t.lower().split() for _, t in rows)]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return sorted({min(d for k, (d, _) in enumerate(rows) if root(k) == root(i)) for i in range(len(rows))})


@pytest.mark.parametrize("chunk", [4, 256])
def test_near_copies_equal_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(jaccard.similar_roots, "__defaults__", (5, 0.8, chunk))
    rng, texts = random.Random(7), []
    for n in (20, 60, 200, 600):
        for edits in (1, 1, 2, 4, 8, 16):
            base = words(rng, n)
            texts += [base, edited(rng, base, max(1, n * edits // 400)), edited(rng, base, max(1, n * edits // 200))]
    hub = words(rng, 150)  # a group whose members are often nearer to the first than to each other
    texts += [hub] + [edited(rng, hub, 1 + i % 3) for i in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000, ""), (1001, " \n"), (1002, "one two"), (1003, "One  TWO"), (1004, rows[0][1].upper())]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in simhash.keep_first(docs, 5, 0.8).collect())
    assert kept == brute_kept(rows)
    assert len(kept) < simhash.keep_first(docs).count()  # fingerprints within 3 bits leave edited copies in
    assert simhash.keep_first(docs.limit(0), 5, 0.8).count() == 0


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_one_row_of_each_group_stays(spark, similarity):
    rng = random.Random(9)
    a, b, c = (" ".join(words(rng, 80)) for _ in range(3))
    rows = [(1, a), (None, a), (None, b), (None, b), (2, a), (2, c), (2, c), (3, c), (1, c), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(((r["doc_id"], r["text"] or "") for r in simhash.keep_first(docs, 5, similarity).collect()), key=str)
    assert kept == sorted([(1, a), (1, c), (None, b), (None, "")], key=str)
