"""The PartEnum join against all pairs, and its signatures against their promise."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from tessera.llm import jaccard, partenum


def words(rng, n, of=4000):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def brute(rows, percent=80):
    """(id, set size, smallest id reachable) of (id, text) rows, by all pairs."""
    def shingled(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingled(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(rng):
    texts = []
    for n in (5, 6, 9, 13, 20, 60, 200, 600):
        for edits in (1, 1, 2, 4, 8, 16, 24):
            base = words(rng, n)
            texts.append(base)
            for share in (400, 200):
                copy = list(base)
                for _ in range(max(1, n * edits // share)):
                    copy[rng.randrange(n)] = f"e{rng.randrange(10**9)}"
                texts.append(copy)
            texts.append(base[: len(base) * 4 // 5 + 1])  # near the limit by size
    hub = words(rng, 150)  # a family whose members are often nearer to the first than to each other
    for i in range(50):
        copy = list(hub)
        for _ in range(1 + i % 3):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**9)}"
        texts.append(copy)
    chain = words(rng, 300)  # each nearly its neighbour, the ends far apart
    for i in range(12):
        texts.append(chain[20 * i : 20 * i + 60] + chain[200:])
    passage = words(rng, 60)
    texts += [words(rng, 40) + passage for _ in range(20)]
    rows = [(3 * i + 1, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1, rows[0][1].upper()), (5000, ""), (5001, " \n\t"), (5002, None), (5003, "one two"), (5004, "One  TWO"), (5005, "one two three"), (None, "lost words here"), (None, rows[9][1])]
    rows += [(5006, "long " * 40_000), (5007, "long " * 7), (5008, rows[40][1]), (5008, rows[40][1]), (5008, rows[41][1]), (5009, "a\x1cb c d e f g"), (5010, "Éa éa b c d e"), (5011, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [80, 60])
def test_components_equal_all_pairs(spark, percent, monkeypatch):
    monkeypatch.setattr(partenum, "BUCKET", 2000)
    rows = corpus(random.Random(5))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, size int, node string").repartition(5)
    got = partenum.linked_sets(docs, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, percent)
    assert got[0].__fields__ == ["doc_id", "n_shingles", "component_id"]


def test_no_rows(spark):
    assert partenum.linked_sets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_similar_sets_share_a_signature(percent):
    """Sets at the limit of the similarity, of every size up to 700 and of all splits of the differences."""
    rng, bands = np.random.default_rng(percent), partenum.Bands(percent)
    for n in [*range(2, 60), 81, 100, 257, 700]:
        for _ in range(6):
            pool = rng.integers(0, 1 << 64, 4 * n + 8, dtype=np.uint64)
            union = max(n, 2)
            most = union - -(-percent * union // 100)  # features that one set only has
            mine = int(rng.integers(0, most + 1))
            both = union - most
            a, b = np.unique(pool[: both + mine]), np.unique(np.concatenate([pool[:both], pool[both + mine : union]]))
            if most and len(a) and len(b) and not np.array_equal(a, b):
                assert 100 * both >= percent * union
                assert set(partenum.signatures(a, bands).tolist()) & set(partenum.signatures(b, bands).tolist())


def test_bands_meet_at_the_similarity():
    bands = partenum.Bands(80)
    for s in range(1, 3000):
        assert bands.of(s) <= bands.of(s * 100 // 80) <= bands.of(s) + 1
        parts, pieces, spare = bands.cut(bands.of(s))
        assert parts == 0 or parts * pieces - spare > 0


def test_features_are_the_distinct_shingles():
    assert len(partenum.features("a b c d e f")) == 2 and len(partenum.features("a b")) == 1 and len(partenum.features(" \n")) == 0
    assert len(partenum.features("x " * 100)) == 1
    assert (partenum.features("A b\tc D\x0be") == partenum.features("a B c d e")).all()
    assert partenum.features("a b c d e")[0] not in partenum.features("e d c b a")


def test_sketches_differ_in_no_more_than_their_sets(monkeypatch):
    monkeypatch.setattr(partenum, "WIDER", 1)
    rng, sets = np.random.default_rng(2), []
    for n in (0, 3, 200, 500, 530, 2000, 2100, 8100, 8300, 150_000):  # of the last the counters are full
        pool = np.unique(rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64))
        sets += [pool[:n], pool[: n + n // 9], pool[n // 9 : n + n // 9], pool[n // 2 : n // 2 + n], np.concatenate([pool[: n // 2], pool[n : n + n // 2]])]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 4 * max(len(sets[i]), len(sets[j])) <= 5 * min(len(sets[i]), len(sets[j]))]
    x, y = np.array(pairs).T
    apart = partenum.Sketches([partenum.sketch_of(s) for s in sets]).apart(x, y)
    true = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in pairs])
    assert (apart <= true).all() and (apart[true > 0] > 0).mean() > 0.9 and len(pairs) > 100


def test_a_text_is_shuffled_once_to_its_partner(spark, monkeypatch):
    """The texts of the first round know their partners: the comparison joins hubs to texts, and texts to texts."""
    plans, plain = [], jaccard.shared_table

    def shared_table(df, name):
        if name == "links":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(jaccard, "shared_table", shared_table)
    text = [" ".join(f"w{i * k % 97}" for i in range(120)) for k in (1, 2)]
    rows = [(0, text[0]), (1, text[0] + " more"), (2, text[1]), (3, text[1] + " more"), (4, "alone in the world of words")]
    got = partenum.linked_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert plans[0].count("Join ") == 2


def test_sketches_go_to_few_places(spark, monkeypatch):
    """Two texts that share a passage meet in many buckets; with their sketches they go to one place for each few blocks."""
    monkeypatch.setattr(partenum, "BUCKET", 300)
    tables, plain = {}, partenum.shared_table

    def shared_table(df, name):
        table = plain(df, name)
        if name in ("met", "open", "pairs"):
            tables[name] = table.toPandas()
        return table

    monkeypatch.setattr(partenum, "shared_table", shared_table)
    rng = random.Random(9)
    passages = [words(rng, 120, 10**9) for _ in range(12) for _ in range(2)]
    passages[1::2] = passages[::2]
    rows = [(i, " ".join(p + words(rng, 60, 10**9))) for i, p in enumerate(passages)]
    got = partenum.linked_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    met, sent = tables["met"]["short"].notna().sum(), tables["open"].dropna(subset="node").drop_duplicates(["place", "node"])
    assert met >= 5 * len(rows) and sent["node"].nunique() == len(rows) and len(sent) <= 2 * len(rows)


def test_open_sets_are_those_with_a_partner():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 30))
        node = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        short, root = (node.astype(np.uint64) >> np.uint64(16)).astype(np.int64), node[rng.integers(0, min(3, len(node)), len(node))]
        members = pd.DataFrame({"bucket": 3, "short": short, "node": node, "root": root, "size": rng.integers(1, 40, len(node))})
        blocks = [np.sort(rng.choice(len(node), int(rng.integers(1, len(node) + 1)), replace=False)) for _ in range(4)]
        packed = pd.DataFrame({"lengths": [np.array(list(map(len, blocks)), "<i4").tobytes()], "blocks": [short[np.concatenate(blocks)].astype("<i8").tobytes()]})
        got = partenum._open(members, packed, 80, 5)
        size = members["size"].to_numpy()
        want = {(node[x], node[y]) for b in blocks for x in b for y in b if root[x] != root[y] and 5 * min(size[x], size[y]) >= 4 * max(size[x], size[y])}
        assert set(got["node"].dropna().astype("int64")) == {x for x, _ in want}
        met = set()
        for row in got.dropna(subset="blocks").itertuples():
            ends = np.cumsum(np.frombuffer(row.lengths, "<i4"))
            there = set(got["node"][(got["place"] == row.place) & got["node"].notna()].astype("int64"))
            for b in np.split(np.frombuffer(row.blocks, "<i8"), ends[:-1]):
                assert set(b.tolist()) <= there
                met |= {(x, y) for x in b for y in b}
        assert want <= met
