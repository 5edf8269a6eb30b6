"""The pipeline against versions of its stages that share no code with them, on the smallest table."""

import hashlib
import re
import zlib
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm.common import read, shared_table
from tessera.llm.queries import ORACLES, QUERIES, default_tokenizer
from tests.llm.test_jaccard import brute_kept
from tests.llm.test_operators import brute_rules

SF = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by_rules(text):
    text = text or ""
    n, chars, symbols, _, repeated = brute_rules(text)
    words = re.split(r"[\x20\x09-\x0D]+", text)
    capitals = sum(not re.search("[a-z]", w) and len(re.findall("[A-Z]", w)) > 1 for w in words)
    marks = len(re.findall(r"""[0-9.,;:'"()-]""", text))
    bad = (n < 20, 100 * repeated > 30 * n, 100 * symbols > 30 * n, 100 * capitals > 30 * n, chars > 40 * n, 100 * marks > 70 * chars)
    return not any(bad)


def mixed_words(rows):
    """Words that the mix takes of each (doc_id, text, source), with distinct ids: sources filled up one by one."""
    size = {d: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t, _ in rows}
    per = {}
    for d, _, s in rows:
        per.setdefault(s, []).append(d)
    order = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + ([None] if None in per else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    whole = {s: sum(size[d] for d in per[s]) for s in order}
    left, free, target = Fraction(3, 2) * sum(whole.values()), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * whole[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = Fraction(2 * whole[s])
            left -= 2 * whole[s]
        free -= over
    out = {}
    for s in order:
        budget = int(target[s])
        copies, rest = divmod(budget, whole[s]) if whole[s] else (0, 0)
        for d in sorted(per[s], key=lambda d: hashlib.md5(str(d).encode()).hexdigest()[:12]):
            more = min(size[d], rest)
            rest -= more
            out[d] = copies * size[d] + more
    return out


@needs_tables
def test_stages(spark):
    docs = read(spark, str(SF), "documents")
    stage, seen = dict(corpus_pipeline.STAGES), {}
    for name in list(stage)[:-1]:
        before = docs
        docs = shared_table(stage[name](spark, docs, str(SF)), name)
        assert docs.columns == before.columns
        seen[name] = (before.collect(), docs.collect())
    before, after = seen["quality_rules"]
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if kept_by_rules(r["text"]))
    before, after = seen["near_duplicates"]
    assert sorted(r["doc_id"] for r in after) == brute_kept([(r["doc_id"], r["text"]) for r in before])
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    before, after = seen["pseudonyms"]
    new, blank = {r["doc_id"]: r for r in after}, lambda t: re.sub("[0-9A-Za-z]+", "x", t)
    assert len(new) == len(before)
    for r in before:
        text = new[r["doc_id"]]["text"]
        private = re.findall(r"\S+@\S+|\+?[0-9][0-9() .-]{7,}[0-9]", r["text"])
        assert blank(text) == blank(r["text"]) and (private or text == r["text"]) and new[r["doc_id"]]["n_chars"] == len(text)
        assert not any(p.split("@")[0] + "@" in text for p in private if "@" in p)
    before, after = seen["mixture"]
    words = {}
    for r in after:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert words == {d: n for d, n in mixed_words([(r["doc_id"], r["text"], r["source"]) for r in before]).items() if n}
    tok = Tokenizer.from_file(default_tokenizer())
    rows = stage["packed"](spark, docs, str(SF)).collect()
    ids = {}
    for r in after:
        x = tok.encode(r["text"], add_special_tokens=False).ids + [1]
        ids.setdefault((r["doc_id"], len(x)), []).append(x)
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        part = np.array(ids[r["doc_id"], r["doc_tokens"]][0][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        assert [o for o, _ in sorted(w)] == [sum(n for _, n in sorted(w)[:i]) for i in range(len(w))] and sum(n for _, n in w) <= 2048


def test_stages_on_odd_tables(spark):
    """Empty tables, null columns, repeated ids and rows, and columns with the stages' own names."""
    prose = " ".join(f"word{'abcdefgh'[i % 8]} of{'xyz'[i % 3]} some{'klmno'[i % 5]}" for i in range(40))
    other = " ".join(f"{'ghij'[i % 4]}line and{'pqr'[i % 3]} more{'stuvw'[i % 5]}{'abc'[i // 5 % 3]}" for i in range(60)) + " mail jo@example.com"
    rows = [(1, prose, "en", "a", 9), (1, prose, "en", "a", 9), (2, prose, None, None, None), (None, other, "en", None, 5), (None, None, None, None, None), (3, "", "en", "b", 0), (4, None, "en", "b", None)]
    odd = SCHEMA + ", _doc string, _size int, _hash int, copies int, id string, fp int, kept boolean, `a.b` int"
    full = spark.createDataFrame([(*r, "d", 1, 2, 3, "i", 4, True, 6) for r in rows], odd)
    for start in (full, full.limit(0)):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = shared_table(stage(spark, docs, str(SF)), name)
            assert docs.columns == start.columns
        extra = {tuple(r)[5:] for r in docs.collect()}
        assert extra == ({("d", 1, 2, 3, "i", 4, True, 6)} if start is full else set())
        texts = {r["text"] for r in docs.collect()}
        assert not any("jo@" in t for t in texts) and (start is not full or any("@example.com" in t for t in texts))
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(SF)).collect()
        assert bool(pieces) == (start is full)


@pytest.mark.parametrize("name", ORACLES)
@needs_tables
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, str(SF)).toPandas()[list(want.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))
