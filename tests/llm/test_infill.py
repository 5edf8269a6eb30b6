"""The fill-in-middle transformation against a plain version, and its round trip."""

import hashlib
import re
from pathlib import Path

import pytest

from tessera.llm import infill
from tessera.llm.queries import OP11_SQL, op11_infill

SF = Path("/root/testdata/sf0.001")
TEXTS = [
    None, "", " ", "\n\t ", "one", " one", "one ", "one two  three\n\nfour ", "é x  y", "has <P> in it", "a <S>", "<M>", "< P> <P < S>",
    "<<P", "x" * 50_000, "w " * 60_000, "a\x1cb \x0bc", "𝒳𝒴 𝒵 q", "<S <P <M> x"[:8],
]


def plain(doc_id, text):
    """The contract, word by word."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, hexed = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_every_form_equals_the_plain_version_and_comes_back():
    forms = set()
    for text in TEXTS:
        for doc_id in [None, 0, -3, 2**62, *range(1, 40)]:
            got = infill.transform(doc_id, text or "")
            assert got == plain(doc_id, text)
            assert infill.restore(got[4], got[1]) == (text or "")
            forms.add(got[1])
    assert forms == {"plain", "spm", "psm"}


def test_marks_that_touch_the_cuts_come_back():
    for form in ("spm", "psm"):
        for pre, mid, suf in [("<", "S>", "<"), ("<S", "M>", "P>"), ("", "", ""), ("P>", "<P", "<M"), ("<<", ">>", "<S")]:
            output = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
            assert infill.restore(output, form) == pre + mid + suf


def test_rows_keep_their_columns(spark):
    rows = [(i if i % 5 else None, t, "x", "y", 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[7], "x", "y", 7)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output string, n int").repartition(3)
    got = infill.fill_in_middle(docs).collect()
    want = sorted(((d, t, *plain(d, t)) for d, t, *_ in rows), key=repr)
    assert sorted(((r["doc"]["doc_id"], r["doc"]["text"], *r[1:]) for r in got), key=repr) == want
    assert {(r["doc"]["form"], r["doc"]["output"], r["doc"]["n"]) for r in got} == {("x", "y", 7)}
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t != "a\x1cb \x0bc"] * 2, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_infill(spark, str(tmp_path)).toPandas()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(OP11_SQL).fetchdf()
    key = lambda df: sorted(df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False), key=repr)
    assert sorted(got.columns) == sorted(want.columns)
    same = [tuple(int(v) if isinstance(v, float) else v for v in r) for r in key(want)]
    assert [tuple(int(v) if isinstance(v, float) else v for v in r) for r in key(got)] == same
    assert (got["output_sha256"] != got["restored_sha256"]).sum() == (got["form"] != "plain").sum()


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
def test_rows_equal_the_sql_without_pandas(spark):
    """Nulls as nulls and numbers as numbers, whatever data frame a version of DuckDB makes of them."""
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = db.execute(OP11_SQL)
    columns, want = [c[0] for c in found.description], found.fetchall()
    got = [tuple(r) for r in op11_infill(spark, str(SF)).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(None in r for r in got) and len(got) > 100
