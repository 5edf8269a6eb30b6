"""The mixture's cut documents: whole but for one text of a source, and as they are written."""

from tessera.llm import mixing


def test_one_text_of_a_source_is_cut_as_written(spark):
    texts = [f"a{i} b\n\tc{i}  d\r\ne f{i}\n " for i in range(40)]
    rows = [(None if s == "a" else i % 2, t, s) for s in "abc" for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mixed_documents(docs).collect()
    for s in "abc":
        cut = {r["text"] for r in out if r["source"] == s and r["text"] not in texts}
        assert len(cut) <= 1 and all(any(t.startswith(c) and c[-1] not in mixing.SPACES for t in texts) for c in cut)
    # one word over a whole copy, if any, is what a floor of the target leaves
    words = {s: sum(len(r["text"].split()) for r in out if r["source"] == s) for s in "abc"}
    want = {r["source"]: r["target"] for r in docs.withColumn("k", mixing.F.concat(mixing.F.lit("0"), "source")).join(
        mixing.targets(mixing.sized(docs)).withColumnRenamed("_key", "k"), "k").collect()}
    assert all(want[s] - 41 <= words[s] <= want[s] for s in "abc")


def test_heads(spark):
    text = "  one\n\ntwo\t three é\x0bfour "
    for n, want in ((1, "  one"), (2, "  one\n\ntwo"), (3, "  one\n\ntwo\t three"), (4, "  one\n\ntwo\t three é"), (5, text[:-1])):
        assert spark.range(1).select(mixing.head_of(mixing.F.lit(text), mixing.F.lit(n))).first()[0] == want


def test_columns_of_any_name_keep_their_values(spark):
    rows = [(i, f"w{i} x y z", "ab"[i % 2], 8, f"c{i}", i, i, f"k{i}", f"t{i}") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, copies string, _size long, _hash long, _key string, target string")
    want = {r[0]: r[4:] for r in rows}
    out = mixing.mixed_documents(d).collect()
    assert out and all(tuple(r)[4:] == want[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in out)
    assert mixing.mix(d).count() == 30
