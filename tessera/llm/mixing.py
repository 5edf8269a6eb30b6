"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed hash of its id. Sizes are summed by source and hash bucket; the running sum over a
source's buckets shows in which bucket its budget ends, and only the documents of that bucket are looked at again
with finer buckets, down to single hash values. A document is then taken by comparing its hash with its source's
threshold: nothing is sorted, and a larger budget always contains a smaller one. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, field_of, shared_table, text_of, whole_row, words_of

WEIGHTS, SHARE_HALVES, MOST = (3, 1, 2), 3, 2
#: The hash has 48 bits, refined 12 at a time.
BITS, STEP = 48, 12


def hash_of(doc_id: Column) -> Column:
    """The first 48 bits of the MD5 of the id as text (null: empty), as a long."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """_doc (the row), _size (words of the text), _key (source in sorting order, null last), _hash and _tie of docs."""
    return docs.select(whole_row(docs).alias("_doc"), docs["doc_id"], docs["text"], docs["source"]).withColumns({
        "_size": F.size(words_of(text_of())).cast("long"),
        "_key": F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))),
        "_hash": hash_of(F.col("doc_id")),
        "_tie": F.shiftrightunsigned(F.xxhash64(text_of()), 64 - BITS),
    })


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """_key, source_size, target: 150 % of all words shared by weight, none above twice its source's size.

    Sources fill up in the order of size over weight; what one can't take is shared among the rest. Comparisons
    are made in whole numbers. One row per source is all that the unpartitioned windows see.
    """
    per = rows.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("_key")) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    per = per.withColumn("w", weight).withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    order = Window.orderBy(F.col("source_size") / F.col("w"), "_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumns({
        "full": F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0).cast("long")),
        "left_w": F.sum("w").over(after),
    })
    # In halves of a word: what is left for this source and the later ones, against its own limit at that rate.
    per = per.withColumn("rest2", SHARE_HALVES * F.col("all") - 2 * F.col("full"))
    per = per.withColumn("capped", 2 * MOST * F.col("source_size") * F.col("left_w") < F.col("w") * F.col("rest2"))
    first = F.min(F.when(~F.col("capped"), F.struct("left_w", "rest2"))).over(Window.partitionBy())
    last_w = F.max(F.when(~F.col("capped"), F.col("left_w"))).over(Window.partitionBy())
    per = per.withColumns({"free_w": last_w, "_first": first})
    free = F.max(F.when(~F.col("capped") & (F.col("left_w") == F.col("free_w")), F.col("rest2"))).over(Window.partitionBy())
    per = per.withColumn("free_rest2", free)
    share = (F.col("w") * F.col("free_rest2")).cast("double") / (2 * F.col("free_w")).cast("double")
    target = F.when(F.col("capped"), (MOST * F.col("source_size")).cast("double")).otherwise(share)
    return per.select("_key", "source_size", target.alias("target"))


def _ends(rows: DataFrame, state: DataFrame) -> DataFrame:
    """_key, _bucket (the hash at which the budget _left of state ends), _left (words wanted of it) and _there."""
    part = rows.where("_size > 0")
    run = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    for done in range(STEP, BITS + 1, STEP):
        here = part.join(state, "_key") if done == STEP else part.join(
            state.withColumnRenamed("_bucket", "_last"),
            (part["_key"] == state["_key"]) & (F.shiftright(part["_hash"], BITS - done + STEP) == F.col("_last")),
        ).drop(state["_key"])
        sums = (
            here.groupBy("_key", F.shiftright("_hash", BITS - done).alias("_bucket"))
            .agg(F.sum("_size").alias("_there"), F.first("_left").alias("_left"))
        )
        sums = sums.withColumn("_before", F.coalesce(F.sum("_there").over(run), F.lit(0).cast("long")))
        ends = (F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_there"))
        state = sums.where(ends).select("_key", "_bucket", (F.col("_left") - F.col("_before")).alias("_left"), "_there")
        state = shared_table(state, "threshold")
    return state


def thresholds(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Per source with words: whole copies, the hash where the rest of its budget ends, and what is left there.

    rows holds _key, _hash and _size; goal comes from targets(). Returns _key, source_size, target, copies,
    _hash_at, _left (words still wanted of that hash value) and _there (words that it has).
    """
    budget = F.floor("target").cast("long")
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    state = goal.select("_key", (budget - F.col("copies") * F.col("source_size")).alias("_left"))
    state = _ends(rows, state)
    return shared_table(goal.join(state.withColumnRenamed("_bucket", "_hash_at"), "_key", "left"), "mix")


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source_size, target and taken: words that the mix takes of each row, repeats counted.

    Below the threshold a document counts once more than its source's whole copies. Documents that share the very
    hash value of the threshold are taken in part, in proportion to their size.
    """
    part = F.floor(F.col("_size") * F.col("_left") / F.col("_there")).cast("long")
    more = F.when(F.col("_hash") < F.col("_hash_at"), F.col("_size")).when(F.col("_hash") == F.col("_hash_at"), part)
    total = F.col("_size") * F.coalesce("copies", F.lit(0)) + F.coalesce(more, F.lit(0))
    joined = rows.drop("source_size", "target", "taken").join(plan, "_key", "left")
    return joined.withColumn("taken", total.cast("long")).drop("copies", "_hash_at", "_left", "_there")


def mix_plan(rows: DataFrame) -> DataFrame:
    """The thresholds of all rows of sized()."""
    small = rows.select("_key", "_hash", "_size")
    return thresholds(small, shared_table(targets(small), "targets"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs.

    Null texts have size 0 and are taken with 0 words; rows with a null source are a source of their own, the
    last. Repeated rows share a hash and are counted each; an empty table gives no rows.
    """
    rows = shared_table(sized(docs.select("doc_id", "text", "source")).select("doc_id", "_key", "_hash", "_size"), "sizes")
    return taken(rows, mix_plan(rows)).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


def head_of(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word (n from 1 to its number of words), as it is written."""
    parts = F.split(F.translate(text, SPACES[1:], " " * 5), " ")
    ends = F.filter(F.transform(parts, lambda p, i: F.when(p != "", i + 1)), lambda i: i.isNotNull())
    return F.substring(text, F.lit(1), F.length(F.array_join(F.slice(parts, F.lit(1), F.element_at(ends, n)), " ")))


def _ties(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """_key, _tie_at, _tie_left, _tie_there: the threshold among the rows that share their source's threshold hash.

    Repeated and null ids share a hash. What mix() takes of such rows in proportion is given here to whole texts in
    the order of their own hashes, so that one distinct text of a source at most is cut.
    """
    tied = rows.where("_size > 0").join(plan.select("_key", "_hash_at", "_left", "_there"), "_key").where("_hash = _hash_at")
    part = F.floor(F.col("_size") * F.col("_left") / F.col("_there")).cast("long")
    budget = shared_table(tied.groupBy("_key").agg(F.sum(part).alias("_left")), "tied")
    ends = _ends(tied.select("_key", F.col("_tie").alias("_hash"), "_size"), budget)
    return ends.select("_key", F.col("_bucket").alias("_tie_at"), F.col("_left").alias("_tie_left"), F.col("_there").alias("_tie_there"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: a row per whole copy, and one with the first words where a part is taken.

    All columns of docs stay as they are, whatever their names, but for the text of what is cut and its n_chars.
    """
    rows = sized(docs)
    small = shared_table(rows.select("_key", "_hash", "_size", "_tie"), "sizes")
    plan = mix_plan(small)
    plan = plan.join(_ties(small, plan), "_key", "left").withColumns({"_at": F.col("_hash_at"), "_n": F.col("copies")})
    d = taken(rows, F.broadcast(shared_table(plan, "plan")))  # one row per source
    share = F.floor(F.col("_size") * F.col("_tie_left") / F.col("_tie_there")).cast("long")
    more = F.when(F.col("_tie") < F.col("_tie_at"), F.col("_size")).when(F.col("_tie") == F.col("_tie_at"), share).otherwise(0)
    tied = (F.col("_hash") == F.col("_at")) & (F.col("_size") > 0)
    d = d.withColumn("_taken", F.when(tied, F.col("_size") * F.col("_n") + more).otherwise(F.col("taken"))).where("_taken > 0")
    n = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    rest = (F.col("_taken") - n * F.col("_size")).cast("int")
    head = F.when(rest > 0, F.array(head_of(text_of(), rest))).otherwise(F.array().cast("array<string>"))
    d = d.select("_doc", F.explode(F.concat(F.array_repeat("text", n), head)).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return d.select(*[new[c].alias(c) if c in new else field_of("_doc", c).alias(c) for c in docs.columns])
