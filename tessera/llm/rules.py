"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger, a table that can be stored, holds the measurements and one long
whose bit i is set where rule i fails. Policies are versioned masks over that long, and ablations (what a policy would
keep without one of its rules) come from bitwise counts over the ledger, without a second look at a text. All of it is
column expressions on Spark's own functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_table, text_of, whole_row, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def measured(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_caps and n_marks (all long).

    n_caps are words of two and more capitals without small letters, n_marks digits and punctuation (both of ASCII). A
    null text is empty and measures zero throughout. Windows of words are compared by 64-bit hashes.
    """
    text, words, w = F.col("_text"), F.col("_words"), window
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumn("_text", text_of())
    d = d.withColumn("_words", words_of(text)).withColumn("_lines", lines)
    d = d.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_caps": F.size(F.filter("_words", lambda x: ~x.rlike("[a-z]") & x.rlike("[A-Z][^A-Z]*[A-Z]"))).cast("long"),
        "n_marks": F.length(F.translate("_text", "0123456789.,;:'\"()- \t\n\x0b\x0c\r", "")).cast("long"),
        "_hash": F.transform("_words", lambda x: F.xxhash64(x)),
    })
    d = d.withColumn("n_marks", F.col("word_chars") - F.col("n_marks"))
    hashes = F.transform(F.sequence(F.lit(1), F.size("_hash") - (w - 1)), lambda i: F.xxhash64(F.slice("_hash", i, w)))
    d = d.withColumn("_seen", F.when(F.size("_hash") >= w, hashes).otherwise(F.array().cast("array<long>")))
    twice = F.size(F.array_distinct("_seen")) < F.size("_seen")
    pairs = F.sort_array(F.transform("_seen", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    d = d.withColumn("_pairs", F.when(twice, pairs))
    same = F.transform(
        "_pairs",
        lambda x, i: F.when(
            (F.get("_pairs", i - 1)["h"] == x["h"]) | (F.get("_pairs", i + 1)["h"] == x["h"]), x["p"]
        ),
    )
    d = d.withColumn("_at", F.sort_array(F.filter(same, lambda p: p.isNotNull())))
    reach = F.transform("_at", lambda p, i: F.least(F.lit(w), F.coalesce(F.get("_at", i + 1) - p, F.lit(w))))
    total = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    # A filter on what follows would move below these projections and repeat all of them in its condition; it does
    # not move below an expression that depends on the row's place, so one is added that is always zero.
    barrier = F.monotonically_increasing_id() * 0
    d = d.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")) + barrier)
    return d.drop("_text", "_words", "_lines", "_hash", "_seen", "_pairs", "_at")


@dataclass(frozen=True)
class Rule:
    """One rule: its name and the condition, over measurements, under which a document fails it."""

    name: str
    fails: Column


def rules() -> list[Rule]:
    """The rules in bit order. The first two are the base rules."""
    n = F.col("n_words")
    return [
        Rule("few_words", n < 20),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 30 * n),
        Rule("many_symbols", 100 * F.col("n_symbols") > 30 * n),
        Rule("capitals", 100 * F.col("n_caps") > 30 * n),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") > n),
        Rule("long_words", F.col("word_chars") > 40 * n),
        Rule("mostly_marks", 100 * F.col("n_marks") > 70 * F.col("word_chars")),
    ]


BASE = 0b000011
#: Versioned policies: the bits that a document must not have. Version 2 leaves out duplicate lines.
POLICIES = {"v1": 0b1111111, "v2": 0b1101111}
CURRENT = "v2"


def ledger(docs: DataFrame) -> DataFrame:
    """docs with all measurements and ``fail_bits``. Columns of docs under these names give way to the ledger's."""
    d = measured(docs)
    bits = [F.when(r.fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return d.withColumn("fail_bits", total)


MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_caps", "n_marks")


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of docs as a table in the shared folder: doc_id, all measurements and fail_bits, a row per row."""
    return shared_table(ledger(docs.select("doc_id", "text")).select("doc_id", *MEASUREMENTS, "fail_bits"), "ledger")


def verdict(policy: str = CURRENT, bits: str = "fail_bits") -> Column:
    """True where a policy keeps the document; the base rules hold in every version."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy] | BASE).cast("long")) == 0


def judged(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """docs with the ledger, ``base_failed`` and ``kept``."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return ledger(docs).withColumns({"base_failed": failed, "kept": verdict(policy)})


def kept_only(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs that a policy keeps, with the columns of docs as they are, whatever their names."""
    whole = docs.select("text", whole_row(docs).alias("_doc"))
    return judged(whole, policy).where("kept").select("_doc.*")


def ablation(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: rows that fail it, that only it rejects, and that the policy keeps with and without it.

    Rows are counted by their bits first, so at most 2 to the number of rules rows are shuffled per task.
    """
    mask = POLICIES[policy] | BASE
    counts = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    used = [(r.name, 1 << i) for i, r in enumerate(rules()) if mask >> i & 1]
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in used])
    rows = counts.withColumn("r", F.explode(each)).select("bits", "n", "r.rule", "r.bit")
    n, bits, bit = F.col("n"), F.col("bits"), F.col("bit")
    zero = F.lit(0).cast("long")
    return rows.groupBy("rule").agg(
        F.sum(F.when(bits.bitwiseAND(bit) != 0, n).otherwise(zero)).alias("failed"),
        F.sum(F.when(bits == bit, n).otherwise(zero)).alias("failed_alone"),
        F.sum(F.when(bits == 0, n).otherwise(zero)).alias("kept"),
        F.sum(F.when((bits == 0) | (bits == bit), n).otherwise(zero)).alias("kept_without"),
    )
