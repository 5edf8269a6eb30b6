"""Fill-in-middle transformation of whole texts.

A text is cut at two unit ends into prefix, middle and suffix, and rearranged so that a model that reads from left to
right learns to fill the middle. One Arrow-batched UDF does it: ``finditer`` of the regex library yields the units,
whose end offsets are kept in a compact array of machine integers; two lookups in it slice the text; hashlib makes the
seeds and, where asked for, the digests. A row depends on nothing but its own id and text, so that a retried task gives
the same rows, and the operator shuffles nothing.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of, whole_row

#: A unit is a word with the spaces before it, or the spaces at the end of a text.
UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_RATE, SPM_RATE = 42, 50, 80

FIELDS = {
    "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string",
    "output_sha256": "string", "restored_sha256": "string",
}


def unit_ends(text: str) -> array:
    """The offset behind each unit, in code points."""
    return array("Q", (m.end() for m in UNIT.finditer(text)))


def seeds(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four 32-bit integers of a document; a null id has those of an empty decimal."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else int(doc_id)}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id: int | None, text: str, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text; the counts are None in the plain form.

    Of 100 documents ``fim_rate`` are rearranged, and of 100 of those ``spm_rate`` with the suffix first. A text that
    is empty or holds one of the marks stays plain.
    """
    ends = unit_ends(text)
    n, (h1, h2, h3, h4) = len(ends), seeds(doc_id, seed)
    if not text or h3 % 100 >= fim_rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first - 1] if first else 0, ends[last - 1] if last else 0
    prefix, middle, suffix = PREFIX + text[:a], text[a:b], SUFFIX + text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, suffix + prefix + MIDDLE + middle
    return n, "psm", a, b - a, prefix + suffix + MIDDLE + middle


def restore(output: str, form: str) -> str:
    """The text that transform() made an output of this form from.

    No mark is in the text, and none can overlap its own edges, so that the first of each kind is the one put there.
    """
    if form == "plain":
        return output
    outer, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = outer.removeprefix(PREFIX).split(SUFFIX, 1)
    else:
        suffix, prefix = outer.removeprefix(SUFFIX).split(PREFIX, 1)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def fill_in_middle(
    docs: DataFrame, fields: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output"), seed: int = SEED,
    fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE,
) -> DataFrame:
    """Every row of docs (doc_id, text and any others, kept in the struct ``doc``) with the fields asked for.

    fields are of FIELDS: ``output`` is the rearranged text, the digests are of it and of the text rebuilt from it. A
    null text is empty; empty texts have no unit and stay plain. Repeated rows give repeated results. Only what is
    asked for leaves the Python worker.
    """

    def rearrange(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            out: dict[str, list] = {f: [] for f in fields}
            for doc_id, text in zip(ids, texts, strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                row = dict(zip(FIELDS, transform(doc_id, text, seed, fim_rate, spm_rate), strict=False))
                if "output_sha256" in out:
                    row["output_sha256"] = _sha256(row["output"])
                if "restored_sha256" in out:
                    row["restored_sha256"] = _sha256(restore(row["output"], row["form"]))
                for f in fields:
                    out[f].append(row[f])
            yield pd.DataFrame({f: pd.Series(v, dtype="Int64" if FIELDS[f] == "long" else "object") for f, v in out.items()})

    kinds = ", ".join(f"{f} {FIELDS[f]}" for f in fields)
    # An id travels as text: long integers that share a batch with nulls would become inexact doubles.
    made = F.pandas_udf(rearrange, kinds)(F.col("doc_id").cast("long").cast("string"), text_of())
    return docs.select(whole_row(docs).alias("doc"), made.alias("_made")).select("doc", "_made.*")
