"""Keyed state over a stream of messages: the last user message of every conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LAST = "turn long, image binary, question string"
FOUND = "conv_id long, turn long, image binary, question string"


def _frame(conv_id: int, turn: int, image: bytes | None, question: str | None) -> pd.DataFrame:
    return pd.DataFrame({"conv_id": [conv_id], "turn": [turn], "image": pd.Series([image], dtype=object), "question": pd.Series([question], dtype=object)})


class LastMessage(StatefulProcessor):
    """The last user message of one conversation, by turn and not by arrival.

    Messages come in any order and any batches. A message that is no later than the one known changes nothing, so that
    repeats are harmless. What is later goes out at once, or, to be settled, when the conversation has been quiet; then
    its state goes too.
    """

    def __init__(self, quiet: int | None, settle: bool) -> None:
        self.quiet, self.settle = quiet, settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", LAST)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.last.get() if self.last.exists() else None
        best = known
        for pdf in rows:
            pdf = pdf[pdf["turn"].notna()]
            if len(pdf):
                r = pdf.loc[pdf["turn"].idxmax()]
                if best is None or int(r["turn"]) > best[0]:
                    best = (int(r["turn"]), None if r["image"] is None else bytes(r["image"]), None if pd.isna(r["question"]) else str(r["question"]))
        if best is not None and best is not known:
            self.last.update(best)
        if self.quiet is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        if best is not known and not self.settle:
            yield _frame(int(key[0]), *best)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.last.get() if self.last.exists() else None
        self.last.clear()
        if self.settle and known is not None:
            yield _frame(int(key[0]), *known)

    def close(self) -> None:
        pass


def last_messages(asked: DataFrame, quiet: int | None = None, settle: bool = False) -> DataFrame:
    """conv_id, turn, image, question over a stream of such rows: a row whenever a conversation has a later message.

    Of all rows of a conversation the one of the largest turn is what a batch would have found. State is a message for
    each conversation; after ``quiet`` milliseconds without a message it goes, and the conversation begins anew. To
    ``settle`` is to give one row for each conversation, when it has been quiet. A null conversation is left out.
    """
    if settle and quiet is None:
        raise ValueError("to settle needs a time of quiet")
    rows = asked.where("conv_id is not null").selectExpr("cast(conv_id as long) as conv_id", "turn", "image", "question")
    mode = "None" if quiet is None else "ProcessingTime"
    return rows.groupBy("conv_id").transformWithStateInPandas(LastMessage(quiet, settle), FOUND, "Append", mode)
