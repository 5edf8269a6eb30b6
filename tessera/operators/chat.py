"""Chat over conversations: what the last user message asks for, and the answer to it.

Rows are messages (conv_id, turn, role, contents), contents an array of parts (media_type, data, text).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.onnx import Model
from tessera.operators.tasks import Task, caption
from tessera.operators.tokenize import WordPieceTokenizer
from tessera.sources import images
from tessera.streaming.chat import last_messages

#: Fixed value: what a conversation without an image is told.
NO_IMAGE = "No image found in the message. Please provide an image."


def last_user(messages: DataFrame) -> DataFrame:
    """conv_id, turn and text of each conversation's last user message. Maxima are taken before the shuffle."""
    user = messages.where(F.col("role") == "user")
    last = user.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m"))
    return last.select("conv_id", "m.turn", "m.text")


def asked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, image and question of every user message (contents: media_type, data, text): its first image
    part and its first text that isn't blank. Row by row, so that a stream can be asked as well."""
    contents = F.col("contents")
    pictures = F.filter(contents, lambda c: c["media_type"].startswith("image/"))
    texts = F.filter(contents, lambda c: c["text"].isNotNull() & (F.trim(c["text"]) != ""))
    parts = F.get(pictures, F.lit(0))["data"].alias("image"), F.get(texts, F.lit(0))["text"].alias("question")
    return messages.where(F.col("role") == "user").select("conv_id", F.col("turn").cast("long").alias("turn"), *parts)


def with_route(last: DataFrame) -> DataFrame:
    """With image and question the route is "answer", with an image alone "caption", without one "none"."""
    kind = F.when(F.col("image").isNull(), "none").when(F.col("question").isNull(), "caption").otherwise("answer")
    return last.withColumn("route", kind)


def route(messages: DataFrame) -> DataFrame:
    """conv_id, image, question and route of the last user message of each conversation."""
    last = asked(messages).groupBy("conv_id").agg(F.max_by(F.struct("image", "question"), "turn").alias("m"))
    return with_route(last.select("conv_id", "m.image", "m.question"))


@dataclass(frozen=True)
class ChatAdapter:
    """Captions and answers for conversations by an image encoder and a decoder."""

    task: Task
    decoder: bytes | Model
    tokenizer: WordPieceTokenizer
    length: int = 50
    bos: int = 101
    eos: int = 102
    model_id: str = "captioning"

    def answered(self, routed: DataFrame, *keep: str) -> DataFrame:
        """conv_id, the columns to keep, role and text of rows with image, question and route.

        A message without an image is told so; an image that can't be decoded gets an empty text.
        """
        d = routed.withColumn(self.task.image, images.decode("image"))
        d = caption(d, self.task, self.decoder, self.tokenizer, "question", self.length, self.bos, self.eos, "_reply")
        text = F.when(F.col("route") == "none", NO_IMAGE).otherwise(F.col("_reply"))
        return d.select("conv_id", *keep, F.lit("assistant").alias("role"), text.alias("text"))

    def reply(self, messages: DataFrame) -> DataFrame:
        """conv_id, role, text: one assistant message for each conversation with a user message. One row holds the
        whole reply."""
        return self.answered(route(messages))

    def reply_stream(self, messages: DataFrame, quiet: int | None = None, settle: bool = False) -> DataFrame:
        """conv_id, turn, role, text over a stream of messages; see tessera.streaming.chat.last_messages."""
        return self.answered(with_route(last_messages(asked(messages), quiet, settle)), "turn")
