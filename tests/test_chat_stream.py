"""Replies over a stream of messages against those of the whole table."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chat, tasks, toy_onnx
from tessera.plans.queries import captioner
from tessera.sources import images
from tessera.streaming import stream
from tests.test_tasks import TINY

KIND = "conv_id long, turn long, role string, contents array<struct<media_type:string,data:binary,text:string>>"


def adapter():
    decoder, words = captioner()
    return chat.ChatAdapter(tasks.Task(toy_onnx.reshaping([3, 4, 4], [48]), TINY), decoder, words, 10, 1, 2)


def messages(rng):
    shade = lambda v: ("image/png", images.png(np.full((4, 4, 3), v, np.uint8)), None)
    txt = lambda s: ("text/plain", None, s)
    parts = [[shade(250)], [shade(3)], [txt("hi")], [shade(3), txt("what")], [txt(" "), shade(250), shade(1)], [("image/png", b"junk", None)], [], None]
    rows = [(c, t, rng.choice(["user", "user", "assistant"]), rng.choice(parts)) for c in range(40) for t in rng.sample(range(30), rng.randrange(1, 9))]
    rows += [rows[0], rows[0], (None, 3, "user", parts[0]), (99, None, "user", parts[0]), (99, 1, "user", parts[1]), (98, 1, "assistant", parts[0])]
    rng.shuffle(rows)
    return rows


def read(spark, folder):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 2).parquet(folder)


def write(spark, rows, folder, files):
    for part in range(files):
        spark.createDataFrame(rows[part::files], KIND).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_gives_the_tables_replies_also_after_a_restart(spark, tmp_path, seed):
    rows, bot = messages(random.Random(seed)), adapter()
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    half = len(rows) // 2
    write(spark, rows[:half], source, 3)
    for _ in range(2):  # a second run without new files adds nothing
        stream.run_available(read(spark, source), bot.reply_stream, out, checkpoint)
    before = spark.read.parquet(out).count()
    write(spark, rows[half:], source, 4)
    stream.run_available(read(spark, source), bot.reply_stream, out, checkpoint)
    got = spark.read.parquet(out)
    assert got.count() > before == spark.read.parquet(out).limit(before).count()
    assert got.groupBy("conv_id", "turn").count().where("count > 1").count() == 0  # each message is answered once
    last = got.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    want = bot.reply(spark.createDataFrame(rows, KIND).where("conv_id is not null"))
    assert {r["conv_id"]: r["text"] for r in last.collect()} == {r["conv_id"]: r["text"] for r in want.collect()}


def test_a_quiet_conversation_is_settled_once(spark, tmp_path):
    """Answers come when nothing has been said for a time, and the state goes with them."""
    bot, source, out = adapter(), str(tmp_path / "in"), str(tmp_path / "out")
    shade = lambda v: [("image/png", images.png(np.full((4, 4, 3), v, np.uint8)), None)]
    write(spark, [(1, 1, "user", shade(250)), (1, 2, "user", shade(3)), (2, 1, "user", [("text/plain", None, "hi")])], source, 1)
    spark.conf.set(stream.PROVIDER, stream.ROCKSDB)
    query = bot.reply_stream(read(spark, source), 2000, True).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
    query = query.trigger(processingTime="500 milliseconds").start(out)
    spark.conf.unset(stream.PROVIDER)
    try:
        until, found = time.time() + 90, {}
        while len(found) < 2 and time.time() < until and query.isActive:
            time.sleep(1)
            found = {r["conv_id"]: (r["turn"], r["text"]) for r in spark.read.schema("conv_id long, turn long, role string, text string").parquet(out).collect()} if any(tmp_path.glob("out/_spark_metadata/*")) else {}
        assert found == {1: (2, "a dog"), 2: (1, chat.NO_IMAGE)}
        write(spark, [(1, 1, "user", shade(250))], source, 1)  # begins anew: its state is gone
        while len(spark.read.parquet(out).collect()) < 3 and time.time() < until and query.isActive:
            time.sleep(1)
        assert sorted((r["conv_id"], r["turn"], r["text"]) for r in spark.read.parquet(out).collect())[0] == (1, 1, "a cat")
    finally:
        query.stop()


def test_to_settle_needs_quiet(spark):
    with pytest.raises(ValueError):
        adapter().reply_stream(spark.createDataFrame([], KIND), None, True)
