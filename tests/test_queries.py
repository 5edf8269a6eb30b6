"""Registered queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tessera.plans.oracle import SQL
from tessera.plans.queries import QUERIES

SF = Path("/root/testdata/sf0.001")
#: One of each kind; the driver compares them all.
NAMES = ["softmax_topk", "nms", "seg_histogram", "depth_stats", "zero_shot_topk", "greedy_decode", "chat_route", "chat_reply", "cosine_topk_neighbors",
         "image_round_trip", "image_resize_preprocess", "tokenize_clip", "attention_mask", "text_encode", "pixel_bytes", "guided_batch", "vae_scale",
         "task_classify", "task_segment", "task_depth", "task_embed", "task_detect", "task_zero_shot", "task_caption", "task_segment_prompts",
         "task_generate", "event_windows", "chat_stream", "image_formats", "seg_runs", "nms_together", "wordpiece", "segment_prompt_table", "prompt_noise", "detections_udtf", "image_folder", "scheduler_requests"]


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "benchmark", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, str(SF)).toPandas()[list(want.columns)]
    key = lambda r: tuple("" if x is None else f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x) for x in r)
    assert sorted(map(key, got.itertuples(index=False))) == sorted(map(key, want.itertuples(index=False)))


def equal_on(spark, folder, name, vectors):
    """The query's rows are its SQL's on a table of these vectors."""
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, 0)", [(i, None if v is None else v.tolist()) for i, v in enumerate(vectors)])
    con.execute(f"COPY embeddings TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    want = con.execute(SQL[name])
    got = QUERIES[name](spark, str(folder)).select([c[0] for c in want.description])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def of_pixels(line):
    """The vector whose picture has these bytes."""
    return (np.frombuffer(bytes.fromhex(line), np.uint8) + 0.5) / 127.5 - 1


#: Pictures of check_l with a depth so close to a step that single and double precision are on different sides.
NEAR_STEPS = ["85787D8E717C7366907F928870796D7E6E7B6F7E8963758D828F6B798C8975AC8A5F94696D5C7380757F86648C75698A825D7F776C77806B90827F9B7C758685",
              "7F809F778B8C6D8592868A987F9A66718D76747579927E8E8F80A27283858680786996857872A577758C9B967581786B6D768E6063917389848269747C6E8782",
              "87708F7F846685847DA07C83708187776872748578857B7B7687A5B6846C8379879F96865F907F857F8A889B888A8F677670847575787E717F7A7D8783989395"]


def test_depths_near_a_step(spark, tmp_path):
    """the SQL reckons in the task's own precision."""
    equal_on(spark, tmp_path, "task_depth", map(of_pixels, NEAR_STEPS))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_a_null_vector_has_no_cosine(spark, tmp_path):
    """by blocks as by SQL; there were zeros for such a vector."""
    equal_on(spark, tmp_path, "cosine_pairs", [*map(of_pixels, NEAR_STEPS), None])


#: Pictures of check_l whose JPEG files came back 4 away in one channel of a pixel.
FAR_OFF = ["7B9690727B7C8B7C6891868E7E7DA2797168787C8A808794847C80927A918694758B93738B6A815F6C706D8C79777A72867B7D81769B5D776C9E6A8A556C787B",
           "7E8A71828382997A798D778C8A7B6B6876789782827A766567828D8183588A676C927A6C5D825EA7818A8683716E6391678A71848090787B796A8B757574738C"]


def test_jpeg_pictures_come_back_near(spark, tmp_path):
    """3 a channel at most, as the SQL says."""
    equal_on(spark, tmp_path, "image_formats", map(of_pixels, FAR_OFF))
