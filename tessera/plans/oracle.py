"""SQL of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from tessera.plans.queries import HEADS, INSIDE

E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
ROWS = "r AS (SELECT vec_id, label, unnest(range(64))::INT AS i, unnest(e) AS x FROM e)"

SOFT = f"""WITH {E}, {ROWS},
s AS (SELECT vec_id, i, x, exp(x - max(x) OVER (PARTITION BY vec_id)) AS w FROM r),
p AS (SELECT vec_id, i, w / sum(w) OVER (PARTITION BY vec_id) AS p,
             row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, i)::INT AS rank FROM s)
"""
NAME = "CASE WHEN i < 40 THEN 'class_' || i ELSE i::VARCHAR END"

POOL = "m AS (SELECT vec_id, (i % 16)::INT AS pos, avg(x) AS v FROM r GROUP BY ALL)"

YOLO = f"""{E}, {ROWS},
raw AS (SELECT vec_id, i // 8 AS k, i % 8 AS box,
               CASE WHEN i < 16 THEN (x + 1) * 50 WHEN i < 32 THEN 20 + 40 * abs(x) ELSE least(1.0, 4 * abs(x)) END AS v FROM r),
b AS (SELECT vec_id, box::INT AS box, max(v) FILTER (k = 0) AS xc, max(v) FILTER (k = 1) AS yc,
             max(v) FILTER (k = 2) AS width, max(v) FILTER (k = 3) AS height, max(v) FILTER (k > 3) AS score,
             min(k) FILTER (k > 3 AND v = best)::INT - 4 AS class_id
      FROM (SELECT *, max(v) FILTER (k > 3) OVER (PARTITION BY vec_id, box) AS best FROM raw) GROUP BY ALL),
d AS (SELECT vec_id, box, class_id, xc - width / 2 AS x, yc - height / 2 AS y, width, height, score FROM b WHERE score > 0.25)
"""
IOU = """CASE WHEN a.width * a.height + c.width * c.height - greatest(least(a.x + a.width, c.x + c.width) - greatest(a.x, c.x), 0)
  * greatest(least(a.y + a.height, c.y + c.height) - greatest(a.y, c.y), 0) > 0
  THEN (greatest(least(a.x + a.width, c.x + c.width) - greatest(a.x, c.x), 0)
  * greatest(least(a.y + a.height, c.y + c.height) - greatest(a.y, c.y), 0))
  / (a.width * a.height + c.width * c.height - greatest(least(a.x + a.width, c.x + c.width) - greatest(a.x, c.x), 0)
  * greatest(least(a.y + a.height, c.y + c.height) - greatest(a.y, c.y), 0)) ELSE 0.0 END"""
KEPT = f"""o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class_id, box) AS rk FROM d),
bad AS (SELECT c.vec_id, a.rk AS by_rk, c.rk FROM o a JOIN o c ON a.vec_id = c.vec_id AND a.class_id = c.class_id AND a.rk < c.rk
        WHERE {IOU} >= 0.45),
walk AS (SELECT vec_id, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM (SELECT DISTINCT vec_id FROM o)
         UNION ALL
         SELECT w.vec_id, w.rk + 1, CASE WHEN EXISTS (SELECT 1 FROM bad WHERE bad.vec_id = w.vec_id AND bad.rk = w.rk + 1
                AND list_contains(w.kept, bad.by_rk)) THEN w.kept ELSE list_append(w.kept, w.rk + 1) END
         FROM walk w JOIN o ON o.vec_id = w.vec_id AND o.rk = w.rk + 1),
last AS (SELECT vec_id, arg_max(kept, rk) AS kept FROM walk GROUP BY vec_id),
n AS (SELECT o.*, row_number() OVER (PARTITION BY o.vec_id ORDER BY o.rk) AS place FROM o JOIN last USING (vec_id) WHERE list_contains(last.kept, o.rk))
"""
BOX = "vec_id, box, class_id, round(x, 5) AS x, round(y, 5) AS y, round(width, 5) AS width, round(height, 5) AS height, round(score, 5) AS score"
NMS = f"WITH RECURSIVE {YOLO}, {KEPT} SELECT {BOX} FROM n"

SEG = f"WITH {E}, {ROWS}, c AS (SELECT vec_id, (i % 16)::INT AS pos, arg_min(i // 16, (-x, i // 16))::INT AS value FROM r GROUP BY ALL)"
DEPTH = f"""WITH {E}, {ROWS}, t AS (SELECT *, min(x) OVER (PARTITION BY vec_id) AS low, max(x) OVER (PARTITION BY vec_id) AS high FROM r),
d AS (SELECT vec_id, i, low, high, (x - low) / CASE WHEN high - low < 1e-8 THEN 1.0 ELSE high - low END AS v FROM t)
"""
EMBED = f"WITH {E}, {ROWS}, {POOL}, q AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM m GROUP BY vec_id) SELECT vec_id, pos, round(CASE WHEN n > 0 THEN v / n ELSE v END, 5) + 0.0 AS value FROM m JOIN q USING (vec_id)"
ZERO = f"""WITH {E}, {ROWS},
t AS (SELECT label AS candidate, i, avg(x) AS x FROM r GROUP BY ALL),
c AS (SELECT r.vec_id, candidate, sum(r.x * t.x) / (sqrt(sum(r.x * r.x)) * sqrt(sum(t.x * t.x))) AS cosine
      FROM r JOIN t ON r.i = t.i GROUP BY ALL),
s AS (SELECT *, exp(100 * cosine - max(100 * cosine) OVER (PARTITION BY vec_id)) AS w FROM c),
p AS (SELECT vec_id, candidate, cosine, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM s)
"""
COS = f"""WITH {E}, c AS (SELECT a.vec_id AS a, b.vec_id AS b,
  list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS cosine
  FROM e a JOIN e b ON a.vec_id < b.vec_id)
"""
BYTES = f"{E}, {ROWS}, px AS (SELECT vec_id, i // 4 AS pixel, i % 4 AS ch, floor((x + 1) * 127.5) AS v FROM r)"
TENSOR = f"""WITH {BYTES}, t AS (SELECT vec_id, ((2 - ch) * 16 + pixel)::INT AS pos,
  (v / 255 - list_extract([0.485, 0.456, 0.406], (3 - ch)::INT)::DOUBLE) / list_extract([0.229, 0.224, 0.225], (3 - ch)::INT)::DOUBLE AS value
  FROM px WHERE ch < 3)
"""
#: The tensor as the model gets it: every step in single precision.
SINGLE = f"""WITH {BYTES}, t AS (SELECT vec_id, ((2 - ch) * 16 + pixel)::INT AS pos,
  (v::FLOAT * (1 / 255::DOUBLE)::FLOAT - list_extract([0.485, 0.456, 0.406]::FLOAT[], (3 - ch)::INT)) / list_extract([0.229, 0.224, 0.225]::FLOAT[], (3 - ch)::INT) AS value
  FROM px WHERE ch < 3)
"""
BILINEAR = f"""{DEPTH.replace('WITH', 'WITH', 1)},
g AS (SELECT o, (o + 0.5) * (8 / 12) - 0.5 AS src FROM (SELECT unnest(range(12))::INT AS o)),
w AS (SELECT o, greatest(floor(src), 0)::INT AS low, least(greatest(floor(src), 0)::INT + 1, 7) AS high, src - floor(src) AS f FROM g),
z AS (SELECT vec_id, list(v ORDER BY i) AS v FROM d GROUP BY vec_id)
SELECT vec_id, y.o * 12 + x.o AS pos,
  round((v[y.low * 8 + x.low + 1] * (1 - x.f) + v[y.low * 8 + x.high + 1] * x.f) * (1 - y.f)
      + (v[y.high * 8 + x.low + 1] * (1 - x.f) + v[y.high * 8 + x.high + 1] * x.f) * y.f, 5) + 0.0 AS value
FROM z, w y, w x
"""
DECODE = f"""WITH RECURSIVE {E}, {ROWS},
best AS (SELECT vec_id, i // 8 AS token, arg_min(i % 8, (-x, i % 8)) AS following FROM r GROUP BY ALL),
walk AS (SELECT vec_id, 0 AS n, 0::BIGINT AS token, ''::VARCHAR AS tokens FROM e
         UNION ALL SELECT w.vec_id, n + 1, b.following, CASE WHEN b.following = 7 THEN tokens ELSE trim(tokens || ' ' || b.following) END
         FROM walk w JOIN best b ON b.vec_id = w.vec_id AND b.token = w.token WHERE n < 6 AND w.token <> 7)
SELECT vec_id, arg_max(tokens, n) AS tokens FROM walk GROUP BY vec_id
"""
#: 8 x 8 pixels from 4 x 4, as a table of places and weights by axis.
RESIZED = f"""WITH {BYTES},
g AS (SELECT o, (o + 0.5::DOUBLE) * 0.5::DOUBLE - 0.5::DOUBLE AS src FROM (SELECT unnest(range(8))::INT AS o)),
w AS (SELECT o, greatest(floor(src), 0)::INT AS low, least(greatest(floor(src), 0)::INT + 1, 3) AS high, src - floor(src) AS f FROM g),
z AS (SELECT vec_id, ch, list(v ORDER BY pixel) AS v FROM px WHERE ch < 3 GROUP BY vec_id, ch)
SELECT vec_id, ((2 - ch) * 64 + y.o * 8 + x.o)::INT AS pos, round(
  (v[y.low * 4 + x.low + 1] * (1 - x.f) + v[y.low * 4 + x.high + 1] * x.f) * (1 - y.f)
  + (v[y.high * 4 + x.low + 1] * (1 - x.f) + v[y.high * 4 + x.high + 1] * x.f) * y.f, 5) + 0.0 AS value
FROM z, w y, w x
"""
#: Words, as bytes: a token is a number between blanks, the last byte of a word 256 more, merges from 512 by rank.
TOKENS = """words AS (SELECT {id} AS id, text IS NULL AS lost,
    regexp_extract_all(lower(text), '''s|''t|''re|''ve|''m|''ll|''d|\\p{{L}}+|\\p{{N}}|[^\\s\\p{{L}}\\p{{N}}]+') AS words FROM {table}),
t AS (SELECT id, lost, list_transform(words, lambda w: array_to_string(list_transform(range(octet_length(encode(w))),
    lambda i: ' ' || (('0x' || hex(encode(w))[2 * i + 1 : 2 * i + 2])::INT + CASE WHEN i + 1 = octet_length(encode(w)) THEN 256 ELSE 0 END) || ' '), '')) AS words FROM words),
m AS (SELECT id, lost, replace(replace(replace(replace(array_to_string(words, '|'), ' 116  104 ', ' 512 '), ' 512  357 ', ' 513 '), ' 97  110 ', ' 514 '), ' 105  110 ', ' 515 ') AS line FROM t),
seq AS (SELECT id, lost, list_filter(string_split_regex(line, '[ |]+'), lambda x: x <> '')[:75] AS part FROM m),
ids AS (SELECT id, CASE WHEN NOT lost THEN ['49406'] || part || ['49407'] || list_transform(range(75 - len(part)), lambda i: '0') END AS ids FROM seq)
"""
DOCS = TOKENS.format(id="doc_id", table="documents")
LAST = "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id"
REPLY = f"""SELECT conv_id, 'assistant' AS role, CASE WHEN turn % 4 <> 0 THEN 'No image found in the message. Please provide an image.'
        ELSE CASE WHEN turn % 8 = 0 THEN 'a ' ELSE '' END || CASE WHEN conv_id * 37 % 256 / 255 >= 0.485 THEN 'cat' ELSE 'dog' END END AS text FROM ({LAST})"""

_longest_first = lambda pieces: "|".join(sorted(pieces, key=len, reverse=True))
#: Alternatives in the order of their length are the longest match first.
WORDPIECE = f"""WITH w AS (SELECT doc_id, text IS NULL AS lost, regexp_extract_all(lower(text), '[\\p{{P}}\\p{{S}}]|[^\\s\\p{{P}}\\p{{S}}]+') AS words FROM documents),
t AS (SELECT doc_id, lost, list_transform(words, lambda w: {{'h': regexp_extract(w, '^(?:{_longest_first(HEADS[1:])})'), 'w': w}}) AS ws FROM w),
u AS (SELECT doc_id, lost, list_transform(ws, lambda s: {{'h': s.h, 'r': regexp_extract_all(substr(s.w, len(s.h) + 1), '(?s:{_longest_first(INSIDE)}|.)')}}) AS ws FROM t),
v AS (SELECT doc_id, lost, flatten(list_transform(ws, lambda s: CASE WHEN s.h = '' OR len(list_filter(s.r, lambda x: NOT list_contains({INSIDE}, x))) > 0 THEN [0]
      ELSE [list_position({HEADS}, s.h) - 1] || list_transform(s.r, lambda x: list_position({INSIDE}, x) + {len(HEADS) - 1}) END)) AS ids FROM u)
SELECT doc_id, CASE WHEN NOT lost THEN len(ids) END::INT AS pieces, CASE WHEN NOT lost THEN len(list_filter(ids, lambda i: i = 0)) END::INT AS unknown,
       CASE WHEN NOT lost THEN md5(array_to_string(ids::VARCHAR[], ' ')) END AS ids FROM v
"""

DETECT = TENSOR.replace("WITH ", "WITH RECURSIVE ", 1) + f""", q AS (SELECT vec_id, pos % 8 AS box, list(value ORDER BY pos) AS v FROM t GROUP BY ALL),
        d AS (SELECT vec_id, box, CASE WHEN v[6] > v[5] THEN 1 ELSE 0 END AS class_id, v[1] - v[3] / 2 AS x, v[2] - v[4] / 2 AS y, v[3] AS width, v[4] AS height,
              greatest(v[5], v[6]) AS score FROM q WHERE greatest(v[5], v[6]) > 0.5), {KEPT}"""

SQL = {
    "softmax_topk": SOFT + "SELECT vec_id, rank, i AS class_id, round(p, 6) AS probability FROM p WHERE rank <= 5",
    "label_lookup": SOFT + f"SELECT vec_id, rank, {NAME} AS label FROM p WHERE rank <= 3",
    "argmax_label": SOFT + f"SELECT vec_id, {NAME} AS predicted FROM p WHERE rank = 1",
    "cls_pool": f"WITH {E}, {ROWS} SELECT vec_id, i AS pos, round(x, 5) + 0.0 AS value FROM r WHERE i < 16",
    "mean_pool": f"WITH {E}, {ROWS}, {POOL} SELECT vec_id, pos, round(v, 5) + 0.0 AS value FROM m",
    "l2_normalize": EMBED,
    "transpose": f"WITH {E}, {ROWS} SELECT vec_id, ((i % 16) * 4 + i // 16)::INT AS pos, round(x, 5) + 0.0 AS value FROM r",
    "yolo_decode": f"WITH {YOLO} SELECT {BOX} FROM d",
    "iou_pairs": f"WITH {YOLO} SELECT a.vec_id, a.box AS box_a, c.box AS box_b, round({IOU}, 5) AS iou FROM d a JOIN d c ON a.vec_id = c.vec_id AND a.box < c.box",
    "nms": NMS,
    "max_detections": NMS + " WHERE place <= 2",
    "box_flatten": f"""WITH RECURSIVE {YOLO}, {KEPT}, f AS (SELECT vec_id, place, count(*) OVER (PARTITION BY vec_id)::INT AS n_boxes,
        [x, y, width, height, class_id, score] AS six FROM n WHERE place <= 2)
        SELECT vec_id, n_boxes, ((place - 1) * 6 + k)::INT AS pos, round(six[k + 1]::FLOAT::DOUBLE, 3) + 0.0 AS value FROM f, (SELECT unnest(range(6)) AS k)""",
    "seg_argmax": SEG + " SELECT vec_id, pos, value FROM c",
    "seg_resize_nearest": SEG + """ SELECT vec_id, (y * 6 + x)::INT AS pos, value FROM c, (SELECT unnest(range(8)) AS y), (SELECT unnest(range(6)) AS x)
        WHERE pos = (y * 4 // 8) * 4 + x * 4 // 6""",
    "seg_label_at": SEG + " SELECT vec_id, value AS class_id, ['road', 'sky', 'tree'][value + 1] AS name FROM c WHERE pos = 6",
    "seg_histogram": SEG + " SELECT vec_id, value AS class_id, count(*) AS pixels, round(100 * count(*) / 16, 4) AS percent FROM c GROUP BY vec_id, value",
    "depth_minmax": DEPTH + "SELECT vec_id, i AS pos, round(v, 5) + 0.0 AS value FROM d",
    "depth_stats": DEPTH + """SELECT vec_id, round(avg(v), 5) AS mean, round(list_extract(list_sort(list(v)), 33), 5) AS median,
        round(any_value(low), 5) AS low, round(any_value(high), 5) AS high FROM d GROUP BY vec_id""",
    "depth_preview": DEPTH + "SELECT vec_id, i AS pos, greatest(0, least(3, floor(v * 4)))::INT AS shade FROM d WHERE i % 8 < 4 AND i < 32",
    "depth_resize_bilinear": BILINEAR,
    "image_preprocess": TENSOR + "SELECT vec_id, pos, round(value, 4) + 0.0 AS value FROM t",
    "image_resize_preprocess": RESIZED,
    "image_round_trip": f"""WITH {BYTES} SELECT vec_id, 4::INT AS width, 4::INT AS height, 'image/png' AS media_type,
        string_agg(printf('%02X', v::INT), '' ORDER BY pixel, ch) AS pixels, 'image/bmp' AS other_type,
        string_agg(printf('%02X', v::INT), '' ORDER BY pixel, ch) FILTER (ch < 3) AS other_pixels FROM px GROUP BY vec_id""",
    "zero_shot_scores": ZERO + "SELECT vec_id, candidate, round(cosine, 5) AS cosine, round(p, 4) AS probability FROM p",
    "zero_shot_topk": ZERO + """SELECT vec_id, rank::INT AS rank, candidate FROM (SELECT vec_id, candidate,
        row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, candidate) AS rank FROM p) WHERE rank <= 3""",
    "best_mask": f"""WITH {E}, {ROWS}, b AS (SELECT vec_id, arg_min(i - 48, (-x, i)) AS best FROM r WHERE i BETWEEN 48 AND 50 GROUP BY vec_id)
        SELECT vec_id, (i % 16)::INT AS pos, CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM r JOIN b USING (vec_id) WHERE i // 16 = best""",
    "mask_foreground": f"WITH {E}, {ROWS} SELECT vec_id, (i // 16)::INT AS mask, count(*) FILTER (x > 0)::INT AS pixels FROM r WHERE i < 48 GROUP BY ALL",
    "greedy_decode": DECODE,
    "chat_last_user": LAST,
    "wordpiece": WORDPIECE,
    "image_formats": f"""WITH {BYTES} SELECT vec_id, 'image/gif' AS media_type,
        string_agg(printf('%02X', v::INT), '' ORDER BY pixel, ch) FILTER (ch < 3) AS pixels, 'image/jpeg' AS other_type,
        4::INT AS width, 4::INT AS height, true AS near FROM px GROUP BY vec_id""",
    "seg_runs": SEG + """, m AS (SELECT vec_id, list(value ORDER BY pos) AS m FROM c GROUP BY vec_id)
        SELECT vec_id, array_to_string(list_transform(range(48), lambda p: m[(p // 6 * 4 // 8 * 4 + p % 6 * 4 // 6 + 1)::INT]), '') AS pixels,
               len(list_filter(m, lambda x: x <> 0))::BIGINT AS foreground, m[7] AS class_id FROM m""",
    "nms_together": f"""WITH RECURSIVE {YOLO}, o AS (SELECT vec_id // 16 AS picture, *, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY score DESC, class_id, vec_id, box) AS rk FROM d),
        bad AS (SELECT c.picture, a.rk AS by_rk, c.rk FROM o a JOIN o c ON a.picture = c.picture AND a.class_id = c.class_id AND a.rk < c.rk WHERE {IOU} >= 0.45),
        walk AS (SELECT picture, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM (SELECT DISTINCT picture FROM o)
                 UNION ALL
                 SELECT w.picture, w.rk + 1, CASE WHEN EXISTS (SELECT 1 FROM bad WHERE bad.picture = w.picture AND bad.rk = w.rk + 1
                        AND list_contains(w.kept, bad.by_rk)) THEN w.kept ELSE list_append(w.kept, w.rk + 1) END
                 FROM walk w WHERE w.rk < (SELECT max(rk) FROM o WHERE o.picture = w.picture))
        SELECT o.picture, vec_id, box, class_id, round(score, 5) AS score FROM o
        JOIN (SELECT picture, unnest(arg_max(kept, rk)) AS rk FROM walk GROUP BY picture) k ON k.picture = o.picture AND k.rk = o.rk""",
    "chat_route": f"""SELECT conv_id, CASE WHEN trim(text) <> '' THEN text END AS question,
        CASE WHEN turn % 4 <> 0 THEN 'none' WHEN trim(text) <> '' THEN 'answer' ELSE 'caption' END AS route FROM ({LAST})""",
    "tokenize_clip": f"WITH {DOCS} SELECT id AS doc_id, array_to_string(ids, ' ') AS ids FROM ids",
    "attention_mask": f"""WITH {DOCS} SELECT id AS doc_id, array_to_string(list_transform(ids, lambda x: CASE WHEN x = '0' THEN '0' ELSE '1' END), '') AS mask,
        coalesce(list_max(list_transform(ids, lambda x, i: CASE WHEN x <> '0' THEN i - 1 ELSE 0 END)), 0)::INT AS last FROM ids""",
    "text_encode": f"""WITH {DOCS}, c AS (SELECT id, list_transform(['513', '514', '515'], lambda k: len(list_filter(ids, lambda x: x = k))) || [77] AS c FROM ids WHERE ids IS NOT NULL)
        SELECT id AS doc_id, pos, round(c[pos + 1] / sqrt(list_inner_product(c::DOUBLE[], c::DOUBLE[])), 4) + 0.0 AS value FROM c, (SELECT unnest(range(4))::INT AS pos)""",
    "score_table": f"WITH {E}, {ROWS} SELECT vec_id, label, i AS pos, round(x, 4) + 0.0 AS value FROM r WHERE i < 4",
    "depth_at": DEPTH + "SELECT vec_id, round(v, 5) AS depth FROM d WHERE i = 2 * 8 + 5",
    "vae_scale": f"WITH {E}, {ROWS} SELECT vec_id, i AS pos, round(x / 0.18215::DOUBLE, 4) + 0.0 AS value FROM r",
    "pixel_bytes": f"""WITH {E}, {ROWS}, b AS (SELECT vec_id, i, floor(least(greatest(4 * x / 2 + 0.5::DOUBLE, 0), 1) * 255)::INT AS v FROM r WHERE i < 48)
        SELECT vec_id, ((i % 16) * 4 + i // 16)::INT AS pos, v AS value FROM b
        UNION ALL SELECT vec_id, p * 4 + 3, 255 FROM embeddings, (SELECT unnest(range(16))::INT AS p)""",
    "guided_batch": f"WITH {E}, {ROWS} SELECT vec_id, i + 4 AS pos, round(x, 5) + 0.0 AS value FROM r WHERE i < 4 UNION ALL SELECT vec_id, i, 0.0::DOUBLE FROM r WHERE i < 4",
    "scheduler_sigmas": """WITH i AS (SELECT unnest(range(1000))::INT AS i),
        b AS (SELECT i, sqrt(0.00085::DOUBLE) + i / 999 * (sqrt(0.012::DOUBLE) - sqrt(0.00085::DOUBLE)) AS r FROM i),
        a AS (SELECT i, exp(sum(ln(1 - r * r)) OVER (ORDER BY i)) AS a FROM b)
        SELECT s::INT AS step, i AS t, round(sqrt((1 - a) / a), 5) AS sigma FROM (SELECT unnest(range(20)) AS s) JOIN a ON i = 999 - s * 50""",
    "scheduler_requests": """WITH i AS (SELECT unnest(range(1000))::INT AS i),
        b AS (SELECT i, sqrt(0.00085::DOUBLE) + i / 999 * (sqrt(0.012::DOUBLE) - sqrt(0.00085::DOUBLE)) AS r FROM i),
        a AS (SELECT i, exp(sum(ln(1 - r * r)) OVER (ORDER BY i)) AS a FROM b),
        q AS (SELECT item_id, item_id % 30 AS steps, unnest(range(item_id % 30))::INT AS step FROM benchmark)
        SELECT item_id, step, i AS t, round(sqrt((1 - a) / a), 5) AS sigma FROM q JOIN a ON i = floor(999 - step * 1000 / steps)::INT""",
    "euler_step": f"""WITH {E}, {ROWS} SELECT x.vec_id, x.i AS pos, round(x.x - 0.5::DOUBLE * n.x, 5) + 0.0 AS value
        FROM r x JOIN r n ON x.vec_id = n.vec_id AND n.i = x.i + 32""",
    "scale_model_input": f"WITH {E}, {ROWS} SELECT vec_id, i AS pos, round(x / sqrt(5.0::DOUBLE), 5) + 0.0 AS value FROM r",
    "cfg_combine": f"""WITH {E}, {ROWS} SELECT u.vec_id, u.i AS pos, round(u.x + 7.5::DOUBLE * (c.x - u.x), 5) + 0.0 AS value
        FROM r u JOIN r c ON u.vec_id = c.vec_id AND c.i = u.i + 32""",
    "cosine_pairs": COS + "SELECT a, b, round(cosine, 4) + 0.0 AS cosine FROM c",
    "cosine_topk_neighbors": COS + """, t AS (SELECT a, b, round(cosine, 9) AS cosine FROM c UNION ALL SELECT b, a, round(cosine, 9) FROM c)
        SELECT a, rank::INT AS rank, b, round(cosine, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM t) WHERE rank <= 3""",
    "onnx_score": f"WITH {E} SELECT vec_id, 64::INT AS n, 64::INT AS width, round(list_sum(e), 4) AS total FROM e",
    "onnx_classify": SOFT + f"SELECT vec_id, {NAME} AS predicted FROM p WHERE rank = 1",
    "onnx_embed": EMBED,
    "onnx_detect": NMS,
    "onnx_segment": SEG + " SELECT vec_id, pos, value FROM c",
    "onnx_depth": DEPTH + "SELECT vec_id, i AS pos, round(v, 5) + 0.0 AS value FROM d",
    "task_classify": TENSOR + """, s AS (SELECT vec_id, pos, exp(value - max(value) OVER (PARTITION BY vec_id)) AS w FROM t),
        p AS (SELECT vec_id, pos, w / sum(w) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, pos) AS n FROM s)
        SELECT vec_id, (n - 1)::INT AS rank, pos AS class_id, round(p, 4) AS probability FROM p WHERE n <= 2""",
    "task_segment": TENSOR + """, c AS (SELECT vec_id, pos % 4 AS cell, arg_min(pos // 4, (-value, pos)) AS best FROM t GROUP BY ALL)
        SELECT vec_id, 4::INT AS "SegmentationMask_Width", 4::INT AS "SegmentationMask_Height", (y * 4 + x)::INT AS pos, best::INT AS class_id
        FROM c, (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS x) WHERE cell = (y // 2) * 2 + x // 2""",
    "task_depth": SINGLE + """, d AS (SELECT *, min(value) OVER (PARTITION BY vec_id) AS low, max(value) OVER (PARTITION BY vec_id) AS high FROM t),
        v AS (SELECT vec_id, pos, low, (value - low) / CASE WHEN high::DOUBLE - low::DOUBLE < 1e-8 THEN 1::FLOAT ELSE high - low END AS value FROM d)
        SELECT vec_id, round(low::DOUBLE, 3) AS low, ((pos // 4 - 1) // 3 * 4 + pos % 4)::INT AS pos,
               floor(200 * value::DOUBLE + 0.37::DOUBLE)::INT AS value FROM v WHERE pos // 4 % 3 = 1""",
    "task_embed": TENSOR + """, n AS (SELECT vec_id, sqrt(sum(value * value)) AS n FROM t WHERE pos < 16 GROUP BY vec_id)
        SELECT t.vec_id, pos, round(CASE WHEN n > 0 THEN value / n ELSE value END, 3) + 0.0 AS value FROM t JOIN n ON t.vec_id = n.vec_id WHERE pos < 16""",
    "task_detect": DETECT + """, f AS (SELECT *, count(*) OVER (PARTITION BY vec_id)::INT AS boxes FROM n)
        SELECT vec_id, boxes, ((place - 1) * 6 + k)::INT AS pos, round(([x, y, width, height, class_id, score])[k + 1], 3) + 0.0 AS value FROM f, (SELECT unnest(range(6)) AS k)""",
    "detections_udtf": DETECT + """ SELECT vec_id, (place - 1)::INT AS place, class_id, CASE class_id WHEN 0 THEN 'cat' ELSE 'dog' END AS label, round(x, 3) + 0.0 AS x,
        round(y, 3) + 0.0 AS y, round(width, 3) + 0.0 AS width, round(height, 3) + 0.0 AS height, round(score, 3) + 0.0 AS score FROM n""",
    "prompt_noise": """WITH h AS (SELECT item_id, pos, md5(item_id || ':' || pos) AS h FROM benchmark, (SELECT unnest(range(16))::INT AS pos)),
        u AS (SELECT item_id, pos, (('0x' || substr(h, 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656 AS u, ('0x' || substr(h, 13, 12))::BIGINT::DOUBLE / 281474976710656 AS v FROM h)
        SELECT item_id, pos, round(sqrt(-2 * ln(u)) * cos(2 * pi() * v), 6) AS value FROM u""",
    "image_folder": f"""WITH {BYTES} SELECT vec_id, (vec_id % 7) || '/' || vec_id || '.png' AS name, 4::INT AS width, 4::INT AS height,
        string_agg(printf('%02X', v::INT), '' ORDER BY pixel, ch) AS pixels FROM px GROUP BY vec_id""",
    "task_zero_shot": TENSOR + """SELECT vec_id, list_extract(['first', 'second', 'third'], arg_min(pos, (-value, pos))::INT + 1) AS predicted, 3::INT AS n
        FROM t WHERE pos < 3 GROUP BY vec_id""",
    "task_caption": TENSOR + """SELECT vec_id, CASE WHEN vec_id % 2 <> 0 THEN 'a ' ELSE '' END || CASE WHEN value >= 0 THEN 'cat' ELSE 'dog' END AS caption FROM t WHERE pos = 0""",
    "chat_stream": REPLY,
    "chat_reply": REPLY,
    "segment_prompt_table": TENSOR + """, n AS (SELECT vec_id, list(value) AS v FROM t WHERE pos BETWEEN 16 AND 31 GROUP BY vec_id)
        SELECT event_id, user_id AS vec_id, coalesce(len(list_filter(v, lambda x: x > event_id % 3)), 0)::INT AS pixels,
               CASE WHEN v IS NOT NULL THEN 0.75::DOUBLE END AS iou FROM events LEFT JOIN n ON n.vec_id = user_id""",
    "task_segment_prompts": TENSOR + """SELECT vec_id, k::INT AS prompt, count(*) FILTER (value > k)::INT AS pixels, 0.75::DOUBLE AS iou
        FROM t, (SELECT unnest(range(3)) AS k) WHERE pos BETWEEN 16 AND 31 GROUP BY ALL""",
    "task_generate": f"""WITH {TOKENS.format(id='item_id', table='benchmark')}
        SELECT id AS item_id, 16::INT AS width, 16::INT AS height, true AS plain,
               array_to_string(list_transform(['515', '514', '513'], lambda k: CASE WHEN list_contains(ids, k) THEN 'BF' ELSE '7F' END), '') || 'FF' AS first FROM ids""",
    "event_windows": """SELECT strftime(time_bucket(INTERVAL 5 minutes, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n
        FROM events WHERE ts IS NOT NULL GROUP BY ALL""",
}
