"""JPEG and GIF against the JVM's own reader and writer, which share no code with these."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chat, tasks, toy_onnx
from tessera.plans.queries import captioner
from tessera.sources import images
from tessera.sources.gif import gif, ungif
from tessera.sources.jpeg import ZIGZAG, jpeg, unjpeg
from tests.test_tasks import TINY


def smooth(h, w, seed=0):
    """A picture of soft waves of colour with some hard edges."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    p = np.stack([127 + 60 * np.sin(x / (5 + 3 * c) + rng.random()) + 60 * np.cos(y / (7 + 2 * c)) for c in range(3)], axis=2)
    p[h // 3 : h // 2, w // 4 : w // 2] = rng.integers(0, 256, 3)
    return np.clip(p, 0, 255).astype(np.uint8)


def written(spark, rgb, kind="jpeg", quality=0.9, progressive=False, grey=False):
    """The bytes of a file by the JVM."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(images.png(rgb)))
    other = jvm.java.awt.image.BufferedImage(image.getWidth(), image.getHeight(), 10 if grey else 5)
    other.getGraphics().drawImage(image, 0, 0, None)
    out, writer = jvm.java.io.ByteArrayOutputStream(), jvm.javax.imageio.ImageIO.getImageWritersByFormatName(kind).next()
    param = writer.getDefaultWriteParam()
    if kind == "jpeg":
        param.setCompressionMode(2)
        param.setCompressionQuality(quality)
    if progressive:
        param.setProgressiveMode(1)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(other, None, None), param)
    stream.flush()
    return bytes(out.toByteArray())


def seen(spark, data):
    """The pixels of a file by the JVM."""
    jvm = spark._jvm
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data)), "png", out)
    p = images.unpng(bytes(out.toByteArray()))
    return np.repeat(p, 3, axis=2) if p.shape[2] == 1 else p[:, :, :3]


@pytest.mark.parametrize("size", [(1, 1), (7, 9), (16, 16), (37, 50), (64, 33)])
@pytest.mark.parametrize("quality", [0.3, 0.9, 1.0])
@pytest.mark.parametrize("progressive", [False, True])
def test_other_writers_jpeg_files(spark, size, quality, progressive):
    data = written(spark, smooth(*size), quality=quality, progressive=progressive)
    ours, theirs = unjpeg(data).astype(int), seen(spark, data).astype(int)
    assert ours.shape == (*size, 3)
    assert np.abs(ours - theirs).max() <= 6 and np.abs(ours - theirs).mean() < 1


def test_grey_jpeg_files(spark):
    data = written(spark, smooth(20, 30), grey=True)
    assert unjpeg(data).shape == (20, 30, 1)
    assert np.abs(np.repeat(unjpeg(data), 3, axis=2).astype(int) - seen(spark, data)).max() <= 2


@pytest.mark.parametrize("size", [(1, 1), (8, 8), (13, 29), (40, 64)])
@pytest.mark.parametrize("noise", [False, True])
def test_own_jpeg_files(spark, size, noise):
    """At quality 100 no channel is more than 3 away, by the JVM's reader either; at 50 soft pictures stay close."""
    rgb = np.random.default_rng(4).integers(0, 256, (*size, 3), dtype=np.uint8) if noise else smooth(*size)
    data = jpeg(rgb, 100)
    assert np.abs(unjpeg(data).astype(int) - rgb).max() <= 3 and np.abs(seen(spark, data).astype(int) - rgb).max() <= 3
    small = jpeg(rgb, 50)
    assert len(small) <= len(data) and np.abs(unjpeg(small).astype(int) - seen(spark, small)).max() <= 4  # roundings of both
    if not noise and min(size) > 8:
        assert np.abs(unjpeg(small).astype(int) - rgb).mean() < 12
    assert np.array_equal(unjpeg(jpeg(np.dstack([rgb, rgb[:, :, :1]]), 100)), unjpeg(data))  # alpha is left out


@pytest.mark.parametrize("low, high, size", [(100, 150, (1600, 800)), (0, 256, (1603, 801))])
def test_no_pixel_comes_back_further_away(low, high, size):
    """among 20,000 blocks of noise several had a pixel 4 away, where the roundings of many coefficients met."""
    from tessera.sources import jpeg as module

    rgb = np.random.default_rng(low).integers(low, high, (*size, 3)).astype(np.float64)
    rgb = np.pad(rgb, ((0, -size[0] % 8), (0, -size[1] % 8), (0, 0)), mode="edge")
    blocks = np.stack([module._blocks(rgb[:, :, c]) for c in range(3)], axis=3)
    counts = module._blocks(np.pad(np.ones(size), ((0, -size[0] % 8), (0, -size[1] % 8))))
    exact = module.COSINES @ (blocks @ module.YCC.T - [128, 0, 0]).transpose(0, 3, 1, 2) @ module.COSINES.T
    x = np.round(exact)
    before, rounded = module._apart(x, blocks, counts), x.copy()
    module._settled(x, exact, blocks, counts)
    assert before.max() == 4 and module._apart(x, blocks, counts).max() <= 3
    assert np.array_equal(x[before <= 3], rounded[before <= 3])  # the others stay as they are


def test_flat_and_extreme_jpeg_pictures(spark):
    for rgb in (np.zeros((9, 9, 3), np.uint8), np.full((9, 9, 3), 255, np.uint8), (np.indices((16, 16)).sum(0) % 2 * 255).astype(np.uint8)[:, :, None].repeat(3, 2)):
        assert np.abs(unjpeg(jpeg(rgb, 100)).astype(int) - rgb).max() <= 3 and np.abs(seen(spark, jpeg(rgb, 100)).astype(int) - rgb).max() <= 3


def test_zigzag():
    assert ZIGZAG[:6] == [0, 1, 8, 16, 9, 2] and ZIGZAG[-3:] == [55, 62, 63] and sorted(ZIGZAG) == list(range(64))


@pytest.mark.parametrize("colours", [1, 2, 5, 16, 200, 256])
@pytest.mark.parametrize("size", [(1, 1), (3, 5), (70, 90)])
def test_gif_files_of_few_colours_are_exact(spark, colours, size):
    rng = np.random.default_rng(colours)
    rgb = rng.integers(0, 256, (colours, 3), dtype=np.uint8)[rng.integers(0, colours, size)]
    assert np.array_equal(ungif(gif(rgb)), rgb) and np.array_equal(seen(spark, gif(rgb)), rgb)
    assert np.array_equal(ungif(written(spark, rgb, "gif"))[:, :, :3], rgb)  # interlaced


def test_gif_files_of_many_colours(spark):
    """Long enough for the code table to fill and begin anew."""
    rgb = np.random.default_rng(1).integers(0, 256, (150, 160, 3), dtype=np.uint8)
    back = ungif(gif(rgb))
    assert np.abs(back.astype(int) - rgb).max() <= 26 and np.array_equal(back, seen(spark, gif(rgb)))
    few = rgb % 3 * 100
    assert np.array_equal(ungif(gif(few)), few)


def test_gif_places_lines_and_transparency():
    """A smaller, interlaced picture on its screen, with one colour that can't be seen."""
    from tessera.sources.gif import _packed

    places = np.arange(6 * 5).reshape(6, 5) % 4
    lines = [0, 4, 2, 1, 3, 5]
    codes = _packed(places[lines].astype(np.uint8).tobytes(), 2)
    palette = bytes(range(12))
    data = b"GIF89a" + bytes([8, 0, 9, 0, 0xF1, 0, 0]) + palette + b"!\xf9\x04\x01\x00\x00\x02\x00" + b"!\xfe\x02hi\x00"
    data += b"," + bytes([1, 0, 2, 0, 5, 0, 6, 0, 0x40, 2, len(codes)]) + codes + b"\0;"
    out = ungif(data)
    assert out.shape == (9, 8, 4) and (out[:2, :, 3] == 0).all() and (out[:, 0, 3] == 0).all()
    assert np.array_equal(out[2:8, 1:6, 0], places * 3) and np.array_equal(out[2:8, 1:6, 3] == 0, places == 2)


def test_broken_files_are_null(spark):
    whole = [jpeg(smooth(24, 24)), gif(smooth(6, 6)), written(spark, smooth(24, 24), progressive=True)]
    rng, rows = random.Random(3), []
    for data in whole:
        rows += [data[:n] for n in range(0, min(len(data), 400), 13)]
        for _ in range(60):
            b = bytearray(data)
            for _ in range(4):
                b[rng.randrange(len(b))] = rng.randrange(256)
            rows.append(bytes(b))
    for data in rows:
        p = images.pixels_of(data)
        assert p is None or p.ndim == 3
    got = spark.createDataFrame([(b"",), (b"\xff\xd8",), (b"GIF89a",), (None,), (whole[0],)], "b binary").select(images.decode("b").alias("i")).collect()
    assert [r["i"] is None or r["i"]["data"] is None for r in got] == [True, True, True, True, False]


def test_a_jpeg_message_gets_a_caption(spark):
    kind = "array<struct<media_type:string,data:binary,text:string>>"
    picture = lambda write, v: write(np.full((4, 4, 3), v, np.uint8))
    rows = [(1, 1, "user", [("image/jpeg", picture(jpeg, 250), None)]), (2, 1, "user", [("image/gif", picture(gif, 3), None)]),
            (3, 1, "user", [("image/jpeg", written(spark, np.full((4, 4, 3), 3, np.uint8)), None), ("text/plain", None, "what")])]
    decoder, words = captioner()
    bot = chat.ChatAdapter(tasks.Task(toy_onnx.reshaping([3, 4, 4], [48]), TINY), decoder, words, 10, 1, 2)
    out = bot.reply(spark.createDataFrame(rows, f"conv_id long, turn long, role string, contents {kind}"))
    assert {r["conv_id"]: r["text"] for r in out.collect()} == {1: "a cat", 2: "a dog", 3: "dog"}


def test_formats_are_chosen_by_media_type(spark):
    d = spark.range(1).select(images.from_pixels(F.lit(2), F.lit(2), F.unhex(F.lit("0A141EFF" * 4))).alias("Image"))
    for asked, kind, head in [("image/JPEG", "image/jpeg", b"\xff\xd8"), ("image/jpg", "image/jpeg", b"\xff\xd8"), ("image/gif", "image/gif", b"GIF"), ("image/tiff", "image/png", b"\x89PNG")]:
        r = d.select(images.encode("Image", asked).alias("f")).first()["f"]
        assert r["media_type"] == kind and bytes(r["data"]).startswith(head)
    with pytest.raises(ValueError):
        images.encode("Image", "image/jpeg", 0)
