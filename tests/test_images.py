import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import images as I


def picture(seed, h, w, samples):
    return np.random.default_rng(seed).integers(0, 256, (h, w, samples)).astype(np.uint8)


@pytest.mark.parametrize("samples", [1, 2, 3, 4])
@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)])
def test_pixels_come_back(samples, filters):
    for h, w in ((1, 1), (1, 9), (7, 1), (13, 17)):
        x = picture(h * w, h, w, samples)
        assert (I.decode_png(I.encode_png(x, filters)) == x).all()


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def made(w, h, depth, colour, raw, palette=None, laced=0):
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced))]
    if palette is not None:
        parts.append(chunk(b"PLTE", bytes(palette)))
    return b"\x89PNG\r\n\x1a\n" + b"".join([*parts, chunk(b"IDAT", zlib.compress(raw)[:5]), chunk(b"IDAT", zlib.compress(raw)[5:]), chunk(b"IEND", b"")])


def test_depths_palettes_and_interlacing():
    # by hand: bits of a grey line, a palette, 16 bits, an interlaced image pixel by pixel
    assert I.decode_png(made(10, 1, 1, 0, b"\0\xaa\x80"))[0, :, 0].tolist() == [255, 0] * 4 + [255, 0]
    assert I.decode_png(made(3, 1, 2, 0, b"\0\x1b"))[0, :, 0].tolist() == [0, 85, 170]
    assert I.decode_png(made(2, 1, 4, 3, b"\0\x10", [9, 8, 7, 1, 2, 3])).tolist() == [[[1, 2, 3], [9, 8, 7]]]
    assert I.decode_png(made(1, 1, 16, 2, b"\0\x12\x34\x56\x78\x9a\xbc")).tolist() == [[[0x12, 0x56, 0x9A]]]
    x = picture(5, 9, 11, 1)
    raw = b""
    for a, b, dx, dy in I._PASSES:
        part = x[b::dy, a::dx, 0]
        if part.size:
            raw += b"".join(b"\0" + row.tobytes() for row in part)
    assert (I.decode_png(made(11, 9, 8, 0, raw, laced=1)) == x).all()


def jpeg(w=20, h=10, scan=b"\x12\xff\x00\x34\xff\xd0\x56", end=b"\xff\xd9", n=3):
    seg = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    frame = seg(0xC0, b"\x08" + struct.pack(">HH", h, w) + bytes([n]) + b"\x01\x11\x00" * n)
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0") + b"\xff" + seg(0xDB, b"\0" * 65) + frame + seg(0xC4, b"\0" * 17) + seg(0xDA, bytes([n]) + b"\x01\x00" * n + b"\0\x3f\0") + scan + end


def test_faults_are_told_apart():
    good = I.encode_png(picture(1, 6, 8, 3), (4,))
    assert I.told(good) == ("png", 8, 6, 3, None)
    assert I.told(good[:-3])[4] == "truncated chunk" and I.told(good[:60])[4].startswith("truncated chunk")
    broken = bytearray(good)
    broken[50] ^= 1
    assert I.told(bytes(broken))[4] == "checksum of chunk IDAT"
    assert I.told(good + b"x")[4] == "bytes after the end"
    assert I.told(made(4, 4, 8, 0, b"\0" * 19))[4] == "pixels end too early" and I.told(made(4, 4, 8, 0, b"\0" * 21))[4] == "too many pixels"
    assert I.told(made(4, 4, 8, 0, b"\7" * 20))[4] == "filter 7" and I.told(made(2, 1, 8, 3, b"\0\1\2", [1, 2, 3]))[4] == "palette"
    assert I.told(made(1 << 16, 1 << 16, 8, 0, b"\0"))[4] == "65536 by 65536 pixels" and I.told(made(4, 4, 3, 0, b"\0"))[4] == "unknown kind"
    assert I.told(jpeg()) == ("jpeg", 20, 10, 3, None) and I.told(jpeg(n=1))[3] == 1
    whole = jpeg()
    assert all(I.told(whole[:k])[4] for k in range(2, len(whole)))  # cut anywhere
    assert I.told(jpeg(end=b""))[4] == "truncated scan" and I.told(jpeg(h=0))[4] == "20 by 0 pixels"
    assert I.told(b"GIF89a")[4] == "neither PNG nor JPEG" and I.told(b"")[4] and I.told(None)[4] == "no bytes"


def test_resizing_equals_a_plain_loop():
    x = picture(3, 7, 12, 3)
    for w, h in ((5, 3), (12, 7), (20, 16), (1, 1)):
        want = np.zeros((h, w, 3))
        for i in range(h):
            for j in range(w):
                total = np.zeros(3)
                norm = 0.0
                for a in range(7):
                    for b in range(12):
                        u = max(0, 1 - abs(a + 0.5 - (i + 0.5) * 7 / h) / max(1, 7 / h))
                        v = max(0, 1 - abs(b + 0.5 - (j + 0.5) * 12 / w) / max(1, 12 / w))
                        total += u * v * x[a, b]
                        norm += u * v
                want[i, j] = total / norm
        assert np.allclose(I.resized(x, w, h), want)
    assert (I.resized(x, 12, 7) == x).all()


def test_files_through_spark(spark, tmp_path):
    x = picture(8, 4, 4, 1)
    rows = [("a.png", I.encode_png(x)), ("b.png", I.encode_png(x)[:-9]), ("c.jpg", jpeg()), ("d.bin", b"zz"), ("e.png", None)]
    names = I.write_files(spark.createDataFrame(rows, "n string, d binary"), f"file://{tmp_path}/i", "n", "d")
    assert names.count() == 5
    got = I.read_images(spark, f"file://{tmp_path}/i")
    # Spark's reader leaves out empty files
    assert got.count() == 4 and I.read_images(spark, f"file://{tmp_path}/i", "*.png").count() == 2
    told = {r.path.rpartition("/")[2]: r.t for r in got.select("path", I.checked(F.col("content")).alias("t")).collect()}
    assert told["a.png"].error is None and (told["c.jpg"].width, told["c.jpg"].height) == (20, 10) and told["b.png"].format == "png" and all(told[k].error for k in ("b.png", "d.bin"))
    assert sorted(r.path.rpartition("/")[2] for r in I.valid_images(got).collect()) == ["a.png", "c.jpg"]
    values = {r.path.rpartition("/")[2]: r.v for r in got.select("path", I.pixel_values(F.col("content"), 4, 4).alias("v")).collect()}
    want = ((np.repeat(x, 3, axis=2) / 255 - I.MEAN) / I.DEVIATION).transpose(2, 0, 1).ravel()
    assert np.allclose(values["a.png"], want, atol=1e-5) and values["b.png"] is None and values["c.jpg"] is None
