"""Images without an image library: files read by Spark, bytes checked, PNG pixels decoded, resized, normalised.

A JPEG is checked by walking its markers: lengths, frame, scans and the end mark; it isn't decoded. A PNG is checked chunk
by chunk with its checksums and decoded as a whole. What is told of each image comes in one pass over its bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pixels of an image at most; one that says it has more is refused before anything is unpacked.
PIXELS = 1 << 28
#: Means and deviations that image models expect, by channel.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)

_PNG = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type, and the bit depths it may have.
_SAMPLES = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}


class Faulty(ValueError):
    """What is wrong with an image's bytes."""


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of the files of a folder, found by their names; Spark's reader leaves out empty files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and bytes of each chunk, the last one's end included; anything amiss is Faulty."""
    at = len(_PNG)
    while True:
        if at + 12 > len(data):
            raise Faulty("truncated chunk")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if at + 12 + size > len(data):
            raise Faulty(f"truncated chunk {kind.decode('latin-1')}")
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise Faulty(f"checksum of chunk {kind.decode('latin-1')}")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            if at != len(data):
                raise Faulty("bytes after the end")
            return


def _rows(raw: bytes, rows: int, width: int, step: int) -> np.ndarray:
    """Lines without their filters; width: bytes of a line, step: bytes of a pixel."""
    if len(raw) != rows * (width + 1):
        raise Faulty(f"{len(raw)} bytes of pixels instead of {rows * (width + 1)}")
    lines = np.frombuffer(raw, np.uint8).reshape(rows, width + 1)
    out = np.zeros((rows, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for y in range(rows):
        kind, line = int(lines[y, 0]), lines[y, 1:]
        if kind == 0:
            now = line
        elif kind == 1:
            now = _running(line, step)
        elif kind == 2:
            now = line + above
        elif kind in (3, 4):
            now = _predicted(line.tolist(), above.tolist(), step, kind)
        else:
            raise Faulty(f"filter {kind}")
        out[y] = above = now
    return out


def _running(line: np.ndarray, step: int) -> np.ndarray:
    """Each byte adds to the one a pixel before."""
    whole = np.zeros(-(-len(line) // step) * step, np.uint8)
    whole[: len(line)] = line
    return np.cumsum(whole.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]


def _predicted(line: list[int], above: list[int], step: int, kind: int) -> np.ndarray:
    out = [0] * len(line)
    for i, x in enumerate(line):
        left = out[i - step] if i >= step else 0
        up = above[i]
        if kind == 3:
            out[i] = (x + (left + up) // 2) & 255
        else:
            corner = above[i - step] if i >= step else 0
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            out[i] = (x + (left if a <= b and a <= c else up if b <= c else corner)) & 255
    return np.array(out, np.uint8)


#: First place and step, across and down, of each of the passes of an interlaced image.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_png(data: bytes) -> np.ndarray:
    """Rows, columns and samples, of 8 bits each (of 16 bits the upper ones); palettes are looked up."""
    if not data.startswith(_PNG):
        raise Faulty("no PNG")
    head = palette = None
    packed = []
    for kind, body in png_chunks(data):
        if head is None:
            if kind != b"IHDR" or len(body) != 13:
                raise Faulty("no header")
            head = struct.unpack(">IIBBBBB", body)
            w, h, depth, colour, pressed, filtered, laced = head
            if not w or not h or w * h > PIXELS:
                raise Faulty(f"{w} by {h} pixels")
            if colour not in _SAMPLES or depth not in _SAMPLES[colour][1] or pressed or filtered or laced > 1:
                raise Faulty("unknown kind")
        elif kind == b"PLTE":
            if len(body) % 3:
                raise Faulty("palette")
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    samples = _SAMPLES[colour][0]
    grid = [(0, 0, 1, 1)] if not laced else _PASSES
    sizes = [(max(0, -(-(w - x) // dx)), max(0, -(-(h - y) // dy))) for x, y, dx, dy in grid]
    lines = [(a * samples * depth + 7) // 8 if a and b else 0 for a, b in sizes]
    want = sum((n + 1) * b for n, (_, b) in zip(lines, sizes, strict=True) if n)
    try:
        d = zlib.decompressobj()
        raw = d.decompress(b"".join(packed), want + 1)
    except zlib.error as e:
        raise Faulty(f"pixels: {e}") from None
    if len(raw) == want and not d.eof:  # the checksum comes after the last byte
        try:
            d.flush()
        except zlib.error as e:
            raise Faulty(f"pixels: {e}") from None
        if not d.eof:
            raise Faulty("pixels end too early")
    if len(raw) != want:
        raise Faulty("pixels end too early" if len(raw) < want else "too many pixels")
    out = np.zeros((h, w, samples), np.uint8)
    at = 0
    for (x, y, dx, dy), (a, b), n in zip(grid, sizes, lines, strict=True):
        if not n:
            continue
        rows = _rows(raw[at : at + b * (n + 1)], b, n, max(1, samples * depth // 8))
        at += b * (n + 1)
        if depth == 16:
            values = rows[:, ::2]
        elif depth == 8:
            values = rows
        else:
            bits = np.unpackbits(rows, axis=1).reshape(b, -1, depth)
            values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, :a]
            if colour == 0:
                values = values * (255 // ((1 << depth) - 1))
        out[y::dy, x::dx] = values.reshape(b, a, samples)
    if colour == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise Faulty("palette")
        return palette[out[:, :, 0]]
    return out


def encode_png(pixels: np.ndarray, filters: tuple[int, ...] = (0,)) -> bytes:
    """A PNG of rows, columns and 1, 2, 3 or 4 samples of 8 bits; row y has filter filters[y % len(filters)]."""
    h, w, samples = pixels.shape
    colour = {1: 0, 3: 2, 2: 4, 4: 6}[samples]
    lines = pixels.reshape(h, w * samples).astype(np.int64)
    raw = bytearray()
    for y in range(h):
        kind = filters[y % len(filters)]
        above = lines[y - 1] if y else np.zeros(w * samples, np.int64)
        left = np.concatenate([np.zeros(samples, np.int64), lines[y][:-samples]])
        corner = np.concatenate([np.zeros(samples, np.int64), above[:-samples]])
        p = left + above - corner
        a, b, c = np.abs(p - left), np.abs(p - above), np.abs(p - corner)
        guess = (0 * left, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner)))[kind]
        raw += bytes([kind]) + ((lines[y] - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")


def jpeg_frame(data: bytes) -> tuple[int, int, int]:
    """Width, height and components, after a walk over all markers; anything amiss is Faulty."""
    if data[:2] != b"\xff\xd8":
        raise Faulty("no JPEG")
    at, frame, scans = 2, None, 0
    while True:
        if at + 2 > len(data):
            raise Faulty("truncated")
        if data[at] != 0xFF:
            raise Faulty("no marker where one should be")
        while at + 1 < len(data) and data[at + 1] == 0xFF:  # fill bytes
            at += 1
        if at + 2 > len(data):
            raise Faulty("truncated")
        marker = data[at + 1]
        at += 2
        if marker == 0xD9:
            if frame is None or not scans:
                raise Faulty("no frame or scan before the end")
            return frame
        if marker in (0x00, 0xD8) or 0xD0 <= marker <= 0xD7:
            raise Faulty(f"marker {marker:02x} out of place")
        if marker == 0x01:
            continue
        if at + 2 > len(data):
            raise Faulty("truncated")
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            raise Faulty("truncated segment")
        body = data[at + 2 : at + size]
        at += size
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if len(body) < 6 or len(body) != 6 + 3 * body[5]:
                raise Faulty("frame")
            h, w, n = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
            if not w or not h or not n or w * h > PIXELS:
                raise Faulty(f"{w} by {h} pixels")
            frame = (w, h, n)
        elif marker == 0xDA:
            if frame is None or not body or len(body) != 4 + 2 * body[0]:
                raise Faulty("scan")
            scans += 1
            # coded bytes go on to the next marker that is neither a stuffed byte nor a restart
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    raise Faulty("truncated scan")
                if data[at + 1] != 0x00 and not 0xD0 <= data[at + 1] <= 0xD7:
                    break
                at += 2



TOLD = "struct<format:string,width:int,height:int,channels:int,error:string>"


def told(data: bytes | None) -> tuple:
    """Format, width, height, channels, and what is wrong (null: nothing)."""
    if data is None:
        return None, None, None, None, "no bytes"
    kind = "png" if data.startswith(_PNG) else "jpeg" if data[:2] == b"\xff\xd8" else None
    try:
        if kind == "png":
            h, w, n = decode_png(data).shape
            return kind, w, h, n, None
        if kind == "jpeg":
            return kind, *jpeg_frame(data), None
        return None, None, None, None, "neither PNG nor JPEG"
    except Faulty as e:
        return kind, None, None, None, str(e)


def checked(data: Column) -> Column:
    """TOLD of an image's bytes."""

    @F.pandas_udf(TOLD)
    def run(images: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([told(x) for x in images], columns=["format", "width", "height", "channels", "error"])
        return out.astype({"width": "Int32", "height": "Int32", "channels": "Int32"})

    return run(data)


def valid_images(df: DataFrame, data: str = "content") -> DataFrame:
    """df without the images that have a fault."""
    return df.withColumn("__told", checked(F.col(data))).where(F.col("__told.error").isNull()).drop("__told")


def rgb(pixels: np.ndarray) -> np.ndarray:
    """Three samples a pixel: grey ones three times, without transparency."""
    return np.repeat(pixels[:, :, :1], 3, axis=2) if pixels.shape[2] < 3 else pixels[:, :, :3]


def weights(n: int, size: int) -> np.ndarray:
    """What each of n places adds to each of `size`: a triangle as wide as a new place, two old ones at least."""
    scale = n / size
    reach = max(1.0, scale)
    centre = (np.arange(size) + 0.5) * scale
    w = np.maximum(0, 1 - np.abs(np.arange(n) + 0.5 - centre[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Rows, columns and samples of the wanted size, as doubles; along each axis in turn."""
    rows = np.tensordot(weights(pixels.shape[0], height), pixels.astype(np.float64), axes=(1, 0))
    return np.einsum("wx,hxc->hwc", weights(pixels.shape[1], width), rows)


def pixel_values(data: Column, width: int = 224, height: int = 224) -> Column:
    """Inputs of an image model: channels, rows and columns of a decoded PNG, resized, scaled to 0 to 1, centred, as one
    array of floats; null where the bytes have a fault or aren't a PNG."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for images in batches:
            yield pd.Series([_values(x, width, height) for x in images], dtype=object)

    return run(data)


def _values(data: bytes | None, width: int, height: int) -> np.ndarray | None:
    try:
        x = resized(rgb(decode_png(data or b"")), width, height) / 255
    except Faulty:
        return None
    return ((x - MEAN) / DEVIATION).transpose(2, 0, 1).ravel().astype(np.float32)


def write_files(df: DataFrame, path: str, name: str, data: str) -> DataFrame:
    """Each row as a file below path; the names written. Files are written under a name of their task's attempt and moved,
    so that a task which runs twice leaves whole files; names must tell rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        f, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")
        f.create_dir(at, recursive=True)
        for b in batches:
            for n, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with f.open_output_stream(f"{at}/.{n}.{attempt}") as out:
                    out.write(x.as_py() or b"")
                f.move(f"{at}/.{n}.{attempt}", f"{at}/{n}")
            yield pa.RecordBatch.from_arrays([b.column(0)], ["name"])

    return df.select(F.col(name).cast("string").alias("name"), F.col(data).alias("data")).mapInArrow(run, T.StructType([T.StructField("name", T.StringType())]))
