"""Images as relations of pixels, and the hook for models that look at whole images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGN = b"\x89PNG\r\n\x1a\n"
PIXELS = "path string, u int, v int, r int, g int, b int"


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit image, (height, width) grey or (height, width, 3) colour."""
    image = np.asarray(image, dtype=np.uint8)
    height, width = image.shape[:2]
    rows = np.column_stack([np.zeros((height, 1), np.uint8), image.reshape(height, -1)])
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _SIGN + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, 3) of an 8-bit grey or colour PNG without interlace; an alpha channel is left out."""
    if not data.startswith(_SIGN):
        raise ValueError("not a PNG")
    at, body, head = 8, b"", b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        head, body = (data[at + 8 : at + 8 + n], body) if kind == b"IHDR" else (head, body + data[at + 8 : at + 8 + n]) if kind == b"IDAT" else (head, body)
        at += 12 + n
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if depth != 8 or colour not in (0, 2, 4, 6) or interlace:
        raise ValueError("only 8-bit grey and colour without interlace")
    step = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height + 1, (width + 1) * step), dtype=np.int64)  # a row above and a pixel to the left, of zeros
    for y in range(height):
        kind, line, up = int(raw[y, 0]), raw[y, 1:].astype(np.int64), out[y]
        if kind == 0:
            out[y + 1, step:] = line
        elif kind == 2:
            out[y + 1, step:] = (line + up[step:]) & 255
        elif kind == 1:
            out[y + 1, step:] = np.cumsum(line.reshape(width, step), axis=0).reshape(-1) & 255
        else:
            own = out[y + 1]
            for x in range(step, len(own)):
                a, b, c = int(own[x - step]), int(up[x]), int(up[x - step])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(p - v))  # of equals the first: left, above, corner
                own[x] = (int(line[x - step]) + guess) & 255
    pixels = out[1:, step:].reshape(height, width, step)
    return (pixels[:, :, :3] if step > 2 else np.repeat(pixels[:, :, :1], 3, axis=2)).astype(np.uint8)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """A row for each pixel of the PNG files of a folder; a task decodes an image at a time."""

    def decode(parts):
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                image = decode_png(content)
                v, u = np.indices(image.shape[:2])
                yield pd.DataFrame({"path": name, "u": u.ravel().astype("int32"), "v": v.ravel().astype("int32"), **{c: image[:, :, k].ravel().astype("int32") for k, c in enumerate("rgb")}})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content").mapInPandas(decode, PIXELS)


def resize(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], values: tuple[str, ...], by: tuple[str, ...] = (), nearest: bool = False) -> DataFrame:
    """Pixels (u, v) of images of `size` (width, height) at another size, between four pixels by their distance.

    A target pixel's centre falls between the centres of source pixels (beyond the outermost ones it takes those); it is
    their mean, weighted by how near they are. Where some of the four are missing or null the others' weights count.
    nearest takes the one pixel that its corner falls on instead, for labels that have no mean. An equi-join on source
    pixels; what is joined is at most four rows for each target pixel."""
    spark = pixels.sparkSession

    def axis(name: str, source: str, have: int, want: int) -> DataFrame:
        t = spark.range(want).select(F.col("id").cast("int").alias(name))
        if nearest:
            return t.select(name, F.expr(f"cast({name} * {have} div {want} as int)").alias(source), F.lit(1.0).alias(f"w{source}"))
        at = F.least(F.greatest((F.col(name) + 0.5) * F.lit(have / want) - 0.5, F.lit(0.0)), F.lit(have - 1.0))
        t = t.withColumn("at", at).withColumn("low", F.floor("at").cast("int"))
        part = F.col("at") - F.col("low")
        ends = F.array(F.struct(F.col("low").alias("k"), (1 - part).alias("w")), F.struct(F.least(F.col("low") + 1, F.lit(have - 1)).alias("k"), part.alias("w")))
        return t.select(name, F.explode(ends).alias("e")).where("e.w > 0").select(name, F.col("e.k").alias(source), F.col("e.w").alias(f"w{source}"))

    # the two axes are numbers of columns and rows, and each pixel meets only its own
    found = pixels.join(axis("tu", "u", size[0], to[0]), "u").join(axis("tv", "v", size[1], to[1]), "v").withColumn("w", F.col("wu") * F.col("wv"))
    mean = [F.try_divide(F.sum(F.col(c) * F.col("w")), F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(c) for c in values]
    return found.groupBy(*by, F.col("tu").alias("u"), F.col("tv").alias("v")).agg(*mean)


def _image_keys(df: DataFrame) -> list[str]:
    """What tells images apart: the frame, and the scan where there is one."""
    return [c for c in ("scan_id", "frame_id") if c in df.columns]


def _key_types(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def infer(images: DataFrame, model: Callable[[np.ndarray], dict[str, np.ndarray]], values: tuple[str, ...] = ("depth", "conf")) -> DataFrame:
    """The hook for a model: it gets each image (height, width, 3) of pixels([scan_id,] frame_id, u, v, r, g, b) once and
    gives a map of numbers for each value, of the image's height and width. One image is one task's at a time."""
    names, keys = ", ".join(f"{v} double" for v in values), _image_keys(images)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(frame["v"].max()) + 1, int(frame["u"].max()) + 1, 3), dtype=np.uint8)
        image[frame["v"], frame["u"]] = frame[["r", "g", "b"]].to_numpy()
        found = model(image)
        v, u = np.indices(image.shape[:2])
        return pd.DataFrame({**{k: frame[k].iloc[0] for k in keys}, "u": u.ravel(), "v": v.ravel(), **{n: np.asarray(found[n], dtype=float).ravel() for n in values}})

    return images.groupBy(*keys).applyInPandas(run, f"{_key_types(images, keys)}, u int, v int, {names}")


def depth_images(levels: DataFrame, size: tuple[int, int]) -> DataFrame:
    """([scan_id,] frame_id, content): the depth levels of each frame's (u, v) as a grey PNG, 0 where there is none."""
    keys = _image_keys(levels)

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((size[1], size[0]), dtype=np.uint8)
        image[frame["v"], frame["u"]] = frame["level"]
        return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in keys}, "content": [encode_png(image)]})

    return levels.groupBy(*keys).applyInPandas(draw, f"{_key_types(levels, keys)}, content binary")
