"""Picture crops of regions and what a vision model says about them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import documents
from .ledger import Ledger


def png(pixels: np.ndarray) -> bytes:
    """A BGR or grey array as a PNG file."""
    grey = pixels.ndim == 2 or pixels.shape[2] == 1
    rows = pixels.reshape(pixels.shape[0], -1) if grey else pixels[..., 2::-1].reshape(pixels.shape[0], -1)
    raw = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0 if grey else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def crops(images: DataFrame, boxes: DataFrame, encode: Callable[[np.ndarray], bytes] = png) -> DataFrame:
    """image_id, group_id, picture: the encoded picture of each region; regions that are empty on the page are left out.

    encode makes a picture file of a BGR array. An image travels once, with the list of its regions' boxes.
    """
    inside = boxes.selectExpr("image_id", "group_id", *(f"cast(greatest({c}, 0) as long) as {c}" for c in ("left_x", "top_y", "right_x", "bottom_y")))
    lists = inside.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("group_id", "left_x", "top_y", "right_x", "bottom_y"))).alias("boxes"))
    rows = images.select("image_id", "height", "width", "channels", "data").join(lists, "image_id")

    def crop(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                page = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                parts = [(b["group_id"], page[b["top_y"] : b["bottom_y"], b["left_x"] : b["right_x"]]) for b in row.boxes]
                found = [(row.image_id, group, encode(part)) for group, part in parts if part.size]
                yield pd.DataFrame(found, columns=["image_id", "group_id", "picture"])

    return rows.mapInPandas(crop, "image_id long, group_id long, picture binary")


def described(
    images: DataFrame, boxes: DataFrame, provider: Callable, on_error: str = "fail", concurrency: int | None = None,
    encode: Callable[[np.ndarray], bytes] = png, media: str = "image/png", ledger: Ledger | None = None,
) -> DataFrame:
    """image_id, group_id, description: one answer for each region that has a picture. media: the type of what encode makes.

    With a ledger, equal pictures are asked about once, and none again that it knows.
    """
    asked = documents.region_prompts(crops(images, boxes, encode), media)
    answers = (ledger.answered if ledger else documents.answered)(asked, provider, "prompt", on_error, concurrency)
    return answers.select("image_id", "group_id", documents.response_text("response").alias("description"))


def summarised(descriptions: DataFrame, provider: Callable, concurrency: int | None = None, ledger: Ledger | None = None) -> DataFrame:
    """image_id, analysis: one answer about all sections of a page; a fixed text where the request fails. ledger: as for described()."""
    answers = (ledger.answered if ledger else documents.answered)(documents.summary_prompts(descriptions), provider, "prompt", "null", concurrency)
    return answers.select("image_id", F.coalesce(documents.response_text("response"), F.lit(documents.SUMMARY_FAILED)).alias("analysis"))


def semantic_similarity(a: Column, b: Column, embed: Callable[[], Callable[[str], np.ndarray | None]] | None = None) -> Column:
    """Cosine of what a provider's model makes of two lower-cased texts; 0 without a model, vectors or on an error."""
    if embed is None:
        return F.lit(0.0)

    def cosine(first: pd.Series, second: pd.Series) -> pd.Series:
        model, out = embed(), []
        for x, y in zip(first, second):
            try:
                u, v = model(x.lower()), model(y.lower())
                size = float(np.linalg.norm(u) * np.linalg.norm(v))
                out.append(float(np.dot(u, v)) / size if size else 0.0)
            except Exception:
                out.append(0.0)
        return pd.Series(out, dtype=float)

    return F.pandas_udf(cosine, "double")(a, b)
