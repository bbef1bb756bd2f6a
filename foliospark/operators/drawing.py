"""Pictures of pages with their regions and elements drawn on them.

What is drawn is a table of shapes, made in the JVM; a kernel paints each page's shapes in order. Lines and borders are bands of
whole pixels along the axes, with square ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import documents

#: Colours as blue, green, red; dashes of the two pictures.
TEXT, PICTURE, REGION, GROUP = (0, 255, 0), (0, 0, 255), (255, 0, 0), (0, 165, 255)
REGION_DASH, GROUP_DASH, FILL = 15, 20, 0.2
SHAPE = ["image_id", "layer", "place", "kind", "x1", "y1", "x2", "y2", "colour", "thickness"]


def _coloured(by_type: bool, colour: tuple[int, int, int] = GROUP) -> Column:
    plain = lambda c: F.array(*(F.lit(x) for x in c))
    return F.when(F.col("type") == "text", plain(TEXT)).otherwise(plain(PICTURE)) if by_type else plain(colour)


def _dashes(boxes: DataFrame, dash: int, layer: int, colour: Column, thickness: int) -> DataFrame:
    """Shapes of the dashed outlines of boxes (image_id, group_id, box)."""
    place = F.struct("group_id", "side", "dash")
    found = documents.dash_segments(boxes, dash).join(boxes.select("image_id", "group_id", colour.alias("colour")), ["image_id", "group_id"])
    return found.withColumns({"layer": F.lit(layer), "place": F.xxhash64(place), "kind": F.lit("line"), "thickness": F.lit(thickness)}).select(*SHAPE)


def group_shapes(boxes: DataFrame, elements: DataFrame) -> DataFrame:
    """Dashed outlines of region groups (image_id, group_id, box), and over them thin ones of elements, by type."""
    inner = elements.withColumn("group_id", F.col("element_id"))
    return _dashes(boxes, GROUP_DASH, 0, _coloured(False), 2).union(_dashes(inner, GROUP_DASH, 1, _coloured(True), 1))


def region_shapes(regions: DataFrame, elements: DataFrame, borders: bool = True) -> DataFrame:
    """Dashed outlines of regions (image_id, region_no, box); over them texts, filled lightly and (borders) framed, and frames of pictures.

    Elements follow each other in the order of their regions (elements with region_no) and ids.
    """
    outer = _dashes(regions.withColumnRenamed("region_no", "group_id"), REGION_DASH, 0, _coloured(False, REGION), 2)
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("region_no", "element_id")).cast("long") * 2
    sides = [F.col(c).alias(n) for c, n in (("left_x", "x1"), ("top_y", "y1"), ("right_x", "x2"), ("bottom_y", "y2"))]
    rows = elements.select("image_id", F.lit(1).alias("layer"), place.alias("place"), "type", *sides, _coloured(True).alias("colour"), F.lit(2).alias("thickness"))
    fills = rows.where("type = 'text'").withColumn("kind", F.lit("fill"))
    frames = (rows if borders else rows.where("type <> 'text'")).withColumns({"kind": F.lit("frame"), "place": F.col("place") + 1})
    return outer.union(fills.select(*SHAPE)).union(frames.select(*SHAPE))


def _band(page: np.ndarray, x1: int, y1: int, x2: int, y2: int, thickness: int, colour: np.ndarray) -> None:
    """A line along an axis, as wide as thickness, cut to the page."""
    before, after = (thickness - 1) // 2, thickness // 2
    left, right, top, bottom = min(x1, x2), max(x1, x2), min(y1, y2), max(y1, y2)
    left, right = (left - before, right + after) if left == right else (left, right)
    top, bottom = (top - before, bottom + after) if top == bottom else (top, bottom)
    page[max(0, top) : max(0, bottom + 1), max(0, left) : max(0, right + 1)] = colour


def painted(page: np.ndarray, shapes: list[dict]) -> np.ndarray:
    """A copy of a BGR page with shapes (kind, x1, y1, x2, y2, colour, thickness) painted in order."""
    page = page.copy()
    for s in shapes:
        x1, y1, x2, y2 = (int(s[c]) for c in ("x1", "y1", "x2", "y2"))
        colour = np.array(s["colour"], np.uint8)
        if s["kind"] == "line":
            _band(page, x1, y1, x2, y2, s["thickness"], colour)
        elif s["kind"] == "frame":
            for ends in ((x1, y1, x2, y1), (x2, y1, x2, y2), (x1, y2, x2, y2), (x1, y1, x1, y2)):
                _band(page, *ends, s["thickness"], colour)
        else:
            area = page[max(0, y1) : max(0, y2 + 1), max(0, x1) : max(0, x2 + 1)]
            area[:] = np.rint(FILL * colour.astype(float) + (1 - FILL) * area).astype(np.uint8)
    return page


def drawn(images: DataFrame, shapes: DataFrame) -> DataFrame:
    """images (image_id, height, width, channels, data) with each page's shapes painted on it, as BGR; an image travels once, with the list of its shapes."""
    item = F.struct("layer", "place", "kind", "x1", "y1", "x2", "y2", "colour", "thickness")
    lists = shapes.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("shapes"))
    rows = images.select("image_id", "height", "width", "channels", "data").join(lists, "image_id", "left")

    def paint(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                page = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                page = page[..., :3] if row.channels >= 3 else np.repeat(page[..., :1], 3, axis=2)
                made = painted(page, row.shapes if row.shapes is not None else [])
                yield pd.DataFrame([(row.image_id, row.height, row.width, 3, made.tobytes())], columns=["image_id", "height", "width", "channels", "data"])

    return rows.mapInPandas(paint, "image_id long, height int, width int, channels int, data binary")
