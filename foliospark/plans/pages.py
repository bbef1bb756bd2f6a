"""From images to documents: text and object detection through providers, then the layout plan.

Pixel scans and model calls are costly, so their results are kept once they are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import documents, duplicates, grouping, leaders, pixels, recognition, vision
from . import layout

COLUMNS = ("image_id", "element_id", "type", "text", "confidence", "left_x", "top_y", "right_x", "bottom_y")


def _numbered(found: DataFrame, order: list[str]) -> DataFrame:
    return found.withColumn("element_id", F.row_number().over(Window.partitionBy("image_id").orderBy(*order)).cast("long"))


def text_blocks(images: DataFrame, reader: Callable) -> DataFrame:
    """Text elements of pages: regions, recognition, filter, page coordinates, duplicates out, reading order."""
    found = cut(_numbered(pixels.recognise(images, reader), ["roi_y", "roi_x", "text"]))
    placed = recognition.absolute_boxes(recognition.recognised(found))
    placed = placed.select("image_id", "element_id", "text", "confidence", *(F.col(c).cast("long").alias(c) for c in ("left_x", "top_y", "right_x", "bottom_y")))
    kept = duplicates.without_duplicate_texts(placed).select("image_id", "element_id")
    ordered = recognition.reading_order(placed.join(kept, ["image_id", "element_id"]).withColumn("type", F.lit("text")))
    return cut(ordered.withColumn("element_id", F.col("place")).select(*COLUMNS))


#: Pixels of white around a turned page.
BORDER = 20


def rotated_text_blocks(images: DataFrame, angles: DataFrame, reader: Callable) -> DataFrame:
    """Text elements of pages read at other angles (angles: image_id, angle in degrees), with rotation, in the page's coordinates.

    Each page is turned, made ready and read whole; boxes are moved back by the border and turned back, and implausible ones left out. A
    missing confidence counts as 0.8.
    """
    schema = "image_id long, angle double, height int, width int, turned_height int, turned_width int, block int, corner int, x double, y double, text string, confidence double"
    names = [part.split()[0] for part in schema.split(", ")]

    def read_turned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = None
        for pdf in frames:
            read = read or reader()
            out = []
            for row in pdf.itertuples():
                page = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                ready = pixels.rotated_ready(pixels.grey(page) if row.channels >= 3 else page[..., 0], row.angle, BORDER)
                size = (ready.shape[0] - 2 * BORDER, ready.shape[1] - 2 * BORDER)
                for k, (box, text, *sure) in enumerate(read(ready)):
                    for c, p in enumerate(box):
                        out.append((row.image_id, row.angle, row.height, row.width, *size, k, c, float(p[0]) - BORDER, float(p[1]) - BORDER, text, float(sure[0]) if sure else 0.8))
            yield pd.DataFrame(out, columns=names)

    rows = images.select("image_id", "height", "width", "channels", "data").join(angles.select("image_id", F.col("angle").cast("double").alias("angle")), "image_id")
    corners = cut(rows.mapInPandas(read_turned, schema))
    turned = recognition.points_to_page(corners, "width", "height", "angle", "turned_width", "turned_height")
    edges = [F.min("ox").alias("left_x"), F.min("oy").alias("top_y"), F.max("ox").alias("right_x"), F.max("oy").alias("bottom_y")]
    blocks = turned.groupBy("image_id", "angle", "block", "height", "width").agg(F.first("text").alias("text"), F.first("confidence").alias("confidence"), *edges)
    kept = recognition.plausible_rotated(blocks, "width", "height").withColumn("text", F.expr(recognition.STRIP))
    kept = _numbered(kept.withColumnRenamed("angle", "rotation"), ["rotation", "top_y", "left_x", "block"])
    return kept.select("image_id", "element_id", F.lit("text").alias("type"), *COLUMNS[3:], "rotation")


def _with_mask(images: DataFrame, texts: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """image_id and the kernel's tuples, for each image's grey array and the mask of its text boxes."""
    names = [part.split()[0] for part in schema.split(",")]
    lists = texts.groupBy("image_id").agg(F.collect_list(F.struct("left_x", "top_y", "right_x", "bottom_y")).alias("boxes"))
    rows = images.select("image_id", "height", "width", "channels", "data").join(lists, "image_id", "left")

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                page = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                boxes = [(b["left_x"], b["top_y"], b["right_x"], b["bottom_y"]) for b in (row.boxes if row.boxes is not None else [])]
                mask = pixels.mask_of_boxes(row.height, row.width, boxes)
                found = kernel(pixels.grey(page) if row.channels >= 3 else page[..., 0], mask)
                if found:
                    yield pd.DataFrame(found, columns=names).assign(image_id=row.image_id)[["image_id", *names]]

    return rows.mapInPandas(apply, f"image_id long, {schema}")


def image_blocks(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Picture elements of pages at three scales: candidates, filters, overlaps out, neighbours merged."""
    schema = "scale double, x long, y long, w long, h long, edge_density double, text_density double"
    found = _with_mask(images, texts, pixels.object_candidates, schema)
    found = found.withColumn("cand_id", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("scale"), "y", "x", "w", "h")).cast("long"))
    kept = leaders.object_clusters(cut(leaders.without_overlaps(cut(recognition.object_candidates(found)))))
    return _numbered(kept, ["top_y", "left_x", "cluster_id"]).select("image_id", "element_id", F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), *COLUMNS[4:])


def image_blocks_by_shape(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Picture elements of pages by morphology."""
    found = _with_mask(images, texts, pixels.image_blocks, "left_x long, top_y long, right_x long, bottom_y long, confidence double")
    return _numbered(found, ["top_y", "left_x", "right_x"]).select("image_id", "element_id", F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), *COLUMNS[4:])


def elements(images: DataFrame, reader: Callable) -> DataFrame:
    """All elements of pages, texts first."""
    texts = text_blocks(images, reader)
    last = texts.groupBy("image_id").agg(F.max("element_id").alias("last"))
    pictures = image_blocks(images, texts).join(last, "image_id", "left").withColumn("element_id", F.col("element_id") + F.coalesce("last", F.lit(0)))
    return texts.unionByName(pictures.select(*COLUMNS))


def page_documents(images: DataFrame, reader: Callable, model: Callable, on_error: str = "fail") -> DataFrame:
    """image_id, total_regions, regions: the nested documents of pages, with a model's descriptions."""
    merged = cut(layout.merged_elements(cut(elements(images, reader))))
    boxes = grouping.group_boxes(grouping.region_groups(merged))
    return documents.vision_documents(boxes, vision.described(images, boxes, model, on_error), layout.paragraphs(merged))
