"""The whole way from elements to documents: regions, columns, lines, rows, paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import clusters, documents, grouping, recognition, textmerge


def build_regions(elements: DataFrame) -> DataFrame:
    """image_id, region_no, box, n_elements, members: elements clustered strictly, then loosely, then with neighbours."""
    return clusters.adjacent_regions(elements)


def merged_elements(elements: DataFrame) -> DataFrame:
    """Elements after text merging inside each region of build_regions: images as they are, texts merged.

    The merged texts get new ids after all others of their page.
    """
    columns = ["text", "confidence", "left_x", "top_y", "right_x", "bottom_y"]
    rows = elements.select("image_id", "element_id", "type", *columns)
    placed = clusters.in_regions(rows)
    last = F.max("element_id").over(Window.partitionBy("image_id"))
    texts = textmerge.merged_texts(placed.withColumn("last", last), ["image_id", "region_no", "last"])
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("region_no", "item_no"))
    texts = texts.select("image_id", (F.col("last") + place).alias("element_id"), F.lit("text").alias("type"), *columns)
    images = rows.where("type <> 'text'").select("image_id", "element_id", "type", *columns)
    return images.unionByName(texts)


def paragraphs(elements: DataFrame) -> DataFrame:
    """image_id, group_id, para_no, text: reading-order paragraphs of each region of vertically grouped elements."""
    columned = grouping.column_clusters(grouping.region_groups(elements))
    lines = grouping.merged_columns(grouping.lines(columned))
    return grouping.paragraphs(grouping.rows(lines))


def run(elements: DataFrame) -> DataFrame:
    """image_id, group_id, text: the region texts of pages, from recognised elements to output."""
    merged = merged_elements(recognition.recognised(elements))
    return documents.region_texts(paragraphs(merged))
