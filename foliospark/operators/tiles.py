"""Clusters of boxes on pages that are too large for one task: by strips with a margin, and components of what meets at their borders.

Two boxes can only be linked if the lower one's top is at most ``reach`` below the upper one's, reach being the same for a whole page. A page is cut into
strips of that height or more. Each strip gets its own boxes and, as a margin, those of the next one, so every link lies in the strip of its upper
box. Strips are labelled like pages, each in one task. A box of a margin has a label there and one in its own strip: these two are one cluster.
Components of such pairs of labels, two numbers each, tell the clusters of the page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.components import least_reachable
from ..functions.lineage import cut, unused
from .clusters import DENSE, in_clusters, near_clusters

#: Boxes of a page from which on it is cut into strips.
CROWDED = 200_000


def _striped(elements: DataFrame, label: Callable[[DataFrame], DataFrame], reach: Column, crowded: int) -> DataFrame:
    """elements with cluster_id. label gives rows (image_id, element_id, box) their cluster_id; reach: over a page's rows (an aggregate)."""
    box = ["left_x", "top_y", "right_x", "bottom_y"]
    strips, n, low, height, strip, home = unused(elements.columns, "strips", "n", "low", "height", "strip", "home")
    rows = elements.select("image_id", "element_id", *box)
    size = F.greatest(F.ceil(reach), F.lit(1)).cast("long")
    pages = cut(rows.groupBy("image_id").agg(F.count("*").alias(n), F.min("top_y").alias(low), size.alias(height)).where(F.col(n) > crowded))
    if pages.isEmpty():
        return label(elements)
    # Joins with a few crowded pages; Spark broadcasts them if they are small.
    plain = label(elements.join(pages.select("image_id"), "image_id", "left_anti"))
    placed = rows.join(pages.select("image_id", low, height), "image_id").withColumn(home, F.floor((F.col("top_y") - F.col(low)) / F.col(height)).cast("long"))
    dealt = placed.withColumn(strip, F.explode(F.array(F.col(home), F.col(home) - 1))).where(F.col(strip) >= 0)
    # A strip is a page of its own for the labelling: its number takes the page's place.
    names = cut(dealt.select("image_id", strip).distinct().withColumn(strips, F.xxhash64("image_id", strip)))
    clash = names.groupBy(strips).count().where("count > 1")
    if not clash.isEmpty():
        raise ValueError("two strips have one number")
    named = dealt.join(names, ["image_id", strip]).select(F.col(strips).alias("image_id"), "element_id", *box, F.col("image_id").alias(n), (F.col(home) == F.col(strip)).alias(home))
    labelled = cut(label(named).select(F.col(n).alias("image_id"), "element_id", F.col(home).alias("home"), "cluster_id"))
    own = labelled.where("home").select("image_id", "element_id", F.col("cluster_id").alias("a"))
    margin = labelled.where("not home").select("image_id", "element_id", F.col("cluster_id").alias("b"))
    met = least_reachable(own.join(margin, ["image_id", "element_id"]).select("image_id", "a", "b").distinct())
    found = own.join(met.withColumnRenamed("node", "a"), ["image_id", "a"], "left").select("image_id", "element_id", F.coalesce("least", "a").alias("cluster_id"))
    return plain.unionByName(elements.join(found, ["image_id", "element_id"]).select(*plain.columns))


def box_clusters(elements: DataFrame, min_x: float, min_y: float, crowded: int = CROWDED) -> DataFrame:
    """elements (all columns) with cluster_id, as in_clusters() gives it; pages of more than ``crowded`` boxes aren't held by one task.

    Dense boxes are at most 2 / DENSE of the tallest box's height apart. Needed memory grows with the boxes of one strip and the next. element_id
    is unique within its page.
    """
    tallest = F.max(F.col("bottom_y") - F.col("top_y"))
    return _striped(elements, lambda rows: in_clusters(rows, min_x, min_y), 2 * tallest / DENSE + 2, crowded)


def near_boxes(elements: DataFrame, distance: int, crowded: int = CROWDED) -> DataFrame:
    """elements (all columns) with cluster_id, as near_clusters() gives it; pages of more than ``crowded`` boxes aren't held by one task."""
    tallest = F.max(F.col("bottom_y") - F.col("top_y"))
    return _striped(elements, lambda rows: near_clusters(rows, distance), tallest + distance + 1, crowded)


def blocks(elements: DataFrame, strict: tuple[float, float], loose: tuple[float, float], crowded: int = CROWDED) -> DataFrame:
    """elements (all columns) with cluster_id (strict) and block_id (loose, of the boxes around strict clusters), as in_blocks() gives them."""
    first = box_clusters(elements, *strict, crowded)
    around = first.groupBy("image_id", "cluster_id").agg(F.min("left_x").alias("left_x"), F.min("top_y").alias("top_y"), F.max("right_x").alias("right_x"), F.max("bottom_y").alias("bottom_y"))
    second = box_clusters(around.withColumnRenamed("cluster_id", "element_id"), *loose, crowded)
    return first.join(second.select("image_id", F.col("element_id").alias("cluster_id"), F.col("cluster_id").alias("block_id")), ["image_id", "cluster_id"]).select(*elements.columns, "cluster_id", "block_id")
