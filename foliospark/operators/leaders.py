"""Leader clustering: in a fixed order a row joins the first seed it resembles, else becomes a seed.

Seeds come from one ordered fold inside the JVM; members are then joined to their first seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .clusters import near_clusters
from .pairs import containing_pairs

_BOX = "left_x, top_y, right_x, bottom_y"
_BOX_TYPE = "left_x:bigint,top_y:bigint,right_x:bigint,bottom_y:bigint"


def seeds(rows: DataFrame, order: str, order_type: str, similar: str) -> DataFrame:
    """image_id, rank, element_id, box of each page's seeds; similar: SQL over seed k and row x; order: falling rank first."""
    item = f"struct({order} as o, element_id, {_BOX})"
    kind = f"array<struct<o:{order_type},element_id:bigint,{_BOX_TYPE}>>"
    fold = f"aggregate(array_sort(collect_list({item})), cast(array() as {kind}), (acc, x) -> if(exists(acc, k -> {similar}), acc, array_append(acc, x)))"
    found = rows.groupBy("image_id").agg(F.expr(fold).alias("seeds"))
    return found.selectExpr("image_id", "posexplode(seeds) as (rank, seed)").selectExpr("image_id", "cast(rank + 1 as bigint) as rank", "seed.element_id as element_id", *(f"seed.{c.strip()} as {c.strip()}" for c in _BOX.split(",")))


def without_overlaps(objects: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The objects (element columns) that stay when, by falling confidence, those with a larger IoU with a kept one go."""
    kept = seeds(objects, "-confidence", "double", f"{g.iou('k', 'x')} > {threshold}")
    return objects.join(kept.select("image_id", "element_id"), ["image_id", "element_id"], "left_semi")


def contained_groups(objects: DataFrame) -> DataFrame:
    """image_id, element_id, seed_id: by falling area, each object with the first seed whose box contains it.

    Containment is transitive, so of all boxes that contain an object the first in that order is in none before it: a seed.
    """
    boxes = objects.select("image_id", "element_id", *_BOX.split(", "), F.expr("struct(-((right_x - left_x) * (bottom_y - top_y)), -confidence, element_id) as place"))
    met = containing_pairs(boxes.drop("place"), boxes, g.contained("a", "b"), "a.image_id as image_id", "a.element_id as element_id", "b.place as place")
    return met.groupBy("image_id", "element_id").agg(F.min("place").alias("first")).select("image_id", "element_id", F.col("first.element_id").alias("seed_id"))


def merged(grouped: DataFrame, group: str) -> DataFrame:
    """image_id, group, box, n_elements, mean confidence of each group of objects (with the group's column)."""
    box = [F.min("left_x").alias("left_x"), F.min("top_y").alias("top_y"), F.max("right_x").alias("right_x"), F.max("bottom_y").alias("bottom_y")]
    return grouped.groupBy("image_id", group).agg(*box, F.count("*").alias("n_elements"), F.avg("confidence").alias("confidence"))


def object_clusters(objects: DataFrame, distance: int = 60) -> DataFrame:
    """image_id, cluster_id, box, confidence, n_elements: contained boxes merged, then boxes within the distance."""
    held = objects.join(contained_groups(objects), ["image_id", "element_id"])
    first = merged(held, "seed_id").withColumnRenamed("seed_id", "element_id").drop("n_elements")
    return merged(near_clusters(first, distance), "cluster_id")
