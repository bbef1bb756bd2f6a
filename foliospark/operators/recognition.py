"""What follows text recognition and object candidates: filters and projections of boxes and angles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Trims as the model's strings are trimmed: all Unicode white space.
STRIP = r"regexp_replace(text, '(?U)^\\s+|\\s+$', '')"


def recognised(elements: DataFrame, least_chars: int = 2, confidence: float = 0.2) -> DataFrame:
    """The text elements that recognition results must be: long enough when trimmed, sure enough."""
    return elements.where(F.expr(f"length({STRIP}) >= {least_chars}") & (F.col("confidence") >= confidence))


def absolute_boxes(found: DataFrame) -> DataFrame:
    """found (image_id, element_id, roi_x, roi_y, box of points, text, confidence) in page coordinates, with bounds."""
    moved = found.withColumn("polygon", F.expr("transform(box, p -> struct(p.x + roi_x as x, p.y + roi_y as y))"))
    edge = lambda f, c: F.expr(f"array_{f}(transform(polygon, p -> p.{c}))")
    return moved.select(
        "image_id", "element_id", F.expr(STRIP).alias("text"), "confidence", "polygon", edge("min", "x").alias("left_x"), edge("min", "y").alias("top_y"),
        edge("max", "x").alias("right_x"), edge("max", "y").alias("bottom_y"),
    )


def rotated_points(points: DataFrame, angle: str, cx: str, cy: str) -> DataFrame:
    """points (x, y) turned by an angle in degrees about (cx, cy), cut to whole numbers towards 0."""
    rad = f"radians(cast({angle} as double))"
    x = f"cast(((x - {cx}) * cos({rad}) - (y - {cy}) * sin({rad})) + {cx} as bigint)"
    y = f"cast(((x - {cx}) * sin({rad}) + (y - {cy}) * cos({rad})) + {cy} as bigint)"
    return points.withColumns({"rx": F.expr(x), "ry": F.expr(y)})


def reading_order(elements: DataFrame) -> DataFrame:
    """The elements with place, from 1, by (top, left, id)."""
    order = Window.partitionBy("image_id").orderBy("top_y", "left_x", "element_id")
    return elements.withColumn("place", F.row_number().over(order).cast("long"))


def object_candidates(found: DataFrame, area: float = 5000, edges: float = 0.1, texts: float = 0.3) -> DataFrame:
    """Candidates (x, y, w, h at a scale, densities) that are objects, as element boxes in page coordinates."""
    kept = found.where(f"h > 0 and w * h >= {area} * scale * scale and cast(w as double) / h >= 0.2 and cast(w as double) / h <= 5 and edge_density > {edges} and text_density < {texts}")
    return kept.selectExpr(
        "image_id", "cand_id as element_id", "'image' as type", "cast(x / scale as bigint) as left_x", "cast(y / scale as bigint) as top_y",
        "cast(x / scale as bigint) + cast(w / scale as bigint) as right_x", "cast(y / scale as bigint) + cast(h / scale as bigint) as bottom_y", "edge_density as confidence",
    )


def angle_histogram(segments: DataFrame) -> DataFrame:
    """image_id, angle, weight: lengths of line segments (x1, y1, x2, y2) summed by whole degrees, from -90 to 90."""
    raw = F.when(F.col("x2") == F.col("x1"), F.lit(90.0)).otherwise(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))))
    turned = F.pmod(raw, F.lit(180.0))
    turned = F.when(turned > 90, turned - 180).otherwise(turned)
    length = F.sqrt(((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1"))).cast("double"))
    return segments.groupBy("image_id", F.bround(turned, 0).cast("long").alias("angle")).agg(F.sum(length).alias("weight"))


def major_angles(histogram: DataFrame, tolerance: int = 5, most: int = 4, share: float = 0.8) -> DataFrame:
    """image_id, place, angle: the heaviest angles that are apart, until they weigh more than the share; 0 always near one.

    By weight, ties to the lesser angle; in the end by absolute angle, ties in the order found, at most ``most``.
    """
    out = "array<bigint>"
    near = f"exists(acc.out, k -> abs(x.angle - k) < {tolerance})"
    taken = "named_struct('w', acc.w + x.weight, 'out', array_append(acc.out, x.angle))"
    step = f"if(acc.w > {share} * total or {near}, acc, {taken})"
    items = "transform(array_sort(collect_list(struct(-weight as o, angle, weight))), x -> struct(x.angle as angle, x.weight as weight))"
    packed = histogram.groupBy("image_id").agg(F.expr(items).alias("items"), F.sum("weight").alias("total"))
    found = packed.withColumn("found", F.expr(f"aggregate(items, named_struct('w', 0.0D, 'out', cast(array() as {out})), (acc, x) -> {step}, acc -> acc.out)"))
    found = found.withColumn("found", F.expr(f"if(exists(found, k -> abs(k) < {tolerance}), found, array_append(found, 0L))"))
    ordered = F.expr("array_sort(transform(found, (a, i) -> struct(abs(a) as o, i, a)))")
    placed = found.select("image_id", F.posexplode(F.slice(ordered, 1, most)).alias("pos", "s"))
    return placed.select("image_id", (F.col("pos") + 1).cast("long").alias("place"), F.col("s.a").alias("angle"))


def angle_clusters(angles: DataFrame, tolerance: int = 5) -> DataFrame:
    """image_id, place, angle (double) of angles (image_id, line_id, angle), modulo 180 and in the order of line_id.

    An angle joins the first cluster with a member nearer than the tolerance. Clusters with a tenth of all angles give
    their mean, or the multiple of 90 near it; without any, 0.
    """
    near = f"exists(k, v -> abs(x.a - v) < {tolerance})"
    at = f"array_position(transform(acc, k -> {near}), true)"
    step = f"if({at} > 0, transform(acc, (k, i) -> if(i = {at} - 1, array_append(k, x.a), k)), array_append(acc, array(x.a)))"
    fold = f"aggregate(array_sort(collect_list(struct(line_id, pmod(cast(angle as double), 180.0D) as a))), cast(array() as array<array<double>>), (acc, x) -> {step})"
    found = angles.groupBy("image_id").agg(F.expr(fold).alias("k"), F.count("*").alias("n"))
    mean = "aggregate(c, 0.0D, (s, v) -> s + v) / size(c)"
    snapped = "case " + " ".join(f"when abs(m - {b}) < {tolerance} then {b}.0D" for b in (0, 90, 180, 270)) + " else m end"
    found = found.withColumn("m", F.expr(f"transform(transform(filter(k, c -> size(c) >= n * 0.1D), c -> {mean}), m -> {snapped})"))
    found = found.withColumn("m", F.expr("if(size(m) = 0, array(0.0D), m)")).select("image_id", F.posexplode("m").alias("pos", "angle"))
    return found.select("image_id", (F.col("pos") + 1).cast("long").alias("place"), "angle")


def rotated_canvas(width: int, height: int, angle: float) -> tuple[int, int]:
    """Width and height of the canvas that holds an image turned by an angle in degrees."""
    c, s = abs(math.cos(math.radians(angle))), abs(math.sin(math.radians(angle)))
    return int(height * s + width * c), int(height * c + width * s)


def points_to_page(points: DataFrame, width: int | str, height: int | str, angle: str, rotated_width: str, rotated_height: str) -> DataFrame:
    """points (x, y) of a page turned by ``angle`` degrees, back in the page's coordinates, as ox, oy, cut towards 0."""
    rad = f"radians(-cast({angle} as double))"
    cx, cy = f"floor({rotated_width} / 2.0D)", f"floor({rotated_height} / 2.0D)"
    # The turn about (cx, cy), then the shift from its centre to the page's.
    x = f"cast(cos({rad}) * x + sin({rad}) * y + ((1 - cos({rad})) * {cx} - sin({rad}) * {cy} + ({width} / 2.0D - {cx})) as bigint)"
    y = f"cast(-sin({rad}) * x + cos({rad}) * y + (sin({rad}) * {cx} + (1 - cos({rad})) * {cy} + ({height} / 2.0D - {cy})) as bigint)"
    return points.withColumns({"ox": F.expr(x), "oy": F.expr(y)})


def plausible_rotated(blocks: DataFrame, width: int | str, height: int | str) -> DataFrame:
    """Rotated text blocks that are sure, of plausible shape, and neither tiny nor as large as the page."""
    w, h = "(right_x - left_x)", "(bottom_y - top_y)"
    ratio = f"(case when {h} > 0 then cast({w} as double) / {h} else 0 end)"
    return blocks.where(f"length({STRIP}) >= 2 and coalesce(confidence, 0.8D) > 0.3 and {ratio} > 0.1 and {ratio} < 10 and {w} > 5 and {h} > 5 and {w} < {width} * 0.9D and {h} < {height} * 0.9D")
