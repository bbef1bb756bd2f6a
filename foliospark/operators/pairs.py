"""Pairs of boxes of one page that meet a condition: equi-joins on the page with the condition as residual.

One partitioning by image_id serves all of them; each pair appears once, the lesser element_id first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = "a.image_id = b.image_id"


def box_pairs(elements: DataFrame, condition: str, **measures: str) -> DataFrame:
    """image_id, a_id, b_id and the measures (SQL over a and b) of pairs that meet the condition."""
    joined = elements.alias("a").join(elements.alias("b"), F.expr(f"{PAGE} and a.element_id < b.element_id and {condition}"))
    return joined.selectExpr("a.image_id as image_id", "a.element_id as a_id", "b.element_id as b_id", *(f"{x} as {n}" for n, x in measures.items()))


#: Levels of containing_pairs(): cells of 2^0 to 2^LEVELS.
LEVELS = 40


def containing_pairs(inner: DataFrame, outer: DataFrame, condition: str, *columns: str) -> DataFrame:
    """columns (SQL over a and b) of rows a of inner and b of outer of one page that meet a condition which implies that box b contains box a.

    What contains a box covers its upper left corner. An outer box is dealt to the cells it touches, at most two on each axis, of a grid as coarse
    as the box is long; an inner box is looked up in the cell of its corner, once in each grid that its page has boxes of. So a pair meets
    in one cell alone, and only boxes of like size and place are compared. Boxes have left_x <= right_x and top_y <= bottom_y.
    """
    size = "cast(pow(2, {t}.level) as bigint)".format
    level = "cast(least({0}, ceil(log2(greatest(1, right_x - left_x, bottom_y - top_y)))) as int)".format(LEVELS)
    cells = lambda low, high: f"explode(sequence(floor({low} / {size(t='b')}), floor({high} / {size(t='b')})))"
    dealt = outer.withColumn("level", F.expr(level)).alias("b")
    dealt = dealt.selectExpr("b.*", f"{cells('left_x', 'right_x')} as cx").alias("b").selectExpr("b.*", f"{cells('top_y', 'bottom_y')} as cy")
    # As many as there are levels, on each page.
    levels = dealt.groupBy("image_id").agg(F.collect_set("level").alias("levels"))
    asked = inner.join(levels, "image_id").select(*inner.columns, F.explode("levels").alias("level")).alias("a")
    asked = asked.selectExpr("a.*", f"floor(left_x / {size(t='a')}) as cx", f"floor(top_y / {size(t='a')}) as cy")
    met = asked.alias("a").join(dealt.alias("b"), F.expr(f"{PAGE} and a.level = b.level and a.cx = b.cx and a.cy = b.cy and {condition}"))
    return met.selectExpr(*columns)


def near_pairs(elements: DataFrame, condition: str, reach: int, **measures: str) -> DataFrame:
    """The same as box_pairs where the condition implies gaps of at most ``reach`` on both axes, for crowded pages.

    Boxes are dealt to the grid cells that they touch, half the reach beyond their edges; pairs meet in shared cells.
    """
    half = -(-reach // 2)
    size = max(256, 2 * half)
    cells = lambda low, high: f"explode(sequence(floor(({low} - {half}) / {size}), floor(({high} + {half}) / {size})))"
    dealt = elements.selectExpr("*", f"{cells('left_x', 'right_x')} as cx").selectExpr("*", f"{cells('top_y', 'bottom_y')} as cy")
    joined = dealt.alias("a").join(dealt.alias("b"), F.expr(f"{PAGE} and a.cx = b.cx and a.cy = b.cy and a.element_id < b.element_id and {condition}"))
    return joined.selectExpr("a.image_id as image_id", "a.element_id as a_id", "b.element_id as b_id", *(f"{x} as {n}" for n, x in measures.items())).distinct()
