"""One-dimensional grouping: regions by vertical gaps, columns, lines, rows and paragraphs.

Gap rules are gaps-and-islands windows; rules that compare with a running mean are ordered folds inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _islands(rows: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = rows.withColumn("__new", F.when(starts, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def region_groups(elements: DataFrame, gap: int = 50) -> DataFrame:
    """The elements with group_id, from 1: a new group where the gap below everything before exceeds ``gap``.

    The running bottom over all predecessors is that of the group, since earlier groups end above it.
    """
    w = Window.partitionBy("image_id").orderBy("top_y", "element_id")
    bottom = F.max("bottom_y").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return _islands(elements, ["image_id"], ["top_y", "element_id"], bottom.isNull() | (F.col("top_y") - bottom > gap), "group_id")


def group_boxes(grouped: DataFrame) -> DataFrame:
    """image_id, group_id, box, n_elements."""
    return grouped.groupBy("image_id", "group_id").agg(
        F.min("left_x").alias("left_x"), F.min("top_y").alias("top_y"), F.max("right_x").alias("right_x"), F.max("bottom_y").alias("bottom_y"), F.count("*").alias("n_elements")
    )


def assigned_columns(groups: DataFrame, columns: DataFrame, margin: int = 20) -> DataFrame:
    """image_id, group_id, column_id for columns (image_id, column_id, box) that lie in a group's box.

    More than half of the column's height overlaps, and it is inside horizontally, up to the margin.
    """
    within = """a.image_id = b.image_id and b.left_x >= a.left_x - {m} and b.right_x <= a.right_x + {m}
        and 2 * (least(a.bottom_y, b.bottom_y) - greatest(a.top_y, b.top_y)) > b.bottom_y - b.top_y""".format(m=margin)
    return groups.alias("a").join(columns.alias("b"), F.expr(within)).selectExpr("a.image_id as image_id", "a.group_id as group_id", "b.column_id as column_id")


def _folded(rows: DataFrame, keys: list[str], order: str, ident: str, value: str, start: str, step: str, name: str) -> DataFrame:
    """The rows with ``name``: an ordered fold over each group gives a number for each row, and both are zipped.

    The rows travel inside the fold's input, so they are computed once and not joined again.
    """
    rest = [c for c in rows.columns if c not in keys]
    item = f"struct({order} as o, {ident} as id, {value} as v, struct({', '.join(rest)}) as r)"
    packed = rows.groupBy(*keys).agg(F.expr(f"array_sort(collect_list({item}))").alias("items"))
    packed = packed.withColumn("marks", F.expr(f"aggregate(items, {start}, (acc, x) -> {step}, acc -> acc.out)"))
    zipped = packed.select(*keys, F.explode(F.arrays_zip("items", "marks")).alias("z"))
    return zipped.select(*keys, *(F.col(f"z.items.r.{c}").alias(c) for c in rest), F.col("z.marks").alias(name))


def running_mean_groups(rows: DataFrame, keys: list[str], ident: str, value: str, order: str, threshold: int, name: str) -> DataFrame:
    """The rows with ``name``, from 1: a new group where the value is further than the threshold from the mean of the
    current one. value: whole numbers; order: SQL of what precedes the identity (a number) in the order."""
    far = f"acc.n > 0 and abs(acc.n * x.v - acc.total) > {threshold} * acc.n"
    grown = "named_struct('g', {g}, 'n', {n}, 'total', {t}, 'out', array_append(acc.out, {g}))"
    step = "if({far}, {new}, {old})".format(
        far=far, new=grown.format(g="acc.g + 1", n="cast(1 as bigint)", t="x.v"), old=grown.format(g="acc.g", n="acc.n + 1", t="acc.total + x.v")
    )
    start = "named_struct('g', cast(1 as bigint), 'n', cast(0 as bigint), 'total', cast(0 as bigint), 'out', cast(array() as array<bigint>))"
    return _folded(rows, keys, order, ident, value, start, step, name)


def column_clusters(grouped: DataFrame, threshold: int = 100) -> DataFrame:
    """Text elements of regions with column_id, from the left: a break where left is far from the column's mean left."""
    texts = grouped.where("type = 'text'")
    return running_mean_groups(texts, ["image_id", "group_id"], "element_id", "left_x", "left_x", threshold, "column_id")


def joined_text(text: str, *order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda s: s["__t"]), " ")


def lines(columned: DataFrame, gap: int = 15) -> DataFrame:
    """image_id, group_id, column_id, line_id, text, v2 (twice the centre), left_sum, right_sum, n: lines of columns.

    A line begins where the gap below the element before exceeds ``gap``.
    """
    keys, order = ["image_id", "group_id", "column_id"], ["top_y", "left_x", "element_id"]
    before = F.lag("bottom_y").over(Window.partitionBy(*keys).orderBy(*order))
    numbered = _islands(columned, keys, order, before.isNull() | (F.col("top_y") - before > gap), "line_id")
    return numbered.groupBy(*keys, "line_id").agg(
        joined_text("text", *order).alias("text"), (F.min("top_y") + F.max("bottom_y")).alias("v2"), F.sum("left_x").alias("left_sum"), F.sum("right_x").alias("right_sum"), F.count("*").alias("n")
    )


def mean(total: str, n: str = "n") -> Column:
    return F.col(total).cast("double") / F.col(n)


def line_table(found: DataFrame) -> DataFrame:
    """The lines as documents show them: v_center, left_x (mean) and avg_right instead of sums."""
    return found.select("image_id", "group_id", "column_id", "line_id", "text", (F.col("v2").cast("double") / 2).alias("v_center"), mean("left_sum").alias("left_x"), mean("right_sum").alias("avg_right"))


def merged_columns(found: DataFrame, gap: int = 50) -> DataFrame:
    """The lines with merged_id, from the left: columns join while the next begins less than ``gap`` right of all before."""
    keys = ["image_id", "group_id"]
    column = Window.partitionBy(*keys, "column_id")
    spans = found.withColumn("low", F.min(mean("left_sum")).over(column)).withColumn("high", F.max(mean("right_sum")).over(column))
    w = Window.partitionBy(*keys).orderBy("low", "column_id", "line_id")
    # Only a column's first line can begin a merged one; before it there are all lines of the columns before.
    first = F.row_number().over(column.orderBy("line_id")) == 1
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("first") & (F.col("before").isNull() | (F.col("low") - F.col("before") >= gap))
    spans = spans.withColumn("first", first).withColumn("before", before)
    return _islands(spans, keys, ["low", "column_id", "line_id"], starts, "merged_id").drop("low", "high", "first", "before")


def rows(found: DataFrame, threshold: int = 25) -> DataFrame:
    """image_id, group_id, row_id, text: lines of all columns whose centres are near the row's mean, joined from the left."""
    ranked = found.withColumn("item", F.row_number().over(Window.partitionBy("image_id", "group_id").orderBy("v2", mean("left_sum"), "column_id", "line_id")).cast("long"))
    grouped = running_mean_groups(ranked, ["image_id", "group_id"], "item", "v2", "0", 2 * threshold, "row_id")
    grouped = grouped.withColumn("at", mean("left_sum"))
    return grouped.groupBy("image_id", "group_id", "row_id").agg(joined_text("text", "at", "v2", "column_id", "line_id").alias("text"))


def word_count(text: str) -> Column:
    return F.size(F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != ""))


def paragraphs(found: DataFrame, few: int = 5) -> DataFrame:
    """image_id, group_id, para_no, text: a row of fewer words than ``few``, or with a colon at its end, begins a paragraph."""
    begins = (F.col("row_id") == F.min("row_id").over(Window.partitionBy("image_id", "group_id"))) | (word_count("text") < few) | F.col("text").endswith(":")
    numbered = _islands(found, ["image_id", "group_id"], ["row_id"], begins, "para_no")
    return numbered.groupBy("image_id", "group_id", "para_no").agg(joined_text("text", "row_id").alias("text"))


def anchor_columns(table: DataFrame, threshold: int = 50) -> DataFrame:
    """The rows of a line table with anchor_id, from 1, by (v_center, left): a break where left is ``threshold`` or more from
    the left of the group's first line."""
    keys = ["image_id", "group_id"]
    ranked = table.withColumn("item", F.row_number().over(Window.partitionBy(*keys).orderBy("v_center", "left_x", "column_id", "line_id")).cast("long"))
    grown = "named_struct('g', {g}, 'first', {f}, 'out', array_append(acc.out, {g}))"
    step = f"if(acc.first is null or abs(x.v - acc.first) >= {threshold}, {grown.format(g='acc.g + 1', f='x.v')}, {grown.format(g='acc.g', f='acc.first')})"
    start = "named_struct('g', cast(0 as bigint), 'first', cast(null as double), 'out', cast(array() as array<bigint>))"
    return _folded(ranked, keys, "0", "item", "left_x", start, step, "anchor_id").drop("item")
