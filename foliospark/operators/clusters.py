"""Clusters of boxes: connected components within a page, and the regions they make."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Phase 1 and phase 2 of region building: least ratios of width and height.
STRICT, LOOSE = (0.2, 0.1), (0.1, 0.1)
#: Least share of the box around two boxes that these fill.
DENSE = 0.15
#: Rows of whole pages, and pairs of boxes, that are handled at a time.
ROWS, PAIRS = 20_000, 1 << 20

Boxes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ROWS rows or one page, from batches in the order of image_id."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pages = batch.column("image_id").to_numpy(zero_copy_only=False)
        if rows >= ROWS:
            # The page that is open goes on to the first row of another one.
            open_ = held[-1].column("image_id")[-1].as_py()
            other = np.flatnonzero(pages != open_)
            if len(other):
                held.append(batch.slice(0, other[0]))
                yield pa.Table.from_batches(held)
                held, rows, batch = [], 0, batch.slice(other[0])
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _ordered(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, Boxes]]:
    """Tables of whole pages in the order of image_id and key, with the numbers of their pages from 0, the keys and the boxes."""
    for table in _whole_pages(batches):
        column = lambda c: table.column(c).to_numpy().astype(np.int64)  # noqa: B023, E731
        image, keys = column("image_id"), column(key)
        order = np.lexsort((keys, image))
        boxes = tuple(column(c)[order] for c in ("left_x", "top_y", "right_x", "bottom_y"))
        yield table.take(pa.array(order)), np.unique(image[order], return_inverse=True)[1], keys[order], boxes


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("image_id").sortWithinPartitions("image_id")


def by_pages(elements: DataFrame, add: Callable[..., dict[str, np.ndarray]], *names: str) -> DataFrame:
    """elements with the long columns that ``add(page, element_id, boxes)`` gives for the rows of whole pages: one exchange by page.

    page numbers the pages from 0, in ascending order; element_id ascends within a page.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, page, element, boxes in _ordered(batches, "element_id"):
            made = add(page, element, boxes)
            for name in names:
                table = table.append_column(name, pa.array(made[name]))
            yield from table.combine_chunks().to_batches()

    schema = StructType([*elements.schema.fields, *(StructField(n, LongType()) for n in names)])
    return _dealt(elements).mapInArrow(label, schema)


def connected(boxes: Boxes, a: np.ndarray, b: np.ndarray, min_x: float, min_y: float) -> np.ndarray:
    """Which pairs of boxes are dense together, and aligned by width or by height. Gaps between them make no difference."""
    (la, ta, ra, ba), (lb, tb, rb, bb) = (tuple(x[k] for x in boxes) for k in (a, b))
    whole = (np.maximum(ra, rb) - np.minimum(la, lb)) * (np.maximum(ba, bb) - np.minimum(ta, tb))
    areas = (ra - la) * (ba - ta) + (rb - lb) * (bb - tb)

    def share(common: np.ndarray, least: np.ndarray) -> np.ndarray:
        return np.where(least > 0, np.maximum(common, 0) / np.maximum(least, 1), 0.0)

    tall = share(np.minimum(ba, bb) - np.maximum(ta, tb), np.minimum(ba - ta, bb - tb))
    wide = share(np.minimum(ra, rb) - np.maximum(la, lb), np.minimum(ra - la, rb - lb))
    return (np.where(whole > 0, areas / np.maximum(whole, 1), 0.0) >= DENSE) & ((tall >= min_y) | (wide >= min_x))


def within(boxes: Boxes, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs of boxes are at most so far apart."""
    (la, ta, ra, ba), (lb, tb, rb, bb) = (tuple(x[k] for x in boxes) for k in (a, b))
    x, y = np.maximum(0, np.maximum(lb - ra, la - rb)), np.maximum(0, np.maximum(tb - ba, ta - bb))
    return x * x + y * y <= distance * distance


def labels(page: np.ndarray, boxes: Boxes, near: Callable[[np.ndarray, np.ndarray], np.ndarray], reach: np.ndarray) -> np.ndarray:
    """For each box the first row that it is linked with, directly or through others of its page.

    near tells of pairs whether they are linked; a box can be linked only with those whose top is at most reach below its own. By falling
    order of tops, so a crowded page has no more pairs than that allows.
    """
    n, top = len(page), boxes[1]
    label = np.arange(n)
    if not n:
        return label
    reach = np.maximum(reach, 0).astype(np.int64)
    low = top.min()
    room = int(top.max() - low + reach.max()) + 1
    order = np.lexsort((top, page))
    key = page[order] * room + (top[order] - low)
    count = np.searchsorted(key, key + reach[order], "right") - np.arange(1, n + 1)
    ends = np.cumsum(count)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        own = count[at:to]
        a = np.repeat(np.arange(at, to), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        a, b = order[a], order[b]
        linked = label[a] != label[b]
        a, b = a[linked], b[linked]
        linked = near(a, b)
        a, b = a[linked], b[linked]
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            least = np.minimum(x, y)[apart]
            np.minimum.at(label, x[apart], least)
            np.minimum.at(label, y[apart], least)
            while (label[label] != label).any():
                label = label[label]
        at = to
    return label


def _connected_labels(page: np.ndarray, boxes: Boxes, min_x: float, min_y: float) -> np.ndarray:
    # Of two dense boxes the areas' sum over the greater width is at most the sum of the heights.
    height = boxes[3] - boxes[1]
    tallest = np.zeros(int(page.max()) + 1 if len(page) else 0, np.int64)
    np.maximum.at(tallest, page, height)
    reach = np.ceil((height + tallest[page]) / DENSE) + 1
    return labels(page, boxes, lambda a, b: connected(boxes, a, b, min_x, min_y), reach)


def _around(label: np.ndarray, page: np.ndarray, boxes: Boxes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Boxes]:
    """The labels in order, each row's number of its label, the labels' pages and the boxes around their rows."""
    own, of = np.unique(label, return_inverse=True)
    around = []
    for k, x in enumerate(boxes):
        pick = np.minimum if k < 2 else np.maximum
        out = x[own].copy()
        pick.at(out, of, x)
        around.append(out)
    return own, of, page[own], tuple(around)


def in_clusters(elements: DataFrame, min_x: float, min_y: float) -> DataFrame:
    """elements (all columns) with cluster_id, the least element_id of those they are connected with."""

    def add(page: np.ndarray, element: np.ndarray, boxes: Boxes) -> dict[str, np.ndarray]:
        return {"cluster_id": element[_connected_labels(page, boxes, min_x, min_y)]}

    return by_pages(elements, add, "cluster_id")


def box_clusters(elements: DataFrame, min_x: float, min_y: float) -> DataFrame:
    """image_id, element_id, cluster_id: components of boxes that are dense together and aligned by width or height."""
    boxes = elements.select("image_id", "element_id", "left_x", "top_y", "right_x", "bottom_y")
    return in_clusters(boxes, min_x, min_y).select("image_id", "element_id", "cluster_id")


def near_clusters(elements: DataFrame, distance: int) -> DataFrame:
    """elements (all columns) with cluster_id, the least element_id of those that are near, directly or through others."""

    def add(page: np.ndarray, element: np.ndarray, boxes: Boxes) -> dict[str, np.ndarray]:
        reach = boxes[3] - boxes[1] + distance
        return {"cluster_id": element[labels(page, boxes, lambda a, b: within(boxes, a, b, distance), reach)]}

    return by_pages(elements, add, "cluster_id")


def union_boxes(rows: DataFrame, *keys: str) -> DataFrame:
    """The box around each group's boxes and their number."""
    return rows.groupBy(*keys).agg(
        F.min("left_x").alias("left_x"), F.min("top_y").alias("top_y"), F.max("right_x").alias("right_x"), F.max("bottom_y").alias("bottom_y"), F.count("*").alias("n_elements")
    )


def regions(clustered: DataFrame) -> DataFrame:
    """image_id, cluster_id, box, n_elements, region_no: clusters (elements with cluster_id) as regions, numbered from the top."""
    boxes = union_boxes(clustered, "image_id", "cluster_id")
    order = Window.partitionBy("image_id").orderBy("top_y", "cluster_id")
    return boxes.withColumn("region_no", F.row_number().over(order).cast("long"))


def as_elements(boxes: DataFrame) -> DataFrame:
    """Region boxes as elements, so that they can be clustered again."""
    return boxes.select("image_id", F.col("cluster_id").alias("element_id"), "left_x", "top_y", "right_x", "bottom_y")


def _phases(page: np.ndarray, boxes: Boxes) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each row's cluster and of its block: both clustering phases, the second over the boxes around the first one's clusters."""
    label = _connected_labels(page, boxes, *STRICT)
    own, of, pages, around = _around(label, page, boxes)
    loose = _connected_labels(pages, around, *LOOSE)
    return label, own[loose][of]


def in_blocks(elements: DataFrame) -> DataFrame:
    """elements (all columns) with cluster_id (strict) and block_id (loose)."""

    def add(page: np.ndarray, element: np.ndarray, boxes: Boxes) -> dict[str, np.ndarray]:
        return dict(zip(("cluster_id", "block_id"), (element[label] for label in _phases(page, boxes))))

    return by_pages(elements, add, "cluster_id", "block_id")


def linewise_order(rows: DataFrame, threshold: int = 10) -> DataFrame:
    """image_id, element_id, cluster_id, line_no, place: elements (with cluster_id) of a cluster in lines.

    By falling height on the page, an element joins the first line whose mean centre is within the threshold, and the
    mean follows; lines stay in the order they began, elements of a line go by left edge.
    """
    item = "struct(top_y, element_id, left_x, top_y + bottom_y as c2)"
    state = "array<struct<n:bigint,total:bigint,members:array<struct<left_x:bigint,top_y:bigint,element_id:bigint>>>>"
    fits = f"abs(line.n * x.c2 - line.total) <= {2 * threshold} * line.n"
    member = "struct(x.left_x as left_x, x.top_y as top_y, x.element_id as element_id)"
    at = f"array_position(transform(acc, line -> {fits}), true)"
    grown = f"struct(line.n + 1 as n, line.total + x.c2 as total, array_append(line.members, {member}) as members)"
    step = f"if({at} > 0, transform(acc, (line, i) -> if(i = {at} - 1, {grown}, line)), array_append(acc, struct(cast(1 as bigint) as n, x.c2 as total, array({member}) as members)))"
    folded = rows.groupBy("image_id", "cluster_id").agg(F.expr(f"aggregate(array_sort(collect_list({item})), cast(array() as {state}), (acc, x) -> {step})").alias("lines"))
    lines = folded.select("image_id", "cluster_id", F.posexplode("lines").alias("line_no", "line"))
    placed = lines.selectExpr("image_id", "cluster_id", "line_no", "posexplode(array_sort(line.members)) as (place, member)")
    return placed.selectExpr("image_id", "member.element_id as element_id", "cluster_id", "cast(line_no + 1 as bigint) as line_no", "cast(place + 1 as bigint) as place")


def _swept(boxes: list[list], vertical: int, horizontal: int) -> list[list]:
    """boxes: [left, top, right, bottom, number of elements, members], from the top; the same after all sweeps."""
    now = boxes
    while True:
        merged, i = [], 0
        while i < len(now):
            a, b = now[i], now[i + 1] if i + 1 < len(now) else None
            near = b is not None and a[2] >= b[0] and b[2] >= a[0] and abs(b[1] - a[3]) <= 2 * vertical
            if near and min(abs(b[0] - a[2]), abs(a[0] - b[2])) <= 2 * horizontal:
                merged.append([min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4], a[5] + b[5]])
                i += 2
            else:
                merged.append(a)
                i += 1
        if len(merged) == len(now):
            return sorted(now, key=lambda r: r[1])
        now = merged


def _merged(page: np.ndarray, ids: np.ndarray, boxes: Boxes, size: np.ndarray, vertical: int, horizontal: int) -> tuple[list[int], list[list]]:
    """Number on its page and box, size and rows of each region that boxes of whole pages make, in the order of pages."""
    order = np.lexsort((ids, boxes[1], page))
    rows = [[*row, [k]] for *row, k in zip(*(x[order].tolist() for x in (*boxes, size)), order.tolist())]
    edges = np.flatnonzero(np.diff(page[order], prepend=-1, append=-1)).tolist()
    numbers, found = [], []
    for a, b in zip(edges[:-1], edges[1:]):
        now = _swept(rows[a:b], vertical, horizontal)
        numbers.extend(range(1, len(now) + 1))
        found.extend(now)
    return numbers, found


_REGIONS = "image_id long, region_no long, left_x long, top_y long, right_x long, bottom_y long, n_elements long, members array<long>"


def _region_table(images: pa.ChunkedArray, numbers: list[int], found: list[list], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """_REGIONS of what _merged() gives; images and ids are those of its rows."""
    rows = np.fromiter((k for region in found for k in region[5]), np.int64)
    ends = np.cumsum([0, *(len(region[5]) for region in found)])
    members = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids[rows])).cast(pa.list_(pa.int64()))
    image = images.take(pa.array(rows[ends[:-1]])).combine_chunks().cast(pa.int64())
    columns = [image, pa.array(numbers, pa.int64()), *(pa.array([region[k] for region in found], pa.int64()) for k in range(5)), members]
    yield pa.RecordBatch.from_arrays(columns, ["image_id", "region_no", "left_x", "top_y", "right_x", "bottom_y", "n_elements", "members"])


def merge_adjacent(boxes: DataFrame, vertical: int = 20, horizontal: int = 100) -> DataFrame:
    """image_id, region_no, box, n_elements, members (cluster ids): neighbours in reading order merged until none can be.

    Each sweep merges disjoint neighbours from the top on. Two merge if their x-intervals meet, the vertical gap is at
    most twice ``vertical`` either way, and the lesser horizontal gap between opposite edges at most twice ``horizontal``.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, page, ids, around in _ordered(batches, "cluster_id"):
            size = table.column("n_elements").to_numpy()
            yield from _region_table(table.column("image_id"), *_merged(page, ids, around, size, vertical, horizontal), ids)

    return _dealt(boxes).mapInArrow(sweep, _REGIONS)


def _block_regions(page: np.ndarray, element: np.ndarray, boxes: Boxes, vertical: int, horizontal: int) -> tuple[np.ndarray, np.ndarray, list[int], list[list]]:
    """The first rows of blocks, the number of each row's block, and what _merged() makes of the blocks."""
    own, of, pages, around = _around(_phases(page, boxes)[1], page, boxes)
    return own, of, *_merged(pages, element[own], around, np.bincount(of, minlength=len(own)), vertical, horizontal)


def adjacent_regions(elements: DataFrame, vertical: int = 20, horizontal: int = 100) -> DataFrame:
    """What merge_adjacent() makes of the boxes around blocks (members: block ids), in one exchange by page."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, page, element, boxes in _ordered(batches, "element_id"):
            own, _, numbers, found = _block_regions(page, element, boxes, vertical, horizontal)
            yield from _region_table(table.column("image_id").take(pa.array(own)), numbers, found, element[own])

    return _dealt(elements.select("image_id", "element_id", "left_x", "top_y", "right_x", "bottom_y")).mapInArrow(sweep, _REGIONS)


def in_regions(elements: DataFrame, vertical: int = 20, horizontal: int = 100) -> DataFrame:
    """elements (all columns) with the region_no that merge_adjacent() gives the block they are in."""

    def add(page: np.ndarray, element: np.ndarray, boxes: Boxes) -> dict[str, np.ndarray]:
        own, of, numbers, found = _block_regions(page, element, boxes, vertical, horizontal)
        number = np.zeros(len(own), np.int64)
        for n, region in zip(numbers, found):
            number[region[5]] = n
        return {"region_no": number[of]}

    return by_pages(elements, add, "region_no")
