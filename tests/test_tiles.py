"""Clusters of crowded pages by strips, against those of one task; components of links within pages."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions.components import least_reachable
from foliospark.operators import clusters, tiles

BOXES = "image_id long, element_id long, left_x long, top_y long, right_x long, bottom_y long"


def some_boxes(seed, pages=3, n=150, tall=30):
    rng = random.Random(seed)
    rows = []
    for page in range(pages):
        for i in range(n if page else n // 3):
            left, top = rng.randrange(-200, 900), rng.randrange(-300, 4000)
            rows.append((page, i * 3 + page, left, top, left + rng.randrange(0, 150), top + rng.randrange(0, tall)))
    return rows


def found(df, *columns):
    return sorted(map(tuple, df.select("image_id", "element_id", *columns, "note").collect()))


@pytest.fixture
def crowded(spark):
    df = spark.createDataFrame(some_boxes(1), BOXES)
    return df.withColumns({"note": F.concat(F.lit("n"), "element_id"), "strip": F.lit(1), "home": F.lit("x"), "n": F.lit(None).cast("int")})


@pytest.mark.parametrize("limit", [0, 60])
def test_strips_give_what_one_task_gives(crowded, limit):
    assert found(tiles.box_clusters(crowded, 0.2, 0.1, limit), "cluster_id") == found(clusters.in_clusters(crowded, 0.2, 0.1), "cluster_id")
    assert found(tiles.near_boxes(crowded, 40, limit), "cluster_id") == found(clusters.near_clusters(crowded, 40), "cluster_id")
    got = tiles.blocks(crowded, clusters.STRICT, clusters.LOOSE, limit)
    assert found(got, "cluster_id", "block_id") == found(clusters.in_blocks(crowded), "cluster_id", "block_id")


def test_a_chain_over_many_strips_is_one_cluster(spark):
    """Boxes that touch only their neighbours, the length of a page of 400 strips, in an order unlike that of their ids; and one apart."""
    rows = [(1, (i * 37) % 400, 0, 12 * i, 50, 12 * i + 12) for i in range(400)] + [(1, 1000, 900, 0, 950, 12), (2, 5, 0, 0, 1, 1)]
    df = spark.createDataFrame(rows, BOXES)
    got = {(r.image_id, r.element_id): r.cluster_id for r in tiles.near_boxes(df, 0, 10).collect()}
    assert got == {(p, i): 0 if (p, i) not in ((1, 1000), (2, 5)) else i for p, i, *_ in rows}


def test_no_boxes(spark):
    assert tiles.box_clusters(spark.createDataFrame([], BOXES), 0.2, 0.1, 0).count() == 0


def test_a_page_of_very_many_boxes(spark):
    """30,000 boxes of one page, which strips and one task label alike."""
    i = F.col("id")
    df = spark.range(30_000).select(F.lit(1).cast("long").alias("image_id"), i.alias("element_id"), (i * 7919 % 5000).alias("left_x"), (i * 104729 % 60_000).alias("top_y"))
    i = F.col("element_id")
    df = df.withColumns({"right_x": F.col("left_x") + i * 31 % 90 + 5, "bottom_y": F.col("top_y") + i * 17 % 25 + 5})
    got, want = tiles.box_clusters(df, 0.2, 0.1, 1000), clusters.in_clusters(df, 0.2, 0.1)
    check = lambda c: c.agg(F.count("*"), F.countDistinct("cluster_id"), F.sum(F.xxhash64("element_id", "cluster_id").cast("decimal(38)"))).first()
    assert check(got) == check(want)


def test_components_equal_a_search(spark):
    rng = random.Random(3)
    links = [(p, rng.randrange(80), rng.randrange(80)) for p in range(3) for _ in range(55)] + [(9, i, i + 1) for i in range(70)] + [(9, 100, 100)]
    got = {(r.image_id, r.node): r.least for r in least_reachable(spark.createDataFrame(links, "image_id long, a long, b long")).collect()}
    want = {}
    for p, a, b in links:
        want.setdefault((p, a), {a}), want.setdefault((p, b), {b})
        both = want[p, a] | want[p, b]
        for node in both:
            want[p, node] = both
    assert got == {key: min(nodes) for key, nodes in want.items()}
