"""Operators without SQL against sequential models, and hand-made edge cases."""

import difflib
import random

import pytest

from foliospark.operators import clusters, documents, duplicates, grouping, leaders, pairs, recognition, textmerge
from foliospark.functions import geometry as g
from foliospark.plans import layout
from foliospark.sources.layout import ELEMENTS


def elements(spark, rows):
    """rows: (image, id, type, text, confidence, left, top, right, bottom)."""
    return spark.createDataFrame(rows, ELEMENTS)


def text(i, left, top, right, bottom, words="some text", confidence=0.9, image=1):
    return (image, i, "text", words, confidence, left, top, right, bottom)


def boxes(seed, n, images=3, width=400, height=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randrange(width), rng.randrange(height)
        out.append((rng.randrange(images), i, rng.choice(["text", "image"]), rng.choice("ab cd ef gh".split()) * rng.randrange(1, 5), rng.randrange(100) / 100, x, y, x + rng.randrange(5, 120), y + rng.randrange(5, 40)))
    return out


@pytest.mark.parametrize("gap,groups", [(50, 1), (51, 2)])
def test_region_gap_is_inclusive(spark, gap, groups):
    df = elements(spark, [text(1, 0, 0, 10, 20), text(2, 0, 20 + gap, 10, 90 + gap)])
    assert grouping.region_groups(df).agg({"group_id": "max"}).first()[0] == groups


def test_region_groups_keep_a_tall_box(spark):
    df = elements(spark, [text(1, 0, 0, 10, 500), text(2, 0, 10, 10, 20), text(3, 0, 540, 10, 550)])
    assert {r.group_id for r in grouping.region_groups(df).collect()} == {1}


def test_lines_compare_with_the_element_before(spark):
    df = elements(spark, [text(1, 0, 0, 10, 500, "tall"), text(2, 0, 10, 10, 20, "b"), text(3, 0, 36, 10, 40, "c"), text(4, 0, 55, 10, 60, "d")])
    lines = grouping.lines(grouping.column_clusters(grouping.region_groups(df)))
    assert sorted((r.line_id, r.text) for r in lines.collect()) == [(1, "tall b"), (2, "c d")]


@pytest.mark.parametrize("offset,columns", [(100, 1), (101, 2)])
def test_column_offset_is_inclusive(spark, offset, columns):
    df = elements(spark, [text(1, 0, 0, 10, 10), text(2, offset, 0, offset + 10, 10)])
    assert grouping.column_clusters(grouping.region_groups(df)).agg({"column_id": "max"}).first()[0] == columns


def test_columns_follow_the_running_mean(spark):
    rng = random.Random(5)
    rows = [text(i, rng.randrange(1500), 0, 2000, 10, image=i % 4) for i in range(200)]
    got = {r.element_id: r.column_id for r in grouping.column_clusters(grouping.region_groups(elements(spark, rows))).collect()}
    for image in range(4):
        own = sorted((r[5], r[1]) for r in rows if r[0] == image)
        number, current = 1, []
        for left, i in own:
            if current and abs(left - sum(current) / len(current)) > 100:
                number, current = number + 1, []
            current.append(left)
            assert got[i] == number


@pytest.mark.parametrize("gap,merged", [(49, 1), (50, 2)])
def test_columns_merge_below_the_gap(spark, gap, merged):
    df = elements(spark, [text(1, 0, 0, 200, 10), text(2, 200 + gap, 0, 600, 10)])
    lines = grouping.lines(grouping.column_clusters(grouping.region_groups(df)))
    assert grouping.merged_columns(lines).agg({"merged_id": "max"}).first()[0] == merged


def test_paragraphs_begin_at_short_rows_and_colons(spark):
    rows = [(1, 1, 1, "one two three four five six"), (1, 1, 2, "a b c d e"), (1, 1, 3, "x y z w"), (1, 1, 4, "p q r s t u"), (1, 1, 5, "k l m n o p:")]
    df = spark.createDataFrame(rows, "image_id long, group_id long, row_id long, text string")
    got = [r.text for r in grouping.paragraphs(df).orderBy("para_no").collect()]
    assert got == ["one two three four five six a b c d e", "x y z w p q r s t u", "k l m n o p:"]


def test_nothing_in_nothing_out(spark):
    none = elements(spark, [])
    assert grouping.paragraphs(grouping.rows(grouping.merged_columns(grouping.lines(grouping.column_clusters(grouping.region_groups(none)))))).count() == 0
    assert clusters.in_blocks(none).count() == clusters.in_regions(none).count() == 0
    assert leaders.object_clusters(none).count() == 0
    assert textmerge.merged_texts(none, ["image_id"]).count() == 0
    assert duplicates.without_duplicate_texts(none).count() == 0


def model_connected(a, b, min_x, min_y):
    (l1, t1, r1, b1), (l2, t2, r2, b2) = a[5:9], b[5:9]
    whole = (max(r1, r2) - min(l1, l2)) * (max(b1, b2) - min(t1, t2))
    dense = ((r1 - l1) * (b1 - t1) + (r2 - l2) * (b2 - t2)) / whole if whole > 0 else 0
    x = max(0, min(r1, r2) - max(l1, l2)) / min(r1 - l1, r2 - l2)
    y = max(0, min(b1, b2) - max(t1, t2)) / min(b1 - t1, b2 - t2)
    return dense >= 0.15 and (y >= min_y or x >= min_x)


def test_clusters_equal_a_search(spark):
    rows = boxes(3, 150)
    got = {r.element_id: r.cluster_id for r in clusters.box_clusters(elements(spark, rows), 0.2, 0.1).collect()}
    left = {r[1]: r for r in rows}
    while left:
        first = min(left)
        queue, seen = [left.pop(first)], {first}
        while queue:
            a = queue.pop()
            for b in [b for b in left.values() if b[0] == a[0] and model_connected(a, b, 0.2, 0.1)]:
                seen.add(b[1])
                queue.append(left.pop(b[1]))
        assert {i for i, c in got.items() if c == first} == seen


def test_labels_of_pages_equal_plain_pairs(monkeypatch):
    """Components of many pages in parts of few pairs, with boxes without area and equal ones."""
    import numpy as np

    monkeypatch.setattr(clusters, "PAIRS", 37)
    rng = np.random.default_rng(5)
    n = 400
    page = np.sort(rng.integers(0, 9, n))
    left, top = rng.integers(-50, 300, n), rng.integers(-500, 900, n)
    boxed = (left, top, left + rng.integers(0, 120, n), top + rng.integers(0, 60, n) * rng.integers(0, 2, n))

    def plain(near):
        label = list(range(n))
        for a in range(n):
            for b in range(a + 1, n):
                if page[a] == page[b] and near(np.array([a]), np.array([b]))[0] and label[a] != label[b]:
                    low, high = sorted((label[a], label[b]))
                    label = [low if x == high else x for x in label]
        return label

    for ratios in (clusters.STRICT, clusters.LOOSE, (0.0, 0.0)):
        assert clusters._connected_labels(page, boxed, *ratios).tolist() == plain(lambda a, b: clusters.connected(boxed, a, b, *ratios))
    assert clusters.labels(page, boxed, lambda a, b: clusters.within(boxed, a, b, 30), boxed[3] - boxed[1] + 30).tolist() == plain(lambda a, b: clusters.within(boxed, a, b, 30))


def test_regions_in_one_pass_equal_the_steps(spark, monkeypatch):
    rows = boxes(6, 200)
    df = elements(spark, rows)
    regions = {m: (r.image_id, r.region_no) for r in clusters.merge_adjacent(clusters.union_boxes(clusters.in_blocks(df), "image_id", "block_id").withColumnRenamed("block_id", "cluster_id")).collect() for m in [(r.image_id, x) for x in r.members]}
    blocks = {r.element_id: (r.image_id, r.block_id) for r in clusters.in_blocks(df).collect()}
    got = {r.element_id: (r.image_id, r.region_no) for r in clusters.in_regions(df).collect()}
    assert got == {e: regions[b] for e, b in blocks.items()} and len(got) == 200


def test_adjacent_regions_take_one_exchange_and_no_group_a_page(spark):
    """Many small pages, one without a number, and an empty table: the regions of the single steps, without a Python call for each page."""
    rows = boxes(8, 900, images=60)
    df = elements(spark, [(None if r[0] == 7 else r[0] - 5, *r[1:]) for r in rows])
    made = layout.build_regions(df)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "FlatMapGroups" not in plan
    steps = clusters.merge_adjacent(clusters.union_boxes(clusters.in_blocks(df), "image_id", "block_id").withColumnRenamed("block_id", "cluster_id"))
    got, want = (sorted(map(repr, rows.collect())) for rows in (made, steps))
    assert got == want and len({r.image_id for r in made.collect()}) == 60
    assert sum(r.n_elements for r in made.collect()) == 900 and any(len(r.members) > 1 for r in made.collect())
    assert layout.build_regions(df.limit(0)).count() == 0


def test_far_boxes_connect_by_density_alone(spark):
    df = elements(spark, [text(1, 0, 0, 400, 100), text(2, 900, 0, 1300, 100)])
    assert pairs.box_pairs(df, g.connected(0.2, 0.1)).count() == 1


def test_linewise_order_equals_first_fit(spark):
    rows = [(1, *r[1:]) for r in boxes(4, 60)]
    one = elements(spark, rows).selectExpr("*", "0L as cluster_id")
    got = [r.element_id for r in clusters.linewise_order(one).orderBy("line_no", "place").collect()]
    lines = []
    for r in sorted(rows, key=lambda r: (r[6], r[1])):
        centre = (r[6] + r[8]) / 2
        for line in lines:
            if abs(centre - sum(c for c, _ in line) / len(line)) <= 10:
                line.append((centre, r))
                break
        else:
            lines.append([(centre, r)])
    assert got == [r[1] for line in lines for _, r in sorted(line, key=lambda m: (m[1][5], m[1][6], m[1][1]))]


def test_wide_overlapping_regions_stay_apart(spark):
    schema = "image_id long, cluster_id long, left_x long, top_y long, right_x long, bottom_y long, n_elements long"
    df = spark.createDataFrame([(1, 1, 0, 0, 1000, 100, 1), (1, 2, 0, 110, 1000, 200, 1)], schema)
    assert clusters.merge_adjacent(df).count() == 2
    narrow = spark.createDataFrame([(1, 1, 0, 0, 150, 100, 1), (1, 2, 0, 110, 150, 200, 2), (1, 3, 0, 230, 150, 300, 1)], schema)
    assert [(r.members, r.n_elements) for r in clusters.merge_adjacent(narrow).collect()] == [([1, 2, 3], 4)]


def test_iou_at_the_threshold_stays(spark):
    # 60 of 200 units: exactly 0.3.
    rows = [(1, 1, "image", None, 0.9, 0, 0, 13, 10), (1, 2, "image", None, 0.8, 7, 0, 20, 10)]
    assert leaders.without_overlaps(elements(spark, rows)).count() == 2
    rows[1] = (1, 2, "image", None, 0.8, 6, 0, 20, 10)
    assert [r.element_id for r in leaders.without_overlaps(elements(spark, rows)).collect()] == [1]


def test_containment_on_a_crowded_page(spark):
    """30,000 boxes of one page, from points to the whole page, a third of them equal, against a scan of those around each."""
    rng = random.Random(12)
    rows = []
    for i in range(20_000):
        size = 2 ** rng.randrange(0, 8)
        x, y = rng.randrange(-5000, 60_000), rng.randrange(60_000)
        rows.append((1, i, "image", None, 0.5, x, y, x + rng.randrange(size), y + rng.randrange(size)))
    rows += [(1, 20_000 + i, "image", None, 0.5, 70_000, 70_000, 70_010, 70_010) for i in range(10_000)]
    rows += [(1, 40_000, "image", None, 0.5, -5000, 0, 100_000, 100_000), (2, 1, "image", None, 0.5, 5, 5, 5, 5)]
    got = {(r.image_id, r.element_id): r.seed_id for r in leaders.contained_groups(elements(spark, [r for r in rows if r[1] < 20_500 or r[1] == 40_000])).collect()}
    assert got[2, 1] == 1 and {v for k, v in got.items() if k[0] == 1} == {40_000}
    small = [r for r in rows if r[1] < 20_000]
    got = {(r.a_id, r.b_id) for r in pairs.containing_pairs(elements(spark, small), elements(spark, small), "a.element_id <> b.element_id and " + g.contained(), "a.element_id as a_id", "b.element_id as b_id").collect()}
    near = {}
    for r in small:
        near.setdefault((r[5] // 128, r[6] // 128), []).append(r)
    want = {
        (a[1], b[1]) for a in small for dx in (0, -1) for dy in (0, -1) for b in near.get((a[5] // 128 + dx, a[6] // 128 + dy), ())
        if a[1] != b[1] and a[5] >= b[5] and a[7] <= b[7] and a[6] >= b[6] and a[8] <= b[8]
    }
    assert got == want and want


def continues(a, b):
    wa, wb = a.split(), b.split()
    return any(len(wa) >= n and b.startswith(" ".join(wa[-n:])) or len(wb) >= n and a.endswith(" ".join(wb[:n])) for n in (1, 2, 3))


def test_continuation_equals_all_pairs(spark):
    """Parts of words, several spaces, blank and null texts, words longer than what texts meet by."""
    rng = random.Random(5)
    words = ["a", "ab", "b", "ba", "aab", "x" * 40, "x" * 40 + "y", "x" * 33, "y" + "x" * 40, "\u00e9"]
    texts = ["".join(rng.choice(["", " ", ""]) + rng.choice(words) + rng.choice([" ", " ", "  ", ""]) for _ in range(rng.randrange(5))) for _ in range(400)] + ["", " ", None]
    rows = [(1 + i % 2, i, "text", t, 0.9, 0, 0, 1, 1) for i, t in enumerate(texts)]
    got = sorted((r.a_id, r.b_id) for r in textmerge.continuation_pairs(elements(spark, rows)).collect())
    known = [(r[0], r[1], r[3]) for r in rows if r[3] is not None]
    assert got == sorted((i, j) for p, i, a in known for q, j, b in known if p == q and i != j and continues(a, b))


def test_continuation_on_a_crowded_page(spark):
    """40,000 texts of one page, each continued by one other."""
    df = spark.range(40_000).selectExpr("1L as image_id", "id as element_id", "'text' as type", "concat('w', id * 7, 'q some words of the ', id, ' text w', (id + 1) * 7, 'q') as text")
    got = textmerge.continuation_pairs(df)
    assert got.where("b_id = a_id + 1").count() == got.count() == 39_999


def test_contained_boxes_go_to_the_first_seed(spark):
    rows = boxes(8, 120)
    got = {r.element_id: r.seed_id for r in leaders.contained_groups(elements(spark, rows)).collect()}
    inside = lambda a, b: a[5] >= b[5] and a[7] <= b[7] and a[6] >= b[6] and a[8] <= b[8]
    seeds = {}
    for r in sorted(rows, key=lambda r: (-(r[7] - r[5]) * (r[8] - r[6]), -r[4], r[1])):
        own = seeds.setdefault(r[0], [])
        seed = next((s for s in own if inside(r, s)), None)
        if seed is None:
            own.append(r)
        assert got[r[1]] == (seed or r)[1]


def test_duplicate_texts_equal_a_sequential_search(spark):
    rng = random.Random(2)
    words = ["invoice number", "invoice numbers", "total", "totals due", "date", "page one"]
    rows = [text(i, rng.randrange(300), rng.randrange(300), 0, 0, rng.choice(words), rng.randrange(100) / 100, i % 2) for i in range(60)]
    rows = [(*r[:7], r[5] + 50, r[6] + 12) for r in rows]
    got = sorted((r.seed_id, r.element_id, r.group_size) for r in duplicates.without_duplicate_texts(elements(spark, rows)).collect())

    def alike(a, b):
        inter = max(0, min(a[7], b[7]) - max(a[5], b[5])) * max(0, min(a[8], b[8]) - max(a[6], b[6]))
        return difflib.SequenceMatcher(None, a[3], b[3]).ratio() > 0.8 or inter / min((a[7] - a[5]) * (a[8] - a[6]), (b[7] - b[5]) * (b[8] - b[6])) > 0.5

    want = []
    for image in (0, 1):
        # In the order of recognition, which isn't that of places.
        rest = sorted((r for r in rows if r[0] == image), key=lambda r: r[1])
        while rest:
            seed = rest[0]
            group = [r for r in rest if r is seed or alike(seed, r)]
            rest = [r for r in rest if r not in group]
            want.append((seed[1], max(group, key=lambda r: r[4])[1], len(group)))
    assert got == sorted(want)


CASES = [
    ("Greek Yogurt", "Yogurt Maker", 10, 10, ["Greek Yogurt Maker"]),
    ("Hello", "Hello world", 10, 10, ["Hello"]),
    ("foobar", "bar baz", 10, 10, ["foobar"]),
    ("see a", "apple pie", 10, 10, ["see apple pie"]),
    ("A b", "C d", 10, 10, ["A b C d"]),
    ("abc", "xyz", 5, 5, ["xyz"]),
    ("abcd", "xyz", 5, 5, ["abcd"]),
    ("A b", "C d", 200, 200, ["A b", "C d"]),
    ("A b", "b c", 2000, 2000, ["A b c"]),
]


@pytest.mark.parametrize("first,second,dx,dy,want", CASES)
def test_text_merging(spark, first, second, dx, dy, want):
    df = elements(spark, [text(1, 0, 0, 20, 10, first), text(2, dx, dy, dx + 20, dy + 10, second)])
    got = textmerge.merged_texts(df, ["image_id"]).orderBy("item_no").collect()
    assert [r.text for r in got] == want
    if len(want) == 1:
        assert (got[0].left_x, got[0].top_y, got[0].right_x, got[0].bottom_y) == (0, 0, dx + 20, dy + 10)


def model_merge(rows):
    def continues(a, b):
        wa, wb = a.split(), b.split()
        return any(b.startswith(" ".join(wa[-n:])) for n in (1, 2, 3) if len(wa) >= n) or any(a.endswith(" ".join(wb[:n])) for n in (1, 2, 3) if len(wb) >= n)

    def splice(a, b):
        if b.startswith(a):
            return a
        overlaps = [" ".join(a.split()[-n:]) for n in (1, 2, 3) if len(a.split()) >= n]
        return next((a + b[len(o) :] for o in overlaps if b.startswith(o)), a)

    out, cur = [], None
    for _, _, _, words, sure, left, top, right, bottom in sorted(rows, key=lambda r: (r[6], r[5], r[1])):
        if cur is None:
            cur = [words, left, top, right, bottom]
            continue
        same = abs(cur[1] - left) <= 5 and abs(cur[2] - top) <= 5
        on = continues(cur[0], words)
        near = cur[3] >= left - 50 and cur[1] <= right + 50 and cur[4] >= top - 50 and cur[2] <= bottom + 50
        if same or on or near:
            new = (cur[0] if len(cur[0]) > len(words) else words) if same else splice(cur[0], words) if on else f"{cur[0]} {words}"
            cur = [new, min(cur[1], left), min(cur[2], top), max(cur[3], right), max(cur[4], bottom)]
        else:
            out.append(cur)
            cur = [words, left, top, right, bottom]
    return out + ([cur] if cur else [])


def test_text_merging_equals_a_sequential_model(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "a", "alp"]
    rows = [text(i, rng.randrange(900), rng.randrange(900), 0, 0, " ".join(rng.choices(words, k=rng.randrange(1, 4))), image=i % 12) for i in range(150)]
    rows = [(*r[:7], r[5] + 40, r[6] + 10) for r in rows]
    got = textmerge.merged_texts(elements(spark, rows), ["image_id"]).orderBy("image_id", "item_no").collect()
    want = [(image, *m) for image in range(12) for m in model_merge([r for r in rows if r[0] == image])]
    assert [(r.image_id, r.text, r.left_x, r.top_y, r.right_x, r.bottom_y) for r in got] == want


def test_recognition_filter_trims_unicode_space(spark):
    df = elements(spark, [text(1, 0, 0, 1, 1, "　a "), text(2, 0, 0, 1, 1, " 88 "), text(3, 0, 0, 1, 1, "ok", 0.2), text(4, 0, 0, 1, 1, "ok", 0.19)])
    assert sorted(r.element_id for r in recognition.recognised(df).collect()) == [2, 3]


def test_major_angles(spark):
    df = spark.createDataFrame([(1, 30, 50.0), (1, 33, 40.0), (1, -60, 45.0), (1, 80, 1.0), (2, 2, 1.0)], "image_id long, angle long, weight double")
    got = [(r.image_id, r.angle) for r in recognition.major_angles(df).orderBy("image_id", "place").collect()]
    assert got == [(1, 0), (1, 30), (1, -60), (1, 80), (2, 2)] or got == [(1, 0), (1, 30), (1, -60), (2, 2)]


def test_angle_clusters(spark):
    df = spark.createDataFrame([(1, i, float(a)) for i, a in enumerate([1, 2, 178, 91, 45, 46])], "image_id long, line_id long, angle double")
    got = [r.angle for r in recognition.angle_clusters(df).orderBy("place").collect()]
    assert got == [0.0, 180.0, 90.0, 45.5]


def test_providers_fail_or_give_null(spark):
    prompts = spark.createDataFrame([(1, "ok"), (2, "bad")], "k long, prompt string")

    def provider():
        def call(prompt):
            if prompt == "bad":
                raise ValueError(prompt)
            return '{"choices": [{"message": {"content": "seen"}}]}'

        return call

    answered = documents.answered(prompts, provider, "prompt", on_error="null")
    assert sorted((r.k, r.t) for r in answered.select("k", documents.response_text("response").alias("t")).collect()) == [(1, "seen"), (2, None)]
    with pytest.raises(Exception, match="bad"):
        documents.answered(prompts, provider, "prompt").collect()


def test_golden_shape(spark):
    boxes_ = [(98, 1472, 22, 1966), (1702, 2396, 20, 1947), (2501, 3249, 17, 1954), (3321, 3839, 18, 1964), (3892, 5684, 22, 1967), (5784, 6502, 16, 1940)]
    df = elements(spark, [text(i, left, top, right, bottom, f"region {i}") for i, (top, bottom, left, right) in enumerate(boxes_)])
    grouped = grouping.group_boxes(grouping.region_groups(df))
    assert sorted((r.top_y, r.bottom_y, r.left_x, r.right_x) for r in grouped.collect()) == boxes_
    told = grouped.selectExpr("image_id", "group_id", "'seen' as description")
    lines = grouping.lines(grouping.column_clusters(grouping.region_groups(df)))
    made = documents.vision_documents(grouped, told, grouping.paragraphs(grouping.rows(grouping.merged_columns(lines)))).first()
    assert made.total_regions == len(made.regions) == 6
    assert [r.text_content.merged_paragraphs for r in made.regions] == [[f"region {i}"] for i in range(6)]
    assert all(r.text_content.columns == [] for r in made.regions)
