"""Pages assembled from a stream that splits them over batches: against the batch result, with restarts, late, repeated and corrected elements."""

import datetime

import pytest
from pyspark.sql import functions as F

from foliospark.plans import layout, registry
from foliospark.streaming import pages

START = datetime.datetime(2024, 5, 1)
SCHEMA = "image_id long, element_id long, type string, text string, confidence double, left_x long, top_y long, right_x long, bottom_y long, n long, at timestamp"


def element(page, i, second, text=None, n=None):
    return (page, i, "text", text or f"word{i} on page {page}", 0.5, 10, 30 * i, 200, 30 * i + 20, n, START + datetime.timedelta(seconds=second))


class Feed:
    """A folder of element files that one query after another reads, each from where the last one stopped."""

    def __init__(self, spark, root, **options):
        self.spark, self.root, self.options, self.n = spark, root, options, 0

    def arrive(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.json(f"{self.root}/in/{self.n:03}")

    def run(self, layout_=layout.paragraphs, per_batch=1):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").json(f"{self.root}/in")
        closed = pages.assembled(stream, "at", "n", patience_ms=10_000, **self.options)
        query = pages.write_pages(closed, f"{self.root}/out", f"{self.root}/state", layout_)
        query.awaitTermination()
        return query

    def versions(self):
        return {r.image_id: r.version for r in self.spark.read.parquet(f"{self.root}/out/pages").groupBy("image_id").agg(F.max("version").alias("version")).collect()}

    def texts(self):
        return {(r.image_id, r.element_id): r.text for r in pages.current(self.spark, f"{self.root}/out").collect()}


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, str(tmp_path))


def as_they_are(rows):
    return rows.select("image_id", "element_id", "text")


def test_split_pages_equal_whole_ones_and_restarts_go_on(spark, feed):
    source = registry.events(spark, "/root/testdata/sf0.001").where("image_id < 40").limit(400).collect()
    number = {}
    for r in source:
        number[r.image_id] = number.get(r.image_id, 0) + 1
    rows = [(*r, number[r.image_id] if r.element_id % 3 == 0 or number[r.image_id] < 3 else None, START) for r in source]
    # Each page's elements are dealt over the files; one page in three isn't announced by some of its rows.
    parts = [[r for r in rows if r[1] % 5 == k] for k in range(5)]
    feed.arrive(*parts[0])
    feed.arrive(*parts[1])
    feed.run()
    # A restart: the same query from its checkpoint, over files that have come since.
    for part in parts[2:]:
        feed.arrive(*part)
    # What closes those that no row has announced: the time goes on.
    feed.arrive(element(-1, 1, 3600, n=1))
    feed.run(per_batch=2)
    want = layout.paragraphs(spark.createDataFrame(source))
    got = pages.current(spark, f"{feed.root}/out").where("image_id >= 0")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert feed.versions() == dict.fromkeys([*number, -1], 1)


def test_announced_pages_close_at_once_and_others_by_the_watermark(feed):
    feed.arrive(element(1, 1, 0, n=2), element(2, 1, 0), element(2, 2, 1))
    feed.run(as_they_are)
    assert feed.versions() == {}
    feed.arrive(element(1, 2, 1), element(3, 1, 5))
    feed.run(as_they_are)
    assert feed.versions() == {1: 1}
    feed.arrive(element(4, 1, 13))
    feed.run(as_they_are)
    # Page 2 was quiet for more than 10 seconds, page 3 for 8.
    assert feed.versions() == {1: 1, 2: 1}
    assert feed.texts() == {(1, 1): "word1 on page 1", (1, 2): "word2 on page 1", (2, 1): "word1 on page 2", (2, 2): "word2 on page 2"}


def test_late_elements_reopen_a_page(feed):
    feed.arrive(element(1, 1, 0, n=1), element(2, 1, 0))
    feed.arrive(element(9, 1, 100, n=1))
    feed.run(as_they_are)
    assert feed.versions() == {1: 1, 2: 1, 9: 1}
    # Long before the watermark, yet not dropped; then the same again, which changes nothing; then a correction.
    feed.arrive(element(1, 2, 1), element(2, 2, 1))
    feed.run(as_they_are)
    assert feed.versions() == {1: 2, 2: 2, 9: 1}
    feed.arrive(element(1, 2, 2), element(2, 2, 2))
    feed.run(as_they_are)
    assert feed.versions() == {1: 2, 2: 2, 9: 1}
    feed.arrive(element(2, 1, 3, "corrected"), element(9, 2, 200))
    feed.run(as_they_are)
    assert feed.versions() == {1: 2, 2: 3, 9: 2}
    assert feed.texts()[2, 1] == "corrected" and feed.texts()[2, 2] == "word2 on page 2" and feed.texts()[1, 2] == "word2 on page 1"


def test_odd_rows_of_a_stream(feed):
    none = (1, None, None, None, None, None, None, None, None, 1, None)
    feed.arrive((None, 1, "text", None, None, None, None, None, None, 1, START), none, element(1, 1, 0), (3, 5, None, "é\x00", None, 0, 0, 0, 0, 0, START))
    feed.arrive(element(8, 1, 100, n=1))
    feed.run(as_they_are)
    assert feed.texts() == {(None, 1): None, (1, 1): "word1 on page 1", (3, 5): "é\x00", (8, 1): "word1 on page 8"}
    feed.run(as_they_are)
    assert set(feed.versions().values()) == {1}


def test_a_batch_that_runs_again_counts_once(spark, feed, tmp_path):
    closed = spark.createDataFrame([(1, 1, *element(1, 1, 0)[1:9]), (1, 2, *element(1, 1, 0, "new")[1:9])], pages.PAGES)
    last = closed.groupBy("image_id").agg(F.max("version").alias("version"))
    assert [r.text for r in pages._latest(closed, last).collect()] == ["new"]


class Held:
    """State of one page in memory that counts calls."""

    def __init__(self):
        self.calls, self.rows, self.row, self.timers = 0, [], None, []

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        held = self

        class Value:
            def get(self):
                held.calls += 1
                return held.row

            def update(self, row):
                held.calls += 1
                held.row = row

            def exists(self):
                return held.row is not None

        return Value()

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def appendValue(self, row):
        self.calls += 1
        self.rows.append(row)

    def registerTimer(self, time):
        self.calls += 1
        self.timers.append(time)

    def deleteTimer(self, time):
        self.calls += 1
        self.timers.remove(time)


def test_calls_to_state_go_by_batches_not_by_elements():
    held = Held()
    page = pages._Assembly(10_000, None)
    page.init(held)

    def arrive(ids, announced=None, mark=""):
        return list(page.handleInputRows((1,), iter([(1, i, announced, 5, f"{i}{mark}") for i in ids]), None))

    assert arrive(range(5000)) == [] and held.calls <= 5
    # The same again and again: what is held stays bounded.
    for _ in range(50):
        assert arrive(range(5000)) == []
    assert sum(len(ids) for ids, _ in held.rows) <= 2 * 5000 + pages.LOOSE
    assert arrive(range(4000, 8999), 9000) == []
    (closed,) = arrive([8999])
    assert closed.version == 1 and sorted(closed.element_id) == list(range(9000)) and held.timers == []
    # Nothing new, then corrections one by one, each of which closes the page again.
    assert arrive(range(100)) == []
    for k in range(40):
        (closed,) = arrive([k], mark="new")
        assert closed.version == k + 2 and dict(zip(closed.element_id, closed.value))[k] == f"{k}new" and len(closed.element_id) == 9000
    assert len(held.rows) <= pages.PARTS + 1


def test_a_page_that_comes_one_by_one_is_seldom_read():
    held = Held()
    page = pages._Assembly(10_000, None)
    page.init(held)
    for i in range(4000):
        assert list(page.handleInputRows((1,), iter([(1, i, None, 5, str(i))]), None)) == []
    assert held.calls <= 3 * 4000 + 20
    (closed,) = page.handleExpiredTimer((1,), None, None)
    assert closed.version == 1 and closed.element_id == list(range(4000)) and closed.value == [str(i) for i in range(4000)]
