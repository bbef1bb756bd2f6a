"""Pages whose elements arrive apart: gathered in state, closed when complete, and closed again when late elements reopen them.

A page's elements are held by element_id, so an element that arrives again changes nothing and a corrected one takes the place of the
former. A page is closed

* as soon as it has as many elements as a row of it has announced, or
* when the watermark is ``patience`` beyond the latest time of its elements.

A closed page is handed on whole, with a version that counts its closings. Its state stays, so what arrives later, however late, reopens it: it closes
again by the same rules, with the next version. ``keep`` bounds how long the elements of a quiet page are held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..plans.layout import paragraphs

_VALUE_TYPE = "type string, text string, confidence double, left_x long, top_y long, right_x long, bottom_y long"
PAGES = f"image_id long, version int, element_id long, {_VALUE_TYPE}"
#: Elements by their ids, each one's values as JSON: state and Python only compare and keep them.
_ARRAYS = "element_id array<long>, value array<string>"
#: Parts of a page after which a page that is read is put together, and rows of parts that may be there beyond twice the elements.
PARTS, LOOSE = 16, 1000
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Assembly(StatefulProcessor):
    """parts: what batches brought of a page, one row of arrays each, a later one before an earlier one; page: the announced number or -1, the number
    it had when parts were last read, the rows of parts, the version, the time of the timer or 0.

    A call to the state costs about as much as a hundred elements, so a batch makes a few of them for each page, however many elements it has. parts are
    read only where it matters what is in them: when the page can be complete, when it was closed, or when repeated elements may have doubled them.
    """

    def __init__(self, patience_ms: int, keep_ms: int | None):
        self.patience_ms, self.keep_ms = patience_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", _ARRAYS, self.keep_ms)
        self.page = handle.getValueState("page", "announced long, has long, stored long, version int, timer long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        announced, has, stored, version, timer = self.page.get() or (-1, 0, 0, 0, 0)
        new: dict[int, str] = {}
        latest = 0
        for _, element_id, told, at_ms, value in rows:
            announced = announced if told is None else max(announced, told)
            latest = max(latest, at_ms)
            if value is not None:
                new[element_id] = value
        held, changed = None, bool(new)
        if (new and stored and not timer) or ((new or timer) and stored + len(new) >= announced >= 0) or stored + len(new) > 2 * has + LOOSE:
            held, parts = self.held() if stored else ({}, 0)
            new = {i: value for i, value in new.items() if held.get(i) != value}
            changed = bool(new)
            held |= new
            has = len(held)
            if parts >= PARTS or stored + len(new) > 2 * has:
                self.parts.put([_arrays(held)])
                new, stored = {}, has
        if new:
            self.parts.appendValue(_arrays(new))
            stored += len(new)
        # Nothing new, but the number that a page waited for.
        waiting = changed or timer > 0
        closes = waiting and held is not None and has >= announced >= 0
        due = 0 if closes else max(timer, latest + self.patience_ms) if waiting else timer
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        self.page.update((announced, has, stored, version + closes, due))
        if closes:
            yield _handed_on(key, version + 1, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.page.exists():
            announced, _, stored, version, _ = self.page.get()
            held, _ = self.held()
            self.page.update((announced, len(held), stored, version + 1, 0))
            yield _handed_on(key, version + 1, held)

    def held(self) -> tuple[dict[int, str], int]:
        """The page's elements, and the number of parts that they are in."""
        held, n = {}, 0
        for part in self.parts.get():
            n += 1
            held.update(zip(*part))
        return held, n

    def close(self) -> None:
        pass


def _arrays(elements: dict[int, str]) -> tuple[list[int], list[str]]:
    """_ARRAYS of elements by their id."""
    return list(elements), list(elements.values())


def _handed_on(key, version: int, held: dict[int, str]) -> Row:
    return Row(image_id=key[0], version=version, element_id=list(held), value=list(held.values()))


def assembled(elements: DataFrame, time: str, announced: str | None = None, delay: str = "0 seconds", patience_ms: int = 60_000, keep_ms: int | None = None) -> DataFrame:
    """PAGES: the elements of each page whenever it closes, as a stream, from a stream of elements in any order.

    time: a column that tells when an element was seen; the watermark is its greatest value less delay. Elements that are older than the watermark
    aren't dropped. announced: a column with the number of a page's elements, null where it isn't known; the greatest counts, and one row of a
    page that has it is enough. Rows with a null element_id hold no element, but can announce a number. Rows of one element in
    one batch and page: the last counts. A null image_id is a page like others; a null time is the oldest.
    """
    spark = elements.sparkSession
    # State with timers and maps is only kept by this store.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    known = F.col(announced).cast("long") if announced else F.lit(None).cast("long")
    seen = F.coalesce(F.unix_millis(F.col(time).cast("timestamp")), F.lit(0))
    fields = StructType.fromDDL(_VALUE_TYPE)
    # Not a number counts as null.
    values = [F.nullif(F.col(f.name).cast(f.dataType), F.lit(float("nan"))) if f.name == "confidence" else F.col(f.name).cast(f.dataType) for f in fields]
    value = F.to_json(F.struct(*(v.alias(f.name) for v, f in zip(values, fields))))
    # The time goes on as a plain number: a column under a watermark would have late rows dropped.
    number = F.col("element_id").cast("long")
    rows = elements.withWatermark(time, delay).select(
        F.col("image_id").cast("long").alias("image_id"), number.alias("element_id"), known.alias("announced"), seen.alias("at_ms"), F.when(number.isNotNull(), value).alias("value")
    )
    closed = rows.groupBy("image_id").transformWithState(_Assembly(patience_ms, keep_ms), f"image_id long, version int, {_ARRAYS}", "Update", "EventTime")
    found = closed.select("image_id", "version", F.explode(F.arrays_zip("element_id", "value")).alias("e"))
    return found.select("image_id", "version", "e.element_id", F.from_json("e.value", fields).alias("v")).select("image_id", "version", "element_id", "v.*")


def write_pages(pages: DataFrame, path: str, checkpoint: str, layout: Callable[[DataFrame], DataFrame] = paragraphs, **trigger: object) -> StreamingQuery:
    """Writes what layout makes of the pages (of assembled()) that each micro-batch closes, and which versions of which pages these are.

    layout gets the elements of closed pages and gives rows with image_id. Both go to folders of the batch's number, in place of what an earlier run of the same batch left there: after a restart each batch counts
    once. current() reads the latest version of each page.
    """

    def append(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            last = held.groupBy("image_id").agg(F.max("version").alias("version"))
            # A page can close twice in one batch; its last closing counts.
            made = layout(_latest(held, last).drop("version"))
            _versioned(made, last).write.mode("overwrite").parquet(f"{path}/layout/batch={number}")
            last.write.mode("overwrite").parquet(f"{path}/pages/batch={number}")
        finally:
            held.unpersist()

    writer = pages.writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _latest(rows: DataFrame, last: DataFrame) -> DataFrame:
    """The rows of each page's last version."""
    keys = last.select(F.col("image_id").alias("_page"), F.col("version").alias("_version"))
    return rows.join(keys, F.col("image_id").eqNullSafe(F.col("_page")) & (F.col("version") == F.col("_version")), "left_semi")


def _versioned(rows: DataFrame, last: DataFrame) -> DataFrame:
    keys = last.select(F.col("image_id").alias("_page"), "version")
    return rows.join(keys, F.col("image_id").eqNullSafe(F.col("_page"))).drop("_page")


def current(spark: SparkSession, path: str) -> DataFrame:
    """What layout made of the latest version of each page that write_pages() has written there."""
    last = spark.read.parquet(f"{path}/pages").groupBy("image_id").agg(F.max("version").alias("version"))
    return _latest(spark.read.parquet(f"{path}/layout").drop("batch"), last).drop("version")
