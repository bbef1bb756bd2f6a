"""Tolerant as-of join: each ask is matched to the latest order of its key at or before its time, within a tolerance.

1. Orders of one key and time are one row: the preferred of them and their number. Tied orders thus never lie on both sides of a bound.
2. Asks and orders together are dealt by ranges of key and time (orders before asks of the same time), whatever the key: one that has
   a third of all rows covers as many ranges as its rows need, and ids split asks of one key and time.
3. Each range is scanned once, in order, row batch by row batch, with the last order met carried along. Asks before the range's first order stay
   open; the range's last order is its summary.
4. A prefix scan over the summaries tells each range the last order before it. It goes by blocks of FAN summaries, and over
   the blocks' own last orders in the same way, so that no task has more than FAN rows however many ranges there are.
5. The open asks of each range are matched to what is carried in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from .common import Scratch, cut

#: Summaries that a task of the prefix scan orders, at most.
FAN = 1024
#: Fixed values of the click match: times are floored to this many microseconds, and matches are at most so old.
FLOOR_US, TOLERANCE_US = 6 * 3_600_000_000, 720 * 3_600_000_000


def carried_in(ends: DataFrame, ranges: int, fan: int = FAN) -> DataFrame:
    """part, carried: the last value that isn't null of all ranges before each, of ends (part from 0 to below ranges, last)."""
    before = lambda w: F.last("last", ignorenulls=True).over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    if ranges <= fan:
        return ends.select("part", before(Window.partitionBy(F.lit(0))).alias("carried"))
    block = F.expr(f"part div {fan}").alias("block")
    blocks = ends.groupBy(block).agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("part"))).alias("last"))
    above = carried_in(blocks.withColumnRenamed("block", "part"), -(-ranges // fan), fan)
    within = ends.select("part", block, before(Window.partitionBy(block)).alias("own"))
    return within.join(above.withColumnsRenamed({"part": "block", "carried": "above"}), "block").select("part", F.coalesce("own", "above").alias("carried"))


def as_of(asks: DataFrame, orders: DataFrame, by: str, at: str, id_: str, best: list[str], tolerance: int, fan: int = FAN) -> DataFrame:
    """id, by, at of each ask, lag, the best columns and n_tied of its match; all columns are longs.

    asks has the columns id, by and at; orders has by, at and the best columns. The match is the latest order with the ask's key
    at or before the ask's time, and at most tolerance earlier; of equal times the one whose best columns are largest, the first deciding
    first, null being least. n_tied counts all orders of that key and time. Asks without a match, or with a null key
    or time, have n_tied 0 and null for the rest; orders with a null key or time match nothing. Rows with equal or null ids
    are asks of their own. Empty tables give an empty result, or asks without matches. Other columns are ignored.
    """
    asks = asks.select(*(F.col(c).cast("long").alias(n) for c, n in ((id_, "id"), (by, "key"), (at, "at"))))
    orders = orders.select(F.col(by).cast("long").alias("key"), F.col(at).cast("long").alias("at"), *(F.col(c).cast("long").alias(f"best{i}") for i, c in enumerate(best)))
    bests = [f"best{i}" for i in range(len(best))]
    placed = F.col("key").isNotNull() & F.col("at").isNotNull()
    known = orders.where(placed).groupBy("key", "at").agg(F.max(F.struct(*bests)).alias("x"), F.count("*").alias("n_tied")).select("key", "at", "x.*", "n_tied")
    order = ["key", "at", "turn", "id"]
    both = known.withColumn("turn", F.lit(0)).unionByName(asks.where(placed).withColumn("turn", F.lit(1)), allowMissingColumns=True)
    both = both.select(*order, *bests, "n_tied").repartitionByRange(*order).sortWithinPartitions(*order)
    carried = ["order_key", "order_at", *bests, "n_tied"]
    names = ["part", "open", "id", "key", "at", *carried]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            is_order = batch.column("turn").to_numpy() == 0
            # The number of orders up to each row; 0: only what earlier batches met.
            latest = np.cumsum(is_order)
            own = batch.select(["key", "at", *bests, "n_tied"]).filter(pa.array(is_order))
            held = pa.table(own.columns, names=carried)
            first = pa.table([pa.array([None if last is None else last[c]], pa.int64()) for c in carried], names=carried)
            held = pa.concat_tables([first, held]).combine_chunks()
            asked = np.flatnonzero(~is_order)
            found = held.take(pa.array(latest[asked]))
            rows = batch.select(["id", "key", "at"]).take(pa.array(asked))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(asked), part)), pa.array((latest[asked] == 0) & (last is None)), *rows.columns, *(found.column(c).combine_chunks() for c in carried)], names
            )
            if latest[-1:].any():
                last = {c: held.column(c)[-1].as_py() for c in carried}
        # The summary: no ask, its last order or none.
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.nulls(1, pa.bool_()), none, none, none, *(pa.array([last and last[c]], pa.int64()) for c in carried)], names)

    schema = ", ".join(f"{n} {'boolean' if n == 'open' else 'long'}" for n in names)
    with Scratch(asks.sparkSession) as scratch:
        scanned = scratch.keep(both.mapInArrow(scan, schema))
        value = F.when(F.col("order_key").isNotNull(), F.struct(*carried))
        ends = scanned.where("open is null").select("part", value.alias("last"))
        ranges = (ends.agg(F.max("part")).first()[0] or 0) + 1
        rest = scanned.where("open").select("part", "id", "key", "at").join(carried_in(ends, ranges, fan), "part", "left")
        matched = scanned.where("not open").select("id", "key", "at", *carried).unionByName(rest.select("id", "key", "at", "carried.*"))
        ok = (F.col("order_key") == F.col("key")) & (F.col("at") - F.col("order_at") <= tolerance)
        shown = lambda c: F.when(ok, c)
        columns = [shown(F.col("at") - F.col("order_at")).alias("lag"), *(shown(F.col(b)).alias(c) for b, c in zip(bests, best)), F.coalesce(shown(F.col("n_tied")), F.lit(0).cast("long")).alias("n_tied")]
        out = [F.col("id").alias(id_), F.col("key").alias(by), F.col("at").alias(at)]
        none = [F.lit(None).cast("long").alias("lag"), *(F.lit(None).cast("long").alias(c) for c in best), F.lit(0).cast("long").alias("n_tied")]
        return cut(matched.select(*out, *columns).union(asks.where(~placed).select(*out, *none)))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time; one without a zone counts as UTC, whatever the session's zone is."""
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.expr(f"(`{name}` - timestamp_ntz'1970-01-01 00:00:00') div interval '0.000001' second")
    return F.unix_micros(F.col(name))


def _used(time: Column, id_: Column) -> Column:
    """The time, floored where the id's check sum is odd."""
    return F.when(F.crc32(id_.cast("string")) % 2 == 1, time - F.pmod(time, F.lit(FLOOR_US))).otherwise(time)


def click_orders(clicks: DataFrame, sales: DataFrame, tolerance_us: int = TOLERANCE_US) -> DataFrame:
    """click_id, client_id, ts_us, sale_id, lag_us, total_cents, n_tied of each click and its latest order.

    Copies of a click count once (should they differ, the one with the greatest client_id, then the latest ts; null is least); rows with a null
    click_id are clicks of their own, their times not floored. Each sale is an order; where the check sum of its id isn't divisible by 3
    a second order with the id -1 - sale_id equals it. A null sale_id is one order, its time not floored. Totals that are null or not finite have
    null cents. Other columns are ignored; see as_of() for null keys and times, ties and empty tables.
    """
    id_, client = F.col("click_id").cast("long"), F.col("client_id").cast("long")
    rows = clicks.select(id_.alias("click_id"), client.alias("client_id"), micros(clicks, "ts").alias("ts_us"))
    once = rows.where("click_id is not null").groupBy("click_id").agg(F.max(F.struct("client_id", "ts_us")).alias("x")).select("click_id", "x.*")
    asks = once.unionByName(rows.where("click_id is null")).withColumn("ts_us", _used(F.col("ts_us"), F.col("click_id")))
    sale, total = F.col("sale_id").cast("long"), F.col("total").cast("double")
    finite = ~F.isnan(total) & (F.abs(total) < F.lit(float("inf")))
    sold = sales.select(
        sale.alias("sale_id"), client.alias("client_id"), _used(micros(sales, "sold_at"), sale).alias("ts_us"),
        F.when(finite, F.floor(100 * total + 0.5)).cast("long").alias("total_cents"),
    )
    ids = F.when(F.crc32(F.col("sale_id").cast("string")) % 3 != 0, F.array("sale_id", -1 - F.col("sale_id"))).otherwise(F.array("sale_id"))
    orders = sold.withColumn("sale_id", F.explode(ids))
    found = as_of(asks, orders, "client_id", "ts_us", "click_id", ["total_cents", "sale_id"], tolerance_us)
    return found.select("click_id", "client_id", "ts_us", "sale_id", F.col("lag").alias("lag_us"), "total_cents", "n_tied")
