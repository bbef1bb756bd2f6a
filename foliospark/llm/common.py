"""What the operators of this subpackage share: reading tables, cutting lineage, texts as flat byte blocks.

A text block joins whole texts, each ended by one ``\\n``, in one byte array, so that words and lines of
many documents are found in a few numpy passes. Blocks are bounded by bytes; a single longer text is a
block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import Scratch, cut, shared_dir, unused  # noqa: F401

BLOCK_BYTES = 2 << 20
#: Fixed value: the word separators of the contracts, ``[\x20\x09-\x0D]``.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
WORD = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: 1 for the first byte of each UTF-8 code point.
LEADS = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of at most ``limit`` bytes of text or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


class Block:
    """Flat bytes of some texts (null: empty) with their words.

    buf: each text's bytes and one ``\\n``; offs: where each text begins (n + 1 entries);
    starts, ends: the words' byte spans; first: each text's first word's number (n + 1 entries).
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        self.n = len(texts)
        if not self.n:
            self.buf, self.offs = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        else:
            ended = pc.binary_join_element_wise(texts, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
            _, where, data = ended.buffers()
            offs = np.frombuffer(where, np.int64)[ended.offset : ended.offset + self.n + 1]
            self.buf, self.offs = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]
        if lower:
            self.buf = LOWER[self.buf]
        self.space = IS_SPACE[self.buf]
        change = np.empty(len(self.space), bool)
        change[:1] = ~self.space[:1]
        np.not_equal(self.space[1:], self.space[:-1], out=change[1:])
        edges = np.flatnonzero(change)
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.offs)
        self.n_words = np.diff(self.first)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value of each byte over each text."""
        return np.add.reduceat(flags, self.offs[:-1], dtype=np.int64) if self.n else np.zeros(0, np.int64)

    def points(self, at: np.ndarray) -> np.ndarray:
        """Code points before each of the ascending byte places, all texts counted."""
        return np.cumsum(span_sums(LEADS[self.buf], np.concatenate(([0], at[:-1])), at)) if len(at) else at

    def word_hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over ascending spans that don't overlap; empty ones have 0."""
    out = np.zeros(len(starts), np.int64)
    full = np.flatnonzero(ends > starts)
    if len(full):
        edges = np.stack((starts[full], ends[full]), axis=1).ravel()
        inside = edges[:-1] if edges[-1] == len(values) else edges
        out[full] = np.add.reduceat(values, inside, dtype=np.int64)[::2]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over 64 bits (two rounds of xor-shift and odd multiplication)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xA0761D6478BD642F)


#: Bytes that are hashed in one pass; longer spans carry their sums over.
_PASS = 1 << 17
_POWERS = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(_PASS, _BASE))))
#: Their inverses modulo 2^64, which odd numbers have.
_UNPOWERS = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(_PASS, np.uint64(pow(int(_BASE), -1, 1 << 64))))))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of ascending spans of bytes that don't overlap and aren't empty."""
    sums = np.zeros(len(starts), np.uint64)
    # The power of the base that each span's next byte has.
    carried = np.uint64(1)
    for low in range(int(starts[0]) if len(starts) else 0, int(ends[-1]) if len(ends) else 0, _PASS):
        high = min(low + _PASS, len(buf))
        i, j = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high)
        if i == j:
            continue
        a, b = np.maximum(starts[i:j], low) - low, np.minimum(ends[i:j], high) - low
        # Powers count from the pass's first byte; dividing by that of a span's first byte makes them count from there.
        terms = _BYTE.take(buf[low:high], mode="clip") * _POWERS[: high - low]
        until = np.cumsum(terms)
        parts = (until[b - 1] - until[a] + terms[a]) * _UNPOWERS[a]
        begun = starts[i] < low
        with np.errstate(over="ignore"):
            if begun:
                parts[0] *= carried
            sums[i:j] += parts
            # What the last span, if it goes on, has to be multiplied by in the next pass.
            if ends[j - 1] > high:
                carried = (carried if begun and j - i == 1 else np.uint64(1)) * _POWERS[high - max(low, int(starts[j - 1]))]
    return mixed(sums + (ends - starts).astype(np.uint64))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of the n neighbouring values from each on, unmixed, by doubling."""
    if len(hashes) < n:
        return hashes[:0]
    out, done, power, width = hashes[:0], 0, hashes, 1
    with np.errstate(over="ignore"):
        factor = _BASE
        while True:
            if n & width:
                m = len(power) - done
                out = out[:m] * factor + power[done:] if done else power
                done += width
            if 2 * width > n:
                return out
            power = power[:-width] * factor + power[width:]
            width, factor = 2 * width, factor * factor


#: Words of 64 bits in a table of hints: what is broadcast stays below about 15 MB, whatever the data.
HINT_WORDS = 1 << 18
#: The same for tables that Python workers get: 8 MB.
BIT_WORDS = 1 << 20


def hinted(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows whose column (long) may be among the values (one column, long), so that a join shuffles fewer.

    A table of bits, one for each hash of a value, is broadcast; its size is bounded. The more values, the more rows pass in vain;
    none is lost.
    """
    word, bit, bits = unused([*rows.columns, *values.columns], "word", "bit", "bits")
    k = HINT_WORDS.bit_length() - 1
    hash_ = lambda c: F.xxhash64(F.lit(k), F.col(c))
    place = lambda c: [F.shiftrightunsigned(hash_(c), 64 - k).alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), hash_(c).bitwiseAND(F.lit(63)).cast("int")).alias(bit)]
    table_ = values.select(*place(values.columns[0])).groupBy(word).agg(F.bit_or(bit).alias(bits))
    marked = rows.select("*", *place(column)).join(F.broadcast(table_), word)
    return marked.where(F.col(bits).bitwiseAND(F.col(bit)) != 0).select(*rows.columns)


def hint_bits(values: DataFrame) -> np.ndarray:
    """The same table of bits for values that are hashes (one column, long), as BIT_WORDS words for Python workers."""
    k, value = BIT_WORDS.bit_length() - 1, F.col(values.columns[0])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), value.bitwiseAND(F.lit(63)).cast("int"))
    rows = values.select(F.shiftrightunsigned(value, 64 - k).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    # At most BIT_WORDS rows of two numbers.
    found = rows.toArrow()
    bits = np.zeros(BIT_WORDS, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint64)


def may_be_among(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) may be among those that hint_bits() saw."""
    k = len(bits).bit_length() - 1
    return (bits[values >> np.uint64(64 - k)] >> (values & np.uint64(63)) & np.uint64(1)).astype(bool)


#: Pairs that a task gathers before it hands them on; text bytes for each bucket, and buckets, at most.
GATHERED, BUCKET_BYTES, MOST_BUCKETS = 1 << 20, 24 << 20, 1 << 17


def buckets_for(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BUCKETS, max(8, -(-size // BUCKET_BYTES)))


def shared_values(rows: DataFrame, pairs: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], buckets: int) -> DataFrame:
    """value (long): the hashes that several ids have, of the pairs (hashes as uint64, ids as int64) that the function makes of batches.

    Each task reduces what it gathers to the least and greatest id of each hash, so one that most rows have is shuffled a few times only,
    and hands on sorted arrays by ranges of hashes: the JVM moves buckets, not rows.
    """

    def reduced(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(value, kind="stable")
        value = value[order]
        first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
        if not len(first):
            return value, low, high
        return value[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)

    def dealt(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids = np.concatenate([i for _, i in held])
        arrays = reduced(np.concatenate([v for v, _ in held]), ids, ids)
        bucket = ((arrays[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        number, begin = np.unique(bucket, return_index=True)
        ends = np.append(begin[1:], len(bucket))
        value, low, high = arrays
        # Hashes that the task has met with one id, which are most, are told without a second one.
        twice = low < high
        blob = lambda x, chosen=None: pa.array([(x[a:b] if chosen is None else x[a:b][chosen[a:b]]).tobytes() for a, b in zip(begin, ends)], pa.binary())
        columns = [pa.array(number.astype(np.int32)), blob(value), blob(low), blob(value, twice), blob(high, twice)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "value", "low", "again", "high"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for value, id_ in pairs(batches):
            held.append((value, id_))
            n += len(value)
            if n >= GATHERED:
                yield dealt(held)
                held, n = [], 0
        if n:
            yield dealt(held)

    def merge(group: pa.Table) -> pa.Table:
        joined = lambda c, kind: np.frombuffer(b"".join(group.column(c).to_pylist()), kind)
        low, high = joined("low", np.int64), joined("high", np.int64)
        ids = np.concatenate((low, high))
        value, low, high = reduced(np.concatenate((joined("value", np.uint64), joined("again", np.uint64))), ids, ids)
        return pa.table({"value": value[low < high].view(np.int64)})

    moved = rows.mapInArrow(deal, "bucket int, value binary, low binary, again binary, high binary")
    return moved.groupBy("bucket").applyInArrow(merge, "value long")
