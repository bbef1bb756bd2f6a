"""Best-fit packing of tokenized documents into sequences under several capacities.

1. Texts are tokenized chunk by chunk: white space separates independent chunks for this tokenizer (its pre-tokenizer
   never joins across white space), so each distinct chunk is encoded once and looked up afterwards, in bulk.
2. A document's ids, followed by a separator, are cut into pieces of at most the sequence length; only longer documents
   are cut. A piece has a demand vector: tokens, one document, attention cost (squared length).
3. Full pieces are sequences by themselves. The others are dealt into groups of bounded size by a hash, and each group
   is packed in order of falling length: a piece goes to the open bin that fits in every dimension and has the best
   score, by least weighted norm of the residuals or by weighted dot product of demand and residuals; if none fits, a new bin
   opens. Bins that stay underfilled are emptied and their pieces packed again in fewer, larger groups, until one group
   holds them or nothing is gained.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import Block, cut, span_sums, text_slices, unused

SEQUENCE, SEPARATOR, TOKENIZER = 2048, 0, "word_bpe_49k.json"
#: Pieces in a group of the first pass, on average.
GROUP = 4000
#: Documents in a sequence, at most: as many as it has tokens, so that it never needs more sequences; weights of the residuals of tokens, documents and attention cost.
DOCUMENTS, WEIGHTS = SEQUENCE, (1.0, 0.3, 0.3)
#: A bin with more free tokens than this share of its capacity is packed again.
UNDERFILLED = 0.02


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds at most, and how bins are scored.

    Pieces that fill a sequence must fit, so the attention cost of a sequence (the sum of its pieces' squared lengths) can't be held
    below the square of its tokens. Every piece has a token, so by default the documents' bound can't bind either and only scores; callers can lower it.
    """

    tokens: int = SEQUENCE
    documents: int = DOCUMENTS
    attention: int = SEQUENCE * SEQUENCE
    #: Of tokens, documents and attention cost in scores.
    weights: tuple[float, float, float] = WEIGHTS
    score: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.float64)


class ChunkIds:
    """Token ids of texts, from the ids of their distinct chunks, each encoded once while the memory of them lasts.

    The tokenizer lower-cases, drops white space and splits at white space, then into runs of letters, single digits
    and runs of other characters. Chunks made of plain characters (ASCII but ``'``, ``<`` and controls; the Latin-1
    letters À to ÿ) are split so here; a chunk with any other character goes to the tokenizer as it is, white space to
    white space. Lower-cased letter runs go straight to the tokenizer's model. ``limit`` bounds the remembered chunks;
    beyond it the memory starts anew. Results don't depend on it.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        # Bytes as the characters that byte-level models use: printable ones as they are, the others from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.as_char = {b: 256 + k for k, b in enumerate(others)}
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encoded(self, chunk: str) -> list[int]:
        if chunk.isalpha() and (chunk.isascii() or max(chunk) < "\u0100") and chunk == chunk.lower():
            raw = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.as_char)
            return [t.id for t in self.model.tokenize(raw)]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def look_up(self, chunks: list[str]) -> np.ndarray:
        """A number for each of the distinct chunks, valid until the next call."""
        if len(self.at) > self.limit:
            self.forget()
        known, at, flat, lengths = len(self.at), self.at, [], []
        out = np.empty(len(chunks), np.int64)
        for i, c in enumerate(chunks):
            k = at.get(c)
            if k is None:
                k = at[c] = known
                known += 1
                ids = self.encoded(c)
                flat += ids
                lengths.append(len(ids))
            out[i] = k
        if lengths:
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(lengths)))
            self.ids = np.concatenate((self.ids, np.array(flat, np.uint32)))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array and where each text's begin (n + 1)."""
        block = Block(texts)
        if not len(block.starts):
            return np.zeros(0, np.uint32), np.zeros(block.n + 1, np.int64)
        buf, inside = block.buf, ~block.space
        after_c3 = np.concatenate(([False], buf[:-1] == 0xC3))
        latin = after_c3 & (buf != 0x97) & (buf != 0xB7)
        odd = inside & (_ODD[buf] | (buf >= 0x80) & (buf != 0xC3) & ~latin)
        plain = span_sums(odd.view(np.uint8), block.starts, block.ends) == 0
        shift = np.zeros(len(buf) + 1, np.int8)
        shift[block.starts[plain]] = 1
        shift[block.ends[plain]] -= 1
        plain_byte = np.cumsum(shift[:-1], dtype=np.int8) > 0
        kind = _KIND[buf]
        turn = plain_byte & ((kind != np.concatenate(([0], kind[:-1]))) | (kind == 2))
        turn[block.starts] = True
        starts = np.flatnonzero(turn)
        buf = np.where(plain_byte & (_UPPER[buf] | latin & (buf <= 0x9E)), buf + np.uint8(32), buf)
        edge = np.zeros(len(buf) + 1, bool)
        edge[starts] = edge[block.ends] = edge[-1] = True
        bounds = np.flatnonzero(edge)
        runs = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf)))
        words = pc.dictionary_encode(runs.take(pa.array(np.searchsorted(bounds, starts))))
        number = self.look_up(words.dictionary.to_pylist())[words.indices.to_numpy()]
        begin, size = self.ends[number], self.ends[number + 1] - self.ends[number]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]))]
        return ids, np.concatenate(([0], ends))[np.searchsorted(starts, block.offs)]


#: Of bytes: chunks that hold one go to the tokenizer whole. / 1 letters, 2 digits, 3 others. / A-Z.
_ODD = np.zeros(256, bool)
_ODD[:32], _ODD[[0x27, 0x3C, 0x7F]] = True, True
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]], _KIND[48:58] = 1, 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_KNOWN: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """The memory of chunks of this Python worker, which lasts over its tasks."""
    if path not in _KNOWN:
        _KNOWN[path] = ChunkIds(path)
    return _KNOWN[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of each piece of each row's text.

    A null or empty text has one piece, the separator; a null doc_id stays null, repeated rows each have their pieces, other columns
    are ignored, an empty table gives an empty result.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_ids(tokenizer)
        for part in text_slices(batches, "text"):
            ids, at = known.encode(part.column("text"))
            own = np.insert(ids, at[1:], np.uint32(separator)).astype("<u4")
            ends = at[1:] + np.arange(1, len(at))
            sizes = np.diff(ends, prepend=0)
            n = -(-sizes // length)
            of = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            begin = (ends - sizes)[of] + piece * length
            end = np.minimum(begin + length, ends[of])
            raw = memoryview(own).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist())]
            columns = [part.column("doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(piece * length), pa.array(end - begin), pa.array(crc, pa.int64())]
            if with_ids:
                # Pieces follow each other, so their ends cut the ids.
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.array(own.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names)

    sql = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenize, sql)


def best_fit(lengths: np.ndarray, capacity: Capacities) -> np.ndarray:
    """Each piece's bin, for lengths in falling order; a piece that alone exceeds a capacity gets a bin of its own.

    A piece goes to the open bin that holds it in every dimension and has the least weighted norm of residuals afterwards
    (score "norm") or the greatest weighted dot product of demand and residuals ("dot"), the oldest of equal ones; all
    shares are of the capacities. Bins that the shortest piece to come doesn't fit are closed.
    """
    whole = capacity.vector()
    wt, wd, wa = capacity.weights
    bins = np.empty(len(lengths), np.int64)
    # Residuals of open bins as shares, and the bins' numbers.
    room, number, open_, made = np.empty((3, 256)), np.empty(256, np.int64), 0, 0
    shares = np.stack((lengths, np.ones(len(lengths)), np.asarray(lengths, np.float64) ** 2)) / whole[:, None]
    # Shares are rounded: what fits exactly must not fail by that.
    slack = 1e-12
    shortest = shares[:, -1] if len(lengths) else None
    scratch = np.empty((3, 256))
    for i, (t, d, a) in enumerate(shares.T.tolist()):
        rt, rd, ra = room[:, :open_]
        best = -1
        if open_:
            fits = (rt >= t - slack) & (rd >= d - slack) & (ra >= a - slack)
            x, y, z = scratch[:, :open_]
            if capacity.score == "norm":
                np.subtract(rt, t, x), np.subtract(rd, d, y), np.subtract(ra, a, z)
                x *= x
                y *= y
                z *= z
                score = wt * x + wd * y + wa * z
            else:
                score = -(wt * t * rt + wd * d * rd + wa * a * ra)
            score[~fits] = np.inf
            best = int(score.argmin())
            if not fits[best]:
                best = -1
        if best < 0:
            if open_ == room.shape[1]:
                keep = (room[:, :open_] >= shortest[:, None] - slack).all(axis=0)
                if 2 * keep.sum() < open_:
                    n = int(keep.sum())
                    room[:, :n], number[:n] = room[:, :open_][:, keep], number[:open_][keep]
                    open_ = n
                else:
                    room, number = np.concatenate((room, np.empty_like(room)), axis=1), np.concatenate((number, np.empty_like(number)))
                    scratch = np.empty_like(room)
            best, open_ = open_, open_ + 1
            room[:, best], number[best] = 1.0, made
            made += 1
        room[0, best] -= t
        room[1, best] -= d
        room[2, best] -= a
        bins[i] = number[best]
    return bins


def packed(items: DataFrame, capacity: Capacities = Capacities(), group: int = GROUP) -> DataFrame:
    """items (any columns, with ``length`` long, never null) with sequence_id and offset added: gapless places in sequences.

    Columns of items that have these names are an error. Rows are numbered, and dealt to groups by a hash of their numbers, so
    equal rows are spread and no group holds more than a few times ``group`` rows; ties are broken by the numbers.
    """
    if {"sequence_id", "offset"} & {c.lower() for c in items.columns}:
        raise ValueError("items have a column sequence_id or offset")
    keep = items.columns
    row, dealt, free = unused([*keep, "sequence_id", "offset"], "row", "dealt", "free")
    schema = StructType([*items.schema.fields, StructField(row, LongType()), *(StructField(c, LongType()) for c in ("sequence_id", "offset")), StructField(free, DoubleType())])

    def pack(pieces_: pa.Table) -> pa.Table:
        level = pieces_.column(dealt)[0].as_py()
        length, rows = (pieces_.column(c).to_numpy() for c in ("length", row))
        falling = np.lexsort((rows, -length))
        bins = best_fit(length[falling], capacity)
        order = np.argsort(bins, kind="stable")
        falling, bins = falling[order], bins[order]
        size = length[falling]
        before = np.cumsum(size) - size
        first = np.searchsorted(bins, bins)
        total = np.bincount(bins, weights=size)
        out = pieces_.drop_columns([dealt]).take(pa.array(falling))
        more = {"sequence_id": level * (1 << 32) + bins, "offset": before - before[first], free: (1 - total / capacity.tokens)[bins]}
        for name, values in more.items():
            out = out.append_column(name, pa.array(values))
        return out

    small = items.where(F.col("length") < capacity.tokens).withColumn(row, F.monotonically_increasing_id())
    full = items.where(F.col("length") >= capacity.tokens)
    done = [full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))]
    count, base = small.count(), 0
    while count:
        n = -(-count // group)
        deal = F.pmod(F.xxhash64(F.lit(base), F.col(row)), F.lit(n)).cast("long") + base
        out = cut(small.withColumn(dealt, deal).groupBy(dealt).applyInArrow(pack, schema))
        base += n
        again = out.where(F.col(free) > UNDERFILLED).select(*keep, row)
        left = again.count()
        if n == 1 or left * 10 > count * 9:
            done.append(out.drop(free, row))
            break
        done.append(out.where(F.col(free) <= UNDERFILLED).drop(free, row))
        small, count = again, left
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole


def packed_documents(docs: DataFrame, tokenizer: str, capacity: Capacities = Capacities(), with_ids: bool = False) -> DataFrame:
    """The pieces of each row of docs (doc_id, text) with their sequences.

    A null or empty text is the separator alone. Null or repeated doc_ids, equal rows and other columns make no
    difference to what is packed: each row's pieces appear once. An empty table gives an empty result.
    """
    return packed(cut(pieces(docs, tokenizer, capacity.tokens, with_ids=with_ids)), capacity)
